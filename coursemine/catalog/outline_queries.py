"""Registered outline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemine.catalog import duck as d
from coursemine.catalog.text_queries import SEP, joined
from coursemine.fixtures import view
from coursemine.functions import fixed_values as fv
from coursemine.operators import outline as ol
from coursemine.sources import corpus as co


def toc(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "toc")


def native(spark: SparkSession, sf: str) -> DataFrame:
    """Native contents rows: the part names, levels and pages partly unusable."""
    return toc(spark, sf).select(
        "material_id", F.col("line_no").alias("toc_no"), (F.col("line_no") % 7).cast("string").alias("level"),
        F.col("line").alias("title"), F.when(F.col("line_no") % 5 != 0, (F.col("line_no") % 300).cast("string")).otherwise(F.lit("x")).alias("page"),
    )


def titled(df: DataFrame, where: str, column: str) -> DataFrame:
    """The same rows, whose other materials have blank lines or titles."""
    return df.withColumn(column, F.when(F.expr(where), F.col(column)).otherwise(""))


def some_native(spark: SparkSession, sf: str) -> DataFrame:
    """Native contents rows that say something for every third material only."""
    return titled(native(spark, sf), "material_id % 3 = 0", "title")


def materials(spark: SparkSession, sf: str) -> DataFrame:
    m = toc(spark, sf).groupBy("material_id").agg(F.max("line_no").alias("created_at"))
    return m.withColumn("goal_id", F.col("material_id") % 5)


def _items(df: DataFrame) -> DataFrame:
    return df.select("material_id", *ol.ITEM_COLUMNS)


def _two_texts(spark, sf):
    p = co.page_texts(view(spark, sf, "pages")).select("material_id", "page_index", F.col("text").alias("page_text"))
    return co.assemble_marked_pages(p)


def q_front_lines(spark, sf):
    marked = ol.front_lines(_two_texts(spark, sf), max_pages=3).withColumn("origin", F.lit("marked"))
    plain = ol.front_lines(view(spark, sf, "material")).withColumn("origin", F.lit("plain"))
    return marked.unionByName(plain)


def q_match_toc_lines(spark, sf):
    return ol.match_toc_lines(toc(spark, sf))


def q_clean_titles(spark, sf):
    t = toc(spark, sf).withColumn("title", ol.clean_title(F.col("line")))
    return t.select("material_id", "line_no", "title", ol.valid_title(F.col("title")).alias("valid"))


def q_extract_outline(spark, sf):
    return _items(ol.extract_outline(toc(spark, sf)))


def q_page_ranges(spark, sf):
    """Every contents line is an item here, in line order."""
    t = ol.match_toc_lines(toc(spark, sf)).select(
        "material_id", F.col("line_no").alias("order"), "title", F.col("page").alias("page_start"),
        F.when(F.col("line_no") % 16 == 0, F.lit(999)).alias("page_end"),
    )
    return ol.page_ranges(t)


def q_outline_from_toc_rows(spark, sf):
    return _items(ol.outline_from_toc_rows(native(spark, sf)))


def _chosen(spark, sf):
    t = toc(spark, sf)
    text = ol.extract_outline(titled(t, "material_id % 4 <> 1", "line"))
    ocr = ol.extract_outline(titled(t, "material_id % 5 <> 2", "line"))
    return ol.choose_outline(materials(spark, sf), ol.outline_from_toc_rows(some_native(spark, sf)), text, ocr)


def q_choose_outline(spark, sf):
    items, status = _chosen(spark, sf)
    n = items.groupBy("material_id").agg(F.count(F.lit(1)).alias("items"), F.max("title").alias("last_title"))
    return status.join(n, "material_id", "left").select("material_id", "outline_status", "outline_source", F.coalesce("items", F.lit(0)).alias("items"), "last_title")


def q_infer_headings(spark, sf):
    t = toc(spark, sf).withColumn("line", F.when(F.col("line_no") % 8 == 3, F.concat(F.lit("[PDF page "), (F.col("line_no") % 50).cast("string"), F.lit("]"))).otherwise(F.col("line")))
    return _items(ol.infer_headings(t))


def q_repair_outline(spark, sf):
    """Items as a model would send them back: levels out of range, pages as text, odd confidences."""
    t = toc(spark, sf).withColumn(
        "item",
        F.struct(
            F.col("line").alias("title"), (F.col("line_no") % 9).cast("string").alias("level"),
            F.when(F.col("line_no") % 3 == 0, "none").otherwise((F.col("line_no") % 200).cast("string")).alias("page_start"),
            F.when(F.col("line_no") % 6 == 1, (F.col("line_no") % 200 + 5).cast("string")).alias("page_end"),
            F.when(F.col("line_no") % 4 == 0, "1.5").when(F.col("line_no") % 4 == 1, "0.25").when(F.col("line_no") % 4 == 2, "high").alias("confidence"),
        ),
    )
    raw = t.select("material_id", F.col("line_no").alias("pos"), F.to_json("item").alias("raw"))
    return _items(ol.repair_outline_items(raw))


def q_outline_topics(spark, sf):
    t = ol.outline_topics(materials(spark, sf), ol.extract_outline(toc(spark, sf)))
    return t.select("goal_id", joined(F.col("topics")).alias("topics"))


def q_rebuild_outlines(spark, sf):
    m = materials(spark, sf).withColumn("outline", F.lit(None).cast("array<struct<title:string,level:int,page_start:int,page_end:int,order:int,confidence:double,source:string>>"))
    m = m.withColumn("outline_status", F.lit("unavailable")).withColumn("outline_source", F.lit("unknown"))
    wanted = m.filter("goal_id IN (0, 2, 3)")
    t = toc(spark, sf)
    out = ol.rebuild_outlines(m, t, wanted, some_native(spark, sf), t)
    item = lambda x: F.concat_ws("/", x["order"], x["level"], x["page_start"], x["page_end"], x["source"], x["title"])
    return out.select(
        "material_id", "goal_id", "outline_status", "outline_source", F.coalesce(F.when(F.col("outline").isNotNull(), F.size("outline")), F.lit(0)).alias("items"),
        F.coalesce(F.array_join(F.transform("outline", item), "; "), F.lit("")).alias("listed"),
    )


QUERIES = {
    "front_lines": q_front_lines,
    "match_toc_lines": q_match_toc_lines,
    "clean_titles": q_clean_titles,
    "extract_outline": q_extract_outline,
    "page_ranges": q_page_ranges,
    "outline_from_toc_rows": q_outline_from_toc_rows,
    "choose_outline": q_choose_outline,
    "infer_headings": q_infer_headings,
    "repair_outline": q_repair_outline,
    "outline_topics": q_outline_topics,
    "rebuild_outlines": q_rebuild_outlines,
}

# --- oracle -------------------------------------------------------------------
_T = d.view("toc")


def _spaces(x: str) -> str:
    return d.strip(d.sub(x, r"\s+", " "))


def _unmark(x: str) -> str:
    return d.strip(d.sub(x, r"^(#{1,6}\s+|[-*+]\s+|\d+[.)、]\s+)", "", ""))


def _title(x: str) -> str:
    x = d.sub(_unmark(x), r"\s*\.{2,}\s*\d{1,4}$")
    x = d.sub(d.sub(x, r"\s+第?\s*\d{1,4}\s*页$"), r"\s+", " ")
    return f"substr({d.sub(x, r'^[ –—:：、.\t-]+|[ –—:：、.\t-]+$')}, 1, 120)"


def _valid(x: str) -> str:
    noise = " OR ".join(f"contains(lower({x}), {d.q(t)})" for t in fv.OUTLINE_NOISE)
    bad = " OR ".join(f"contains({x}, {d.q(t)})" for t in fv.OUTLINE_BAD_LATEX)
    return f"(length({x}) BETWEEN 2 AND 120 AND lower({x}) NOT IN {d.inlist(fv.OUTLINE_NOISE_EXACT)} AND NOT ({noise}) AND NOT ({bad}) AND {d.count(x, '[0-9]')} <= greatest(6, length({x}) * 0.55))"


def _matched(src: str, name: str = "hit") -> str:
    """CTE (material_id, line_no, line, title, level, page) of contents lines; no CJK forms in these tables."""
    lead = r"(?:\.{2,}|…+|\s{2,})\s*(\d{1,4})$"
    pats = [(r"(?i)^((?:\d+\.){1,3}\d*)\s+(.+)$", None), (r"(?i)^(Chapter\s+\d+)\s*[:：.-]?\s*(.+)$", 1), (r"(?i)^(Section\s+\d+(?:\.\d+)*)\s*[:：.-]?\s*(.+)$", 2)]
    title, level = "CASE", "CASE"
    for p, lv in pats:
        pre = _spaces(f"regexp_extract(b, {d.q(p)}, 1)")
        title += f" WHEN regexp_matches(b, {d.q(p)}) THEN {d.strip('concat(' + pre + ', chr(32), ' + _spaces(f'regexp_extract(b, {d.q(p)}, 2)') + ')')}"
        level += f" WHEN regexp_matches(b, {d.q(p)}) THEN " + (str(lv) if lv else f"least(length({pre}) - length(replace({pre}, '.', '')) + 1, 4)")
    return f"""{name}0 AS (SELECT *, {_unmark(_spaces('line'))} AS s FROM {src}),
{name}1 AS (SELECT *, {d.strip(d.sub('s', lead))} AS b, nullif(TRY_CAST(regexp_extract(s, {d.q(lead)}, 1) AS INT), 0) AS page FROM {name}0),
{name} AS (SELECT material_id, line_no, line, page, {title} END AS title, CAST({level} END AS INT) AS level FROM {name}1)"""


def _ends(src: str) -> str:
    """page_end and order over relation src (…, page_start, page_end, ord)."""
    nxt = "first_value(CASE WHEN page_start > 0 THEN page_start END IGNORE NULLS) OVER (PARTITION BY material_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""(SELECT * REPLACE (CAST(coalesce(page_end, CASE WHEN nx > page_start THEN nx - 1 END) AS INT) AS page_end), CAST(row_number() OVER (PARTITION BY material_id ORDER BY ord) AS INT) AS "order"
FROM (SELECT *, {nxt} AS nx FROM {src}))"""


def _outline(src: str, name: str, source: str = "text_toc") -> str:
    """CTE ``name`` with the outline items of lines src."""
    n = name
    return f"""{n}f AS (SELECT * FROM {src} WHERE {d.strip('line')} <> '' QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY line_no) <= 900),
{n}h AS (SELECT material_id, min(line_no) AS hl FROM {n}f WHERE lower({_spaces('line')}) IN {d.inlist(fv.OUTLINE_HEADERS)} GROUP BY material_id),
{_matched(n + 'f', n + 'm')},
{n}c AS (SELECT m.material_id, line_no, {_title('title')} AS title, level, page, CASE WHEN line_no > coalesce(hl, 9e18) OR page IS NOT NULL THEN 0.86::DOUBLE ELSE 0.72::DOUBLE END AS confidence
  FROM {n}m m LEFT JOIN {n}h USING (material_id) WHERE title IS NOT NULL AND lower({_spaces('line')}) NOT IN {d.inlist(fv.OUTLINE_HEADERS)}),
{n}v AS (SELECT * FROM {n}c WHERE {_valid('title')} QUALIFY row_number() OVER (PARTITION BY material_id, title ORDER BY line_no) = 1),
{n}k AS (SELECT * FROM {n}v QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY line_no) <= 80),
{n}r AS (SELECT *, line_no AS ord, page AS page_start, NULL::INT AS page_end, {d.q(source)} AS source FROM {n}k QUALIFY count(*) OVER (PARTITION BY material_id) >= 3),
{n} AS (SELECT material_id, title, level, page_start, page_end, "order", confidence, source FROM {_ends(n + 'r')})"""


_NATIVE = f"(SELECT material_id, line_no AS toc_no, line_no % 7 AS lv, line AS title, CASE WHEN line_no % 5 <> 0 THEN line_no % 300 END AS pg FROM {_T})"
_NAT = f"""natc AS (SELECT material_id, toc_no, greatest(1, least(lv, 4))::INT AS level, {_title('title')} AS title, CAST(nullif(pg, 0) AS INT) AS page_start FROM {_NATIVE}),
natv AS (SELECT *, toc_no AS ord, NULL::INT AS page_end, 0.95::DOUBLE AS confidence, 'pdf_toc' AS source FROM natc WHERE {_valid('title')} QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY toc_no) <= 80),
nat AS (SELECT material_id, title, level, page_start, page_end, "order", confidence, source FROM {_ends('natv')})"""
_SOME_NAT = _NAT.replace(_NATIVE, f"(SELECT * FROM {_NATIVE} WHERE material_id % 3 = 0)")
_ALL = 'SELECT material_id, title, level, page_start, page_end, "order", confidence, source FROM '
_MARKED = f"""pg AS (SELECT material_id, page_index, coalesce(nullif({d.strip('ocr_text')}, ''), nullif({d.strip('built_in_text')}, ''), '') AS t FROM {d.view('pages')}),
doc AS (SELECT material_id, string_agg(concat('[PDF page ', page_index, ']', chr(10), t), concat(chr(10), chr(10)) ORDER BY page_index) AS text FROM pg WHERE t <> '' GROUP BY material_id)"""
_LISTED = """string_agg(concat_ws('/', "order", level, page_start, page_end, source, title), '; ' ORDER BY "order")"""
_MD = r"^(#{1,4})\s+(.+)$"

ORACLE = {
    "front_lines": f"""WITH {_MARKED}, a AS (SELECT material_id, string_split_regex(text, {d.q(d.LINE_BREAK)}) AS ls FROM doc),
u AS (SELECT material_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM a),
p AS (SELECT *, sum(CASE WHEN regexp_matches({d.strip('line')}, '(?i)^\\[(?:PDF|PDF OCR)\\s+page\\s+\\d+\\]') THEN 1 ELSE 0 END) OVER (PARTITION BY material_id ORDER BY i) AS page FROM u),
m AS (SELECT 'marked' AS origin, material_id, i, {d.strip('line')} AS line FROM p WHERE page <= 3),
b AS (SELECT material_id, string_split_regex(text, {d.q(d.LINE_BREAK)})[1:900] AS ls FROM {d.view('material')}),
ub AS (SELECT 'plain' AS origin, material_id, unnest(range(len(ls))) AS i, {d.strip('unnest(ls)')} AS line FROM b)
SELECT origin, material_id, CAST(row_number() OVER (PARTITION BY origin, material_id ORDER BY i) - 1 AS INT) AS line_no, line
FROM (SELECT * FROM m UNION ALL SELECT * FROM ub) WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY origin, material_id ORDER BY i) <= 900""",
    "match_toc_lines": f"WITH {_matched(_T)} SELECT material_id, line_no, title, level, page FROM hit WHERE title IS NOT NULL",
    "clean_titles": f"SELECT material_id, line_no, {_title('line')} AS title, {_valid('(' + _title('line') + ')')} AS valid FROM {_T}",
    "extract_outline": f"WITH {_outline(_T, 'ot')} {_ALL} ot",
    "page_ranges": f"""WITH {_matched(_T)}, i AS (SELECT material_id, line_no AS ord, title, page AS page_start, CASE WHEN line_no % 16 = 0 THEN 999 END AS page_end FROM hit WHERE title IS NOT NULL)
SELECT material_id, title, page_start, page_end, "order" FROM {_ends('i')}""",
    "outline_from_toc_rows": f"WITH {_NAT} {_ALL} nat",
    "choose_outline": f"""WITH {_SOME_NAT}, {_outline(f'(SELECT * FROM {_T} WHERE material_id % 4 <> 1)', 'ot')}, {_outline(f'(SELECT * FROM {_T} WHERE material_id % 5 <> 2)', 'x')},
a AS (SELECT 0 AS turn, 'pdf_toc' AS src, * FROM nat UNION ALL SELECT 1, 'text_toc', * FROM ot UNION ALL SELECT 2, 'ocr_markdown', * FROM x),
b AS (SELECT * FROM a QUALIFY rank() OVER (PARTITION BY material_id ORDER BY turn) = 1),
n AS (SELECT material_id, src, count(*) AS items, max(title) AS last_title FROM b GROUP BY ALL)
SELECT m.material_id, CASE WHEN src IS NULL THEN 'unavailable' ELSE 'ready' END AS outline_status, coalesce(src, 'heading_infer') AS outline_source, coalesce(items, 0) AS items, last_title
FROM (SELECT DISTINCT material_id FROM {_T}) m LEFT JOIN n USING (material_id)""",
    "infer_headings": f"""WITH t AS (SELECT material_id, line_no, CASE WHEN line_no % 8 = 3 THEN concat('[PDF page ', line_no % 50, ']') ELSE line END AS line FROM {_T}),
f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY line_no) <= 3000),
pm AS (SELECT *, TRY_CAST(regexp_extract(line, '(?i)\\[(?:PDF|PDF OCR|PPT slide)\\s+(?:page|slide)?\\s*(\\d+)\\]', 1) AS INT) AS mk FROM f),
pp AS (SELECT *, nullif(last_value(mk IGNORE NULLS) OVER (PARTITION BY material_id ORDER BY line_no), 0) AS page_start FROM pm),
bd AS (SELECT material_id, line_no, {_spaces('line')} AS line, page_start FROM pp WHERE mk IS NULL),
{_matched(f'(SELECT material_id, line_no, {_unmark("line")} AS line FROM bd)', 'hm')},
j AS (SELECT bd.*, hm.title AS tt, hm.level AS tl, {_unmark('bd.line')} AS s FROM bd JOIN hm ON bd.material_id = hm.material_id AND bd.line_no = hm.line_no),
h AS (SELECT material_id, line_no, page_start, CASE WHEN regexp_matches(line, {d.q(_MD)}) THEN regexp_extract(line, {d.q(_MD)}, 2) WHEN tt IS NOT NULL THEN tt
   WHEN length(s) BETWEEN 4 AND 36 AND NOT regexp_matches(s, '[。，,;；]$') AND len(string_split(s, ' ')) <= 8 AND regexp_matches(s, '(?i)({fv.HEADING_WORDS})') THEN s END AS raw,
   CAST(CASE WHEN regexp_matches(line, {d.q(_MD)}) THEN length(regexp_extract(line, {d.q(_MD)}, 1)) WHEN tt IS NOT NULL THEN tl ELSE 2 END AS INT) AS level FROM j),
c AS (SELECT material_id, line_no, page_start, level, {_title('raw')} AS title FROM h WHERE raw IS NOT NULL),
v AS (SELECT * FROM c WHERE {_valid('title')} QUALIFY row_number() OVER (PARTITION BY material_id, title ORDER BY line_no) = 1),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY line_no) <= 80),
r AS (SELECT *, line_no AS ord, NULL::INT AS page_end, 0.68::DOUBLE AS confidence, 'heading_infer' AS source FROM k QUALIFY count(*) OVER (PARTITION BY material_id) >= 3)
{_ALL} {_ends('r')}""",
    "repair_outline": f"""WITH c AS (SELECT material_id, line_no, {_title('line')} AS title, greatest(1, least(line_no % 9, 4))::INT AS level,
  CASE WHEN line_no % 3 <> 0 THEN nullif(line_no % 200, 0) END::INT AS page_start, CASE WHEN line_no % 6 = 1 THEN line_no % 200 + 5 END::INT AS page_end,
  CASE line_no % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM {_T}),
v AS (SELECT * FROM c WHERE {_valid('title')} QUALIFY row_number() OVER (PARTITION BY material_id, title ORDER BY line_no) = 1),
r AS (SELECT *, line_no AS ord, 'llm_refined' AS source FROM v QUALIFY row_number() OVER (PARTITION BY material_id ORDER BY line_no) <= 80)
{_ALL} {_ends('r')}""",
    "outline_topics": f"""WITH {_outline(_T, 'ot')}, m AS (SELECT material_id, max(line_no) AS created_at FROM {_T} GROUP BY material_id),
p AS (SELECT material_id % 5 AS goal_id, trim(title) AS title, created_at, material_id, "order" FROM ot JOIN m USING (material_id)),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY goal_id, title ORDER BY created_at, material_id, "order") = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY goal_id ORDER BY created_at, material_id, "order") AS turn FROM f QUALIFY turn <= 12)
SELECT goal_id, string_agg(title, {d.q(SEP)} ORDER BY turn) AS topics FROM k GROUP BY goal_id""",
    "rebuild_outlines": f"""WITH {_SOME_NAT}, {_outline(_T, 'ot')}, m AS (SELECT DISTINCT material_id, material_id % 5 AS goal_id FROM {_T}),
nn AS (SELECT material_id, count(*) AS n, {_LISTED} AS listed FROM nat GROUP BY material_id), n2 AS (SELECT material_id, count(*) AS n, {_LISTED} AS listed FROM ot GROUP BY material_id)
SELECT m.material_id, goal_id, CASE WHEN goal_id IN (0, 2, 3) AND coalesce(nn.n, n2.n) IS NOT NULL THEN 'ready' ELSE 'unavailable' END AS outline_status,
  CASE WHEN goal_id NOT IN (0, 2, 3) THEN 'unknown' WHEN nn.n IS NOT NULL THEN 'pdf_toc' WHEN n2.n IS NOT NULL THEN 'text_toc' ELSE 'heading_infer' END AS outline_source,
  CASE WHEN goal_id IN (0, 2, 3) THEN CAST(coalesce(nn.n, n2.n, 0) AS INT) ELSE 0 END AS items,
  CASE WHEN goal_id IN (0, 2, 3) THEN coalesce(nn.listed, n2.listed, '') ELSE '' END AS listed
FROM m LEFT JOIN nn USING (material_id) LEFT JOIN n2 USING (material_id)""",
}
