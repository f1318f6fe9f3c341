"""Registered text queries: normalization, chunking, enrichment, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemine.catalog import duck as d
from coursemine.fixtures import table, view
from coursemine.functions import fixed_values as fv, terms, text as tx, tokens as tk
from coursemine.operators import chunking, enrichment as en, packing

SEP = " ¦ "


def joined(c) -> F.Column:
    return F.array_join(c, SEP)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(view(spark, sf, "material"))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return en.enrich_chunks(chunks(spark, sf))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    v = view(spark, sf, "pages")
    text = F.coalesce(F.when(tx.strip(F.col("ocr_text")) != "", F.col("ocr_text")), F.col("built_in_text"))
    return v.select("material_id", "page_index", text.alias("text"))


def term_text(c) -> F.Column:
    """Terms as 'source/kind/confidence' joined, for comparison."""
    return joined(F.transform(c, lambda t: F.concat_ws("/", t["source"], t["kind"], F.format_number(t["confidence"], 3))))


def q_normalize_text(spark, sf):
    return view(spark, sf, "material").select("material_id", F.md5(tx.normalize_text(F.col("text"))).alias("text_md5"))


def q_chunk_documents(spark, sf):
    return chunks(spark, sf).select("material_id", "chunk_index", "content")


def q_chunk_multi_paragraph(spark, sf):
    return chunking.chunk_documents(view(spark, sf, "multi")).select("material_id", "chunk_index", "content")


def q_chunk_turns(spark, sf):
    """The same chunks from turns as rows; no conversation is put together."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("material_id"), "turn", "text")
    return packing.pack_paragraphs(packing.paragraph_rows(turns, ["material_id"], "turn"), ["material_id"])


def q_chunk_pages(spark, sf):
    named = pages(spark, sf).withColumn("filename", F.concat(F.lit("conv/"), F.col("material_id").cast("string"), F.lit(".pdf")))
    out = chunking.chunk_pages(named)
    return out.select(
        "material_id", "page_index", "chunk_index", "content",
        chunking.source_label(F.col("filename"), F.col("chunk_index"), F.col("page_index")).alias("source"),
    )


def q_clean_for_retrieval(spark, sf):
    a = view(spark, sf, "material").select(F.lit("material").alias("origin"), F.col("material_id").alias("id"), "text")
    b = view(spark, sf, "math").select(F.lit("math").alias("origin"), F.col("chunk_id").alias("id"), "text")
    return a.unionByName(b).select("origin", "id", F.md5(tx.clean_for_retrieval(F.col("text"))).alias("cleaned_md5"))


def q_extract_formulas(spark, sf):
    a = view(spark, sf, "material").select(F.lit("material").alias("origin"), F.col("material_id").alias("id"), "text")
    b = view(spark, sf, "math").select(F.lit("math").alias("origin"), F.col("chunk_id").alias("id"), "text")
    return a.unionByName(b).select("origin", "id", joined(tx.extract_formulas(F.col("text"))).alias("formulas"))


def q_is_formula_line(spark, sf):
    lines = view(spark, sf, "math").select("chunk_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line"))
    return lines.select("chunk_id", "line_no", tx.is_formula_line(tx.strip(F.col("line"))).alias("is_formula"))


def q_detect_language(spark, sf):
    return view(spark, sf, "material").select("material_id", tx.detect_language(F.col("text")).alias("source_lang"))


def q_extract_key_terms(spark, sf):
    c = chunks(spark, sf).withColumn("retrieval_text", tx.clean_for_retrieval(F.col("content")))
    return c.select("material_id", "chunk_index", term_text(terms.extract_key_terms(F.col("retrieval_text"))).alias("terms"))


def q_clean_key_term(spark, sf):
    """Whole part names and lines of the math view as candidate terms."""
    c = view(spark, sf, "math").select("chunk_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line"))
    return c.select(
        "chunk_id", "line_no", terms.clean_key_term(F.col("line")).alias("term"), terms.valid_key_term(F.col("line")).alias("valid")
    )


def _first_words(c: F.Column, n: int) -> F.Column:
    """The first pieces between spaces of what is left of a text without all but A-Z, a-z and spaces; the first may be empty.

    They end before the word n + 1 that has a letter, so no more of a long text is cleaned and split.
    """
    start = F.regexp_extract(c, r"\A(?:[^A-Za-z]*+[A-Za-z][^ ]*+){%d}" % (n + 1), 0)
    bare = F.regexp_replace(F.when(start != "", start).otherwise(c), "[^A-Za-z ]+", "")
    return F.slice(F.split(bare, " +", n + 1), 1, n)


def _outside_terms(c: DataFrame) -> DataFrame:
    """Terms as a model would supply them: the first words of the chunk, confidence partly missing."""
    words = _first_words(F.col("content"), 6)
    item = lambda w, i: F.struct(
        w.alias("source"), F.lit("").alias("zh"), F.lit("").alias("kind"),
        F.when(i % 2 == 0, F.lit(0.9) - i * F.lit(0.1)).alias("confidence"), F.lit("").alias("term_source"),
    )
    return c.withColumn("outside", F.transform(words, item))


def q_rank_terms(spark, sf):
    c = _outside_terms(chunks(spark, sf))
    return c.select("material_id", "chunk_index", term_text(terms.rank_terms(terms.normalize_terms(F.col("outside"), "llm"))).alias("terms"))


def q_enrich_chunks(spark, sf):
    e = enriched(spark, sf)
    return e.select(
        "material_id", "chunk_index", "source_lang", "summary_zh", term_text(F.col("key_terms")).alias("terms"),
        joined(F.col("formulas")).alias("formulas"), F.md5("embedding_text").alias("embedding_md5"),
    )


def q_rebuild_chunk_terms(spark, sf):
    c = chunks(spark, sf).select("material_id", "chunk_index", F.col("content").alias("content_raw"), F.substring("content", 1, 500).alias("content_preview"))
    ids = view(spark, sf, "material").filter(F.col("goal_id") < 10).select("material_id")
    out = en.rebuild_chunk_terms(c, ids)
    return out.groupBy("material_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.size("key_terms")).alias("terms"), F.sum(F.size("formulas")).alias("formulas"),
        F.sum(F.length("retrieval_text")).alias("retrieval_chars"),
    )


def q_usable_terms(spark, sf):
    c = _outside_terms(chunks(spark, sf))
    return c.select("material_id", "chunk_index", joined(terms.usable_terms(F.col("outside"))).alias("terms"))


def q_term_labels(spark, sf):
    c = _outside_terms(chunks(spark, sf)).withColumn(
        "outside", F.transform("outside", lambda t, i: t.withField("zh", F.when(i % 3 == 0, F.upper(t["source"])).otherwise(F.lit(""))))
    )
    return c.select("material_id", "chunk_index", joined(terms.term_labels(F.col("outside"))).alias("labels"))


def q_metadata_round_trip(spark, sf):
    c = _outside_terms(chunks(spark, sf)).withColumn("key_terms", F.col("outside").cast(f"array<{terms.TERM_TYPE}>"))
    c = c.withColumn("formulas", tx.extract_formulas(F.col("content"))).withColumn("plan_id", F.lit(None).cast("int"))
    packed = en.pack_metadata(c.select("material_id", "chunk_index", "goal_id", "plan_id", "key_terms", "formulas"), ["material_id", "chunk_index", "goal_id", "plan_id"])
    # every seventh chunk gets a broken term list, which must come back empty
    broken = packed.withColumn(
        "metadata", F.when(F.col("chunk_index") % 7 == 3, F.replace("metadata", F.lit('"key_terms_json":"['), F.lit('"key_terms_json":"[['))).otherwise(F.col("metadata"))
    )
    back = en.unpack_metadata(broken.select("material_id", "chunk_index", "metadata"))
    return back.select(
        "material_id", "chunk_index", F.get_json_object("metadata", "$.goal_id").cast("int").alias("goal_id"),
        F.get_json_object("metadata", "$.plan_id").isNull().alias("plan_dropped"),
        F.size("key_terms").alias("n_terms"), joined(F.transform("key_terms", lambda t: t["source"])).alias("sources"), joined(F.col("formulas")).alias("formulas"),
    )


def q_fingerprint(spark, sf):
    v = view(spark, sf, "material")
    key = tx.payload_key("page", {"goal_id": F.col("goal_id"), "filename": F.col("filename")})
    return v.select("material_id", tx.fingerprint(F.col("text")).alias("text_hash"), key.alias("cache_key"))


def q_fallback_parse_json(spark, sf):
    from coursemine.fixtures import table

    e = table(spark, sf, "events")
    raw = (
        F.when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done")))
        .when(F.col("event_id") % 4 == 2, F.substring("props", 1, 5))
        .when(F.col("event_id") % 4 == 3, F.lit("no object"))
        .otherwise(F.col("props"))
    )
    fallback = F.struct(F.lit(-1).cast("bigint").alias("k"))
    return e.select("event_id", tx.fallback_parse_json(raw, "k bigint", fallback)["k"].alias("k"))


def q_tokenize_lexical(spark, sf):
    return view(spark, sf, "material").select("material_id", F.md5(F.array_join(tk.tokenize_lexical(F.col("text")), " ")).alias("tokens_md5"),
                                               F.size(tk.tokenize_lexical(F.col("text"))).alias("n"))


def q_formula_tokens(spark, sf):
    v = view(spark, sf, "math")
    return v.select("chunk_id", F.array_join(F.array_sort(tk.formula_tokens(F.col("text"), tx.extract_formulas(F.col("text")))), " ").alias("tokens"))


def q_rewrite_queries(spark, sf):
    from coursemine.operators.retrieval import rewrite_queries

    r = rewrite_queries(view(spark, sf, "query"))
    return r.select("query_id", "semantic_query", F.array_join("lexical_terms", " ").alias("lexical_terms"), F.array_join("formula_terms", " ").alias("formula_terms"))


def q_hash_tokens(spark, sf):
    t = tk.hash_tokens(F.col("text"))
    return view(spark, sf, "material").select("material_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


QUERIES = {
    "normalize_text": q_normalize_text,
    "chunk_documents": q_chunk_documents,
    "chunk_multi_paragraph": q_chunk_multi_paragraph,
    "chunk_turns": q_chunk_turns,
    "chunk_pages": q_chunk_pages,
    "clean_for_retrieval": q_clean_for_retrieval,
    "extract_formulas": q_extract_formulas,
    "is_formula_line": q_is_formula_line,
    "detect_language": q_detect_language,
    "extract_key_terms": q_extract_key_terms,
    "clean_key_term": q_clean_key_term,
    "rank_terms": q_rank_terms,
    "enrich_chunks": q_enrich_chunks,
    "rebuild_chunk_terms": q_rebuild_chunk_terms,
    "usable_terms": q_usable_terms,
    "term_labels": q_term_labels,
    "metadata_round_trip": q_metadata_round_trip,
    "fingerprint": q_fingerprint,
    "fallback_parse_json": q_fallback_parse_json,
    "tokenize_lexical": q_tokenize_lexical,
    "formula_tokens": q_formula_tokens,
    "rewrite_queries": q_rewrite_queries,
    "hash_tokens": q_hash_tokens,
}

# --- oracle -------------------------------------------------------------------
M = d.view("material")
_both = f"(SELECT 'material' AS origin, material_id AS id, text FROM {M} UNION ALL SELECT 'math', chunk_id, text FROM {d.view('math')})"
_STOP = "|".join(fv.TERM_STOPWORDS)
_NOISE = sorted({w.lower() for w in fv.LATEX_DROPPED} | {w.lower() for w in fv.LATEX_SPOKEN} | set(fv.EXTRA_NOISE_WORDS) | set(fv.TERM_STOPWORDS))


def clean_latin(x: str) -> str:
    x = d.sub(d.sub(x, r"\s+", " "), r" [A-Za-z]$")
    x = d.sub(x, rf"^(?:(?:{_STOP})(?: |$))+", "", "gi")
    return f"trim({d.sub(x, rf'(?:(?: |^)(?:{_STOP}))+$', '', 'gi')})"


def clean_any(x: str) -> str:
    """Key-term cleaning without the ideograph step."""
    x = d.sub(d.strip(x), r"^\$+|\$+$")
    x = d.strip(d.sub(x, r"^\\\(|\\\)$|^\\\[|\\\]$"))
    x = d.sub(x, r"^formulae?\s*:\s*", "", "gi")
    x = d.strip(d.sub(d.sub(x, r"\s+[A-Za-z]$"), r"\s+", " "))
    x = d.sub(x, rf"^(?:(?:{_STOP})(?: |$))+", "", "gi")
    return f"trim({d.sub(x, rf'(?:(?: |^)(?:{_STOP}))+$', '', 'gi')})"


def valid(x: str) -> str:
    """Validity of a cleaned term without ideographs."""
    words = f"list_transform(regexp_extract_all({x}, '[A-Za-z]+'), lambda w: lower(w))"
    return f"""(length({x}) >= 2 AND lower({x}) NOT IN {d.inlist(_NOISE)}
  AND NOT list_has_any({words}, {d.lst(fv.FORMULA_WORDS)})
  AND NOT (len({words}) = 1 AND {words}[1] IN {d.inlist(fv.FORMULA_WORDS + fv.FORMULA_LONE_WORDS)})
  AND NOT regexp_matches({x}, '[\\\\{{}}^_]') AND NOT regexp_full_match({x}, '\\d*[A-Za-z]\\d*')
  AND NOT regexp_full_match({x}, '(?:[A-Za-z]\\s*){{1,5}}') AND NOT regexp_full_match({x}, '[\\d\\s.,:/+-]+')
  AND NOT (regexp_matches({x}, '[=+*/<>-]') AND regexp_matches({x}, '[A-Za-z0-9]'))
  AND {d.count(x, '[^A-Za-z0-9' + chr(92) + 's-]')} <= greatest(1, length({x}) // 4))"""


def latin_bonus(x: str) -> str:
    names = [(n, b) for n, _, b in fv.CONCEPTS if n.isascii()]
    arms = [f"WHEN lower({x}) = {d.q(n)} THEN CAST({b} AS DOUBLE)" for n, b in names]
    arms += [f"WHEN contains(lower({x}), {d.q(n)}) THEN CAST({b} AS DOUBLE) * 0.65::DOUBLE" for n, b in names]
    return "CASE " + " ".join(arms) + " ELSE 0.0::DOUBLE END"


def latin_kind_sql(x: str) -> str:
    return f"CASE WHEN {latin_bonus(x)} > 0 THEN 'concept' ELSE 'term' END"


def terms_cte(src: str) -> str:
    """CTE ``ranked`` (material_id, chunk_index, rk, term, kind, confidence) from chunks with column rt."""
    concept = " UNION ALL ".join(
        f"SELECT material_id, chunk_index, {d.q(n)} AS term, {b}::DOUBLE + 1.0::DOUBLE AS score, {d.q(kd)} AS kind, -1 AS pos FROM k_text WHERE contains(lower(ct), {d.q(n)})"
        for n, kd, b in fv.CONCEPTS if n.isascii()
    )
    return f"""
k_text AS (SELECT material_id, chunk_index, {d.clean('rt')} AS ct FROM {src}),
k_list AS (SELECT material_id, chunk_index, list_filter(list_transform(
   regexp_extract_all({d.masked('ct')}, '\\b[A-Za-z][A-Za-z0-9-]*(?:\\s+[A-Za-z][A-Za-z0-9-]*){{0,2}}\\b'),
   lambda x: {clean_latin('x')}), lambda x: x <> '') AS ps FROM k_text),
k_phrase AS (SELECT material_id, chunk_index, unnest(ps) AS p, unnest(range(len(ps))) AS pos FROM k_list),
k_count AS (SELECT material_id, chunk_index, p, count(*) AS n, min(pos) AS pos FROM k_phrase GROUP BY ALL),
k_cand AS (SELECT material_id, chunk_index, {clean_latin('p')} AS term,
   0.7::DOUBLE + least(n, 4) * 0.25::DOUBLE + least({d.count('p', '[A-Za-z]+')}, 3) * 0.15::DOUBLE AS score, NULL AS kind, pos FROM k_count
   UNION ALL {concept}),
k_valid AS (SELECT *, {latin_bonus('term')} AS bonus FROM k_cand WHERE {valid('term')}),
k_own AS (SELECT *, score + bonus AS own, lower(term) AS identity FROM k_valid),
k_best AS (SELECT *, round(least(0.95::DOUBLE, 0.48::DOUBLE + own / 6.0::DOUBLE), 3) AS confidence FROM k_own
   QUALIFY row_number() OVER (PARTITION BY material_id, chunk_index, identity ORDER BY own DESC, pos) = 1),
ranked AS (SELECT material_id, chunk_index, term, coalesce(kind, {latin_kind_sql('term')}) AS kind, confidence, bonus,
   row_number() OVER (PARTITION BY material_id, chunk_index ORDER BY own + confidence + bonus DESC, length(term) DESC, term) AS rk
   FROM k_best QUALIFY rk <= 5)"""


_TERM = "concat_ws('/', term, kind, printf('%.3f', confidence))"
_OUTSIDE = "regexp_split_to_array(regexp_replace(content, '[^A-Za-z ]', '', 'g'), ' +')[1:6]"

# paragraphs are packed one at a time by a recursive query
_MULTI = f"""
WITH RECURSIVE m AS (SELECT material_id, {d.normalize('text')} AS t FROM {d.view('multi')}),
pl AS (SELECT material_id, list_filter(list_transform(string_split_regex(t, '\\n{{2,}}'), lambda x: {d.strip('x')}), lambda x: x <> '') AS ps FROM m),
fold(material_id, i, done, open) AS (
  SELECT material_id, 0, CAST([] AS VARCHAR[]), '' FROM pl
  UNION ALL
  SELECT f.material_id, f.i + 1,
    CASE WHEN length(p.ps[f.i + 1]) > 800 THEN list_concat(CASE WHEN f.open <> '' THEN list_append(f.done, f.open) ELSE f.done END,
              list_transform(range(0, length(p.ps[f.i + 1]), 680), lambda s: {d.strip('substr(p.ps[f.i + 1], s + 1, 800)')}))
         WHEN f.open = '' OR length(f.open) + 2 + length(p.ps[f.i + 1]) <= 800 THEN f.done
         ELSE list_append(f.done, f.open) END,
    CASE WHEN length(p.ps[f.i + 1]) > 800 THEN ''
         WHEN f.open = '' THEN p.ps[f.i + 1]
         WHEN length(f.open) + 2 + length(p.ps[f.i + 1]) <= 800 THEN concat(f.open, chr(10), chr(10), p.ps[f.i + 1])
         ELSE p.ps[f.i + 1] END
  FROM fold f JOIN pl p USING (material_id) WHERE f.i < len(p.ps)),
fin AS (SELECT f.material_id, list_filter(CASE WHEN open <> '' THEN list_append(done, open) ELSE done END, lambda x: length(x) >= 20) AS cs
  FROM fold f JOIN pl p USING (material_id) WHERE f.i = len(p.ps))
SELECT material_id, CAST(unnest(range(len(cs))) AS INT) AS chunk_index, unnest(cs) AS content FROM fin"""

_PAGE_CUT = (
    f"CASE WHEN t = '' THEN [] WHEN length(t) <= 800 THEN [t] ELSE list_transform(range(0, length(t), 680), lambda i: {d.strip('substr(t, i + 1, 800)')}) END"
)
_FORM_TOK = "list_distinct(flatten(list_concat([" + d.formula_tokens_of("text") + "], list_transform(fs, lambda f: " + d.formula_tokens_of("f") + "))))"


def _rewrite() -> str:
    sem = d.clean("query")
    return f"""WITH {d.formulas_cte('(SELECT query_id, query AS text FROM ' + d.view('query') + ')', 'query_id')},
s AS (SELECT query_id, query, CASE WHEN {sem} <> '' THEN {sem} ELSE {d.strip('query')} END AS semantic_query FROM {d.view('query')}),
t AS (SELECT query_id, semantic_query, {d.lexical_tokens('semantic_query')} AS lt,
  flatten(list_concat([{d.formula_tokens_of('query')}], list_transform(fs, lambda f: {d.formula_tokens_of('f')}))) AS ft
  FROM s JOIN formulas USING (query_id))
SELECT query_id, semantic_query, array_to_string({d.distinct('lt')}[1:24], ' ') AS lexical_terms,
  array_to_string({d.distinct('ft')}[1:24], ' ') AS formula_terms FROM t"""


_CH = d.chunks_cte()
ORACLE = {
    "normalize_text": f"SELECT material_id, md5({d.normalize('text')}) AS text_md5 FROM {M}",
    "chunk_documents": f"WITH {_CH} SELECT material_id, chunk_index, content FROM chunks",
    "chunk_multi_paragraph": _MULTI,
    "chunk_turns": _MULTI,
    "chunk_pages": f"""WITH p AS (SELECT material_id, page_index, {d.normalize("coalesce(nullif(" + d.strip('ocr_text') + ", ''), built_in_text)")} AS t FROM {d.view('pages')}),
c AS (SELECT material_id, page_index, list_filter({_PAGE_CUT}, lambda x: length(x) >= 20) AS cs FROM p),
u AS (SELECT material_id, page_index, unnest(range(len(cs))) AS pos, unnest(cs) AS content FROM c),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY material_id ORDER BY page_index, pos) - 1 AS INT) AS chunk_index FROM u)
SELECT material_id, page_index, chunk_index, content,
  concat('conv/', material_id, '.pdf#page-', page_index, '-chunk-', chunk_index) AS source FROM n""",
    "clean_for_retrieval": f"SELECT origin, id, md5({d.clean('text', True)}) AS cleaned_md5 FROM {_both}",
    "extract_formulas": f"WITH {d.formulas_cte(_both, 'origin, id')} SELECT origin, id, coalesce(array_to_string(fs, {d.q(SEP)}), '') AS formulas FROM formulas",
    "is_formula_line": f"""WITH l AS (SELECT chunk_id, string_split(text, chr(10)) AS ls FROM {d.view('math')}),
u AS (SELECT chunk_id, CAST(unnest(range(len(ls))) AS INT) AS line_no, trim(unnest(ls)) AS line FROM l)
SELECT chunk_id, line_no, {d.is_formula_line('line')} AS is_formula FROM u""",
    "detect_language": f"""SELECT material_id, CASE WHEN n = 0 THEN 'unknown' ELSE 'en' END AS source_lang
FROM (SELECT material_id, {d.count('text', '[A-Za-z]')} AS n FROM {M})""",
    "extract_key_terms": f"""WITH {_CH}, src AS (SELECT material_id, chunk_index, {d.clean('content')} AS rt FROM chunks), {terms_cte('src')}
SELECT s.material_id, s.chunk_index, coalesce(string_agg({_TERM}, {d.q(SEP)} ORDER BY rk), '') AS terms
FROM src s LEFT JOIN ranked r ON s.material_id = r.material_id AND s.chunk_index = r.chunk_index GROUP BY s.material_id, s.chunk_index""",
    "clean_key_term": f"""WITH l AS (SELECT chunk_id, string_split(text, chr(10)) AS ls FROM {d.view('math')}),
u AS (SELECT chunk_id, CAST(unnest(range(len(ls))) AS INT) AS line_no, unnest(ls) AS line FROM l),
c AS (SELECT chunk_id, line_no, {clean_any('line')} AS term FROM u)
SELECT chunk_id, line_no, term, {valid('term')} AS valid FROM c""",
    "rank_terms": f"""WITH {_CH}, o AS (SELECT material_id, chunk_index, {_OUTSIDE} AS ws FROM chunks),
u AS (SELECT material_id, chunk_index, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM o),
c AS (SELECT material_id, chunk_index, i, {clean_any('w')} AS t FROM u),
v AS (SELECT *, round(greatest(0.0::DOUBLE, least(CASE WHEN i % 2 = 0 THEN 0.9::DOUBLE - i * 0.1::DOUBLE ELSE 0.76::DOUBLE END, 0.98::DOUBLE)), 3) AS conf FROM c WHERE {valid('t')}),
b AS (SELECT *, {latin_bonus('t')} AS bonus FROM v),
k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY material_id, chunk_index, lower(t) ORDER BY conf + bonus DESC, i) = 1),
r AS (SELECT material_id, chunk_index, t AS term, {latin_kind_sql('t')} AS kind, conf AS confidence,
  row_number() OVER (PARTITION BY material_id, chunk_index ORDER BY conf + bonus DESC, length(t) DESC, t) AS rk FROM k QUALIFY rk <= 5)
SELECT o.material_id, o.chunk_index, coalesce(string_agg({_TERM}, {d.q(SEP)} ORDER BY rk), '') AS terms
FROM o LEFT JOIN r ON o.material_id = r.material_id AND o.chunk_index = r.chunk_index GROUP BY o.material_id, o.chunk_index""",
    "rebuild_chunk_terms": f"""WITH {_CH}, src AS (SELECT material_id, chunk_index, content AS text, {d.clean('content')} AS rt FROM chunks WHERE goal_id < 10), {terms_cte('src')},
{d.formulas_cte('src', 'material_id, chunk_index')},
tn AS (SELECT material_id, chunk_index, count(*) AS n FROM ranked GROUP BY ALL)
SELECT s.material_id, count(*) AS chunks, CAST(sum(coalesce(tn.n, 0)) AS BIGINT) AS terms, CAST(sum(len(f.fs)) AS BIGINT) AS formulas,
  CAST(sum(length(rt)) AS BIGINT) AS retrieval_chars
FROM src s LEFT JOIN tn ON s.material_id = tn.material_id AND s.chunk_index = tn.chunk_index
JOIN formulas f ON s.material_id = f.material_id AND s.chunk_index = f.chunk_index GROUP BY s.material_id""",
    "usable_terms": f"""WITH {_CH}, o AS (SELECT material_id, chunk_index, {_OUTSIDE} AS ws FROM chunks),
f AS (SELECT material_id, chunk_index, list_filter(list_transform(ws, lambda w, i: CASE WHEN (i - 1) % 2 = 1 OR 0.9::DOUBLE - (i - 1) * 0.1::DOUBLE >= 0.45 THEN {clean_any('w')} ELSE '' END), lambda x: x <> '' AND {valid('x')}) AS ts FROM o)
SELECT material_id, chunk_index, coalesce(array_to_string({d.distinct('ts')}, {d.q(SEP)}), '') AS terms FROM f""",
    "term_labels": f"""WITH {_CH}, o AS (SELECT material_id, chunk_index, {_OUTSIDE} AS ws FROM chunks),
f AS (SELECT material_id, chunk_index, list_filter(list_transform(ws, lambda w, i: CASE WHEN (i - 1) % 3 = 0 AND w <> '' AND upper(w) <> w THEN concat(w, ' / ', upper(w)) ELSE w END), lambda x: x <> '')[1:5] AS ts FROM o)
SELECT material_id, chunk_index, coalesce(array_to_string(ts, {d.q(SEP)}), '') AS labels FROM f""",
    "metadata_round_trip": f"""WITH {_CH}, {d.formulas_cte('(SELECT material_id, chunk_index, content AS text FROM chunks)', 'material_id, chunk_index')},
o AS (SELECT material_id, chunk_index, goal_id, CASE WHEN chunk_index % 7 = 3 THEN [] ELSE {_OUTSIDE} END AS ws FROM chunks)
SELECT o.material_id, o.chunk_index, goal_id, true AS plan_dropped, CAST(len(ws) AS INT) AS n_terms, coalesce(array_to_string(ws, {d.q(SEP)}), '') AS sources,
  coalesce(array_to_string(fs, {d.q(SEP)}), '') AS formulas FROM o JOIN formulas f ON o.material_id = f.material_id AND o.chunk_index = f.chunk_index""",
    "fingerprint": f"""SELECT material_id, sha256(text) AS text_hash,
concat('coursemine:page:', sha256(concat('{{"filename":"', filename, '","goal_id":', goal_id, '}}'))) AS cache_key FROM {M}""",
    "fallback_parse_json": """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k FROM events""",
    "tokenize_lexical": f"""WITH t AS (SELECT material_id, {d.lexical_tokens('text')} AS ts FROM {M}),
u AS (SELECT material_id, unnest(ts) AS tok, unnest(range(len(ts))) AS pos FROM t),
f AS (SELECT material_id, tok, min(pos) AS pos FROM u GROUP BY ALL),
g AS (SELECT material_id, string_agg(tok, ' ' ORDER BY pos) AS s, count(*) AS n FROM f GROUP BY material_id)
SELECT material_id, md5(coalesce(s, '')) AS tokens_md5, CAST(coalesce(n, 0) AS INT) AS n FROM t LEFT JOIN g USING (material_id)""",
    "formula_tokens": f"""WITH {d.formulas_cte(d.view('math'), 'chunk_id')}
SELECT chunk_id, array_to_string(list_sort({_FORM_TOK}), ' ') AS tokens FROM {d.view('math')} JOIN formulas USING (chunk_id)""",
    "rewrite_queries": _rewrite(),
    "hash_tokens": f"""SELECT material_id, CAST(len(ts) AS INT) AS n, md5(coalesce(array_to_string(ts, ' '), '')) AS tokens_md5
FROM (SELECT material_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ts FROM {M})""",
}


def enriched_cte(src: str) -> str:
    """CTE ``enr`` (keys, source_lang, summary_zh, terms, n_terms, fs, embedding_text) from chunks src with text and rt."""
    k = "material_id, chunk_index"
    on = lambda t: f"{t}.material_id = s.material_id AND {t}.chunk_index = s.chunk_index"
    return f"""{terms_cte(src)}, {d.formulas_cte(src, k)},
e_re AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY confidence + bonus DESC, length(term) DESC, term) AS r2 FROM ranked),
e_t AS (SELECT {k}, count(*) AS n_terms, string_agg(term, '、' ORDER BY rk) AS names, string_agg({_TERM}, {d.q(SEP)} ORDER BY r2) AS terms,
  string_agg(concat(term, ' = '), '；' ORDER BY r2) AS pairs FROM e_re GROUP BY ALL),
e_1 AS (SELECT s.material_id, s.chunk_index, s.text, rt, fs, coalesce(n_terms, 0) AS n_terms, coalesce(terms, '') AS terms, pairs, names,
  CASE WHEN {d.count('rt', '[A-Za-z]')} = 0 THEN 'unknown' ELSE 'en' END AS source_lang FROM {src} s LEFT JOIN e_t ON {on('e_t')} JOIN formulas f ON {on('f')}),
e_2 AS (SELECT *, CASE WHEN source_lang = 'en' THEN concat('该英文片段主要围绕 ', coalesce(names, '核心概念'), ' 等概念展开。') WHEN length(rt) <= 160 THEN rt ELSE concat(substr(rt, 1, 160), '...') END AS summary_zh FROM e_1),
enr AS (SELECT *, concat_ws(chr(10), CASE WHEN rt <> '' THEN rt ELSE text END, CASE WHEN len(fs) > 0 THEN concat('Formulae: ', array_to_string(fs[1:5], ' ; ')) END,
  CASE WHEN summary_zh <> '' THEN concat('中文摘要：', summary_zh) END, CASE WHEN pairs IS NOT NULL THEN concat('核心术语：', pairs) END) AS embedding_text FROM e_2)"""


ORACLE["enrich_chunks"] = f"""WITH {_CH}, src AS (SELECT material_id, chunk_index, content AS text, {d.clean('content')} AS rt FROM chunks), {enriched_cte('src')}
SELECT material_id, chunk_index, source_lang, summary_zh, terms, coalesce(array_to_string(fs, {d.q(SEP)}), '') AS formulas, md5(embedding_text) AS embedding_md5 FROM enr"""
