"""Course outlines: contents lines and headings to a leveled, page-ranged table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import collapse, count_of, let, lines, strip, unnest
from coursemine.operators.ranking import number_in_key, top_per_key

ITEM_COLUMNS = ["title", "level", "page_start", "page_end", "order", "confidence", "source"]
TOC_PATTERNS = [
    (r"(?i)\A(第\s*[一二三四五六七八九十百千万\d]+\s*[章节篇讲])\s*[:：、.\-]?\s*(.+)\z", 1),
    (r"(?i)\A((?:\d+\.){1,3}\d*)\s+(.+)\z", None),
    (r"(?i)\A(Chapter\s+\d+)\s*[:：.\-]?\s*(.+)\z", 1),
    (r"(?i)\A(Section\s+\d+(?:\.\d+)*)\s*[:：.\-]?\s*(.+)\z", 2),
]
PAGE_LEADER = r"(?:\.{2,}|…+|\s{2,})\s*(\d{1,4})\z"
FRONT_MARK = r"(?i)\A\[(?:PDF|PDF OCR)\s+page\s+\d+\]"
ANY_MARK = r"(?i)\[(?:PDF|PDF OCR|PPT slide)\s+(?:page|slide)?\s*(\d+)\]"


def normalize_spaces(c: Column) -> Column:
    return strip(collapse(c))


def strip_markdown(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\A(#{1,6}\s+|[-*+]\s+|\d+[.)、]\s+)", ""))


def clean_title(c: Column) -> Column:
    c = F.regexp_replace(strip_markdown(c), r"\s*\.{2,}\s*\d{1,4}\z", "")
    c = collapse(F.regexp_replace(c, r"\s+第?\s*\d{1,4}\s*页\z", ""))
    return F.substring(F.regexp_replace(c, r"\A[ \-–—:：、.\t]+|[ \-–—:：、.\t]+\z", ""), 1, 120)


def valid_title(c: Column) -> Column:
    # as a filter it is moved below the title's projection, which would put the cleaning into every one of its tests
    return let(c, _valid_title)


def _valid_title(c: Column) -> Column:
    low = F.lower(c)
    noisy = low.isin(*fv.OUTLINE_NOISE_EXACT)
    for token in fv.OUTLINE_NOISE:
        noisy = noisy | low.contains(token)
    for token in fv.OUTLINE_BAD_LATEX:
        noisy = noisy | c.contains(token)
    digits = count_of(c, "[0-9]")
    return F.length(c).between(2, 120) & ~noisy & (digits <= F.greatest(F.lit(6.0), F.length(c) * F.lit(0.55)))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def match_toc(line: Column) -> Column:
    """Struct (title, level, page) of a contents line, or null."""
    def matched(text: Column) -> Column:
        digits = F.regexp_extract(text, PAGE_LEADER, 1)
        page = F.when(digits != "", _positive(digits.cast("int")))
        return let(strip(F.regexp_replace(text, PAGE_LEADER, "")), lambda body: by_pattern(body, page))

    def by_pattern(body: Column, page: Column) -> Column:
        out = None
        for pattern, level in TOC_PATTERNS:
            prefix = normalize_spaces(F.regexp_extract(body, pattern, 1))
            title = strip(F.concat(prefix, F.lit(" "), normalize_spaces(F.regexp_extract(body, pattern, 2))))
            depth = F.lit(level) if level else F.least(count_of(prefix, r"\.") + 1, F.lit(4))
            item = F.struct(title.alias("title"), depth.cast("int").alias("level"), page.alias("page"))
            out = F.when(body.rlike(pattern), item) if out is None else out.when(body.rlike(pattern), item)
        return out

    return let(strip_markdown(normalize_spaces(line)), matched)


def front_lines(materials: DataFrame, max_pages: int = 20, max_lines: int = 900) -> DataFrame:
    """(material_id, line_no, line) of the first pages of marked texts, or the first lines of others."""
    def front(ls: Column) -> Column:
        marks = F.filter(
            F.transform(ls, lambda x, i: F.when(strip(x).rlike(FRONT_MARK), i)), lambda i: i.isNotNull()
        )
        return let(
            marks,
            lambda m: F.when(F.size(m) == 0, F.slice(ls, 1, max_lines))
            .when(F.size(m) > max_pages, F.slice(ls, F.lit(1), F.get(m, F.lit(max_pages))))
            .otherwise(ls),
        )

    def candidates(c: Column) -> Column:
        kept = F.filter(F.transform(let(lines(c), front), strip), lambda x: x != "")
        return F.slice(kept, 1, max_lines)

    return unnest(materials, ["material_id"], candidates(F.col("text")), "line_no", "line")


def match_toc_lines(rows: DataFrame) -> DataFrame:
    """(material_id, line_no, title, level, page) of the lines that are contents entries."""
    found = rows.select("material_id", "line_no", match_toc(F.col("line")).alias("m")).filter(F.col("m").isNotNull())
    return found.select("material_id", "line_no", "m.title", "m.level", "m.page")


def _page_end(following: Column) -> Column:
    start = _positive(F.col("page_start"))
    return F.coalesce(F.col("page_end"), F.when(start.isNotNull() & (following > start), following - 1)).cast("int")


def _next_page(w: WindowSpec) -> Column:
    return F.first(_positive(F.col("page_start")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))


def page_ranges(items: DataFrame, key: str = "material_id", block: int = 1024) -> DataFrame:
    """Fill page_end from the next known page_start and renumber, for any number of items per key.

    The next page is looked up inside a block of the order, else it is the first known
    page of the later blocks, so no task sees a whole key.
    """
    start, order = _positive(F.col("page_start")), F.col("order")
    items = items.withColumn("_at", F.floor(order / block))
    firsts = items.groupBy(key, "_at").agg(F.min_by(start, F.when(start.isNotNull(), order)).alias("_first"))
    later = Window.partitionBy(key).orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select(key, "_at", F.first("_first", ignorenulls=True).over(later).alias("_later"))
    following = F.coalesce(_next_page(Window.partitionBy(key, "_at").orderBy("order")), F.col("_later"))
    ended = items.join(firsts, [key, "_at"]).withColumn("page_end", _page_end(following))
    return number_in_key(ended, [key], F.col("_at"), [order], "_n").withColumn("order", F.col("_n")).drop("_n", "_at", "_later")


def _short_page_ranges(items: DataFrame) -> DataFrame:
    """As ``page_ranges`` for outlines, which have at most 80 items."""
    w = Window.partitionBy("material_id").orderBy("order")
    ended = items.withColumn("_end", _page_end(_next_page(w))).withColumn("order", F.row_number().over(w))
    return ended.withColumn("page_end", F.col("_end")).drop("_end")


def _first_titles(items: DataFrame, least: int, order: str = "line_no", distinct: bool = True) -> DataFrame:
    """First occurrence per title, numbered, at most 80, none when fewer than ``least``."""
    if distinct:
        rest = [c for c in items.columns if c not in ("material_id", "title")]
        items = items.groupBy("material_id", "title").agg(F.min_by(F.struct(*rest), order).alias("_r"))
        items = items.select("material_id", "title", *[F.col("_r")[c].alias(c) for c in rest])
    kept = top_per_key(items, ["material_id"], [F.col(order)], fv.MAX_OUTLINE_ITEMS, "order")
    if least > 1:
        kept = kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("material_id"))).filter(F.col("_n") >= least).drop("_n")
    return kept


def _shape(items: DataFrame) -> DataFrame:
    return _short_page_ranges(items).select("material_id", *ITEM_COLUMNS)


def extract_outline(rows: DataFrame, max_lines: int = 900, source: str = "text_toc") -> DataFrame:
    """Outline items from lines (material_id, line_no, line)."""
    front = top_per_key(
        rows.filter(strip(F.col("line")) != ""), ["material_id"], [F.col("line_no")], max_lines, "_n"
    ).drop("_n")
    header = F.trim(F.lower(normalize_spaces(F.col("line")))).isin(*fv.OUTLINE_HEADERS)
    first_header = front.groupBy("material_id").agg(F.min(F.when(header, F.col("line_no"))).alias("_header"))
    found = match_toc_lines(front.filter(~header)).withColumn("title", clean_title(F.col("title"))).filter(valid_title(F.col("title")))
    found = found.join(first_header, "material_id")
    started = F.coalesce(F.col("line_no") > F.col("_header"), F.lit(False)) | F.col("page").isNotNull()
    items = found.select(
        "material_id", "title", "line_no", "level", F.col("page").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
        F.when(started, 0.86).otherwise(0.72).alias("confidence"), F.lit(source).alias("source"),
    )
    return _shape(_first_titles(items, 3))


def outline_from_toc_rows(toc: DataFrame) -> DataFrame:
    """Items of native contents rows (material_id, toc_no, level, title, page)."""
    cleaned = toc.withColumn("title", clean_title(F.col("title"))).filter(valid_title(F.col("title")))
    level = F.greatest(F.lit(1), F.least(F.coalesce(F.col("level").try_cast("int"), F.lit(1)), F.lit(4)))
    items = cleaned.select(
        "material_id", "title", "toc_no", level.alias("level"), _positive(F.col("page").try_cast("int")).alias("page_start"),
        F.lit(None).cast("int").alias("page_end"), F.lit(0.95).alias("confidence"), F.lit("pdf_toc").alias("source"),
    )
    return _shape(_first_titles(items, 1, "toc_no", distinct=False))


def choose_outline(materials: DataFrame, native: DataFrame, text: DataFrame, ocr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, status per material): the first non-empty of native contents, text, OCR."""
    ranked = None
    for turn, (items, name) in enumerate(((native, "pdf_toc"), (text, "text_toc"), (ocr, "ocr_markdown"))):
        part = items.withColumn("source", F.lit(name)).withColumn("_turn", F.lit(turn))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy("material_id").agg(F.min("_turn").alias("_turn"), F.min_by("source", "_turn").alias("outline_source"))
    items = ranked.join(best.select("material_id", "_turn"), ["material_id", "_turn"]).drop("_turn")
    status = materials.select("material_id").join(best.drop("_turn"), "material_id", "left").select(
        "material_id",
        F.when(F.col("outline_source").isNull(), "unavailable").otherwise("ready").alias("outline_status"),
        F.coalesce("outline_source", F.lit("heading_infer")).alias("outline_source"),
    )
    return items, status


def infer_headings(rows: DataFrame, max_lines: int = 3000) -> DataFrame:
    """Items from headings, contents-like lines and short keyword titles; pages carried from the last mark."""
    block = F.floor(F.col("line_no") / 1024)
    front = number_in_key(rows.filter(strip(F.col("line")) != ""), ["material_id"], block, [F.col("line_no")], "_n").filter(
        F.col("_n") <= max_lines
    )
    mark = F.regexp_extract("line", ANY_MARK, 1)
    w = Window.partitionBy("material_id").orderBy("line_no")
    paged = front.withColumn("_mark", F.when(mark != "", mark.cast("int")))
    # a mark without a usable number still resets the page, hence the struct
    page = F.last(F.when(F.col("_mark").isNotNull(), F.struct(_positive(F.col("_mark")).alias("p"))), ignorenulls=True).over(w)["p"]
    body = paged.withColumn("page_start", page).filter(F.col("_mark").isNull())
    line = normalize_spaces(F.col("line"))
    md = r"\A(#{1,4})\s+(.+)\z"

    def heading(x: Column) -> Column:
        return let(strip_markdown(x), lambda s: let(match_toc(s), lambda t: pick(x, s, t)))

    def pick(x: Column, s: Column, t: Column) -> Column:
        item = lambda title, level: F.struct(title.alias("title"), level.cast("int").alias("level"))
        titled = (
            F.length(s).between(4, 36) & ~s.rlike("[。，,;；]\\z") & (F.size(F.split(s, r"\s+")) <= 8)
            & s.rlike(f"(?i)({fv.HEADING_WORDS})")
        )
        return (
            F.when(x.rlike(md), item(F.regexp_extract(x, md, 2), F.length(F.regexp_extract(x, md, 1))))
            .when(t.isNotNull(), item(t["title"], t["level"]))
            .when(titled, item(s, F.lit(2)))
        )

    found = body.withColumn("m", heading(line)).filter(F.col("m").isNotNull())
    items = found.select(
        "material_id", clean_title(F.col("m.title")).alias("title"), "line_no", F.col("m.level").alias("level"), "page_start",
        F.lit(None).cast("int").alias("page_end"), F.lit(0.68).alias("confidence"), F.lit("heading_infer").alias("source"),
    ).filter(valid_title(F.col("title")))
    return _shape(_first_titles(items, 3))


RAW_ITEM = "struct<title:string,level:string,page_start:string,page_end:string,confidence:string>"


def repair_outline(raw: DataFrame) -> DataFrame:
    """Untrusted items (material_id, raw JSON array) → cleaned items."""
    return _repaired(unnest(raw, ["material_id"], F.from_json("raw", f"array<{RAW_ITEM}>"), "pos", "i"))


def repair_outline_items(raw: DataFrame) -> DataFrame:
    """The same from one row per item (material_id, pos, raw JSON object), for outlines too long for one text."""
    return _repaired(raw.select("material_id", "pos", F.from_json("raw", RAW_ITEM).alias("i")))


def _repaired(rows: DataFrame) -> DataFrame:
    rows = rows.filter(F.col("i").isNotNull())
    cleaned = rows.withColumn("title", clean_title(F.coalesce(F.col("i.title"), F.lit("")))).filter(valid_title(F.col("title")))
    as_int = lambda c: F.col(f"i.{c}").try_cast("int")
    items = cleaned.select(
        "material_id", "title", "pos", F.greatest(F.lit(1), F.least(F.coalesce(as_int("level"), F.lit(1)), F.lit(4))).alias("level"),
        _positive(as_int("page_start")).alias("page_start"), _positive(as_int("page_end")).alias("page_end"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("i.confidence").try_cast("double"), F.lit(0.8)))).alias("confidence"),
        F.lit("llm_refined").alias("source"),
    )
    return _shape(_first_titles(items, 1, "pos"))


def outline_topics(materials: DataFrame, items: DataFrame, n: int = 12) -> DataFrame:
    """(goal_id, topics): distinct titles over a goal's materials in creation order, the first n."""
    titled = items.select("material_id", F.trim("title").alias("title"), "order").filter(F.length(F.trim("title")).between(2, 120))
    placed = titled.join(materials.select("material_id", "goal_id", "created_at"), "material_id")
    first = placed.groupBy("goal_id", "title").agg(F.min(F.struct("created_at", "material_id", "order")).alias("at"))
    kept = top_per_key(first, ["goal_id"], [F.col("at")], n, "turn")
    return kept.groupBy("goal_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "title"))), lambda x: x["title"]).alias("topics")
    )


def rebuild_outlines(materials: DataFrame, rows: DataFrame, wanted: DataFrame, native: DataFrame, ocr_rows: DataFrame) -> DataFrame:
    """Materials with outline, status and source recomputed for the wanted ones; other columns are kept."""
    pick = lambda df: df.join(wanted.select("material_id").distinct(), "material_id", "left_semi")
    items, status = choose_outline(
        pick(materials), outline_from_toc_rows(pick(native)), extract_outline(pick(rows)),
        extract_outline(pick(ocr_rows), source="ocr_markdown"),
    )
    nested = items.groupBy("material_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("order", F.struct(*ITEM_COLUMNS).alias("i")))), lambda x: x["i"]
        ).alias("_outline")
    )
    fresh = status.join(nested, "material_id", "left").select(
        "material_id", F.col("outline_status").alias("_status"), F.col("outline_source").alias("_source"), "_outline"
    )
    out = materials.join(fresh, "material_id", "left")
    done = F.col("_status").isNotNull()
    return out.select(
        *[c for c in materials.columns if c not in ("outline", "outline_status", "outline_source")],
        F.when(done, F.col("_outline")).otherwise(F.col("outline")).alias("outline"),
        F.coalesce("_status", "outline_status").alias("outline_status"),
        F.coalesce("_source", "outline_source").alias("outline_source"),
    )
