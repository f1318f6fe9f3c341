"""Registered queries on sources, sinks and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemine.catalog import duck as d
from coursemine.catalog.text_queries import SEP, chunks, joined
from coursemine.fixtures import table, view
from coursemine.operators import chunking
from coursemine.sources import corpus as co, tables as tb


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, or below the warehouse, which is shared as well, when none is set."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")
    return f"{base}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"


def entity_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The entity tables as far as the driver's tables give them."""
    plan, task = view(spark, sf, "plan"), view(spark, sf, "task")
    material = view(spark, sf, "material")
    return {
        "goal": view(spark, sf, "goal"), "plan": plan, "task": task,
        "quiz": view(spark, sf, "quiz_question").withColumnRenamed("quiz_id", "plan_id"),
        "review": plan.select(F.col("plan_id"), "goal_id"),
        "adjustment": plan.select("plan_id", "goal_id"),
        "job": view(spark, sf, "events").select("event_id", "job_id", (F.col("job_id") % 20).alias("goal_id")),
        "material": material.drop("text"), "chunk": chunks(spark, sf).select("material_id", "chunk_index"),
        "translation": view(spark, sf, "pages").select("material_id", "page_index"),
    }


KEY_OF = {"goal": "goal_id", "plan": "plan_id", "task": "plan_id", "quiz": "plan_id", "review": "plan_id", "adjustment": "plan_id", "job": "job_id",
          "material": "material_id", "chunk": "material_id", "translation": "material_id"}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table and the sum of their keys, so that other rows of the same number show."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(KEY_OF[name]), F.lit(0)).cast("bigint").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


def _materials(spark, sf):
    m = view(spark, sf, "material")
    return m.select(
        "material_id", "goal_id", "filename", F.lit("pending").alias("parse_status"),
        F.when(F.col("material_id") % 4 == 0, "old error").alias("error_message"), F.lit(0).alias("chunk_count"),
    )


def q_read_text_corpus(spark, sf):
    """Benchmark passages written out by Spark as text files of up to 50 passages, then read back as a corpus."""
    path = scratch(spark, "corpus")
    b = table(spark, sf, "benchmark").select(F.floor(F.col("item_id") / 50).alias("part"), "item_id", "text")
    b.repartition("part").sortWithinPartitions("part", "item_id").select("part", "text").write.partitionBy("part").text(path)
    texts, _ = co.read_text_corpus(spark, path)
    return texts.select(
        F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint").alias("part"), "file_type",
        F.regexp_replace("text", "\n\\z", "").alias("text"),
    )


def q_detect_changed_files(spark, sf):
    m = view(spark, sf, "material")
    moved = lambda when, name: F.when(when, F.concat(F.lit(name), F.col("filename"))).otherwise(F.col("filename")).alias("path")
    files = m.select(moved(F.col("material_id") % 10 == 9, "new/"), F.col("text").cast("binary").alias("content"))
    manifest = m.select(
        moved(F.col("material_id") % 10 <= 1, "old/"),
        F.when(F.col("material_id") % 10 == 2, None).when(F.col("material_id") % 10 == 3, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("file_sha256"),
    )
    return co.detect_changed_files(files, manifest)


def _ocr_lines(spark, sf):
    """One JSONL line per turn; a line holds the OCR text of a page and its built-in text as a second page."""
    v = view(spark, sf, "pages")
    item = lambda c: F.struct(F.struct(F.coalesce(F.col(c), F.lit("")).alias("text")).alias("markdown"))
    line = F.to_json(F.struct(F.struct(F.array(item("ocr_text"), item("built_in_text")).alias("layoutParsingResults")).alias("result")))
    return v.select("material_id", F.col("page_index").alias("line_no"), line.alias("line"))


def q_read_ocr_files(spark, sf):
    """OCR results written out as JSONL files, fifty conversations to a file, and read as pages."""
    path = scratch(spark, "ocr")
    lines = _ocr_lines(spark, sf).withColumn("part", F.floor(F.col("material_id") / 50))
    lines.repartition("part").sortWithinPartitions("part", "material_id", "line_no").select("part", "line").write.partitionBy("part").text(path)
    pages, _ = co.read_ocr_pages(spark, path, name=r"part=(\d+)/")
    return pages


def q_read_ocr_pages(spark, sf):
    lines = _ocr_lines(spark, sf)
    blank = lines.select("material_id", (F.col("line_no") + 100000).alias("line_no"), F.lit("  ").alias("line"))
    pages, _ = co.ocr_pages_from_lines(lines.unionByName(blank))
    return pages


def q_split_marked_pages(spark, sf):
    p = co.page_texts(view(spark, sf, "pages")).select("material_id", "page_index", F.col("text").alias("page_text"))
    return co.split_marked_pages(co.assemble_marked_pages(p)).select("material_id", "page_index", "page_text")


def q_page_catalog(spark, sf):
    c = co.page_catalog(view(spark, sf, "pages"))
    return c.select("material_id", "page_count", F.concat_ws(",", F.col("readable_pages").cast("array<string>")).alias("readable_pages"))


def _replaced(spark, sf):
    c = chunks(spark, sf)
    target = tb.chunk_rows(chunking.chunk_documents(view(spark, sf, "material"), 400, 60))
    new = c.filter(F.col("goal_id") < 7).select("material_id", "chunk_index", "content")
    return tb.replace_chunks(target, new, _materials(spark, sf))


def q_replace_chunks(spark, sf):
    state, _ = _replaced(spark, sf)
    return state.groupBy("material_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content_preview")).alias("preview_chars"), F.max("document_id").alias("last_id")
    )


def q_replace_chunks_materials(spark, sf):
    return _replaced(spark, sf)[1].select("material_id", "parse_status", "error_message", "chunk_count")


def q_delete_scope(spark, sf):
    t = entity_tables(spark, sf)
    goals = t["goal"].filter("goal_id % 10 = 3").select("goal_id")
    return counts(tb.delete_scope(t, "goal", goals))


def q_delete_material(spark, sf):
    t = entity_tables(spark, sf)
    return counts(tb.delete_scope({k: t[k] for k in ("material", "chunk", "translation")}, "material", t["material"].filter("material_id % 3 = 1").select("material_id")))


def q_delete_for_replan(spark, sf):
    t = entity_tables(spark, sf)
    return counts(tb.delete_for_replan(t, t["goal"].filter("goal_id % 4 = 1").select("goal_id")))


def q_backfill_schema(spark, sf):
    c = chunks(spark, sf).select(
        "material_id", "chunk_index", F.substring("content", 1, 500).alias("content_preview"), F.when(F.col("chunk_index") % 2 == 0, F.col("content")).alias("content_raw")
    )
    wanted = {"content_raw": ("string", None), "retrieval_text": ("string", None), "outline_status": ("string", F.lit("unavailable")), "formulas": ("array<string>", F.array())}
    out = tb.backfill_schema(c, wanted)
    return out.select("material_id", "chunk_index", F.length("content_raw").alias("raw_chars"), F.length("retrieval_text").alias("retrieval_chars"), "outline_status", F.size("formulas").alias("n_formulas"))


def q_ingest_snippets(spark, sf):
    m = view(spark, sf, "material")
    b = table(spark, sf, "benchmark")
    notes = b.select(
        F.col("item_id").alias("note_id"), (F.col("item_id") % 20).cast("int").alias("goal_id"), F.lit("note").alias("source_name"),
        F.when(F.col("item_id") % 8 == 5, "   ").otherwise(F.col("text")).alias("content"), F.col("item_id").alias("plan_id"), F.lit(1).alias("day_index"),
    )
    corpus, _ = tb.ingest_snippets(m, notes, 1_000_000_000)
    return chunking.chunk_documents(corpus).groupBy("material_id", "goal_id", "file_type", "plan_id", "day_index").agg(F.count(F.lit(1)).alias("chunks"))


def q_set_material_status(spark, sf):
    m = _materials(spark, sf)
    o = view(spark, sf, "material").select(
        "material_id",
        F.get(F.array(*[F.lit(x) for x in ("processing", "failed", "uploaded", "ocr_ready", "ready", "unknown")]), (F.col("material_id") % 7).cast("int")).alias("outcome"),
        F.col("text").alias("message"), F.length("filename").alias("page_count"),
    )
    out = tb.set_material_status(m, o)
    return out.select("material_id", "parse_status", F.md5("error_message").alias("error_md5"), "chunk_count")


QUERIES = {
    "read_text_corpus": q_read_text_corpus,
    "detect_changed_files": q_detect_changed_files,
    "read_ocr_pages": q_read_ocr_pages,
    "read_ocr_files": q_read_ocr_files,
    "split_marked_pages": q_split_marked_pages,
    "page_catalog": q_page_catalog,
    "replace_chunks": q_replace_chunks,
    "replace_chunks_materials": q_replace_chunks_materials,
    "delete_scope": q_delete_scope,
    "delete_material": q_delete_material,
    "delete_for_replan": q_delete_for_replan,
    "backfill_schema": q_backfill_schema,
    "ingest_snippets": q_ingest_snippets,
    "set_material_status": q_set_material_status,
}

# --- oracle -------------------------------------------------------------------
_M, _P, _PL = d.view("material"), d.view("pages"), d.view("plan")
_CH = d.chunks_cte()
_PAGE = f"coalesce(nullif({d.strip('ocr_text')}, ''), nullif({d.strip('built_in_text')}, ''), '')"
_CUT400 = f"CASE WHEN t = '' THEN [] WHEN length(t) <= 400 THEN [t] ELSE list_transform(range(0, length(t), 340), lambda i: {d.strip('substr(t, i + 1, 400)')}) END"
_NAMES = {
    "goal": "SELECT goal_id FROM g WHERE NOT ({w})",
    "plan": "SELECT plan_id FROM p WHERE NOT ({w})",
    "adjustment": "SELECT plan_id FROM p WHERE NOT ({w})",
    "job": f"SELECT job_id FROM (SELECT *, job_id % 20 AS goal_id FROM {d.view('events')}) WHERE NOT ({{w}})",
    "task": f"SELECT plan_id FROM {d.view('task')} WHERE plan_id NOT IN (SELECT plan_id FROM p WHERE {{w}})",
    "quiz": f"SELECT quiz_id FROM {d.view('quiz_question')} WHERE quiz_id NOT IN (SELECT plan_id FROM p WHERE {{w}})",
    "review": "SELECT plan_id FROM p WHERE NOT ({w})",
    "material": "SELECT material_id FROM m WHERE NOT ({w})",
    "chunk": "SELECT material_id FROM chunks WHERE NOT ({w})",
    "translation": f"SELECT material_id FROM {_P} WHERE material_id NOT IN (SELECT material_id FROM m WHERE {{w}})",
}


def _counts(where: dict[str, str]) -> str:
    head = f"WITH {_CH}, g AS {d.view('goal')}, p AS {_PL}, m AS {_M}"
    rows = " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS keys FROM ({_NAMES[k].replace('{w}', w)}) AS x(k)" for k, w in where.items())
    return f"{head} {rows}"


_G = "goal_id % 10 = 3"
ORACLE = {
    "read_text_corpus": "SELECT CAST(item_id // 50 AS BIGINT) AS part, 'txt' AS file_type, string_agg(text, chr(10) ORDER BY item_id) AS text FROM benchmark GROUP BY ALL",
    "read_ocr_files": f"""WITH i AS (SELECT material_id // 50 AS part, material_id, page_index AS ln, 0 AS pos, coalesce(ocr_text, '') AS t FROM {_P} UNION ALL SELECT material_id // 50, material_id, page_index, 1, coalesce(built_in_text, '') FROM {_P}),
n AS (SELECT part AS material_id, CAST(row_number() OVER (PARTITION BY part ORDER BY material_id, ln, pos) AS INT) AS page_index, {d.strip('t')} AS markdown FROM i)
SELECT CAST(material_id AS VARCHAR) AS material_id, page_index, markdown FROM n WHERE markdown <> ''""",
    "detect_changed_files": f"""SELECT filename AS path, CASE material_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'new' WHEN 2 THEN 'stale' WHEN 3 THEN 'stale' WHEN 9 THEN 'stale' ELSE 'unchanged' END AS state,
CASE WHEN material_id % 10 <> 9 THEN sha256(text) END AS sha256 FROM {_M}
UNION ALL SELECT concat('new/', filename), 'new', sha256(text) FROM {_M} WHERE material_id % 10 = 9
UNION ALL SELECT concat('old/', filename), 'stale', NULL FROM {_M} WHERE material_id % 10 <= 1""",
    "read_ocr_pages": f"""WITH i AS (SELECT material_id, page_index AS ln, 0 AS pos, coalesce(ocr_text, '') AS t FROM {_P} UNION ALL SELECT material_id, page_index, 1, coalesce(built_in_text, '') FROM {_P}),
n AS (SELECT material_id, CAST(row_number() OVER (PARTITION BY material_id ORDER BY ln, pos) AS INT) AS page_index, {d.strip('t')} AS markdown FROM i)
SELECT * FROM n WHERE markdown <> ''""",
    "split_marked_pages": f"SELECT material_id, page_index, {_PAGE} AS page_text FROM {_P} WHERE {_PAGE} <> ''",
    "page_catalog": f"""SELECT material_id, count(DISTINCT page_index) AS page_count,
coalesce(string_agg(page_index::VARCHAR, ',' ORDER BY page_index) FILTER (WHERE {_PAGE} <> ''), '') AS readable_pages FROM {_P} GROUP BY material_id""",
    "replace_chunks": f"""WITH {_CH}, old AS (SELECT material_id, list_filter({_CUT400}, lambda x: length(x) >= 20) AS cs FROM mat),
fresh AS (SELECT DISTINCT material_id FROM chunks WHERE goal_id < 7),
u AS (SELECT material_id, unnest(range(len(cs))) AS chunk_index, unnest(cs) AS content FROM old WHERE material_id NOT IN (SELECT material_id FROM fresh)
  UNION ALL SELECT material_id, chunk_index, content FROM chunks WHERE goal_id < 7)
SELECT material_id, count(*) AS chunks, CAST(sum(length(substr(content, 1, 500))) AS BIGINT) AS preview_chars, max(concat('material_', material_id, '_chunk_', chunk_index)) AS last_id FROM u GROUP BY material_id""",
    "replace_chunks_materials": f"""WITH {_CH}, n AS (SELECT material_id, CAST(count(*) AS INT) AS n FROM chunks WHERE goal_id < 7 GROUP BY material_id)
SELECT m.material_id, CASE WHEN n IS NULL THEN 'pending' ELSE 'ready' END AS parse_status, CASE WHEN n IS NULL AND m.material_id % 4 = 0 THEN 'old error' END AS error_message,
  coalesce(n, 0) AS chunk_count FROM {_M} m LEFT JOIN n USING (material_id)""",
    "delete_scope": _counts({k: _G for k in _NAMES}),
    "delete_material": _counts({k: "material_id % 3 = 1" for k in ("material", "chunk", "translation")}),
    "delete_for_replan": _counts({k: "goal_id % 4 = 1" if k in tb.REPLAN_TABLES else "false" for k in _NAMES}),
    "backfill_schema": f"""WITH {_CH} SELECT material_id, chunk_index, CAST(length(CASE WHEN chunk_index % 2 = 0 THEN content ELSE substr(content, 1, 500) END) AS INT) AS raw_chars,
CAST(length(substr(content, 1, 500)) AS INT) AS retrieval_chars, 'unavailable' AS outline_status, 0 AS n_formulas FROM chunks""",
    "ingest_snippets": f"""WITH {_CH} SELECT material_id, goal_id, file_type, NULL::BIGINT AS plan_id, NULL::INT AS day_index, count(*) AS chunks FROM chunks GROUP BY ALL
UNION ALL SELECT item_id + 1000000000, CAST(item_id % 20 AS INT), 'manual', item_id, 1, 1 FROM benchmark WHERE item_id % 8 <> 5""",
    "set_material_status": f"""SELECT material_id, CASE material_id % 7 WHEN 0 THEN 'processing' WHEN 1 THEN 'failed' WHEN 2 THEN 'uploaded' WHEN 3 THEN 'ocr_ready' WHEN 4 THEN 'ready' ELSE 'pending' END AS parse_status,
md5(CASE material_id % 7 WHEN 1 THEN substr(text, 1, 2000) WHEN 6 THEN CASE WHEN material_id % 4 = 0 THEN 'old error' END END) AS error_md5,
CAST(CASE WHEN material_id % 7 IN (3, 4) THEN length(filename) ELSE 0 END AS INT) AS chunk_count FROM {_M}""",
}
