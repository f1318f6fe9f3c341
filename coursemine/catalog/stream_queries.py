"""Registered queries on conversations, caches, jobs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemine.catalog import duck as d
from coursemine.catalog.source_queries import scratch
from coursemine.catalog.text_queries import SEP
from coursemine.fixtures import table, view
from coursemine.functions import fixed_values as fv
from coursemine.functions.text import fingerprint
from coursemine.operators import conversations as cv
from coursemine.sources import corpus as co, tables as tb
from coursemine.streaming import incremental as ic, jobs as jb

LATIN_RULES = [
    ("insert", [["que", "the "]]), ("adjust", [["an"], ["ou", "ing"]]), ("read_page", [["PDF", "page"]]), ("review", [["ti"]]), ("search", [["er", "le"]]),
]
LATIN_MARKERS = ["the ", "que "]


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def q_last_user_message(spark, sf):
    return cv.last_user_message(turns(spark, sf))


def q_recent_turns(spark, sf):
    return cv.recent_turns(turns(spark, sf), 3).select("conv_id", "turn", "role", "from_end")


def _lined(spark, sf):
    """Turns with answer-like marks put before some of their lines."""
    mark = F.when(F.col("turn") % 3 == 0, "## ").when(F.col("turn") % 3 == 1, "2. ").otherwise("")
    return turns(spark, sf).withColumn("text", F.concat(mark, F.col("text"), F.when(F.col("turn") % 4 == 1, "\nB. last option").otherwise("")))


def q_useful_lines(spark, sf):
    return cv.useful_lines(_lined(spark, sf)).select("conv_id", "turn", "line_no", "line")


def q_compress_history(spark, sf):
    return cv.compress_history(_lined(spark, sf), 900)


def q_fit_context(spark, sf):
    return cv.fit_context(turns(spark, sf), budget=2400, compress_at=1200, most_per_message=1000)


def q_fitted_messages(spark, sf):
    m = cv.fitted_messages(turns(spark, sf), budget=2400, compress_at=1200, most_per_message=1000, target=600)
    return m.select("conv_id", "turn", "role", F.length("text").alias("chars"))


def q_classify_intent(spark, sf):
    m = turns(spark, sf).select("conv_id", "turn", F.col("text").alias("message"))
    k = F.col("conv_id")
    context = {"has_goal": k % 7 != 0, "has_plan": k % 3 != 0, "has_page": k % 2 == 0}
    return cv.classify_intent(m, rules=LATIN_RULES, markers=LATIN_MARKERS, **context).select("conv_id", "turn", "intent", F.md5("payload").alias("payload_md5"))


def q_session_index(spark, sf):
    e = table(spark, sf, "events")
    u = F.col("user_id")
    w = e.select(
        F.when(F.col("event_id") % 17 != 0, u.cast("string")).alias("id"), F.col("event_id").alias("write_no"),
        cv.session_title(F.concat_ws("  ", "event_type", "props", F.col("event_id").cast("string"))).alias("title"),
        cv.session_context(F.when(u % 4 == 0, u), F.when(u % 3 == 0, u), F.when(u % 2 == 0, u)).alias("context_type"),
        F.lit("2024").alias("created_at"), F.when(F.col("event_id") % 13 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("updated_at"),
    )
    return cv.session_index(w)


def _page_hashes(spark, sf):
    p = co.page_texts(view(spark, sf, "pages")).filter("readable")
    return p.select("material_id", "page_index", F.lit("zh").alias("target_lang"), fingerprint(F.col("text")).alias("text_hash"))


def _translations(spark, sf):
    """Cached translations, outdated ones for every fourth page."""
    p = _page_hashes(spark, sf)
    return p.withColumn("text_hash", F.when(F.col("page_index") % 4 == 0, F.sha2("text_hash", 256)).otherwise(F.col("text_hash"))).select(
        *ic.CACHE_KEY, F.lit("fr").alias("source_lang"), F.concat(F.lit("old "), F.col("page_index").cast("string")).alias("translated_text")
    )


def q_translation_lookup(spark, sf):
    hits, misses = ic.translation_lookup(_page_hashes(spark, sf), _translations(spark, sf))
    a = hits.select("material_id", "page_index", F.lit("hit").alias("outcome"), "translated_text")
    return a.unionByName(misses.select("material_id", "page_index", F.lit("miss").alias("outcome"), F.lit(None).cast("string").alias("translated_text")))


def _written(spark, sf):
    """Translations as they are written: two for every page, the second one later on some and earlier on the others."""
    rows = _page_hashes(spark, sf).withColumn("source_lang", F.lit("en"))
    late = F.when(F.col("page_index") % 5 == 1, 2).otherwise(0)
    return rows.withColumn("seq", F.lit(1)).withColumn("translated_text", F.lit("first")).unionByName(
        rows.withColumn("seq", late).withColumn("translated_text", F.lit("second"))
    )


def q_upsert_cache(spark, sf):
    return ic.upsert_cache(_translations(spark, sf), _written(spark, sf))


def q_upsert_cache_stream(spark, sf):
    """The rows arrive in slices that mix first and second translations; the older cache is the first version."""
    out, check = scratch(spark, "cache"), scratch(spark, "check")
    rows = _written(spark, sf).select(*ic.CACHE_KEY, "source_lang", "translated_text", "seq")
    tb.write_version(_translations(spark, sf).withColumn("seq", F.lit(None).cast("int")).select(*rows.columns), out, 0)
    _replay(spark, rows, F.pmod(F.xxhash64(*ic.CACHE_KEY, "seq"), F.lit(1000)), lambda stream: ic.upsert_cache_stream(stream, out, check))
    return ic.cached(spark, out)


def _replay(spark: SparkSession, df: DataFrame, order: F.Column, start, steps: int = 3) -> None:
    """Let the rows arrive in ``steps`` slices by ``order``; ``start(stream)`` runs once after each arrival."""
    path = scratch(spark, "arrivals")
    timed = df.withColumn("_order", order.cast("double"))
    bounds = timed.approxQuantile("_order", [i / steps for i in range(1, steps)], 0.01)
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        part = timed
        if low is not None:
            part = part.filter(F.col("_order") > low)
        if high is not None:
            part = part.filter(F.col("_order") <= high)
        part.drop("_order").write.mode("append").parquet(path)
        start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()


def _job_events(spark, sf):
    v = view(spark, sf, "events")
    return v.withColumn("ts", F.col("ts").cast("timestamp")).withColumn(
        "result", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string")))
    ).withColumn("error", F.when(F.col("status") == "failed", F.concat(F.lit("e"), F.col("event_id").cast("string"))))


def _state_out(df):
    return df.select("job_id", "status", "progress", "result", "error_message", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("finished_at"))


def q_job_state(spark, sf):
    return _state_out(ic.job_state(_job_events(spark, sf)))


def q_job_state_stream(spark, sf):
    out, check = scratch(spark, "jobs"), scratch(spark, "check")
    e = _job_events(spark, sf)
    _replay(spark, e, F.unix_timestamp("ts"), lambda stream: ic.job_state_stream(stream, out, check))
    return _state_out(tb.newest(spark, out, ["job_id"]))


def q_job_track_stream(spark, sf):
    """Jobs followed event by event, those that were silent for two days marked."""
    out, check = scratch(spark, "tracked"), scratch(spark, "check")
    _replay(spark, _job_events(spark, sf), F.unix_timestamp("ts"), lambda stream: jb.track_jobs_stream(stream, out, check, "2 days", "1 hour"))
    t = tb.newest(spark, out, ["job_id"])
    return _state_out(t).join(t.select("job_id", "stalled"), "job_id")


def q_job_progress(spark, sf):
    e = view(spark, sf, "events")
    stages = list(fv.STAGE_RATIO) + ["ocr_running", "waiting"]
    n = F.col("event_id")
    staged = e.select(
        "job_id", "event_id", (n % 5).cast("int").alias("file_index"), (n % 5 + 1 + n % 3).cast("int").alias("file_count"),
        F.element_at(F.array(*[F.lit(s) for s in stages]), (n % len(stages) + 1).cast("int")).alias("stage"),
        F.when(n % 7 != 0, (n % 40).cast("int")).alias("current_page"), (n % 30).cast("int").alias("total_pages"),
    )
    return ic.job_progress(staged).select("job_id", "event_id", "stage", "progress")


def _arriving(spark, sf):
    m = view(spark, sf, "material")
    return m.select("material_id", F.when(F.col("material_id") % 25 == 7, "  ").otherwise(F.col("text")).alias("text"))


def q_stream_ingest(spark, sf):
    """All materials arrive in slices, are enriched and embedded; every one ends as chunks or as a failure."""
    a, b, check = scratch(spark, "chunks"), scratch(spark, "status"), scratch(spark, "check")
    _replay(spark, _arriving(spark, sf), F.col("material_id"), lambda stream: ic.stream_ingest(stream, a, b, check))
    chunks = ic.stored_chunks(spark, a, b).groupBy("material_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content_raw")).alias("chars"), F.sum(F.size("key_terms")).alias("terms"),
        F.sum(F.size("embedding")).alias("dims"))
    none = F.lit(0).cast("bigint")
    bad = ic.ingest_failures(spark, b).select("material_id", none.alias("chunks"), none.alias("chars"), none.alias("terms"), none.alias("dims"), "error_message")
    return chunks.withColumn("error_message", F.lit(None).cast("string")).unionByName(bad)


def q_ingest_batch(spark, sf):
    """The enriched form of ingestion as one batch."""
    stored, _ = ic.ingest_batch(_arriving(spark, sf))
    return stored.select("material_id", "chunk_index", "document_id", "source_lang", F.size("key_terms").alias("n_terms"), F.size("embedding").alias("dims"))


def q_ingest_failures(spark, sf):
    """Materials of which no chunk comes."""
    return ic.ingest_batch(_arriving(spark, sf))[1]


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

# --- oracle -------------------------------------------------------------------
_LINED = """ln AS (SELECT conv_id, turn, role, concat(CASE turn % 3 WHEN 0 THEN '## ' WHEN 1 THEN '2. ' ELSE '' END, text, CASE WHEN turn % 4 = 1 THEN concat(chr(10), 'B. last option') ELSE '' END) AS text FROM conversations)"""
_USE = " OR ".join(f"regexp_matches(x, {d.q(p)})" for p in fv.USEFUL_LINE_PATTERNS)
_SHOW = f"substr({d.strip(d.sub('x', r'^(#{1,6}' + chr(92) + 's+|[-*+]' + chr(92) + 's+)', '', ''))}, 1, 500)"
_UL = f"""{_LINED}, ul AS (SELECT conv_id, turn, role, text, list_transform(list_filter(list_transform(string_split_regex(text, {d.q(d.LINE_BREAK)}), lambda x: {d.strip('x')}), lambda x: x <> '' AND ({_USE})), lambda x: {_SHOW})[1:24] AS ls FROM ln)"""
_HEAD = f"concat('{fv.HISTORY_HEADER}', chr(10), '{fv.HISTORY_COUNT}', n_turns, chr(10), '{fv.HISTORY_POINTS}')"
_COMP = f"""{_UL}, nb AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS tn, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM ul),
pc AS (SELECT *, concat(tn, '. ', role, '：') AS hd, substr(replace({d.strip('text')}, chr(10), ' '), 1, 300) AS pv FROM nb),
pp AS (SELECT *, CASE WHEN len(ls) > 0 THEN concat(hd, chr(10), array_to_string(list_transform(ls[1:10], lambda x: concat('- ', x)), chr(10))) WHEN pv <> '' THEN concat(hd, pv) END AS piece FROM pc),
gr AS (SELECT *, length({_HEAD}) + coalesce(sum(length(piece) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pp),
al AS (SELECT conv_id, concat({_HEAD}, coalesce(concat(chr(10), string_agg(piece, chr(10) ORDER BY turn) FILTER (WHERE before < TARGET OR tn = 1)), '')) AS s,
  CAST(sum(length(text)) AS BIGINT) AS original_chars FROM gr GROUP BY conv_id, n_turns)"""
_CUT = "CASE WHEN length(s) > TARGET THEN concat(substr(s, 1, TARGET - 20), chr(10), '" + fv.HISTORY_CUT + "') ELSE s END"
_FIT = f"""rc AS (SELECT conv_id, turn, role, text, length(text) AS chars, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS from_end FROM conversations WHERE {d.strip('text')} <> '' QUALIFY from_end <= 12),
fd AS (SELECT *, coalesce(max(CASE WHEN from_end > 4 THEN chars END) OVER (PARTITION BY conv_id), 0) > 1200 OR (max(from_end) OVER (PARTITION BY conv_id) > 4 AND sum(chars) OVER (PARTITION BY conv_id) > 2400) AS folded FROM rc),
ft AS (SELECT *, CASE WHEN from_end > 4 AND folded THEN 'compress' WHEN chars > 1000 THEN 'clamp' ELSE 'keep' END AS action FROM fd)"""
_PG = f"""pg0 AS (SELECT material_id, page_index, coalesce(nullif({d.strip('ocr_text')}, ''), nullif({d.strip('built_in_text')}, ''), '') AS t FROM {d.view('pages')}),
pg AS (SELECT material_id, page_index, 'zh' AS target_lang, sha256(t) AS text_hash FROM pg0 WHERE t <> ''),
tc AS (SELECT material_id, page_index, target_lang, CASE WHEN page_index % 4 = 0 THEN sha256(text_hash) ELSE text_hash END AS text_hash, 'fr' AS source_lang, concat('old ', page_index) AS translated_text FROM pg)"""
_ACC = """CASE WHEN conv_id % 7 = 0 THEN 'chat' WHEN contains(text, 'que') OR contains(text, 'the ') THEN 'insert' WHEN conv_id % 3 <> 0 AND contains(text, 'an') AND (contains(text, 'ou') OR contains(text, 'ing')) THEN 'adjust'
 WHEN conv_id % 2 = 0 AND (contains(text, 'PDF') OR contains(text, 'page')) THEN 'read_page' WHEN conv_id % 3 <> 0 AND contains(text, 'ti') THEN 'review' WHEN contains(text, 'er') OR contains(text, 'le') THEN 'search' ELSE 'chat' END"""
_AFTER = lambda m: d.strip(f"substr(text, instr(text, {d.q(m)}) + {len(m)})")
_STATE = """je AS (SELECT job_id, event_id, ts, status, CASE status WHEN 'pending' THEN 0 WHEN 'success' THEN 100 WHEN 'running' THEN greatest(0, least(100, progress)) END AS progress,
  CASE WHEN event_id % 3 = 0 THEN concat('r', event_id) END AS result, CASE WHEN status = 'failed' THEN concat('e', event_id) END AS error FROM EV),
js AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, CAST(coalesce(arg_max(progress, (ts, event_id)) FILTER (WHERE progress IS NOT NULL), 0) AS INT) AS progress,
  arg_max(result, (ts, event_id)) FILTER (WHERE result IS NOT NULL) AS result, arg_max(error, (ts, event_id)) FILTER (WHERE status = 'failed') AS err, max(ts) FILTER (WHERE status IN ('success', 'failed')) AS fin FROM je GROUP BY job_id)
SELECT job_id, status, progress, result, CASE WHEN status = 'failed' THEN err END AS error_message, strftime(date_trunc('second', fin), '%Y-%m-%d %H:%M:%S') AS finished_at FROM js""".replace("EV", d.view("events"))
_STAGES = list(fv.STAGE_RATIO) + ["ocr_running", "waiting"]
_RATIO = "CASE " + " ".join(f"WHEN stage = '{s}' THEN {v}::DOUBLE" for s, v in fv.STAGE_RATIO.items()) + " ELSE 0.15::DOUBLE END"

ORACLE = {
    "last_user_message": f"SELECT conv_id, coalesce({d.strip('arg_max(text, turn) FILTER (WHERE role = ' + d.q('user') + ')')}, '') AS message FROM conversations GROUP BY conv_id",
    "recent_turns": f"SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS from_end FROM conversations WHERE {d.strip('text')} <> '' QUALIFY from_end <= 3",
    "useful_lines": f"WITH {_UL} SELECT conv_id, turn, CAST(unnest(range(len(ls))) AS INT) AS line_no, unnest(ls) AS line FROM ul",
    "compress_history": f"WITH {_COMP} SELECT conv_id, {_CUT} AS summary, CAST(length({_CUT}) AS INT) AS summary_chars, original_chars FROM al".replace("TARGET", "900"),
    "fit_context": f"WITH {_FIT} SELECT conv_id, turn, role, CAST(chars AS INT) AS chars, from_end, action FROM ft",
    "fitted_messages": (f"WITH {_FIT}, cv AS (SELECT conv_id, turn, role, text FROM ft WHERE action = 'compress'), " + _COMP.replace(_LINED, "ln AS (SELECT * FROM cv)")
        + f" SELECT conv_id, -1::BIGINT AS turn, 'assistant' AS role, CAST(length({_CUT}) AS INT) AS chars FROM al UNION ALL SELECT conv_id, turn, role, CAST(CASE WHEN chars > 1000 THEN 920 ELSE chars END AS INT) FROM ft WHERE action <> 'compress'").replace("TARGET", "600"),
    "classify_intent": f"""SELECT conv_id, turn, {_ACC} AS intent, CASE WHEN {_ACC} = 'insert' THEN md5(CASE WHEN contains(text, 'the ') THEN coalesce(nullif({_AFTER('the ')}, ''), text)
  WHEN contains(text, 'que ') THEN coalesce(nullif({_AFTER('que ')}, ''), text) ELSE text END) END AS payload_md5 FROM conversations""",
    "session_index": """WITH w AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS write_no, concat_ws(' ', event_type, props, event_id) AS t,
  CASE WHEN user_id % 4 = 0 THEN 'pdf' WHEN user_id % 3 = 0 THEN 'plan' WHEN user_id % 2 = 0 THEN 'goal' ELSE 'general' END AS context_type, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS updated_at
  FROM events WHERE event_id % 17 <> 0 AND event_id % 13 <> 0)
SELECT id, write_no, CASE WHEN length(t) > 20 THEN concat(substr(t, 1, 20), '...') ELSE t END AS title, context_type, '2024' AS created_at, updated_at FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY write_no DESC) = 1""",
    "translation_lookup": f"WITH {_PG} SELECT pg.material_id, pg.page_index, CASE WHEN tc.text_hash IS NULL THEN 'miss' ELSE 'hit' END AS outcome, translated_text FROM pg LEFT JOIN tc USING (material_id, page_index, target_lang, text_hash)",
    "upsert_cache": f"""WITH {_PG}, nw AS (SELECT material_id, page_index, target_lang, text_hash, 'en' AS source_lang, CASE WHEN page_index % 5 = 1 THEN 'second' ELSE 'first' END AS translated_text FROM pg)
SELECT * FROM nw UNION ALL SELECT * FROM tc WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.material_id = tc.material_id AND nw.page_index = tc.page_index AND nw.text_hash = tc.text_hash)""",
    "upsert_cache_stream": f"""WITH {_PG}, nw AS (SELECT material_id, page_index, target_lang, text_hash, 'en' AS source_lang, CASE WHEN page_index % 5 = 1 THEN 'second' ELSE 'first' END AS translated_text FROM pg)
SELECT * FROM nw UNION ALL SELECT * FROM tc WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.material_id = tc.material_id AND nw.page_index = tc.page_index AND nw.text_hash = tc.text_hash)""",
    "job_state": f"WITH {_STATE}",
    "job_state_stream": f"WITH {_STATE}",
    "job_track_stream": f"""WITH {_STATE.replace(" AS finished_at FROM js", f""" AS finished_at, status NOT IN ('success', 'failed')
  AND epoch_ms(last_ts) + 48 * 3600000 < epoch_ms((SELECT max(ts) FROM {d.view('events')})) - 3600000 AS stalled FROM js""").replace("max(ts) FILTER", "max(ts) AS last_ts, max(ts) FILTER")}""",
    "job_progress": f"""WITH e AS (SELECT job_id, event_id, event_id % 5 AS fi, event_id % 5 + 1 + event_id % 3 AS fc, {d.lst(_STAGES)}[event_id % {len(_STAGES)} + 1] AS stage, CASE WHEN event_id % 7 <> 0 THEN event_id % 40 END AS cp, event_id % 30 AS tp FROM {d.view('events')}),
s AS (SELECT *, 10 + fi * 60 // fc AS st, greatest(1, (fi + 1) * 60 // fc - fi * 60 // fc) AS span,
  CASE WHEN stage = 'ocr_running' AND tp <> 0 AND cp IS NOT NULL THEN 0.08::DOUBLE + least(1.0::DOUBLE, cp / tp::DOUBLE) * 0.45::DOUBLE ELSE {_RATIO} END AS r FROM e)
SELECT job_id, event_id, stage, CAST(greatest(0, least(100, st + floor(span * r))) AS INT) AS progress FROM s""",
}


def _ingest() -> dict[str, str]:
    from coursemine.catalog.text_queries import enriched_cte

    enriched = f"""{d.chunks_cte()}, src AS (SELECT material_id, chunk_index, content AS text, {d.clean('content')} AS rt FROM chunks WHERE material_id % 25 <> 7), {enriched_cte('src')}"""
    lost = f"SELECT material_id FROM {d.view('material')} WHERE material_id % 25 = 7 OR material_id NOT IN (SELECT material_id FROM chunks)"
    return {
        "ingest_batch": f"""WITH {enriched}
SELECT material_id, chunk_index, concat('material_', material_id, '_chunk_', chunk_index) AS document_id, source_lang, CAST(n_terms AS INT) AS n_terms, 384 AS dims FROM enr""",
        "ingest_failures": f"WITH {d.chunks_cte()} SELECT material_id, '{ic.NO_TEXT}' AS error_message FROM ({lost})",
        "stream_ingest": f"""WITH {enriched}, n AS (SELECT material_id, CAST(sum(n_terms) AS BIGINT) AS terms FROM enr GROUP BY material_id)
SELECT material_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, any_value(terms) AS terms, 384 * count(*) AS dims, NULL::VARCHAR AS error_message
FROM chunks JOIN n USING (material_id) WHERE material_id % 25 <> 7 GROUP BY material_id
UNION ALL SELECT material_id, 0, 0, 0, 0, '{ic.NO_TEXT}' FROM ({lost})""",
    }


ORACLE.update(_ingest())
