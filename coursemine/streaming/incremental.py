"""Caches, job state and incremental ingestion; each batch operator and its streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from coursemine.functions import fixed_values as fv
from coursemine.operators.chunking import chunk_documents, chunk_text
from coursemine.operators.enrichment import enrich_chunks
from coursemine.operators.ranking import latest_per_key
from coursemine.operators.vectors import hash_embed
from coursemine.sources.tables import VERSION, claim_version, document_id, newest, read_version, versions, write_version

CACHE_KEY = ["material_id", "page_index", "target_lang", "text_hash"]


# --- translation cache --------------------------------------------------------


def translation_lookup(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): a cached translation counts only while the page's text hash still matches."""
    hits = pages.join(cache, CACHE_KEY)
    return hits, pages.join(cache.select(*CACHE_KEY), CACHE_KEY, "left_anti")


def upsert_cache(cache: DataFrame, rows: DataFrame, order: str = "seq") -> DataFrame:
    """Cache after the rows are written: the newest row per key replaces, others are added."""
    rest = [c for c in cache.columns if c not in CACHE_KEY]
    old = cache.withColumn("_at", F.struct(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("s")))
    new = rows.withColumn("_at", F.struct(F.lit(1).alias("g"), F.col(order).cast("bigint").alias("s"))).select(*old.columns)
    both = old.unionByName(new).groupBy(*CACHE_KEY).agg(F.max_by(F.struct(*rest), "_at").alias("_r"))
    return both.select(*CACHE_KEY, *[F.col("_r")[c].alias(c) for c in rest])


def upsert_cache_stream(rows: DataFrame, cache_path: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Arriving translations are appended, the newest row per key of each micro-batch; ``cached`` reads the cache.

    The order of writing, not that of arrival, decides, so late and repeated rows do no harm.
    """
    def run(batch: DataFrame, number: int) -> None:
        write_version(latest_per_key(batch, CACHE_KEY, [order]), cache_path, claim_version(batch, cache_path, number))

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(spark: SparkSession, cache_path: str, order: str = "seq") -> DataFrame:
    """The cache as last written; rows without a number, as of a cache that was there before, are the oldest."""
    return latest_per_key(versions(spark, cache_path), CACHE_KEY, [order, VERSION]).drop(order, VERSION)


# --- jobs ---------------------------------------------------------------------


def job_state(events: DataFrame) -> DataFrame:
    """State per job of events (job_id, event_id, ts, status, progress, result, error).

    One aggregation of max_by terms, combined before the shuffle; it runs
    unchanged on a stream in update or complete mode.
    """
    order = F.struct("ts", "event_id")
    status, ended = F.col("status"), F.col("status").isin("success", "failed")
    progress = (
        F.when(status == "pending", 0).when(status == "success", 100)
        # without a number of its own the event leaves progress as it was (least and greatest skip nulls)
        .when((status == "running") & F.col("progress").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))))
    )
    at = lambda test: F.when(test, order)
    state = events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by(progress, at(progress.isNotNull())).alias("progress"),
        F.max_by("result", at(F.col("result").isNotNull())).alias("result"),
        F.max_by("error", at(status == "failed")).alias("_error"),
        F.max(F.when(ended, F.col("ts"))).alias("finished_at"),
    )
    failed = F.col("status") == "failed"
    return state.select(
        "job_id", "status", F.coalesce("progress", F.lit(0)).cast("int").alias("progress"), "result",
        F.when(failed, F.substring("_error", 1, 2000)).alias("error_message"), "finished_at",
    )


def job_state_stream(events: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Changed job states of each micro-batch are appended; ``newest`` reads the last state per job."""
    def run(batch: DataFrame, number: int) -> None:
        write_version(batch, table_path, claim_version(batch, table_path, number))

    return (
        job_state(events).writeStream.outputMode("update").foreachBatch(run)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def job_progress(events: DataFrame) -> DataFrame:
    """Progress of file-processing events (file_index, file_count, stage, current_page, total_pages)."""
    n = F.greatest(F.lit(1), F.col("file_count"))
    start = 10 + F.floor(F.col("file_index") * 60 / n)
    end = 10 + F.floor((F.col("file_index") + 1) * 60 / n)
    span = F.greatest(F.lit(1), end - start)
    paged = (F.col("stage") == "ocr_running") & (F.coalesce("total_pages", F.lit(0)) != 0) & F.col("current_page").isNotNull()
    by_page = F.lit(0.08) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("current_page") / F.col("total_pages"))) * F.lit(0.45)
    ratio = F.when(paged, by_page)
    for stage, value in fv.STAGE_RATIO.items():
        ratio = ratio.when(F.col("stage") == stage, value)
    progress = start + F.floor(span * ratio.otherwise(fv.STAGE_RATIO_OTHER))
    return events.withColumn("progress", F.greatest(F.lit(0), F.least(F.lit(100), progress)).cast("int"))


# --- ingestion ----------------------------------------------------------------

NO_TEXT = "No readable text in material"


def ingest_chunks(materials: DataFrame) -> DataFrame:
    """Stored rows of all chunks of arriving materials (material_id, text, …), enriched and embedded, in one pass."""
    chunks = chunk_documents(materials.select("material_id", "text"))
    full = hash_embed(enrich_chunks(chunks), "embedding_text", out="embedding")
    c = F.col("content")
    rows = full.withColumn("document_id", document_id()).withColumn("content_preview", F.substring(c, 1, fv.PREVIEW_CHARS))
    return rows.withColumn("content_raw", F.coalesce("content_raw", c) if "content_raw" in full.columns else c).drop("content", "embedding_text")


def ingest_batch(materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored chunks, failures) of arriving materials; every material is in one of the two."""
    failed = F.size(chunk_text(F.coalesce("text", F.lit("")))) == 0
    failures = materials.filter(failed).select("material_id", F.lit(NO_TEXT).alias("error_message"))
    return ingest_chunks(materials), failures


def stream_ingest(
    materials: DataFrame,
    chunk_path: str,
    status_path: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame] = ingest_chunks,
) -> StreamingQuery:
    """Arriving materials replace their chunks; those without a chunk fail and the rest continue.

    A micro-batch writes its chunks once, as a version of its own, and then one status
    row per material, counted from what was written.  Readers go by the newest status
    (``stored_chunks``, ``ingest_failures``), so a batch that dies between the two writes
    is not seen, and its repetition overwrites both versions.
    """
    def run(batch: DataFrame, number: int) -> None:
        number = claim_version(batch, status_path, number)
        write_version(process(batch), chunk_path, number)
        written = read_version(batch.sparkSession, chunk_path, number)
        counts = written.groupBy("material_id").agg(F.count(F.lit(1)).alias("chunks"))
        status = batch.select("material_id").distinct().join(counts, "material_id", "left")
        failed = F.when(F.col("chunks").isNull(), NO_TEXT)
        write_version(status.select("material_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), failed.alias("error_message")), status_path, number)

    return materials.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_chunks(spark: SparkSession, chunk_path: str, status_path: str) -> DataFrame:
    """Chunks of each material as of its newest status."""
    status = newest(spark, status_path, ["material_id"], keep_version=True).select("material_id", VERSION)
    return versions(spark, chunk_path).join(status, ["material_id", VERSION], "left_semi").drop(VERSION)


def compact_ingested(spark: SparkSession, chunk_path: str, status_path: str, to_chunks: str, to_status: str) -> None:
    """Live chunks and newest statuses as the first version of two other tables, to which readers and the stream then switch.

    Chunks that a material no longer has stay out; the statuses, which make chunks visible, are written last.
    """
    number = versions(spark, status_path).agg(F.max(VERSION)).first()[0] or 0
    write_version(stored_chunks(spark, chunk_path, status_path), to_chunks, number)
    write_version(newest(spark, status_path, ["material_id"]), to_status, number)


def ingest_failures(spark: SparkSession, status_path: str) -> DataFrame:
    """Materials whose newest status is a failure."""
    return newest(spark, status_path, ["material_id"]).filter(F.col("error_message").isNotNull()).select("material_id", "error_message")
