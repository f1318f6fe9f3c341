"""Table maintenance: replacing, deleting, back-filling and status changes, as whole-table jobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursemine.functions import fixed_values as fv
from coursemine.operators.chunking import chunk_text
from coursemine.operators.ranking import latest_per_key

# child table → (parent table, key): the tree along which deletes cascade
FOREIGN_KEYS = {
    "plan": ("goal", "goal_id"),
    "task": ("plan", "plan_id"),
    "quiz": ("plan", "plan_id"),
    "review": ("plan", "plan_id"),
    "adjustment": ("goal", "goal_id"),
    "material": ("goal", "goal_id"),
    "chunk": ("material", "material_id"),
    "translation": ("material", "material_id"),
    "job": ("goal", "goal_id"),
}
REPLAN_TABLES = ["quiz", "task", "review", "plan", "adjustment"]


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def document_id() -> Column:
    return F.concat(F.lit("material_"), F.col("material_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Stored form of new chunks (material_id, chunk_index, content)."""
    c = F.col("content")
    raw = F.coalesce(F.col("content_raw"), c) if "content_raw" in chunks.columns else c
    text = F.coalesce(F.col("retrieval_text"), c) if "retrieval_text" in chunks.columns else c
    return chunks.select(
        "material_id", "chunk_index", document_id().alias("document_id"),
        F.substring(c, 1, fv.PREVIEW_CHARS).alias("content_preview"), raw.alias("content_raw"), text.alias("retrieval_text"),
    )


def replace_chunks(target: DataFrame, new: DataFrame, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, materials) after all chunks of the new rows' materials are replaced."""
    rows = chunk_rows(new)
    state = without(target, rows, "material_id").unionByName(rows)
    counts = rows.groupBy("material_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    done = F.col("_n").isNotNull()
    updated = (
        materials.join(counts, "material_id", "left")
        .withColumn("parse_status", F.when(done, "ready").otherwise(F.col("parse_status")))
        .withColumn("error_message", F.when(~done, F.col("error_message")))
        .withColumn("chunk_count", F.coalesce("_n", "chunk_count"))
        .drop("_n")
    )
    return state, updated


VERSION = "version"


def write_version(rows: DataFrame, path: str, number: int) -> None:
    """Append rows as one version of the table; a repeated call overwrites that version and no other."""
    rows.write.mode("overwrite").parquet(f"{path}/{VERSION}={number}")


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{VERSION}={number}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all versions, with the column ``version``."""
    return spark.read.parquet(path).withColumn(VERSION, F.col(VERSION).cast("long"))


CLAIM = "stream string, batch long, version long"


def claim_version(batch: DataFrame, path: str, number: int) -> int:
    """The version that micro-batch ``number`` of the running stream writes to the table.

    It is the one the same batch had when it ran before, else the next after all of the
    table, so that a stream that begins again with a new checkpoint neither overwrites
    nor loses to older versions.  A table has one writer at a time.
    """
    spark, claims = batch.sparkSession, f"{path}/_claims"
    stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
    last = -1
    try:
        held = spark.read.schema(CLAIM).parquet(claims)
        own, last = held.agg(F.max(F.when((F.col("stream") == stream) & (F.col("batch") == number), F.col("version"))), F.max("version")).first()
        if own is not None:
            return own
    except AnalysisException:  # no claim yet
        pass
    try:
        last = max(last, versions(spark, path).agg(F.max(VERSION)).first()[0] or 0)
    except AnalysisException:  # no version yet
        pass
    spark.createDataFrame([(stream, number, last + 1)], CLAIM).coalesce(1).write.mode("append").parquet(claims)
    return last + 1


def newest(spark: SparkSession, path: str, keys: list[str], keep_version: bool = False) -> DataFrame:
    """The row of the last version per key: one aggregate, combined before the shuffle."""
    rows = latest_per_key(versions(spark, path), keys, [VERSION])
    return rows if keep_version else rows.drop(VERSION)


def compact(spark: SparkSession, path: str, to: str, keys: list[str]) -> None:
    """Write the newest rows as the first version of another table; readers then switch to it.

    For tables whose rows are replaced key by key.  A material's chunks are replaced
    together and may become fewer: those are compacted by ``compact_ingested``.
    """
    number = versions(spark, path).agg(F.max(VERSION)).first()[0] or 0
    write_version(newest(spark, path, keys), to, number)


def delete_scope(tables: dict[str, DataFrame], root: str, keys: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting the root rows of ``keys`` and all that hangs below them.

    Deleted parents travel down the tree as key sets; each table is one anti join.
    """
    gone = {root: keys}
    out = dict(tables)
    id_of = {"goal": "goal_id", "plan": "plan_id", "material": "material_id"}
    out[root] = without(tables[root], keys, id_of[root])
    for child, (parent, key) in FOREIGN_KEYS.items():
        if parent in gone and child in tables:
            out[child] = without(tables[child], gone[parent], key)
            if child in id_of:
                gone[child] = tables[child].join(gone[parent].select(key).distinct(), key, "left_semi").select(id_of[child])
    return out


def delete_for_replan(tables: dict[str, DataFrame], goals: DataFrame) -> dict[str, DataFrame]:
    """Drop plans, tasks, quizzes, reviews and adjustments of the goals; goals and materials stay."""
    picked = {k: v for k, v in tables.items() if k in REPLAN_TABLES}
    plans = tables["plan"].join(goals.select("goal_id").distinct(), "goal_id", "left_semi").select("plan_id")
    out = dict(tables)
    for name in picked:
        by_goal = name in ("plan", "adjustment")
        out[name] = without(tables[name], goals, "goal_id") if by_goal else without(tables[name], plans, "plan_id")
    return out


def backfill_schema(df: DataFrame, wanted: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Add the absent columns with their defaults; chunk texts fall back to the preview where null."""
    for name, (kind, default) in wanted.items():
        if name not in df.columns:
            df = df.withColumn(name, (F.lit(None) if default is None else default).cast(kind))
    if "content_preview" in df.columns:
        for name in ("content_raw", "retrieval_text"):
            if name in df.columns:
                df = df.withColumn(name, F.coalesce(name, "content_preview"))
    return df


def ingest_snippets(corpus: DataFrame, snippets: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame]:
    """(corpus, errors): hand-written notes (note_id, goal_id, source_name, content, plan_id, day_index) as materials.

    Note ids are shifted by ``first_id``; notes that give no chunk become error rows.
    """
    readable = F.size(chunk_text(F.coalesce("content", F.lit("")))) > 0
    errors = snippets.filter(~readable).select("note_id", F.lit("No readable text in snippet").alias("error"))
    notes = snippets.filter(readable).select(
        (F.col("note_id") + first_id).alias("material_id"), "goal_id", F.col("source_name").alias("filename"),
        F.lit("manual").alias("file_type"), F.col("content").alias("text"), "plan_id", "day_index",
    )
    return corpus.unionByName(notes, allowMissingColumns=True), errors


def set_material_status(materials: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Materials after outcome rows (material_id, outcome, message, page_count); one outcome per material."""
    m = materials.join(outcomes, "material_id", "left")
    o = F.col("outcome")
    status = F.when(o.isin("processing", "failed", "uploaded", "ocr_ready", "ready"), o).otherwise(F.col("parse_status"))
    error = F.when(o == "failed", F.substring("message", 1, 2000)).when(o.isNull(), F.col("error_message"))
    count = F.when(o == "uploaded", 0).when(o.isin("ocr_ready", "ready"), F.col("page_count")).otherwise(F.col("chunk_count"))
    return m.select(
        *[c for c in materials.columns if c not in ("parse_status", "error_message", "chunk_count")],
        status.alias("parse_status"), error.alias("error_message"), count.cast("int").alias("chunk_count"),
    )
