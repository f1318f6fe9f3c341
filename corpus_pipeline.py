"""Corpus pipeline: documents through five operators, each stage written and read again.

Stages take and give the columns of ``documents``; the last adds ``copy``.  Each works on
what its predecessor kept: line counts, groups of copies and source sizes are its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from coursemine.fixtures import table
from coursemine.llm import decontamination, line_dedup, mixing, quality_rules, simhash
from coursemine.llm.common import shared_folder


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source does."""
    return quality_rules.keep_good(docs, F.col("source"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; ``n_chars`` follows the text."""
    index = line_dedup.LineIndex(spark).insert(docs)
    return line_dedup.drop_lines(docs, index).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_documents(docs)


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("simhash", near_copies), ("decontamination", benchmark), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


# The near copies and the mix have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict = {}
