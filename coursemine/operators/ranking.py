"""Ranking, numbering and running totals that survive a key holding a third of the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key.

    ``row_number() <= k`` is planned with a group limit before the shuffle, so at
    most k rows per key and input task travel, however large the key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as a max aggregate: combined before the shuffle, one row per key and task."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def _block_offsets(df: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Sum of ``amount`` over the earlier blocks of each key; as many rows as there are blocks."""
    totals = df.groupBy(*keys, "_block").agg(amount.alias("_total"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_before"))


def number_in_key(df: DataFrame, keys: list[str], block: Column, order: list[Column], name: str) -> DataFrame:
    """Consecutive 1-based number of each row within its key.

    ``block`` is any value that grows with ``order`` and holds a bounded number
    of rows per key (a page or line number divided by a constant, a day).  Rows are
    numbered inside their block, and blocks are shifted by the size of the earlier
    ones, so no task sees a whole key.
    """
    df = df.withColumn("_block", block)
    offsets = _block_offsets(df, keys, F.count(F.lit(1)))
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    return (
        df.withColumn("_in_block", F.row_number().over(w))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, (F.col("_before") + F.col("_in_block")).cast("int"))
        .drop("_block", "_before", "_in_block")
    )


def running_sum(
    df: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over this and all earlier rows of the key, block by block as in ``number_in_key``."""
    df = df.withColumn("_block", block)
    offsets = _block_offsets(df, keys, F.sum(value))
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_in_block", F.sum(value).over(w))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.col("_in_block"))
        .drop("_block", "_before", "_in_block")
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as written once below the shared checkpoint folder, or below the warehouse: several readers, one computation."""
    spark = df.sparkSession
    base = (spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")
    path = f"{base}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether the side has at most ``max_rows`` rows; counting stops there.  Asked before a broadcast hint."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi-join whose big side may have hot keys: it is cut into salts, the small side is repeated per salt."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
