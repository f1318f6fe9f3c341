"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursemine.operators.ranking import top_per_key

# White space of the word rule, for SQL trims and for Java patterns.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def whole(text: str | Column = "text") -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, other letters as they are.

    ``lower`` does the same to ASCII text and is much faster than ``translate``,
    which is left to texts with other characters.
    """
    slow = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(slow)


def strip_ascii(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def words(c: Column) -> Column:
    """Words of a non-null text as an array, none for a blank one."""
    bare = strip_ascii(c)
    return F.when(bare == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(bare, SPACES))


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n).cast("int")


def _sample_order(key: str) -> Column:
    return F.xxhash64(F.lit("fit"), F.col(key))


def group_sizes(df: DataFrame, group: str, key: str) -> dict:
    """Rows and least hash of a key of each non-null group, for ``hash_sample``; the groups must be few."""
    place = F.shiftrightunsigned(_sample_order(key), 11)
    found = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"))
    return {r[0]: (r["n"], r["least"]) for r in found.collect()}


def hash_sample(df: DataFrame, group: str, key: str, sizes: dict, k: int, tie: Column | None = None) -> DataFrame:
    """At most k rows of each group in the order of a hash of the key; null groups go.

    ``sizes`` are the ``group_sizes``.  Rows whose hash lies above the share that twice k makes of
    the group go before the shuffle, so the task of a group gets some 2k rows, however large the group
    and however many the input tasks.  Rows of one key share a hash: a group with much-repeated keys may
    yield fewer than k, but never none.
    """
    wanted = 2 * k + 40
    limits = [(g, max(int(min(1.0, wanted / n) * 2**53), least)) for g, (n, least) in sizes.items()]
    limits = df.sparkSession.createDataFrame(limits, f"_group {df.schema[group].dataType.simpleString()}, _limit long")
    near = df.join(F.broadcast(limits), F.col(group) == F.col("_group")).withColumn("_order", _sample_order(key))
    place = F.shiftrightunsigned("_order", 11)
    near = near.filter(place <= F.col("_limit"))
    by = [place, F.col("_order"), F.col(key), *([] if tie is None else [tie])]
    return top_per_key(near, [group], by, k, "_rank").select(*df.columns)


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: spark.checkpoint.dir; a temporary folder only where it is unset and all runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("coursemine.local.checkpoint", None) or tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("coursemine.local.checkpoint", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialize in the shared checkpoint folder: computed once, and kept when executors go."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table, which compresses and prunes columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored or checkpointed table that nothing will read again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frames made here lose the files of their shuffles when an action on them ends; for frames that are stored or checkpointed at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: spreads every input bit over the word."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
