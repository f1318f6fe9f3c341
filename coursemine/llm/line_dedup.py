"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

The index has two tables.  ``counts`` holds, per line key (128-bit hash), the number of
documents that contain it.  ``filters`` holds, per shard of the keys, a cuckoo filter of
the keys that have reached the threshold, and the hashes of the other counted keys that
this filter would wrongly accept (about one in ten thousand); with these exceptions a
filter answers exactly for every counted key.  Documents can be inserted and deleted:
the counts change by their lines, and only keys that cross the threshold enter or leave
a filter, which a cuckoo filter, unlike a Bloom filter, can do in place.

Keys are spread over shards by hash, so a line that a third of all documents share is
one counted key like any other: counts are combined before the shuffle.  Filters go to
the tasks that read the documents when their size, summed first, is within a bound;
beyond it, (document, key) pairs go to the shards instead, each shard's pairs cut into
slices by document, with the same result.

Defined results: a null or empty text is one empty line, kept; lines of white space have
no key and stay; a repeated row is a document of its own; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from coursemine.llm.common import cut, lower_ascii, mixed, shared_folder, strip_ascii, whole

THRESHOLD = 10
SLOTS = 4
KICKS = 500
# Counted keys per shard, so that a shard fits one task easily, and filter bytes that may be sent to every task.
SHARD_KEYS = 1 << 19
BROADCAST_BYTES = 64 << 20
# (document, key) pairs per slice of a shard on the way without broadcast.
SLICE_PAIRS = 1 << 19
FILTER_SCHEMA = "shard int, slots binary, wrong binary"


def line_keys(text: Column) -> Column:
    """Key of every line in order; empty where the line has none."""
    return F.transform(F.split(text, "\n", -1), lambda x: lower_ascii(strip_ascii(x)))


def _hashed(df: DataFrame, key: str) -> DataFrame:
    """128 bits of the key as two longs."""
    return df.withColumn("h1", F.xxhash64(key)).withColumn("h2", F.xxhash64(F.lit(1), F.col(key)))


def count_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """h1, h2, n: documents that hold the line.  Keys are made distinct inside their document, without a shuffle."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(whole(text)))).alias("key")).filter(F.col("key") != "")
    return _hashed(keys, "key").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


# ---- cuckoo filter: an array of buckets of four 16-bit fingerprints; 0 is a free slot ----

def _prints(h2: np.ndarray) -> np.ndarray:
    return (h2.astype(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _other(prints: np.ndarray) -> np.ndarray:
    """What the two buckets of a fingerprint differ by."""
    return mixed(prints).astype(np.int64) & np.int64(0x7FFFFFFF)


def empty_filter(keys: int) -> np.ndarray:
    """Room for so many keys at a load of at most two thirds; a power of two of buckets."""
    return np.zeros((1 << max(2, int(np.ceil(np.log2(max(keys, 1) * 1.5 / SLOTS)))), SLOTS), np.uint16)


def contains(slots: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    prints, mask = _prints(h2), np.int64(len(slots) - 1)
    one = h1 & mask
    two = one ^ (_other(prints) & mask)
    return (slots[one] == prints[:, None]).any(1) | (slots[two] == prints[:, None]).any(1)


def insert(slots: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> bool:
    """Put every key in; False when a key finds no place, and the filter must be built larger."""
    mask, rng = len(slots) - 1, np.random.default_rng(len(slots))
    prints = _prints(h2)
    for at, p, step in zip((h1 & np.int64(mask)).tolist(), prints.tolist(), _other(prints).tolist()):
        for _ in range(KICKS):
            free = next((b for b in (at, at ^ (step & mask)) if not slots[b].all()), None)
            if free is not None:
                slots[free, int(np.argmin(slots[free] != 0))] = p
                break
            # Both buckets are full: move a resident to its other bucket and go on from there.
            place = int(rng.integers(SLOTS))
            at = at ^ (step & mask) if rng.integers(2) else at
            p, slots[at, place] = int(slots[at, place]), p
            step = int(_other(np.array([p], np.uint16))[0])
            at ^= step & mask
        else:
            return False
    return True


def delete(slots: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
    """Take out keys that are in the filter; one equal fingerprint in one of its two buckets goes."""
    mask = len(slots) - 1
    prints = _prints(h2)
    for at, p, step in zip((h1 & np.int64(mask)).tolist(), prints.tolist(), _other(prints).tolist()):
        for b in (at, at ^ (step & mask)):
            found = np.flatnonzero(slots[b] == p)
            if len(found):
                slots[b, found[0]] = 0
                break


def _shard_of(shards: int) -> Column:
    return F.pmod(F.shiftright("h1", 40), F.lit(shards)).cast("int")


def _update_shard(threshold: int):
    def run(key, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = keys["h1"].to_numpy(np.int64), keys["h2"].to_numpy(np.int64)
        before, after = keys["before"].to_numpy() >= threshold, keys["after"].to_numpy() >= threshold
        slots = np.frombuffer(old["slots"].iloc[0], np.uint16).reshape(-1, SLOTS).copy() if len(old) else None
        placed = slots is not None
        if placed:
            delete(slots, h1[before & ~after], h2[before & ~after])
            placed = insert(slots, h1[~before & after], h2[~before & after])
        room = int(after.sum())
        while not placed:
            slots = empty_filter(room)
            placed = insert(slots, h1[after], h2[after])
            room = 2 * room + 8
        wrong = ~after & contains(slots, h1, h2)
        exact = np.stack([h1[wrong], h2[wrong]], 1)
        return pd.DataFrame({"shard": [int(key[0])], "slots": [slots.tobytes()], "wrong": [exact.tobytes()]})

    return run


def update_filters(old: DataFrame, keys: DataFrame, shards: int, threshold: int) -> DataFrame:
    """Filters after the counts of ``keys`` (h1, h2, before, after; all counted keys) have changed."""
    keys = keys.withColumn("shard", _shard_of(shards))
    return old.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(_update_shard(threshold), FILTER_SCHEMA)


class _Shards:
    """All filters of an index in the memory of a task."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], shards: int) -> None:
        self.shards, self.rows = shards, {r[0]: (np.frombuffer(r[1], np.uint16).reshape(-1, SLOTS), r[2]) for r in rows}

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        shard = (h1 >> np.int64(40)) % self.shards
        for s, (slots, wrong) in self.rows.items():
            at = np.flatnonzero(shard == s)
            if len(at):
                out[at] = accepted(slots, wrong, h1[at], h2[at])
        return out


def accepted(slots: np.ndarray, wrong: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    hit = contains(slots, h1, h2)
    bad = np.frombuffer(wrong, np.int64).reshape(-1, 2)
    at = np.flatnonzero(hit)
    if len(bad) and len(at):
        known = set(map(tuple, bad.tolist()))
        hit[at] = [(a, b) not in known for a, b in zip(h1[at].tolist(), h2[at].tolist())]
    return hit


class LineIndex:
    """Counts and filters of the lines of a changing set of documents, kept in a shared folder.

    Every change writes a new version beside the old one and then switches to it, so a
    change that dies half-way leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, threshold: int = THRESHOLD, shard_keys: int = SHARD_KEYS, folder: str | None = None) -> None:
        self.spark, self.threshold, self.shard_keys = spark, threshold, shard_keys
        self.folder = folder or f"{shared_folder(spark)}/lines-{uuid.uuid4()}"
        self.version, self.shards = 0, 0

    def counts(self) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(f"{self.folder}/v{self.version}/counts")

    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTER_SCHEMA).parquet(f"{self.folder}/v{self.version}/filters")

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._change(count_lines(docs, text))

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take out documents that were inserted before."""
        return self._change(count_lines(docs, text).withColumn("n", -F.col("n")))

    def _change(self, delta: DataFrame) -> LineIndex:
        to = f"{self.folder}/v{self.version + 1}"
        if self.version:
            old = self.counts().select("h1", "h2", F.col("n").alias("before"), F.lit(0).cast("long").alias("change"))
            both = old.unionByName(delta.select("h1", "h2", F.lit(0).cast("long").alias("before"), F.col("n").alias("change")))
            both = both.groupBy("h1", "h2").agg(F.sum("before").alias("before"), F.sum("change").alias("change"))
            keys = both.select("h1", "h2", "before", (F.col("before") + F.col("change")).alias("after"))
        else:
            keys = delta.select("h1", "h2", F.lit(0).cast("long").alias("before"), F.col("n").alias("after"))
        keys.write.parquet(f"{to}/keys")
        keys = self.spark.read.schema("h1 long, h2 long, before long, after long").parquet(f"{to}/keys")
        keys.filter("after > 0").select("h1", "h2", F.col("after").alias("n")).write.parquet(f"{to}/counts")
        shards = 1 << max(0, int(np.ceil(np.log2(max(keys.count(), 1) / self.shard_keys))))
        kept = self.version and shards <= self.shards
        shards = self.shards if kept else shards
        old = self.filters() if kept else self.spark.createDataFrame([], FILTER_SCHEMA)
        # With other shards than before the filters are built anew, from the counts alone.
        rows = keys if kept else keys.withColumn("before", F.lit(0).cast("long"))
        update_filters(old, rows, shards, self.threshold).write.parquet(f"{to}/filters")
        self.version, self.shards = self.version + 1, shards
        return self

    def frequent_lines(self, docs: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``docs`` with ``__drop``: for each line whether its key is frequent.  All lines of ``docs`` must be counted in the index."""
        size = self.filters().agg(F.sum(F.length("slots") + F.length("wrong")).alias("n")).first()["n"] or 0
        if size <= broadcast_bytes:
            held = self.spark.sparkContext.broadcast([tuple(r) for r in self.filters().collect()])
            return docs.withColumn("__drop", _probe(held, self.shards)(*_hash_lists(text)))
        return self._routed(docs, text)

    def _routed(self, docs: DataFrame, text: str) -> DataFrame:
        """The same answer from the shards: pairs go to (shard, slice of the documents), answers go back to the documents."""
        docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
        pairs = docs.select("__row", F.explode(F.array_distinct(line_keys(whole(text)))).alias("key")).filter(F.col("key") != "")
        pairs = _hashed(pairs, "key").drop("key").withColumn("shard", _shard_of(self.shards))
        per_shard = pairs.groupBy("shard").agg(F.count(F.lit(1)).alias("pairs"))
        slices = self.filters().join(per_shard, "shard").withColumn("slices", F.ceil(F.col("pairs") / SLICE_PAIRS).cast("int"))
        filters = slices.select("shard", "slots", "wrong", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        pairs = pairs.join(slices.select("shard", "slices"), "shard").withColumn(
            "slice", F.pmod(F.xxhash64("__row"), F.col("slices")).cast("int"))

        def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            slots = np.frombuffer(right["slots"].iloc[0], np.uint16).reshape(-1, SLOTS)
            hit = accepted(slots, right["wrong"].iloc[0], left["h1"].to_numpy(np.int64), left["h2"].to_numpy(np.int64))
            return left.loc[hit, ["__row", "h1"]]

        hits = pairs.drop("slices").groupBy("shard", "slice").cogroup(filters.groupBy("shard", "slice")).applyInPandas(
            answer, "__row long, h1 long")
        found = hits.groupBy("__row").agg(F.collect_set("h1").alias("__found"))
        hashes = F.transform(line_keys(whole(text)), lambda k: F.when(k != "", F.xxhash64(k)))
        none = F.expr("cast(array() as array<bigint>)")
        dropped = F.transform(hashes, lambda h: h.isNotNull() & F.coalesce(F.array_contains(F.coalesce("__found", none), h), F.lit(False)))
        return docs.join(found, "__row", "left").withColumn("__drop", dropped).drop("__row", "__found")


def _hash_lists(text: str) -> list[Column]:
    keys = line_keys(whole(text))
    return [
        F.transform(keys, lambda k: F.when(k != "", F.xxhash64(k))),
        F.transform(keys, lambda k: F.when(k != "", F.xxhash64(F.lit(1), k))),
    ]


def _probe(held, shards: int):
    """Arrow function: two lists of hashes per document to a list of flags; a null hash (no key) is false."""
    @F.arrow_udf("array<boolean>")
    def probe(one: pa.Array, two: pa.Array) -> pa.Array:
        all_shards = _Shards(held.value, shards)
        flat1, flat2 = one.flatten(), two.flatten()
        has = flat1.is_valid().to_numpy(zero_copy_only=False)
        h1 = flat1.fill_null(0).to_numpy(zero_copy_only=False)
        h2 = flat2.fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(one).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(has & all_shards.holds(h1, h2)))

    return probe


def drop_lines(docs: DataFrame, index: LineIndex, text: str = "text", **options: int) -> DataFrame:
    """``docs`` with frequent lines taken out of the text; other columns as they are."""
    return split_lines(docs, index, text, **options).withColumn(text, F.col("__kept")).select(*docs.columns)


def split_lines(docs: DataFrame, index: LineIndex, text: str = "text", **options: int) -> DataFrame:
    """``docs`` with ``__drop`` (a flag per line) and ``__kept``: the other lines joined by a line feed."""
    flagged = index.frequent_lines(docs, text, **options)
    kept = F.filter(F.split(whole(text), "\n", -1), lambda x, i: ~F.get("__drop", i))
    return flagged.withColumn("__kept", F.array_join(kept, "\n"))
