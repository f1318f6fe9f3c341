"""Document fingerprints: a wide SimHash of weighted terms, and classes of fingerprints within a Hamming radius.

Terms are pairs of neighbouring words; each adds its weight, 1 + ln(occurrences), to the
bits set in its hash and takes it from the others, and the signs of the sums are the
fingerprint.  Of ``BITS`` bits cut into radius + 1 blocks, two fingerprints within the
radius share a block; a table per block, permuted so that this block leads, brings them
together, and the distance over all bits decides.  Tasks give out a spanning forest of the
links they find, never all pairs; a long run of equal blocks is cut into parts that meet
pairwise.

``edited`` compares a document with itself after its end was replaced by the beginning of
the next document.  Rows are sorted by range, so a task holds neighbours and passes on one
row at a time; only the first and last row of each task are brought together afterwards.

Defined results: a null text counts as empty; a text without words has fingerprint zero;
words are cut at ASCII white space and A-Z are lower-cased; a single word is a term.  Ids
go in falling order, null last, rows of one id in order of a hash of the text and of the
text; a single row is its own next document; an empty table gives no rows; other columns
are ignored.  The class of a fingerprint is the smallest id reachable over links (a null
id only where there is no other).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from coursemine.llm.common import cut, mixed, whole
from coursemine.llm.components import components
from coursemine.llm.windows import MEMO, Memo, rolling, word_code

BITS = 256
TERM_WORDS = 2
RADIUS = 8
# Fingerprints of one block value in a part, and rows of tables in a task.
PART = 16_384
TASK_ROWS = 100_000
_SALTS = [0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) for i in range(BITS // 64)]


class Hasher:
    """Fingerprints of texts; the codes of words seen before are kept, up to a bound."""

    def __init__(self) -> None:
        self.codes = Memo(word_code, MEMO)

    def __call__(self, text: str) -> bytes:
        codes = np.array([self.codes[w] for w in text.encode().lower().split()], np.uint64)
        terms = codes if len(codes) < TERM_WORDS else rolling(codes, TERM_WORDS).view(np.uint64)
        terms, times = np.unique(terms, return_counts=True)
        # weights in sixteenths, so that sums are exact and equal texts agree to the last bit
        weights = np.rint(16 * (1 + np.log(times))).astype(np.int64)
        votes, all_weights = np.zeros(BITS, np.int64), int(weights.sum())
        for w in np.unique(weights):
            same = terms[weights == w]
            for at in range(0, len(same), 16384):
                part = np.stack([mixed(same[at:at + 16384] + np.uint64(s)) for s in _SALTS], 1)
                votes += w * np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(0, dtype=np.int64)
        return np.packbits(2 * votes > all_weights).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprint(text: Column) -> Column:
    """Fingerprint as lower-case hex digits."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        of = Hasher()
        return pa.array([of(t.as_py() or "").hex() for t in texts], pa.string())

    return run(text)


# ---- documents against their edited text ----

DIGEST = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
# What a row of a sorted task is: finished, or the first or last of the task, whose text goes on.
DONE, FIRST, LAST = 0, 1, 2


def edit(text: str, following: str) -> str:
    """The last third of the text replaced by as many code points from the beginning of the next one, or by all of it."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _digest(of: Hasher, text: str, own: bytes, following: str, next_one: bytes) -> tuple:
    changed = edit(text, following)
    other = of(changed)
    return (len(text), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, next_one))


def _neighbours(kind: pa.DataType):
    """Rows of a sorted task: a digest for each but the last, and the texts of the first and the last."""
    names = ["part", "role", "_key", "_text", *(c.split()[0] for c in DIGEST.split(", "))]
    types = [pa.int64(), pa.int64(), kind, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, before = Hasher(), TaskContext.get().partitionId(), None
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                now = (key, text, of(text))
                if before is None:
                    rows.append((part, FIRST, key, text, *[None] * 6))
                else:
                    rows.append((part, DONE, before[0], None, *_digest(of, before[1], before[2], text, now[2])))
                before = now
            if rows:
                yield told(rows)
        if before is not None:
            yield told([(part, LAST, before[0], before[1], *[None] * 6)])

    return run


def edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the columns of ``DIGEST`` for every row."""
    kind = docs.select(key).schema[0].dataType
    columns = [c.split()[0] for c in DIGEST.split(", ")]
    rows = docs.select(F.col(key).alias("_key"), whole(text).alias("_text"))
    order = [F.col("_key").desc_nulls_last(), F.xxhash64("_text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "_text")
    arrow = rows.select("_key").limit(0).toArrow().schema.field(0).type
    schema = f"part bigint, role bigint, _key {kind.simpleString()}, _text string, {DIGEST}"
    found = cut(rows.mapInArrow(_neighbours(arrow), schema))
    ends = found.filter(F.col("role") != DONE)
    # one number per task of the sort
    parts = sorted(r["part"] for r in ends.filter(F.col("role") == FIRST).select("part").collect())
    done = found.filter(F.col("role") == DONE).select(F.col("_key").alias(key), *columns)
    if not parts:
        return done
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, follower long")
    first = ends.filter(F.col("role") == FIRST).select(F.col("part").alias("follower"), F.col("_text").alias("following"))
    last = ends.filter(F.col("role") == LAST).select("part", "_key", "_text").join(after, "part").join(first, "follower")

    @F.arrow_udf(f"struct<{DIGEST.replace(' ', ': ').replace(',: ', ', ')}>")
    def digest(texts: pa.Array, following: pa.Array) -> pa.Array:
        of = Hasher()
        pairs = [(a.as_py(), b.as_py()) for a, b in zip(texts, following)]
        return pa.array([dict(zip(columns, _digest(of, a, of(a), b, of(b)))) for a, b in pairs])

    closed = last.select(F.col("_key").alias(key), digest("_text", "following").alias("d")).select(key, "d.*")
    return done.unionByName(closed)


# ---- classes within a radius, by permuted block tables ----

def blocks(radius: int = RADIUS) -> list[tuple[int, int]]:
    """Start and length, in hex digits, of the radius + 1 blocks."""
    ends = [BITS // 4 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _links(prints: list[str], radius: int) -> Iterator[tuple[str, str]]:
    """A spanning forest of the links among the fingerprints of one block value."""
    bits = np.frombuffer(bytes.fromhex("".join(prints)), "<u8").reshape(len(prints), -1)
    label = np.arange(len(prints))
    for i in range(len(prints) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
        others = others[np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64) <= radius]
        for j in others[np.unique(label[others], return_index=True)[1]].tolist():
            yield prints[i], prints[j]
        label[np.isin(label, label[others])] = label[i]


def _table(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["table", "print"])
        runs, prints = rows["table"].to_numpy(), rows["print"].tolist()
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
        pairs = [p for a, b in zip(cuts, cuts[1:]) for p in _links(prints[a:b], radius)]
        return pd.DataFrame({"u": pd.Series([p[0] for p in pairs], dtype=object), "v": pd.Series([p[1] for p in pairs], dtype=object)})

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links that connect exactly the distinct fingerprints (``print``, hex) within ``radius`` bits of each other."""
    tables = F.array(*[F.xxhash64(F.lit(t), F.substring("print", a + 1, n)) for t, (a, n) in enumerate(blocks(radius))])
    rows = prints.select("print", F.explode(tables).alias("run"))
    sizes = cut(rows.groupBy("run").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    rows = rows.join(sizes, "run").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    own = F.pmod(F.xxhash64(F.lit("part"), "print"), F.col("parts")).cast("int")
    rows = rows.select("print", "run", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("print", F.xxhash64("run", F.least("own", "other"), F.greatest("own", "other")).alias("table"))
    task = F.pmod(F.col("table"), F.lit(total // TASK_ROWS + 1)).alias("task")
    return rows.select("print", "table", task).groupBy("task").applyInPandas(_table(radius), "u string, v string").distinct()


def classes(prints: DataFrame, radius: int = RADIUS, key: str = "doc_id", column: str = "fingerprint") -> DataFrame:
    """``column``, class_id: of every fingerprint of the rows, the smallest key reachable over links of at most ``radius`` bits."""
    distinct = cut(prints.groupBy(F.col(column).alias("print")).agg(F.min(key).alias("least")))
    found = components(links(distinct, radius)).select(F.col("u").alias("print"), F.col("v").alias("root"))
    rooted = distinct.join(found, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    return rooted.join(least, "root").select(F.col("print").alias(column), "class_id")
