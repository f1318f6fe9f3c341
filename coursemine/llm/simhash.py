"""SimHash near-dedup with BK-trees over shards of the fingerprints.

Fingerprints within ``radius`` bits share, when the 64 bits are cut into radius + 2
blocks, at least two whole blocks.  Every pair of blocks with its bits is a shard; the
distinct fingerprints of a shard form a BK-tree (children keyed by their distance to the
parent), and a search follows only the edges within the radius of the distance at hand.
A shard's tree is sent to the tasks that hold queries of that shard: one, or several
where a shard is large.  Trees of all fingerprints are never brought together, as they
grow with the corpus.  From each shard only a spanning forest of its links leaves, so a
large group of near copies gives one row per member and not all pairs.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is
linked like any other; repeated rows are copies of each other; a null id never is the
smallest unless all ids of a component are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from coursemine.llm.common import cut, mixed
from coursemine.llm.components import components
from coursemine.llm.windows import Memo
from coursemine.operators.ranking import is_small

RADIUS = 4
SHINGLE = 4
SEED = 42
# Fingerprints of a shard that one task queries, and rows per task of shards.
SLICE = 4096
TASK_ROWS = 100_000
# Dropped rows (an id and a hash) up to this many go to every task; beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: str, n: int) -> list[bytes]:
    """Word n-grams of the ASCII-lowered text, repeats included; the whole sequence when it is shorter."""
    w = text.encode().lower().split()
    joined = b" ".join(w)
    if len(w) <= n:
        return [joined] if w else []
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[n - 1:] - 1).tolist())]


def simhash(text: str | None, n: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint: a bit is set where it is set in over half of the shingles' hashes."""
    parts = shingles(text or "", n)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(parts), 65536):  # bounded memory for very long texts
        h = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts[at:at + 65536]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, n: int = SHINGLE) -> Column:
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), n) for t in texts], pa.int64())

    return run(text)


def _shards(fp: str, radius: int, blocks: int) -> Column:
    """For every choice of as many blocks as must agree: its number and the fingerprint's bits there."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[
        F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(signed(sum(masks[c] for c in chosen)))))
        for i, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ])


class BkTree:
    """Distinct 64-bit values; a child hangs at its Hamming distance from the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (value, {})
                return
            node = node[1][d]

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [self.root] if self.root else []
        while stack:
            node, children = stack.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                yield node
            stack += [child for edge, child in children.items() if d - radius <= edge <= d + radius]


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _link_shard(nodes: list[int], fps: list[int], wide: list[int | None], asks: list[bool], radius: int, wide_radius: int) -> Iterator[tuple[int, int]]:
    """(member, representative) for every linked member of a shard."""
    tree, at = BkTree(), {}
    for i, fp in enumerate(fps):
        tree.add(fp)
        at.setdefault(fp, []).append(i)
    parent = {i: i for i in range(len(nodes))}
    for i in (i for i, a in enumerate(asks) if a):
        for fp in tree.within(fps[i], radius):
            for j in at[fp]:
                a, b = _root(parent, i), _root(parent, j)
                if a != b and (wide[i] is None or (wide[i] ^ wide[j]).bit_count() <= wide_radius):
                    parent[b] = a
    for i in parent:
        r = _root(parent, i)
        if r != i:
            yield nodes[i], nodes[r]


def _link_task(radius: int, wide_radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shard", "node"])
        shard, node, fp = (rows[c].to_numpy(np.int64) for c in ("shard", "node", "fp"))
        asks, fp = rows["asks"].tolist(), fp.view(np.uint64).tolist()
        wide = [None if x is None else int.from_bytes(x, "little") for x in rows["wide"]]
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        pairs = [
            pair for a, b in zip(cuts, cuts[1:])
            for pair in _link_shard(node[a:b].tolist(), fp[a:b], wide[a:b], asks[a:b], radius, wide_radius)
        ]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})

    return run


def link(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, wide_radius: int = 0) -> DataFrame:
    """u, v: links among distinct nodes (node, fp, wide) that connect exactly what lies within ``radius`` bits.

    Where ``wide`` is not null, linked nodes must lie within ``wide_radius`` bits of it as well.
    Of ``blocks`` blocks, blocks - radius agree; more blocks make more and smaller shards.
    Shards of one node are dropped.  Small shards share a task; a shard of more than
    ``SLICE`` nodes is split by query, its tree going to every slice.
    """
    rows = nodes.select("node", "fp", "wide", F.explode(_shards("fp", radius, blocks or radius + 2)).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = rows.join(sizes, "shard").withColumn("slices", F.ceil(F.col("size") / SLICE).cast("int"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select(
        "shard", "node", "fp", "wide", (F.pmod(F.xxhash64("node"), F.col("slices")) == F.col("slice")).alias("asks"),
        F.pmod(F.xxhash64("shard", "slice"), F.lit(total // TASK_ROWS + 1)).alias("task"),
    )
    return rows.groupBy("task").applyInPandas(_link_task(radius, wide_radius), "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """key, fp (long), component_id: smallest key of the documents reachable over links of at most ``radius`` bits.

    Exact copies meet first: one row per fingerprint goes on, and partial aggregation
    keeps a group of copies from meeting in one task.
    """
    prints = cut(docs.select(F.col(key), fingerprint(F.col(text), n).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min(key).alias("first")))
    nodes = distinct.select(F.col("fp").alias("node"), "fp", F.lit(None).cast("binary").alias("wide"))
    found = components(link(nodes, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    members = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(members, "fp").select(key, "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- near copies by similarity: fingerprints find candidates, sketches judge them, the sets of shingles decide what is in doubt ----

# Five-word shingles and Jaccard similarity of near copies; bits of distinct words that may
# differ among candidates of the trees.
COPY_SHINGLE = 5
COPY_SIMILARITY = 0.8
COPY_RADIUS = 2
# Candidates also share the BAND least hashes of one of BANDS orders of the shingles: at
# similarity s a pair meets with probability 1 - (1 - s^4)^12, 0.998 at 0.8.
BAND, BANDS = 4, 12
# A sketch is the least shingle hash of each of so many bins, in eight bits; the second
# number holds for documents whose doubtful pairs are too many for the first.
BINS, MORE_BINS = 256, 4096
# A sketch decides alone where its estimate is so many standard errors, and SLACK for equal
# bytes of different hashes, from the similarity asked for.
ERRORS, SLACK = 4.0, 0.01
# Doubtful pairs that a document may have in one shard before the finer sketch is asked.
DOUBTFUL = 2
# Nodes of a shard in a part; parts meet pairwise.
PART = 4096
_ORDERS = mixed(np.arange(1, BAND * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def _majority(hashes: np.ndarray) -> int:
    """Signed 64 bits, set where over half of the hashes have them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _hashes(parts) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles."""
    return np.sort(_hashes(set(shingles(text or "", COPY_SHINGLE))))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(parts: np.ndarray, bins: int) -> bytes:
    """A byte per bin of the sorted hashes: 0 for an empty one, else of its least member."""
    at = (parts >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros(bins, np.uint8)
    out[at[first]] = 1 + mixed(parts[first]) % np.uint64(255)
    return out.tobytes()


def copy_prints(text: str | None) -> dict:
    """node: hash of the set of shingles; n: its size; fp: fingerprint of the distinct longer words; bands: hashes of the set's
    least members; sketch.

    Shingles change with every edit and words hardly, so words find near copies within a
    few bits; short words are left out as all texts of a language share them.  A passage
    put in changes many words at once; such copies meet in a band.
    """
    distinct = set((text or "").encode().lower().split())
    long_words = [w for w in distinct if len(w) > 4] or list(distinct)
    parts = shingle_set(text)
    least = np.full(len(_ORDERS), np.uint64(2**64 - 1))
    for at in range(0, len(parts), 16384):
        least = np.minimum(least, (parts[at:at + 16384, None] * _ORDERS).min(0))
    bands = [xxhash.xxh64_intdigest(m.tobytes(), k) - (1 << 63) for k, m in enumerate(least.reshape(BANDS, BAND))] if len(parts) else []
    return {
        "node": xxhash.xxh64_intdigest(parts.tobytes()) - (1 << 63), "n": len(parts), "fp": _majority(_hashes(long_words)),
        "bands": bands, "sketch": sketch(parts, BINS),
    }


PRINTS = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
# What a pair that leaves a shard is: alike beyond doubt; to be compared; left for the finer sketch.
SURE, OPEN, PUT_OFF = 0, 1, 2


def _judged(sketches: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimated similarities of node i to others, and whether these are beyond doubt at least ``similarity``, or may be.

    Bins are a sample of the union of both sets without repetition, so the error of an
    estimate vanishes where the bins hold nearly all of the union.
    """
    a, b = sketches[i], sketches[others]
    filled = ((a > 0) | (b > 0)).sum(1)
    alike = ((a == b) & (a > 0)).sum(1) / np.maximum(filled, 1)
    union = (n[i] + n[others]) / (1 + alike)
    error = ERRORS * np.sqrt(similarity * (1 - similarity) / np.maximum(filled, 1) * np.maximum(1 - filled / union, 0)) + SLACK
    return alike, alike - error >= similarity, alike + error >= similarity


def _candidate_shard(node, fp, n, group, sketches, tree: bool, similarity: float, most: int | None) -> Iterator[tuple[int, int, int]]:
    """(u, v, kind), u < v, for the candidates of a shard, whose nodes come in order of their sizes.

    Left out are pairs of one group and pairs that sure ones connect; doubtful pairs beyond
    ``most`` of a node are put off, and a spanning forest of these leaves.
    """
    bits = np.packbits(sketches & 1, axis=1).view("<u8")
    bins = sketches.shape[1]
    # the low bits of a bin differ in half of the cases where its members do
    far = bins * (1 - similarity) / 2 + ERRORS * np.sqrt(bins * (1 - similarity) / 2) + 1
    found, at = BkTree(), {}
    if tree:
        for i, x in enumerate(fp):
            found.add(x)
            at.setdefault(x, []).append(i)
    around = Memo(lambda x: np.sort(np.concatenate([at[y] for y in found.within(x, COPY_RADIUS)])), 500)
    last = np.searchsorted(n, n / similarity * (1 + 1e-9), side="right")
    seen = np.arange(len(node))
    told = lambda i, j, kind: (int(min(node[i], node[j])), int(max(node[i], node[j])), kind)
    apart = len(np.unique(group))
    for i in range(len(node)):
        if apart == 1:
            return
        others = around[fp[i]] if tree else np.arange(i + 1, last[i])
        others = others[(others > i) & (others < last[i])]
        others = others[group[others] != group[i]]
        others = others[np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64) <= far]
        if not len(others):
            continue
        alike, sure, maybe = _judged(sketches, n, i, others, similarity)
        for j in others[sure][np.unique(group[others[sure]], return_index=True)[1]].tolist():
            apart -= 1
            yield told(i, j, SURE)
        group[np.isin(group, group[others[sure]])] = group[i]
        open_at = maybe & (group[others] != group[i])
        for rank, k in enumerate(np.flatnonzero(open_at)[np.argsort(-alike[open_at], kind="stable")].tolist()):
            j = others[k]
            if most is None or rank < most:
                yield told(i, j, OPEN)
            elif seen[i] != seen[j]:
                seen[seen == seen[j]] = seen[i]
                yield told(i, j, PUT_OFF)


def _candidate_task(similarity: float, most: int | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shard", "n", "node"])
        shard, node, n, group = (rows[c].to_numpy(np.int64) for c in ("shard", "node", "n", "member_of"))
        fp, tree = rows["fp"].to_numpy(np.int64).view(np.uint64).tolist(), rows["tree"].to_numpy(bool)
        sketches = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        out = {
            pair for a, b in zip(cuts, cuts[1:])
            for pair in _candidate_shard(node[a:b], fp[a:b], n[a:b], group[a:b].copy(), sketches[a:b], tree[a], similarity, most)
        }
        both = np.array(sorted(out), np.int64).reshape(-1, 3)
        return pd.DataFrame({"u": both[:, 0], "v": both[:, 1], "kind": both[:, 2]})

    return run


def candidates(nodes: DataFrame, similarity: float, most: int | None, bins: int = BINS) -> DataFrame:
    """u, v, kind: pairs of nodes (node, n, fp, bands, sketch, member_of) that are alike or to be compared.

    They meet within ``COPY_RADIUS`` bits of the words, found by BK-trees of shards as in
    ``link``, or in a band.  Shards of one node are dropped before sketches travel; a
    shard of more than ``PART`` nodes is cut into parts that meet pairwise.
    """
    trees = _shards("fp", COPY_RADIUS, COPY_RADIUS + 2)
    n_trees = len(list(combinations(range(COPY_RADIUS + 2), 2)))
    rows = nodes.select("node", F.posexplode(F.concat(trees, F.col("bands"))).alias("pos", "shard"))
    rows = rows.select("node", (F.col("pos") < n_trees).alias("tree"), "shard")
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    rows = cut(rows.join(sizes, "shard").withColumn("parts", F.ceil(F.col("size") / PART).cast("int")))
    own = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int")
    rows = rows.select("node", "tree", "shard", "size", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.select("node", "tree", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("shard"))
    total = rows.count()
    rows = rows.join(nodes.select("node", "n", "fp", "sketch", "member_of"), "node")
    rows = rows.withColumn("task", F.pmod(F.xxhash64(F.lit("task"), "shard"), F.lit(total * bins // (BINS * TASK_ROWS) + 1)))
    task = _candidate_task(similarity, most)
    return rows.groupBy("task").applyInPandas(task, "u long, v long, kind long").groupBy("u", "v").agg(F.min("kind").alias("kind"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = pa.array([shingle_set(t.as_py()).tobytes() for t in b.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), sets], ["node", "parts"])


def _texts_of(needed: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, parts: the sets of shingles of the needed nodes, made of the texts (id, h, t) anew."""
    needed = cut(nodes.join(needed, "node").select("node", F.col("first")["id"].alias("_id"), F.col("first")["h"].alias("_h")))
    side = F.broadcast(needed) if is_small(needed, BROADCAST_ROWS) else needed
    found = texts.join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("node", "t")
    return found.mapInArrow(_sets, "node long, parts binary").groupBy("node").agg(F.first("parts").alias("parts"))


def _compared(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) whose sets of shingles are as similar as asked."""
    sets = cut(_texts_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, texts))

    @F.arrow_udf("boolean")
    def same(left: pa.Array, right: pa.Array) -> pa.Array:
        read = lambda x: np.frombuffer(x.as_py(), np.uint64)
        return pa.array([jaccard(read(a), read(b)) >= similarity for a, b in zip(left, right)], pa.bool_())

    left, right = (sets.select(F.col("node").alias(c), F.col("parts").alias(f"{c}_parts")) for c in ("u", "v"))
    return pairs.join(left, "u").join(right, "v").filter(same("u_parts", "v_parts")).select("u", "v")


def copy_links(nodes: DataFrame, texts: DataFrame, similarity: float = COPY_SIMILARITY) -> DataFrame:
    """u, v: links that connect all candidates whose sets of shingles are ``similarity`` alike.

    A sketch decides where its error leaves no doubt, the sets themselves decide the rest.
    Documents with more doubtful pairs than ``DOUBTFUL`` in a shard meet once more, with
    finer sketches, without the pairs that are connected by then and without a bound.
    """
    pairs = cut(candidates(nodes.withColumn("member_of", F.col("node")), similarity, DOUBTFUL))
    links = cut(pairs.filter(F.col("kind") == SURE).select("u", "v").unionByName(
        _compared(pairs.filter(F.col("kind") == OPEN).select("u", "v"), nodes, texts, similarity)))
    again = cut(pairs.filter(F.col("kind") == PUT_OFF).select(F.explode(F.array("u", "v")).alias("node")).distinct())
    if not again.take(1):
        return links

    @F.arrow_udf("binary")
    def fine(parts: pa.Array) -> pa.Array:
        return pa.array([sketch(np.frombuffer(x.as_py(), np.uint64), MORE_BINS) for x in parts], pa.binary())

    groups = components(links).select(F.col("u").alias("node"), F.col("v").alias("member_of"))
    sketches = _texts_of(again, nodes, texts).select("node", fine("parts").alias("sketch"))
    asked = nodes.drop("sketch").join(sketches, "node").join(groups, "node", "left")
    asked = cut(asked.withColumn("member_of", F.coalesce("member_of", "node")))
    pairs = cut(candidates(asked, similarity, None, MORE_BINS))
    more = _compared(pairs.filter(F.col("kind") == OPEN).select("u", "v"), nodes, texts, similarity)
    return links.unionByName(pairs.filter(F.col("kind") == SURE).select("u", "v")).unionByName(more)


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = COPY_SIMILARITY) -> DataFrame:
    """One row of each group of near copies, documents linked by a Jaccard similarity of ``similarity`` or more: of the smallest key (null first), its other columns as they are."""
    @F.arrow_udf("struct<node: bigint, n: bigint, fp: bigint, bands: array<bigint>, sketch: binary>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([copy_prints(t.as_py()) for t in texts], PRINTS)

    text_hash = F.xxhash64(F.lit(7), F.col(text))
    prints = docs.select(F.col(key).alias("id"), text_hash.alias("h"), run(F.col(text)).alias("p"))
    prints = cut(prints.select("id", "h", "p.*"))
    nodes = cut(prints.groupBy("node").agg(
        F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min(F.struct("id", "h")).alias("first")))
    texts = docs.select(F.col(key).alias("id"), text_hash.alias("h"), F.col(text).alias("t"))
    found = components(copy_links(nodes, texts, similarity)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = nodes.select("node", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    members = rooted.join(kept, "root").select("node", "kept")
    same = F.col("id").eqNullSafe(F.col("kept")["id"]) & (F.col("h") == F.col("kept")["h"])
    judged = cut(prints.select("id", "h", "node").join(members, "node").select("id", "h", same.alias("stays")))
    gone = judged.filter(~F.col("stays")).select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
    again = judged.filter("stays").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.col("id").alias("__id"), F.col("h").alias("__h"))
    on = F.col(key).eqNullSafe(F.col("__id")) & (text_hash == F.col("__h"))
    small = lambda side: F.broadcast(side) if is_small(side, BROADCAST_ROWS) else side
    rest = docs.join(small(gone), on, "left_anti")
    again = cut(again)
    if not again.take(1):
        return rest
    # Repeated rows of a document that stays: only these are brought together, to keep one of each.
    single = rest.join(small(again), on, "left_anti")
    repeated = rest.join(small(again), on, "left_semi").dropDuplicates([key, text])
    return single.unionByName(repeated)
