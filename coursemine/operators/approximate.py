"""Approximate nearest neighbours: k-means cells, product-quantised vectors, exact re-ranking.

An index is fitted on a bounded sample and then describes every vector by its nearest cell
and by one byte per sub-space for what the cell's centre leaves over.  A request
looks only into cells near to it, compares codes by table look-up, and the best of them are
ranked by their true distance.  ``dense_topk`` is the exact search.

Null vectors are no candidates, and requests without a vector have no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from coursemine.operators.ranking import is_small, top_per_key
from coursemine.operators.vectors import _unit, tile_nearest

# Vectors of the sample that an index is fitted on, and codewords of a sub-space (one byte).
SAMPLE = 20_000
CODEWORDS = 256
ROUNDS = 12
# Requests, and neighbours of each, by which the sample shows how many cells a search needs.
PROBES, NEIGHBOURS = 256, 10
# Candidates up to this number (keys only) are sent to the vectors; more meet them in a shuffle.
BROADCAST_CANDIDATES = 200_000


class Index(NamedTuple):
    """Centres (cells × dims), codebooks (sub-spaces × codewords × dims of a sub-space), and for each number of
    cells the share of true neighbours within so many cells, measured on the sample; fixed sizes."""

    centres: np.ndarray
    books: np.ndarray
    shares: np.ndarray

    def cells_for(self, recall: float) -> int:
        """Cells to look into for this share of the neighbours."""
        return min(int(np.searchsorted(self.shares, recall)) + 1, len(self.shares))

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(unit @ self.centres.T - (self.centres**2).sum(1) / 2, axis=1)

    def codes(self, rest: np.ndarray) -> np.ndarray:
        parts = self._split(rest)
        return np.stack([_nearest(p, b) for p, b in zip(parts, self.books)], axis=1).astype(np.uint8)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Inner products of each request's parts with all codewords."""
        return np.stack([p @ b.T for p, b in zip(self._split(unit), self.books)], axis=1)

    def _split(self, x: np.ndarray) -> list[np.ndarray]:
        width = self.books.shape[2]
        x = np.pad(x, ((0, 0), (0, len(self.books) * width - x.shape[1])))
        return [x[:, i * width:(i + 1) * width] for i in range(len(self.books))]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        # a centre that nothing is nearest to starts again at some vector
        centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


def _shares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Share of the nearest vectors of some vectors of the sample that lie in the first 1, 2, … cells.

    Probes are midway between a vector and another, since requests are rarely a vector itself.
    """
    rng = np.random.default_rng(0)
    a, b = rng.integers(len(x), size=(2, PROBES))
    probe = x[a] + 0.5 * x[b]
    found = np.argsort(-(probe @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    order = np.argsort((centres**2).sum(1) / 2 - probe @ centres.T, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)[np.arange(PROBES)[:, None], _nearest(x, centres)[found]]
    return np.cumsum(np.bincount(rank.ravel(), minlength=len(centres))) / rank.size


def fit_index(vectors: DataFrame, keys: list[str], cells: int, subspaces: int, vector: str = "embedding", sample: int = SAMPLE) -> Index | None:
    """Index from at most ``sample`` vectors, the first by a hash of their keys; None without vectors."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.xxhash64(*keys).alias("_h"), F.col(vector).alias("_v"))
    x = rows.orderBy("_h", "_v").limit(sample).select("_v").toPandas()
    if x.empty:
        return None
    x = _unit(x["_v"])
    centres = _kmeans(x, cells, 1)
    index = Index(centres, np.zeros((subspaces, 1, -(-x.shape[1] // subspaces))), _shares(x, centres))
    rest = x - centres[index.cells(x)]
    books = [_kmeans(p, CODEWORDS, 2 + i) for i, p in enumerate(index._split(rest))]
    return index._replace(books=np.stack(books))


def encode(vectors: DataFrame, index: Index, vector: str = "embedding") -> DataFrame:
    """The same rows with ``cell`` and ``code`` (a byte per sub-space); rows with a null vector go.

    Written with ``partitionBy("cell")`` a search reads only the cells it looks into.
    """
    held = vectors.sparkSession.sparkContext.broadcast(index)

    @F.pandas_udf("struct<cell: int, code: binary>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            if v.empty:
                yield pd.DataFrame({"cell": [], "code": []})
                continue
            x = _unit(v)
            cell = held.value.cells(x)
            codes = held.value.codes(x - held.value.centres[cell])
            yield pd.DataFrame({"cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes]})

    out = vectors.filter(F.col(vector).isNotNull()).withColumn("_d", described(F.col(vector)))
    return out.select(*vectors.columns, "_d.cell", "_d.code")


def probes(queries: DataFrame, counts: DataFrame, index: Index, least_cells: int, least_vectors: int, salts: int = 16) -> DataFrame:
    """(query_id, _scope, _q, cell): the cells nearest to a request, ``least_cells`` of those its scope has and
    more until they hold ``least_vectors`` vectors of the scope, so that a small scope yields as much as it has."""
    held = queries.sparkSession.sparkContext.broadcast(index)
    salted = queries.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    counts = counts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    columns, schema = queries.columns, T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left[columns].iloc[:0].assign(cell=np.zeros(0, np.int32)).astype({"_q": object})
        right = right.sort_values("cell")
        cell, n = right["cell"].to_numpy(), right["_n"].to_numpy()
        centres = held.value.centres[cell]
        near = np.argsort((centres**2).sum(1) / 2 - _unit(left["_q"]) @ centres.T, axis=1, kind="stable")
        before = np.cumsum(n[near], axis=1) - n[near]
        row, at = np.nonzero((before < least_vectors) | (np.arange(len(n)) < least_cells))
        out = left[columns].iloc[row].reset_index(drop=True)
        return out.assign(cell=cell[near[row, at]].astype(np.int32))

    return salted.groupBy("_scope", "_salt").cogroup(counts.groupBy("_scope", "_salt")).applyInPandas(choose, schema)


def approximate_topk(
    queries: DataFrame,
    encoded: DataFrame,
    index: Index,
    keys: list[str],
    k: int,
    least_cells: int = 8,
    candidates: int = 200,
    scope: str = "goal_id",
    query_vector: str = "vector",
    vector: str = "embedding",
    tile_vectors: int = 200_000,
    tile_queries: int = 2_000,
) -> DataFrame:
    """(query_id, *keys, distance, rank) as ``dense_topk``: the nearest of the ``candidates`` vectors whose codes are nearest.

    ``keys`` must name one vector.  Hot cells are cut into tiles.  The vectors themselves are read
    only for candidates.  With all cells and as many candidates as vectors the result is exact.
    """
    spark = queries.sparkSession
    asked = queries.filter(F.col(query_vector).isNotNull()).select("query_id", F.col(scope).alias("_scope"), F.col(query_vector).alias("_q"))
    rows = encoded.select(F.col(scope).alias("_scope"), *keys, "cell", "code")
    counts = rows.groupBy("_scope", "cell").agg(F.count(F.lit(1)).alias("_n"))
    place = F.struct("_scope", "cell")
    to = probes(asked, counts, index, least_cells, candidates)
    held = spark.sparkContext.broadcast(index)
    key_fields = [T.StructField(c, encoded.schema[c].dataType) for c in keys]
    first = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    schema = T.StructType([*first, *key_fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        right = right.sort_values(keys, ignore_index=True)
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1)
        cell = int(right["cell"].iloc[0])
        unit, n = _unit(left["_q"]), min(candidates, len(right))
        base, tables = unit @ held.value.centres[cell], held.value.tables(unit)
        for i, query in enumerate(left["query_id"]):
            near = base[i] + tables[i][np.arange(codes.shape[1]), codes].sum(1)
            at = np.argsort(-near, kind="stable")[:n]
            part = right[keys].iloc[at].reset_index(drop=True)
            part.insert(0, "query_id", query)
            yield part.assign(cell=np.int32(cell), near=near[at])

    as_text = F.to_json(place)
    found = tile_nearest(
        to.select("query_id", as_text.alias("_scope"), "_q"), rows.select(as_text.alias("_scope"), *keys, "cell", "code"),
        keys, best, schema, tile_vectors, tile_queries,
    )
    found = top_per_key(found, ["query_id"], [F.desc("near"), *[F.col(c) for c in keys]], candidates).select("query_id", *keys, "cell")
    own, requests = encoded.select(*keys, "cell", F.col(vector).alias("_v")), asked.select("query_id", "_q")
    if is_small(asked, BROADCAST_CANDIDATES // candidates):
        found, requests = F.broadcast(found), F.broadcast(requests)
    pairs = own.join(found, [*keys, "cell"]).join(requests, "query_id")

    @F.pandas_udf("double")
    def distance(q: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(np.round(1.0 - np.einsum("ij,ij->i", _unit(q), _unit(v)), 6) + 0.0) if len(q) else pd.Series([], dtype=float)

    ranked = pairs.select("query_id", *keys, distance("_q", "_v").alias("distance"))
    return top_per_key(ranked, ["query_id"], [F.col("distance"), *[F.col(c) for c in keys]], k)


def recall(exact: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: requests, neighbours of the exact search, and the share of them that was found."""
    hit = found.select("query_id", *keys, F.lit(1).alias("_hit"))
    both = exact.select("query_id", *keys).join(hit, ["query_id", *keys], "left")
    return both.agg(
        F.count_distinct("query_id").alias("requests"), F.count(F.lit(1)).alias("neighbours"),
        F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"),
    )
