"""Vectors: signed feature hashing, pooling, pluggable encoders, exact nearest neighbours."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from coursemine.functions import fixed_values as fv
from coursemine.functions.text import let
from coursemine.functions.tokens import hash_tokens
from coursemine.operators.ranking import top_per_key


def token_hash(token: Column) -> Column:
    """32-bit hash from the head of the MD5 digest, the same in every SQL engine."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def sparse_hash_vector(tokens: Column, dims: int = fv.EMBED_DIMS) -> Column:
    """ARRAY<struct(bucket, weight)> of a token array, by bucket, not normalized.

    Tokens become integers ``2 * bucket + (sign > 0)``; once sorted, each value's
    count is the distance between its first position and the next value's.  A
    text never becomes one row per token, and nothing is shuffled.
    """
    def code(t: Column) -> Column:
        return let(
            token_hash(t),
            lambda h: ((h % dims) * 2 + F.when(F.shiftright(h, 8) % 2 == 0, 1).otherwise(0)).cast("int"),
        )

    def starts(codes: Column) -> Column:
        first = F.transform(
            codes, lambda x, i: F.when((i == 0) | (F.get(codes, i - 1) != x), F.struct(x.alias("code"), i.alias("at")))
        )
        return let(F.filter(first, lambda x: x.isNotNull()), lambda runs: counted(runs, F.size(codes)))

    def counted(runs: Column, n: Column) -> Column:
        signed = F.transform(
            runs,
            lambda x, i: F.struct(
                F.floor(x["code"] / 2).cast("int").alias("bucket"),
                ((F.coalesce(F.get(runs, i + 1)["at"], n) - x["at"]) * F.when(x["code"] % 2 == 1, 1).otherwise(-1)).alias("weight"),
            ),
        )
        return let(signed, merged)

    def merged(parts: Column) -> Column:
        same = lambda a, b: F.coalesce(a["bucket"] == b["bucket"], F.lit(False))
        both = F.transform(
            parts,
            lambda x, i: F.when(
                (i == 0) | ~same(F.get(parts, i - 1), x),
                F.struct(
                    x["bucket"].alias("bucket"),
                    (x["weight"] + F.when(same(F.get(parts, i + 1), x), F.get(parts, i + 1)["weight"]).otherwise(0)).alias("weight"),
                ),
            ),
        )
        return F.filter(both, lambda x: x.isNotNull() & (x["weight"] != 0))

    return let(F.sort_array(F.transform(tokens, code)), starts)


def unit_weights(sparse: Column) -> Column:
    def scaled(items: Column) -> Column:
        squares = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["weight"] * x["weight"])
        return let(
            F.sqrt(squares.cast("double")),
            lambda norm: F.transform(
                items, lambda x: F.struct(x["bucket"].alias("bucket"), (x["weight"] / norm).alias("weight"))
            ),
        )

    return let(sparse, scaled)


def dense_vector(sparse: Column, dims: int = fv.EMBED_DIMS) -> Column:
    """Dense ARRAY<float> from bucket-ordered (bucket, weight): gaps are filled with zeros."""
    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0.0), n.cast("int"))

    def spread(items: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(items, i - 1)["bucket"]).otherwise(F.lit(-1))
        filled = F.transform(items, lambda x, i: F.concat(zeros(x["bucket"] - before(i) - 1), F.array(x["weight"])))
        return F.concat(F.flatten(filled), zeros(F.lit(dims - 1) - before(F.size(items))))

    return let(sparse, spread).cast("array<float>")


_WORD, _IDEOGRAPH = re.compile("[a-z0-9_]+"), re.compile("[\u4e00-\u9fff]")
# Rows whose dense vectors are summed at once.
SUMMED = 1000


@lru_cache(1 << 17)
def _signed_hash(token: str) -> int:
    """``token_hash`` and the sign of a token: the sign is that of the number, which is the hash from 1."""
    h = int.from_bytes(hashlib.md5(token.encode(), usedforsecurity=False).digest()[:4], "big")
    return h + 1 if (h >> 8) % 2 == 0 else -h - 1


def _text_tokens(text: str) -> list[str]:
    """``hash_tokens`` of one text."""
    words = _WORD.findall(text.lower())
    if text.isascii():
        return words
    ideographs = _IDEOGRAPH.findall(text)
    return words + ideographs + [a + b for a, b in zip(ideographs, ideographs[1:])]


def _hashed(texts: list[str | None], dims: int) -> np.ndarray:
    """Unit vectors of some texts, one row each."""
    tokens = [_text_tokens(t or "") for t in texts]
    flat = np.fromiter(map(_signed_hash, chain.from_iterable(tokens)), np.int64)
    cells = np.repeat(np.arange(len(texts)) * dims, [len(ts) for ts in tokens]) + (np.abs(flat) - 1) % dims
    sums = np.bincount(cells, np.sign(flat), len(texts) * dims).reshape(len(texts), dims)
    norms = np.sqrt((sums * sums).sum(1, keepdims=True))
    return (sums / np.where(norms > 0, norms, 1)).astype(np.float32)


def hash_embed(df: DataFrame, text: str = "text", dims: int = fv.EMBED_DIMS, out: str = "vector") -> DataFrame:
    """L2-normalized signed feature hashing; a zero vector for texts without tokens, none for null.

    The same numbers as ``dense_vector(unit_weights(sparse_hash_vector(...)))``, summed batch by batch.
    """
    # a map over batches: as a function inside a projection it would pull what the text is made from into its argument
    rows = df.drop(out)
    schema = T.StructType(rows.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SUMMED):
                part = batch.slice(at, SUMMED)
                texts = part.column(text)
                flat = pa.array(_hashed(texts.to_pylist(), dims).ravel())
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dims)
                vectors = pa.ListArray.from_arrays(offsets, flat, mask=texts.is_null())
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*part.schema.names, out])

    return rows.mapInArrow(run, schema)


def mean_pool(df: DataFrame, group: list[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean per group; partial sums are combined before the shuffle."""
    spread = df.select(*group, F.posexplode(vector).alias("_pos", "_x"))
    means = spread.groupBy(*group, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    # one entry per dimension: the collected group is as long as a vector
    return means.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_m"))), lambda x: x["_m"]).alias("vector")
    )


def retried(call: Callable[[list], list], tries: int) -> Callable[[list], list]:
    """The same call, repeated after a failure; after the last try the failure goes on."""
    def run(items: list) -> list:
        for attempt in range(tries):
            try:
                return call(items)
            except Exception:
                if attempt == tries - 1:
                    raise
        return []

    return run


def embed_with(
    df: DataFrame,
    encode: Callable[[list[str]], list[list[float]]],
    text: str = "text",
    batch: int = 32,
    tries: int = 3,
    out: str = "vector",
    number: T.DataType = T.FloatType(),
) -> DataFrame:
    """Vectors from a pluggable encoder: lists of texts in, lists of vectors out, null as "".

    Arrow batches are cut to ``batch`` texts per call.  A failing call is retried;
    after the last try the task fails, and Spark reruns it elsewhere.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(number))])
    call = retried(encode, tries)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame[text]]
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch):
                vectors.extend(call(texts[i : i + batch]))
            yield frame.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def blake_hash(token: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little")


def md5_hash(token: bytes) -> int:
    """As ``token_hash``."""
    return int(hashlib.md5(token).hexdigest()[:8], 16)


def hash_encoder(hashed: Callable[[bytes], int] = blake_hash, dims: int = fv.EMBED_DIMS) -> Callable[[list[str]], list[list[float]]]:
    """Encoder for ``embed_with``: signed feature hashing, by default on 64-bit BLAKE2b digests, which Spark SQL lacks.

    Each distinct token of a batch is hashed once.
    """
    def encode(texts: list[str]) -> list[list[float]]:
        out, known = np.zeros((len(texts), dims)), {}
        for row, text in zip(out, texts):
            ideographs = re.findall("[一-鿿]", text)
            pairs = [a + b for a, b in zip(ideographs, ideographs[1:])]
            tokens = re.findall("[a-z0-9_]+", text.lower()) + ideographs + pairs
            for token in set(tokens).difference(known):
                h = hashed(token.encode())
                known[token] = h % dims, -1.0 if h >> 8 & 1 else 1.0
            if tokens:
                at, sign = zip(*map(known.__getitem__, tokens))
                np.add.at(row, list(at), sign)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return list(out / np.where(norms == 0, 1.0, norms))

    return encode


# --- exact nearest neighbours -------------------------------------------------


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def _block_best(query_ids: np.ndarray, a: np.ndarray, block: pd.DataFrame, keys: list[str], k: int, wanted: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The k nearest rows of the block for each unit query; equals are taken in key order, so copies add no rows.

    Rows that miss a value which the query wants (columns of ``wanted``, null for any) are no candidates.
    """
    block = block.sort_values(keys, ignore_index=True)
    b = _unit(block["_v"])
    n = min(k, len(b))
    for start in range(0, len(a), 64):
        d = np.round(1.0 - a[start : start + 64] @ b.T, 6) + 0.0  # no negative zero
        for name in wanted.columns:
            want = wanted[name].to_numpy(object)[start : start + 64, None]
            d[(want != None) & (want != block[name].to_numpy(object)[None, :])] = np.inf  # noqa: E711
        kth = np.partition(d, n - 1, axis=1)[:, n - 1]
        at = [np.concatenate([near := np.flatnonzero(row < limit), np.flatnonzero(row == limit)[: n - len(near)]]) for row, limit in zip(d, kth)]
        part = block[keys].iloc[np.concatenate(at)].reset_index(drop=True)
        part.insert(0, "query_id", np.repeat(query_ids[start : start + 64], n))
        part["distance"] = np.concatenate([row[i] for row, i in zip(d, at)])
        yield part[np.isfinite(part["distance"])]


def dense_topk(
    queries: DataFrame,
    vectors: DataFrame,
    keys: list[str],
    k: int,
    scope: str = "goal_id",
    query_vector: str = "vector",
    vector: str = "embedding",
    conditions: tuple[str, ...] = (),
    tile_vectors: int = 50_000,
    tile_queries: int = 2_000,
) -> DataFrame:
    """(query_id, *keys, distance, rank): the k nearest vectors in the query's scope by cosine distance.

    Exact, and pairs are never materialized.  At most ``tile_queries`` requests go to the
    vectors, which are read once where they are made: a task gives its k nearest rows per
    request.  More requests meet the vectors of their scope in a grid of tiles, NumPy multiplies tile by tile, and at most k rows per request and
    tile come out.  Most scopes are one tile; a scope with a third of all vectors is as
    many as it needs.  ``conditions`` are columns of both sides (a material, plan, day or
    source type): a request sees only vectors with its values, null standing for any, and
    they are looked at before the best are taken.  Ranking uses the distance rounded to six digits, then the keys.
    """
    # fresh names on both sides: requests may be derived from the vectors themselves
    asked = [F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(conditions)]
    queries = queries.select("query_id", F.col(scope).alias("_scope"), F.col(query_vector).alias("_q"), *asked)
    vectors = vectors.select(F.col(scope).alias("_scope"), *[F.col(c).alias(c) for c in keys], F.col(vector).alias("_v"), *asked)
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    fields += [T.StructField(c, vectors.schema[c].dataType) for c in keys]
    schema = T.StructType(fields + [T.StructField("distance", T.DoubleType())])

    few = queries.limit(tile_queries + 1).toPandas()
    if len(few) <= tile_queries:
        near = _few_nearest(few, vectors, keys, k, schema)
    else:
        near = _tile_nearest(queries, vectors, keys, k, schema, tile_vectors, tile_queries)
    return top_per_key(near, ["query_id"], [F.col("distance"), *[F.col(c) for c in keys]], k)


def _few_nearest(queries: pd.DataFrame, vectors: DataFrame, keys: list[str], k: int, schema: T.StructType) -> DataFrame:
    """The k nearest rows of each task for requests that every task can hold; vectors are neither counted nor shuffled."""
    known = lambda scope: None if pd.isna(scope) else scope
    asked = {known(s): (own["query_id"].to_numpy(), _unit(own["_q"]), own.filter(like="_c")) for s, own in queries.groupby("_scope", dropna=False)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = []
        for frame in frames:
            for scope, block in frame.groupby("_scope", dropna=False, sort=False):
                if known(scope) in asked:
                    ids, a, wanted = asked[known(scope)]
                    best += _block_best(ids, a, block, keys, k, wanted)
            if best:
                found = pd.concat(best, ignore_index=True).sort_values(["query_id", "distance", *keys])
                best = [found.groupby("query_id", dropna=False).head(k)]
        yield from best

    return vectors.mapInPandas(run, schema)


def _tile_nearest(
    queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, schema: T.StructType, tile_vectors: int, tile_queries: int
) -> DataFrame:
    def best(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        wanted = left[[c for c in left.columns if c.startswith("_c")]]
        return _block_best(left["query_id"].to_numpy(), _unit(left["_q"]), right, keys, k, wanted)

    return tile_nearest(queries, vectors, keys, best, schema, tile_vectors, tile_queries)


def tile_nearest(
    queries: DataFrame, vectors: DataFrame, keys: list[str], best: Callable[[pd.DataFrame, pd.DataFrame], Iterator[pd.DataFrame]],
    schema: T.StructType, tile_vectors: int, tile_queries: int,
) -> DataFrame:
    """Grid of (query tile, vector tile) per ``_scope``; a scope with a third of all vectors is as many tiles as it needs.

    ``best`` gives the rows of one tile from its requests and its vectors, neither of them empty.
    """
    def tiles(df: DataFrame, size: int, name: str) -> DataFrame:
        n = df.groupBy("_scope").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
        return n.filter(F.col(name) > 1)  # at most (rows / size) scopes need a tile count

    v_tiles, q_tiles = tiles(vectors, tile_vectors, "_nv"), tiles(queries, tile_queries, "_nq")

    def placed(df: DataFrame, own: str, own_n: str, other: str, other_n: str, ident: list[str]) -> DataFrame:
        df = df.join(v_tiles, "_scope", "left").join(q_tiles, "_scope", "left")
        df = df.withColumn(own, F.pmod(F.xxhash64(*ident), F.coalesce(own_n, F.lit(1))).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other_n, F.lit(1)) - 1))).drop("_nv", "_nq")

    q = placed(queries, "_tq", "_nq", "_tv", "_nv", ["query_id"])
    v = placed(vectors, "_tv", "_nv", "_tq", "_nq", keys)

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return pd.concat(list(best(left, right)), ignore_index=True)

    by = ["_scope", "_tq", "_tv"]
    return q.groupBy(*by).cogroup(v.groupBy(*by)).applyInPandas(tile, schema)
