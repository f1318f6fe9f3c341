"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed.  Centred vectors are stored once; a pass multiplies the
covariance with a block Q as the sum of X'(XQ) over all tasks, of which the driver gets a
matrix of dimension x block.  Two passes of a block Krylov space bound the spectrum; then
a polynomial in the covariance, evaluated by the Chebyshev recurrence with one pass a
degree, damps the interval of the unwanted eigenvalues, QR makes the block orthonormal and
Rayleigh-Ritz reads eigenpairs off it, until the residuals of the wanted ones are at the
level of rounding.  A block that does not get there is widened, at last to all dimensions,
where Rayleigh-Ritz is exact.

Defined results: vectors that are null, empty or hold null or non-finite entries are
dropped, and so are vectors whose length is not the most frequent one (of equally frequent
ones the larger).  Entries beyond 2**52 count as 2**52.  Components whose eigenvalue is
zero to rounding have a null ``whitened``; without any spread ``explained`` is null, and
with no usable component ``identity_error`` is null.  A deviation beyond a long is null.
Repeated rows and keys are rows of their own; a null key stays null; an empty table gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from coursemine.llm.common import discard, store

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 52
# Block width per wanted component; degrees of one filter; the power of e by which a filter
# may separate the block's ends before its columns lose digits to the largest eigenvalue.
WIDTH, DEGREES, SPREAD = 2, 16, 25.0
# A wanted pair is certified when its residual is below this share of the largest eigenvalue.
CERTIFIED = 1e-13
# Filters before the block is widened.
PATIENCE = 25
SEED = 12


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors with exact sums; eigenvalues, falling, and their unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None
    passes: int

    @property
    def usable(self) -> np.ndarray:
        top = self.values[0] if len(self.values) else 0.0
        return self.values > 8 * np.finfo(float).eps * len(self.sums) * top

    def projection(self) -> np.ndarray:
        """Columns that turn centred vectors into whitened components; zero where there is no spread."""
        scale = np.where(self.usable, self.values, 1.0)
        return np.where(self.usable, self.vectors / np.sqrt(scale), 0.0)


def finite(vector: str) -> Column:
    """Whether the vector can be used: present, not empty, every entry a finite number."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def _integers(column: pa.Array, d: int) -> np.ndarray:
    """Rows of x = floor(1024 c) + 100000 from a column of float arrays of length d."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.clip(np.floor(SCALE * c), -LARGEST, LARGEST)).astype(np.int64).reshape(-1, d) + SHIFT


def _spread(x: np.ndarray, n: int, sums: tuple[int, ...], largest: int) -> np.ndarray:
    """n x - S, exact: in longs where they suffice, in Python's integers beyond."""
    if n * largest < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _sums(rows: DataFrame, d: int) -> tuple[int, tuple[int, ...], int]:
    """n, sums per dimension and the largest magnitude, added by the tasks in 32-bit halves so that no total overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _integers(b.column(0), d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array(np.full(d, len(x))), pa.array((x >> 32).sum(0)),
                 pa.array((x & 0xFFFFFFFF).sum(0)), pa.array(np.abs(x).max(0))], ["dim", "n", "high", "low", "most"])

    parts = rows.mapInArrow(run, "dim long, n long, high long, low long, most long").groupBy("dim")
    found = parts.agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.max("most").alias("most")).orderBy("dim").collect()
    return found[0]["n"], tuple((r["high"] << 32) + r["low"] for r in found), max(r["most"] for r in found)


def _centred(rows: DataFrame, d: int, n: int, sums: tuple[int, ...], largest: int) -> DataFrame:
    """One binary of d doubles x - S/n a row, stored: what every pass reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = (_spread(_integers(b.column(0), d), n, sums, largest) / n).astype("<f8")
            ends = pa.array(np.arange(len(c) + 1, dtype=np.int64) * (8 * d))
            whole = pa.Array.from_buffers(pa.large_binary(), len(c), [None, ends.buffers()[1], pa.py_buffer(c.tobytes())])
            yield pa.RecordBatch.from_arrays([whole.cast(pa.binary())], ["c"])

    return store(rows.mapInArrow(run, "c binary"))


def _total(centred: DataFrame, d: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a matrix that ``part`` makes of the centred rows of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            _, ends, data = b.column(0).buffers()
            first = np.frombuffer(ends, np.int32)[b.column(0).offset] if len(b.column(0)) else 0
            total += part(np.frombuffer(data, "<f8", len(b.column(0)) * d, int(first)).reshape(-1, d) if len(b.column(0)) else np.zeros((0, d)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "value"])

    out = np.zeros(shape)
    for r in centred.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out.flat[r["at"]] = r["value"]
    return out


class _Covariance:
    """Products of the covariance with a block; each is a pass over the stored vectors."""

    def __init__(self, centred: DataFrame, d: int, n: int) -> None:
        self.centred, self.d, self.n, self.passes = centred, d, n, 0

    def times(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        return _total(self.centred, self.d, q.shape, lambda c: c.T @ (c @ q)) / self.n


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenpairs of the covariance within an orthonormal basis, falling, and the images of the vectors."""
    h = basis.T @ image
    values, w = np.linalg.eigh((h + h.T) / 2)
    w = w[:, ::-1]
    return values[::-1], basis @ w, image @ w


def _filtered(cov: _Covariance, x: np.ndarray, image: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance applied to x, small on [low, high]; scaled to one at ``top``."""
    half, centre = (high - low) / 2, (high + low) / 2
    gain = float(np.arccosh(max((top - centre) / half, 1.0)))
    degrees = int(np.clip(SPREAD / max(gain, 1e-3), 2, DEGREES))
    first = s = half / (top - centre)
    before, now = x, (image - centre * x) * (s / half)
    for _ in range(degrees - 1):
        after = 1 / (2 / first - s)
        before, now = now, 2 * (after / half) * (cov.times(now) - centre * now) - s * after * before
        s = after
    return now


def _eigenpairs(cov: _Covariance, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors, certified by their residuals."""
    d = cov.d
    rng = np.random.default_rng(SEED)
    width = min(d, max(WIDTH * k, k + 4))
    basis = [np.linalg.qr(rng.standard_normal((d, width)))[0]]
    images = [cov.times(basis[0])]
    if 2 * width <= d:
        basis.append(np.linalg.qr(np.hstack([basis[0], images[0]]))[0][:, width:2 * width])
        images.append(cov.times(basis[1]))
    values, x, image = _ritz(np.hstack(basis), np.hstack(images))
    # no eigenvalue lies further below the least Ritz value than its residual is expected to say
    low = max(0.0, float(values[-1] - np.linalg.norm(image[:, -1] - values[-1] * x[:, -1])))
    values, x, image = values[:width], x[:, :width], image[:, :width]
    tried = 0
    while True:
        top = float(values[0])
        residual = np.linalg.norm(image[:, :k] - x[:, :k] * values[:k], axis=0).max()
        if width == d or residual <= CERTIFIED * top or top <= 0:
            return np.maximum(values[:k], 0.0), x[:, :k]
        tried += 1
        if tried % PATIENCE == 0:
            x = np.linalg.qr(np.hstack([x, rng.standard_normal((d, min(width, d - width)))]))[0]
            width = x.shape[1]
            values, x, image = _ritz(x, cov.times(x))
            continue
        high = max(float(values[-1]), 1e-9 * top)
        x = np.linalg.qr(_filtered(cov, x, image, low if low < 0.999 * high else 0.0, high, top))[0]
        values, x, image = _ritz(x, cov.times(x))


def fit(vectors: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> Whitening | None:
    """The k leading components of all usable vectors; None where there are none."""
    rows = vectors.filter(finite(vector)).select(F.col(vector).alias("_v"))
    lengths = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d = lengths["d"]
    rows = rows.filter(F.size("_v") == d)
    n, sums, largest = _sums(rows, d)
    centred = _centred(rows, d, n, sums, largest)
    cov = _Covariance(centred, d, n)
    values, found = _eigenpairs(cov, min(k, d))
    trace = float(_total(centred, d, (1, 1), lambda c: np.array([[np.einsum("ij,ij->", c, c)]]))[0, 0] / n)
    draft = Whitening(n, sums, largest, values, found, trace, None, cov.passes)
    w = draft.projection()[:, draft.usable]
    error = None
    if w.shape[1]:
        white = _total(centred, d, (w.shape[1],) * 2, lambda c: (c @ w).T @ (c @ w)) / n
        error = float(np.abs(white - np.eye(w.shape[1])).max())
    discard(centred)
    return Whitening(n, sums, largest, values, found, trace, error, cov.passes)


def transform(vectors: DataFrame, model: Whitening | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, deviation, whitened (array, null for components without spread) of every usable vector."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"_key {kind}, deviation bigint, whitened array<double>"
    rows = vectors.filter(finite(vector)).select(F.col(key).alias("_key"), F.col(vector).alias("_v"))
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("_key", key)
    d, w, usable = len(model.sums), model.projection(), model.usable

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spread = _spread(_integers(b.column(1), d), model.n, model.sums, model.largest)
            rough = (spread.astype(np.float64) ** 2).sum(1)
            exact = [int((s.astype(object) ** 2).sum()) if r > 2.0**62 else None for s, r in zip(spread, rough)] if (rough > 2.0**62).any() else None
            if exact is None:
                deviation = (spread.astype(np.int64) ** 2).sum(1).tolist()
            else:
                deviation = [int((s.astype(np.int64) ** 2).sum()) if e is None else e if e < 1 << 63 else None for s, e in zip(spread, exact)]
            white = (spread / model.n).astype(np.float64) @ w
            values = pa.array(white.ravel(), mask=np.tile(~usable, len(white)))
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * w.shape[1]), values)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), whole], ["_key", "deviation", "whitened"])

    return rows.filter(F.size("_v") == d).mapInArrow(run, schema).withColumnRenamed("_key", key)


def components(vectors: DataFrame, model: Whitening | None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row per vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = transform(vectors, model, vector, key)
    n, error = (model.n, model.identity_error) if model else (0, None)
    parts = [float(v / model.trace) if model.trace > 0 else None for v in model.values] if model else []
    explained = F.array(*[F.lit(p).cast("double") for p in parts]) if parts else F.lit(None).cast("array<double>")
    rows = rows.select(key, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select(
        key, (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
