"""Whitening against NumPy's eigenvectors of the whole covariance."""

import math

import numpy as np
import pytest

from coursemine.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>, whitened string, n int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(vectors)], SCHEMA).repartition(5)


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, ((n * x - s) ** 2).sum(1), c @ q[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1] / np.trace(v)


def compare(spark, vectors, k=8):
    docs = table(spark, vectors)
    model = wh.fit(docs, k=k)
    rows = wh.components(docs, model).collect()
    n, deviation, white, part = brute(vectors)
    assert len(rows) == n * min(k, len(vectors[0]))
    got = np.zeros((n, min(k, len(vectors[0]))))
    for r in rows:
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert math.isclose(r["explained"], part[r["component"] - 1], rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    white = white[:, :got.shape[1]]
    white = white * np.sign((white * got).sum(0))
    assert np.abs(white - got).max() < 1e-7
    return model


@pytest.mark.parametrize("seed, d, scale", [(1, 40, 1.0), (2, 64, 0.97), (3, 24, 0.6), (4, 5, 1.0), (5, 1, 1.0)])
def test_equals_numpy(spark, seed, d, scale):
    """Flat and steep spectra, dimensions above and below the block."""
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((300, d)) * scale ** np.arange(d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]).tolist()
    model = compare(spark, vectors)
    assert model.passes > 3 or d <= 16


def test_equal_eigenvalues_beyond_the_block(spark):
    """One direction stands out of forty equal ones: the block is widened where filters cannot separate."""
    vectors = [[0.0] * i + [s * (4.0 if i == 0 else 1.0)] + [0.0] * (39 - i) for i in range(40) for s in (1.0, -1.0)]
    docs = table(spark, vectors)
    model = wh.fit(docs)
    x = np.floor(1024 * np.array(vectors)) + 100_000
    v = np.cov(x.T, bias=True)
    assert np.abs(v @ model.vectors - model.vectors * model.values).max() < 1e-9 * model.values[0]
    assert np.allclose(model.values, np.linalg.eigvalsh(v)[::-1][:8], rtol=1e-12) and model.identity_error < 1e-9


def test_dropped_vectors_ties_and_no_spread(spark):
    good = [[1.0, 2.0], [1.0, 2.0], [0.5, -0.25]]
    odd = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0]]
    docs = table(spark, good + odd)
    rows = wh.components(docs, wh.fit(docs)).collect()
    assert sorted({r["vec_id"] for r in rows}) == [0, 1, 2] and {r["n"] for r in rows} == {3}
    # all on a line: the second component has no spread
    assert {r["component"]: r["whitened"] is None for r in rows} == {1: False, 2: True}
    assert all(r["identity_error"] < 1e-9 for r in rows)
    same = table(spark, [[1.0, 2.0]] * 3)
    rows = wh.components(same, wh.fit(same)).collect()
    assert len(rows) == 6 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in rows} == {(None, None, None, 0)}
    none = docs.filter("vec_id between 3 and 7")
    assert wh.fit(none) is None and wh.components(none, None).collect() == []
    assert wh.components(docs.filter("false"), wh.fit(docs.filter("false"))).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    """Sums and deviations beyond a long's range do not wrap."""
    vectors = [[3.0e12, 1.0], [-3.0e12, 2.0], [1.0e12, 3.0], [float(2**60), 0.0]]
    docs = table(spark, vectors)
    rows = wh.components(docs, wh.fit(docs)).collect()
    assert {r["deviation"] for r in rows} == {None} and {r["n"] for r in rows} == {4}
    small = table(spark, [[1.0e5, 1.0], [-1.0e5, 2.0]])
    x = [[int(1024e5) + 100_000, 101_024], [-int(1024e5) + 100_000, 102_048]]
    want = {i: sum((2 * x[i][d] - x[0][d] - x[1][d]) ** 2 for d in (0, 1)) for i in (0, 1)}
    assert {r["vec_id"]: r["deviation"] for r in wh.components(small, wh.fit(small)).collect()} == want
