"""Approximate neighbours against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursemine.operators import approximate as ap, vectors as vx

DIMS = 48


@pytest.fixture(scope="module")
def table(spark):
    """Scopes of very different size (one has most vectors), copies, a zero vector, nulls."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, DIMS))
    rows = []
    for i in range(4000):
        scope = 1 if i % 3 else 2 + i % 7 if i % 100 else 99
        rows.append((i, scope, [float(x) for x in middles[i % 40] + 0.7 * rng.normal(size=DIMS)]))
    rows += [(10_000 + i, 1, rows[5][2]) for i in range(300)] + [(20_000, 1, [0.0] * DIMS), (20_001, 1, None)]
    return spark.createDataFrame(rows, "chunk_id bigint, goal_id int, embedding array<float>").repartition(4).cache()


@pytest.fixture(scope="module")
def requests(table):
    q = table.filter("chunk_id % 40 = 3 OR chunk_id >= 20000").select(F.col("chunk_id").alias("query_id"), "goal_id", F.col("embedding").alias("vector"))
    return q.cache()


@pytest.fixture(scope="module")
def index(table):
    return ap.fit_index(table, ["chunk_id"], cells=32, subspaces=12)


def test_recall_on_all_requests(table, requests, index):
    exact = vx.dense_topk(requests.filter("vector IS NOT NULL"), table.filter("embedding IS NOT NULL"), ["chunk_id"], 30)
    near = ap.approximate_topk(requests, ap.encode(table, index), index, ["chunk_id"], 30, least_cells=8, candidates=400)
    got = ap.recall(exact, near, ["chunk_id"]).first()
    assert got["recall"] >= 0.9 and got["requests"] == requests.count() - 1
    # as many hits as the exact search has, small scopes included
    assert near.count() == got["neighbours"]


def test_all_cells_and_candidates_are_exact(table, requests, index, monkeypatch):
    exact = vx.dense_topk(requests.filter("vector IS NOT NULL"), table.filter("embedding IS NOT NULL"), ["chunk_id"], 10)
    want = {tuple(r) for r in exact.select("query_id", "chunk_id", "distance", "rank").collect()}
    extra = ap.encode(table, index).withColumn("near", F.lit(1)).withColumn("_scope", F.lit(2))
    for bound in (200_000, 0):
        monkeypatch.setattr(ap, "BROADCAST_CANDIDATES", bound)
        near = ap.approximate_topk(requests, extra, index, ["chunk_id"], 10, least_cells=32, candidates=100_000, tile_vectors=90, tile_queries=20)
        assert {tuple(r) for r in near.select("query_id", "chunk_id", "distance", "rank").collect()} == want


def test_codes_are_short_and_fits_agree(table, index):
    coded = ap.encode(table, index)
    assert {r[0] for r in coded.select(F.length("code")).distinct().collect()} == {12}
    assert coded.count() == table.filter("embedding IS NOT NULL").count()
    again = ap.fit_index(table.repartition(7), ["chunk_id"], cells=32, subspaces=12)
    assert all(np.array_equal(a, b) for a, b in zip(index, again))


def test_no_vectors(spark, table, requests, index):
    empty = table.limit(0)
    assert ap.fit_index(empty, ["chunk_id"], 4, 4) is None
    assert ap.approximate_topk(requests, ap.encode(empty, index), index, ["chunk_id"], 3).count() == 0
    assert ap.approximate_topk(requests.limit(0), ap.encode(table, index), index, ["chunk_id"], 3).count() == 0
    tiny = table.filter("chunk_id < 3")
    small = ap.fit_index(tiny, ["chunk_id"], 32, 5)  # fewer vectors than cells, dims no multiple of sub-spaces
    assert ap.approximate_topk(requests, ap.encode(tiny, small), small, ["chunk_id"], 3).filter("distance IS NULL").count() == 0


def test_sample_tells_the_cells_for_a_recall(index):
    assert list(index.shares) == sorted(index.shares) and abs(index.shares[-1] - 1) < 1e-9
    few, many = index.cells_for(0.5), index.cells_for(0.99)
    assert 1 <= few <= many <= 32 and index.cells_for(1.1) == 32
