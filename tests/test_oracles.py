"""Registered queries against DuckDB on the smallest tables.

By default a selection runs; COURSEMINE_ALL=1 runs every query that has SQL.
"""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from coursemine.fixtures import TABLES

SF = "/root/testdata/sf0.001"
SELECTED = [
    "chunk_documents", "chunk_pages", "extract_formulas", "tokenize_lexical", "hash_embed", "lexical_topk", "hybrid_search", "dense_topk_tiled",
    "extract_outline", "page_ranges", "expand_plans", "repair_tasks", "weak_points", "grade_choices", "repair_questions", "compress_history",
    "fit_context", "stream_ingest", "job_state", "replace_chunks", "delete_scope", "page_catalog",
]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are absent")


def canon(v):
    return f"{v:.6f}" if isinstance(v, float) else repr(v) if v is None or isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("COURSEMINE_ALL") else SELECTED)
def test_equals_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*cols).collect())
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == sorted(tuple(canon(v) for v in r) for r in rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
