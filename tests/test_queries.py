"""Every registered query against DuckDB over the same tables."""

import math

import duckdb
import pytest

from assayer.plans import evidence_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, con, name):
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0
