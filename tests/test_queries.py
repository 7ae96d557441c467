"""Every registered fact-graph query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from factgraph.plans import composites, curation, lifecycle, registry, reports, scans, seams, streams  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def text(x):
    return "None" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    found = con.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ours == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(registry.QUERIES) - set(registry.SQL):
        assert registry.QUERIES[name](spark, SF).count() > 0, name
