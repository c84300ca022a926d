"""Every catalogue query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    rows = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=repr)
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(want.fetchall())


def test_without_sql(spark):
    for name in catalog.QUERIES.keys() - catalog.SQL.keys():
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_prefix_of_equal_segments(spark, tmp_path):
    """The first of equal segments lies behind a gap, and so do the others, in whatever order they come."""
    path = str(tmp_path / "lineitem.parquet")
    duckdb.sql(f"COPY (SELECT s AS l_orderkey, CAST(CASE WHEN i = 0 THEN 1 ELSE 4 END AS INTEGER) AS l_linenumber, CASE WHEN i = 0 THEN 3.0 ELSE 7.0 END AS l_quantity FROM range(20000) a(s), range(40) b(i)) TO '{path}'")
    want = [(10, 13, 1, 20000)]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    assert c.execute(f"SELECT start, prefix_end, n_segments, count(*) FROM ({catalog.SQL['contiguous_prefix']}) GROUP BY ALL").fetchall() == want
    got = catalog.QUERIES["contiguous_prefix"](spark, str(tmp_path)).groupBy("start", "prefix_end", "n_segments").count()
    assert [tuple(r) for r in got.collect()] == want
