"""Every registered query with SQL, on the smallest tables, against DuckDB; and the driver's entry points."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from strandweave.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, tables, name):
    got, expected = QUERIES[name](spark, SF), tables.sql(ORACLE_SQL[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(expected.columns, expected.fetchall())


def test_entry_points(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["id", "m", "degree"] and frame.count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(QUERIES) <= set(__spark_entry__.queries())
