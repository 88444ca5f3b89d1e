"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pixeltide.plans import checks, queries

QUERIES, ORACLE_SQL = queries.QUERIES | checks.QUERIES, queries.ORACLE_SQL | checks.ORACLE_SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return made


def same(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(f"{float(x):.5f}" if isinstance(x, float) else str(x) for x in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, con, sf_dir, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert same(ours) == same(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_doubles_are_rounded_as_the_sql_rounds_them(spark):
    values = [0.7200124999999999, 0.3600124999999999, 0.12345650000000001, -0.7200124999999999, -4e-7, 2.5e-6, 1e305, 27021597764222979.0, float("inf"), float("nan"), None]
    ours = [r["x"] for r in queries.rounded(spark.createDataFrame([(v,) for v in values], "x double")).collect()]
    theirs = [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert [str(x) for x in ours] == [str(x) for x in theirs]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
