"""Every registered query of the time-series part against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from barflow.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def oracle(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_the_sql(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(comparable(r[c]) for c in names) for r in df.collect())
    cursor = oracle.execute(SQL[name])
    places = {c[0]: k for k, c in enumerate(cursor.description)}
    assert sorted(places) == names
    assert got == sorted(tuple(comparable(r[places[c]]) for c in names) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"cpcv_evaluation"}))
def test_queries_without_sql_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_the_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
