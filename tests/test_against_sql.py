"""Registered queries beside their SQL on the smallest tables."""

import duckdb
import pytest

import check
from fieldgauge.plans.queries import SQL, TABLE


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["qualify"])
def test_query_equals_its_sql(spark, sf, duck, name):
    df = TABLE[name](spark, sf)
    got = check.normal([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == check.normal(cur.fetchall(), names)


@pytest.mark.parametrize("name", ["npz_ingest"])
def test_arrays_equal_their_sql(spark, sf, duck, name):
    test_query_equals_its_sql(spark, sf, duck, name)


def test_pairs_of_the_linear_learner_are_stored(spark, sf):
    got = TABLE["linear_reduced_targets"](spark, sf)
    assert got.inputFiles() and not any("events" in name for name in got.inputFiles())
