"""Sums of a few blocks run in a few tasks: every further one would hold a Python worker without work."""

import numpy as np
import pytest

from fieldgauge.functions.sums import add_blocks
from fieldgauge.operators import basis, iterate
from fieldgauge.session import ship_package


def table(spark, y, parts=6):
    return spark.createDataFrame([(v.tolist(),) for v in y], "y array<double>").repartition(parts)


def tasks(df):
    return df.rdd.getNumPartitions()


def test_narrow_fields_are_summed_by_one_task(spark):
    ship_package(spark)
    y = np.random.default_rng(1).normal(size=(40, 5)) + 3
    df, z = table(spark, y), y - y.mean(axis=0)
    start = iterate._start(df, 5, 3, 0)
    image = iterate.image(df, y.mean(axis=0), start, "q", 3)
    assert (tasks(start), tasks(image)) == (1, 1)
    scatter = basis.centred_scatter(df, "y", width=5)
    assert tasks(scatter) == 1
    q = np.asarray(start.first()["q"]).reshape(5, 3)
    np.testing.assert_allclose(np.asarray(image.first()["z"]).reshape(5, 3), z.T @ z @ q, rtol=1e-9)
    np.testing.assert_allclose(np.asarray(scatter.first()["m2"]).reshape(5, 5), z.T @ z, rtol=1e-9)


@pytest.mark.parametrize("fan_in", [2, 64], ids=["salted", "one level"])
def test_sums_of_known_keys(spark, fan_in):
    ship_package(spark)
    parts = spark.range(0, 60, 1, 10).selectExpr("cast(id % 3 as int) AS b", "1L AS n", "array(double(id), 1.0d) AS z")
    for count, most in ((3, 4), (None, 4), (1, 1)):  # four shuffle partitions; a count too low is slower and no less right
        got = add_blocks(parts, ["b"], ["z"], fan_in=fan_in, count=count)
        assert tasks(got) == most
        assert {r["b"]: (r["n"], r["z"]) for r in got.collect()} == {b: (20, [570.0 + 20 * b, 20.0]) for b in range(3)}


@pytest.mark.parametrize("side", ["features", "randomized"])
def test_small_tables_need_no_python_worker(spark, side):
    ship_package(spark)
    y = np.vstack([np.eye(4, 6) * s * f for f in (3, 2) for s in (1, -1)])
    arrow = "spark.sql.execution.arrow.pyspark.enabled"
    held = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")  # Spark's default
    try:
        got = basis.complete_basis(table(spark, y), side=side, k=4)
    finally:
        spark.conf.set(arrow, held)
    plan = got.record._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan and "Arrow" not in plan
    row = got.record.first()
    assert (row["rank"], row["n"], row["d"], row["n_clusters"]) == (4, 16, 6, 1)
    assert [r["j"] for r in got.directions.orderBy("j").collect()] == [0, 1, 2, 3]
