"""Every product gives the same result when the directions are too large to share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.functions import blocks
from fieldgauge.operators import codec, metrics, select
from fieldgauge.session import ship_package

D, K = 24, 11
KEEP = [3, 0, 7, 9, 1, 10]


@pytest.fixture(scope="module")
def case(spark):
    ship_package(spark)
    r = np.random.default_rng(8)
    rows = [(int(i % 3), i, r.normal(size=D).tolist(), r.normal(size=D).tolist()) for i in range(60)]
    rows.append(rows[5])  # the same row twice
    df = spark.createDataFrame(rows, "seed int, id int, y array<double>, p array<double>").repartition(3)
    vecs = np.linalg.qr(r.normal(size=(D, K)))[0].T
    vecs[4] = 2 * vecs[4] + vecs[5]  # not orthonormal
    basis = spark.createDataFrame([(j, v.tolist(), 1.0) for j, v in enumerate(vecs)], "j int, vec array<double>, eigval double")
    return df, basis, r.normal(size=D)


def results(df, basis, mean):
    c = codec.encode(df, ["y", "p"], basis, mean, KEEP)
    plain = codec.encode(df, "y", basis, mean)
    return {
        "encode": c.drop("y", "p"),
        "encode_all": plain.drop("y", "p"),
        "decode": codec.decode(c.select("seed", "id", "c_y"), "c_y", basis, mean, KEEP),
        "project": codec.project(df.select("seed", "id", "p"), "p", basis, mean, KEEP),
        "floor": metrics.floor_perp(df, "y", basis, mean, KEEP, ["seed"]),
        "arms": metrics.arm_rows(df, "y", "p", basis, mean, KEEP),
        "parts": metrics.decompose(df, "y", "p", basis, mean, KEEP),
        "loss": metrics.coeff_loss(c, "c_y", "c_p", basis, KEEP),
        "gain": select.direction_gain(df, "y", "p", basis, mean, with_mse=True),
        "gain_all": select.direction_gain(df, "y", "p", basis, mean, by=[]),
    }


def numbers(df):
    cols = sorted(df.columns)
    out = []
    for r in df.collect():
        flat = []
        for c in cols:
            flat += list(r[c]) if isinstance(r[c], list) else [r[c]]
        out.append(flat)
    return cols, np.array(sorted(out, key=lambda v: [round(x, 6) for x in v]), float)


@pytest.mark.parametrize("strip", [8 * D * 2, 8 * D * 64], ids=["six-strips", "one-strip"])
def test_lowered_bound_gives_the_same_results(case, monkeypatch, strip):
    want = {name: numbers(df) for name, df in results(*case).items()}
    monkeypatch.setattr(codec, "BROADCAST_BYTES", 64)
    monkeypatch.setattr(codec, "STRIP_BYTES", strip)
    for name, df in results(*case).items():
        cols, got = numbers(df)
        assert cols == want[name][0], name
        np.testing.assert_allclose(got, want[name][1], atol=1e-9, err_msg=name)


def test_strip_is_copied_once_per_lane_and_a_row_once_per_strip(case):
    df, basis, _ = case
    matrix = blocks.strips(basis, size=4)
    assert (matrix.k, matrix.count) == (K, 3)
    held = blocks.numbered(df)
    seen = blocks.over_strips(
        held, ["id"], ["y"], matrix, "id int, strip int",
        lambda s, b, own, y: own.append_column("strip", __import__("pyarrow").array(np.full(own.num_rows, s, np.int32))), lanes=5,
    )
    assert seen.groupBy("id", "strip").count().agg(F.sum("count")).first()[0] == 3 * 61
    with pytest.raises(ValueError):
        blocks.strips(basis, [1, 1])
    with pytest.raises(ValueError):
        blocks.strips(basis, [1, 99])


def test_runs_are_added_across_batches(spark):
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = spark.createDataFrame([(i % 5, [float(i), 1.0]) for i in range(100)], "r bigint, v array<double>")
        got = {r["r"]: list(r["v"]) for r in blocks.add_runs(parts, "r", ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: [float(sum(range(k, 100, 5))), 20.0] for k in range(5)}
