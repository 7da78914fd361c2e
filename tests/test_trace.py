import pytest

from fieldgauge.operators import trace as ops


def curve(spark, values, parts=1):
    rows = [("a", 0, i + 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "arm string, seed int, epoch int, val_mse double").repartition(parts)


def replay(spark, values, patience=20, min_delta=1e-3, parts=1):
    return ops.replay_stopping(curve(spark, values, parts), patience, min_delta).first()


def test_patience(spark, parts):
    got = replay(spark, [1, 0.9, 0.8998, 0.8997, 0.8996], 3, 1e-3, parts)
    assert (got["selected_epoch"], got["stop_epoch"], got["stop_reason"]) == (2, 5, "PATIENCE")
    assert got["raw_best_epoch"] == 5


def test_small_gains_accumulate_against_the_running_best(spark):
    assert replay(spark, [1, 0.9, 0.89955, 0.8995, 0.89945])["selected_epoch"] == 2
    assert replay(spark, [1, 0.9995, 0.999, 0.9985], 20)["selected_epoch"] == 3
    got = replay(spark, [1.0] + [0.9995] * 20)
    assert (got["selected_epoch"], got["stop_epoch"], got["stop_reason"]) == (1, 21, "PATIENCE")


def test_ceiling(spark):
    got = replay(spark, [1 / (i + 1) for i in range(300)])
    assert got["stop_reason"] == "CEILING_REACHED" and not got["converged"] and got["stop_epoch"] == 300


def test_epochs_after_the_stop_do_not_count(spark):
    got = replay(spark, [1, 1, 1, 0.1], 2)
    assert (got["stop_epoch"], got["raw_best_epoch"], got["raw_best_val"]) == (3, 1, 1.0)


def test_unusable_curves_are_named(spark):
    assert replay(spark, [1, float("nan"), 0.5])["stop_reason"] == "NONFINITE"
    assert replay(spark, [0.0, 0.5])["stop_reason"] == "NONPOSITIVE_BEST"


def test_trace_checks(spark):
    rows = [
        ("ok", 2, 3, 5, "x", "y"), ("late", 6, 3, 5, "x", "y"), ("raw", 2, 9, 5, "x", "y"),
        ("alias", 2, 3, 5, "x", "x"), ("null", None, 3, 5, "x", "y"),
    ]
    df = spark.createDataFrame(rows, "arm string, selected_epoch int, raw_best_epoch int, stop_epoch int, selected_sha256 string, raw_best_sha256 string")
    got = {r["arm"]: r["reason"] for r in ops.check_traces(df, ["selected_epoch", "stop_epoch"]).collect()}
    assert got == {"late": "selected_after_stop", "raw": "raw_best_after_stop", "alias": "checkpoint_overwritten", "null": "missing_field"}


@pytest.mark.parametrize("n, width, count", [(50, 10, 5), (50, 2, 25), (7, 3, 3)])
def test_segments_cover_every_epoch_once(spark, n, width, count):
    rows = spark.createDataFrame([("s", n, width)], "run string, n int, width int")
    parts = ops.segments(rows, "n", "width")
    assert parts.count() == count
    assert ops.check_segments(parts, ["run"], "n").count() == 0
    assert ops.check_segments(parts.where("segment <> 1"), ["run"], "n").count() == 1


def test_calibration_prefers_the_earliest_admissible_rule(spark):
    df = curve(spark, [1, 0.5, 0.49, 0.2, 0.2, 0.2, 0.2, 0.2])
    got = {r["patience"]: r for r in ops.calibrate_stopping(df, [(1, 0.1), (2, 0.1), (4, 0.1)]).collect()}
    assert not got[1]["admissible"] and got[2]["admissible"] and got[2]["chosen"]
    assert got[2]["max_epochs"] == 6 and sum(r["chosen"] for r in got.values()) == 1


def test_parameter_count(spark):
    df = spark.createDataFrame([(1024, 8)], "d_in int, d_out int")
    assert ops.parameter_counts(df).first()["n_parameters"] == 1024 * 256 + 256 + 256 * 256 + 256 + 256 * 8 + 8


def test_mean_does_not_depend_on_the_split(spark, parts):
    from pyspark.sql import functions as F

    from fieldgauge.plans import tables

    values = [0.1, 0.2, 0.3, None, 0.7, 1e16, -1e16]
    rows = spark.createDataFrame(list(enumerate(values)), "at int, v double").orderBy(F.desc("at")).repartition(parts)
    total = 0.0
    for v in values:
        total += v or 0.0
    assert rows.groupBy().agg(tables.mean_in_order("v", "at").alias("m")).first()["m"] == total / 6
