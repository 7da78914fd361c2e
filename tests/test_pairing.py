import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.functions import ranking
from fieldgauge.functions.vectors import flatten_masked
from fieldgauge.operators import pairing as ops


def ramp(spark, frames=101, width=8, trajectories=3, parts=3):
    rows = [("f", k, t, [float(t + 1000 * k)] * width) for k in range(trajectories) for t in range(frames)]
    return spark.createDataFrame(rows, "family string, traj int, t int, field array<double>").repartition(parts)


def test_strided_ramp(spark, parts):
    got = ops.pair_strided(ramp(spark, parts=parts)).where("traj = 0").orderBy("t").collect()
    assert [r["t"] for r in got] == list(range(0, 100, 5))
    assert all(r["x"][0] == r["t"] and r["y"][0] == r["t"] + 1 for r in got)


@pytest.mark.parametrize("width", [2, 3, 4096])
def test_next_frame_stays_inside_the_trajectory(spark, width):
    frames = ramp(spark, 14).where("not (traj = 1 and t in (4, 5, 6, 7))")
    got = ops.pair_next(frames, width=width).collect()
    assert len(got) == 13 + 9 + 13
    assert all(r["y"][0] // 1000 == r["traj"] for r in got)
    gap = [r for r in got if r["traj"] == 1 and r["t"] == 3][0]
    assert gap["y"][0] == 1008.0


def test_roll_pairs_the_previous_row_and_wraps(spark):
    df = spark.createDataFrame([(i * 10, [float(i)]) for i in range(25)], "id int, field array<double>").repartition(6)
    got = {r["id"]: (r["x"][0], r["y"][0]) for r in ops.pair_roll(df, "id").collect()}
    assert got[0] == (24.0, 0.0) and all(got[i * 10] == (i - 1.0, float(i)) for i in range(1, 25))


@pytest.mark.parametrize("chunk", [8, 20, 4096])
@pytest.mark.parametrize("stride, n", [(1, None), (3, None), (4, 5)])
def test_windows_match_a_plain_loop(spark, chunk, stride, n):
    data = {s: np.random.default_rng(i).random(50) for i, s in enumerate("ab")}
    df = spark.createDataFrame([(s, t, float(v)) for s in data for t, v in enumerate(data[s])], "series_id string, step bigint, value double").repartition(5)
    starts = list(range(0, 50 - 5 - 3, stride))[:n]
    got = {(r["series_id"], r["start"]): (r["x"], r["y"]) for r in ops.sliding_pairs(df, 5, 3, stride, n, chunk=chunk).collect()}
    assert set(got) == {(s, k) for s in data for k in starts}
    for (s, k), (x, y) in got.items():
        assert x == data[s][k : k + 5].tolist() and y == data[s][k + 5 : k + 8].tolist()


def test_last_admissible_start_is_excluded():
    assert list(ops.window_starts(10, 4, 2, 1, None)) == [0, 1, 2, 3]


def test_scaler_ranges():
    assert ops.scaler_range("legacy_raw_fraction", 101, 0.8) == (0, 80)
    assert ops.scaler_range("train_window_union", 100, 0.8, 10, 10, 4) == (0, 4 * 15 + 20)
    with pytest.raises(ValueError):
        ops.scaler_range("train_window_union", 100, 1.0, 10, 10, 4)


def test_scaler_is_population_and_flags_bad_values(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, float("nan")), ("b", 1, 1.0)], "series_id string, step int, value double")
    got = {r["series_id"]: r for r in ops.fit_scaler(df, (0, 2)).collect()}
    assert got["a"]["mu"] == 2.0 and got["a"]["sd"] == pytest.approx(1.0 + 1e-8)
    assert [r["series_id"] for r in ops.bad_scalers(ops.fit_scaler(df, (0, 2))).collect()] == ["b"]
    with pytest.raises(Exception, match="bad scaler of series b"):
        ops.apply_scaler(df, ops.fit_scaler(df, (0, 2))).collect()


def test_centring_gate(spark):
    y = np.random.default_rng(1).standard_normal((50, 4)) + 7
    df = spark.createDataFrame([(v.tolist(),) for v in y], "y array<double>").repartition(4)
    good = ops.centring_residual(df, "y", y.mean(0)).first()
    assert good["passed"] and good["frobenius"] == pytest.approx(np.linalg.norm(y - y.mean(0)))
    assert not ops.centring_residual(df, "y", y.mean(0) + 1e-6).first()["passed"]


def test_masked_flatten(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [True, False, True])], "v array<double>, m array<boolean>")
    assert df.select(flatten_masked(F.col("v"), F.col("m")).alias("k")).first()["k"] == [1.0, 3.0]


def test_cluster_ids_are_dense_over_families(spark):
    df = spark.createDataFrame([("b", 5, 0), ("a", 9, 0), ("a", 2, 0), ("a", 2, 1), ("b", 1, 0)], "family string, traj int, t int")
    got = {(r["family"], r["traj"]): r["cluster"] for r in ops.assign_cluster(df, "traj").collect()}
    assert got == {("a", 2): 0, ("a", 9): 1, ("b", 1): 2, ("b", 5): 3}


@pytest.mark.parametrize("splits", [1, 7, 1023])
def test_positions_with_a_hot_group(spark, splits):
    """A group with most rows is ranked in many tasks and the ranks are still exact."""
    rows = [("hot", i * 3 % 1009) for i in range(1009)] + [("cold", i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = ranking.ordered_position(df, ["g"], "v", splits=splits).collect()
    assert all(r["rank"] == r["v"] for r in got)
    hashed = ranking.hash_position(df, ["g"], 1, ["g", "v"])
    assert sorted(r["rank"] for r in hashed.where("g = 'hot'").collect()) == list(range(1009))
