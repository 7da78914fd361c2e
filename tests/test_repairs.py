"""Cases that once gave wrong results."""

import datetime

import pytest

from fieldgauge.functions import ranking
from fieldgauge.operators import codec, metrics, pairing, roles, select
from fieldgauge.plans import qualify, walk


def test_choice_is_the_same_on_the_large_basis_branch(spark, sf, monkeypatch):
    w = walk.study(spark, sf)
    rows = walk.predictions(w)

    def chosen():
        found, _ = qualify.choose(rows, w.basis, w.mean, w.width, walk.LADDER)
        return {r["seed"]: r["selected_k"] for r in found.collect()}

    small = chosen()
    monkeypatch.setattr(codec, "BROADCAST_BYTES", 1024)
    monkeypatch.setattr(select, "kept_rows", lambda *a: None)
    monkeypatch.setattr(codec, "kept_rows", lambda *a: None)
    assert chosen() == small


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_gain_that_is_not_finite_fails(spark, bad):
    gains = spark.createDataFrame([(0, 0, 1.0), (0, 1, bad)], "seed int, j int, gain double")
    with pytest.raises(Exception, match="not finite"):
        select.gain_order(gains).collect()


def test_family_without_baseline_fails(spark):
    dense = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0)], "family string, seed int, mse double")
    base = spark.createDataFrame([("a", 2.0)], "family string, mse double")
    with pytest.raises(Exception, match="no baseline"):
        metrics.qualify_dense(dense, base).collect()


def test_role_with_two_ranges(spark):
    ranges = spark.createDataFrame([("train", 0, 3), ("test", 3, 6), ("train", 6, 10)], "role string, lo long, hi long")
    got = {r["id"]: r["role"] for r in roles.split_ranges(spark.range(10), ranges, "id").collect()}
    assert got == {i: "test" if 3 <= i < 6 else "train" for i in range(10)}


@pytest.mark.parametrize("method", ["hash", "pcg64"])
def test_weights_give_every_key_a_role(spark, method):
    sizes = {"a": 7, "b": 40, "c": 1}
    keys = spark.createDataFrame([(f, i) for f, n in sizes.items() for i in range(n)], "family string, traj int")
    got = roles.split_by_trajectory(keys, 3, method=method, weights={"train": 11, "selection": 4, "test": 5}).collect()
    assert {(r["family"], r["traj"]) for r in got} == {(f, i) for f, n in sizes.items() for i in range(n)}
    for r in got:
        at = r["rank"] * 20 / sizes[r["family"]]
        assert r["role"] == ("train" if at < 11 else "selection" if at < 15 else "test")
    with pytest.raises(ValueError, match="either"):
        roles.split_by_trajectory(keys, 3)


@pytest.mark.parametrize("kind, values", [
    ("double", [3.0, None, -1.5, None, 2.5, float("nan"), 1e300, 0.0]),
    ("string", ["10", "9", None, "", "doc-b", "doc-a", "é", "doc-abc", "Z"]),
    ("date", [datetime.date(2024, 1, 2), None, datetime.date(1960, 5, 1)]),
])
def test_positions_do_not_depend_on_the_buckets(spark, kind, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}")

    def order(splits):
        ranked = ranking.ordered_position(rows, [], "v", splits=splits, n=len(values))
        return [r["v"] for r in ranked.orderBy("rank").collect()]

    whole = order(None)
    assert whole[0] is None
    for splits in (1, 3, 16):
        assert list(map(repr, order(splits))) == list(map(repr, whole))


def test_pairs_without_a_horizon_reach_the_end(spark):
    frames = spark.range(300).selectExpr("'f' AS family", "1 AS traj", "int(id) AS t", "array(double(id)) AS field")
    got = [r["t"] for r in pairing.pair_strided(frames, stride=7, horizon=None).orderBy("t").collect()]
    assert got == list(range(0, 299, 7))
    assert pairing.pair_strided(frames, stride=7).count() == len(range(0, 100, 7))
