import numpy as np
import pytest

from fieldgauge.operators import select as ops
from fieldgauge.operators.basis import dct_basis


def gains(spark, values, parts=1):
    rows = [(0, j, float(g)) for j, g in enumerate(values)]
    return spark.createDataFrame(rows, "seed int, j int, gain double").repartition(parts)


def limits(spark, value):
    return spark.createDataFrame([(0, 0.05, float(value))], "seed int, tau double, threshold double")


def pick(spark, values, ladder, threshold, policy="max_rung", parts=1, **kw):
    tails = ops.gain_tail(ops.gain_order(gains(spark, values, parts)))
    return ops.select_rung(tails, ladder, limits(spark, threshold), policy, **kw).first()


def test_first_rung_within_the_threshold(spark, parts):
    got = pick(spark, [8, 4, 2, 1, 0.5, -100], [1, 2, 3, 4, 6], 1.6, "full_dim", parts)
    assert got["selected_k"] == 3
    tails = {r["k"]: r["tail"] for r in ops.gain_tail(ops.gain_order(gains(spark, [8, 4, 2, 1, 0.5, -100]))).collect()}
    assert tails[4] == pytest.approx(0.5)  # the negative gain counts as zero


def test_ties_keep_index_order(spark):
    got = ops.gain_order(gains(spark, [3, 3, 1, 0, -2], 5)).orderBy("rank").collect()
    assert [r["j"] for r in got] == [0, 1, 2, 3, 4]


def test_threshold_is_inclusive(spark):
    assert pick(spark, [4, 2, 1], [1, 2, 3], 3.0, "full_dim")["selected_k"] == 1
    assert pick(spark, [4, 2, 1], [1, 2, 3], np.nextafter(3.0, 0), "full_dim")["selected_k"] == 2


def test_fallback_policies(spark):
    got = pick(spark, [8, 4, 2, 1], [1, 2], 0.5, "max_rung", caps={"basis_cap": 2, "gram_resolution_cap": 3})
    assert got["selected_k"] == 2 and got["used_fallback"]
    assert got["censor_reasons"] == ["ladder_cap", "basis_cap"]
    assert pick(spark, [8, 4, 2, 1], [1, 2, 4], 0.5, "full_dim")["selected_k"] == 4
    with pytest.raises(Exception, match="full width"):
        pick(spark, [8, 4, 2, 1], [1, 2], 0.5, "full_dim")
    with pytest.raises(Exception, match="no rung"):
        pick(spark, [8, 4, 2, 1], [1, 2], 0.5, "fail")
    with pytest.raises(Exception, match="exceeds"):
        pick(spark, [8, 4], [1, 3], 0.5, "max_rung")


def test_previous_tail_is_null_on_the_first_rung(spark):
    assert pick(spark, [8, 1], [1, 2], 5.0)["tail_at_previous"] is None
    assert pick(spark, [8, 4, 1], [1, 2, 3], 2.0)["tail_at_previous"] == pytest.approx(5.0)


def test_effective_ladder():
    assert [max(ops.effective_ladder(r)) for r in (6239, 300, 100, 5)] == [4096, 256, 96, 4]
    with pytest.raises(ValueError):
        ops.effective_ladder(3)


@pytest.mark.parametrize("k, nxt", [(4, 8), (8, 16), (16, 32), (2, 4), (2048, 4096)])
def test_resolve_ranks(spark, k, nxt):
    rows = spark.createDataFrame([(k, [])], "selected_k int, censor_reasons array<string>")
    got = ops.resolve_ranks(rows, ops.effective_ladder(6239)).first()
    assert (got["k_prop"], got["k_next"], got["status"]) == (k, nxt, "RESOLVED")


def test_resolve_ranks_blocks(spark):
    rows = spark.createDataFrame(
        [(4096, []), (8, ["ladder_cap"]), (5, [])], "selected_k int, censor_reasons array<string>"
    )
    got = [r["status"] for r in ops.resolve_ranks(rows, ops.effective_ladder(6239)).collect()]
    assert got == ["BLOCKED_NO_K_NEXT", "BLOCKED_SELECTOR_CENSORED", "BLOCKED_RANK_OFF_LADDER"]


def test_gain_matches_numpy(spark, parts):
    rng = np.random.default_rng(3)
    y, p, mean = rng.standard_normal((40, 8)), rng.standard_normal((40, 8)), rng.standard_normal(8)
    rows = [(i % 2, y[i].tolist(), p[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "seed int, y array<double>, p array<double>").repartition(parts)
    basis = dct_basis(spark, 8)
    b = np.asarray([r["vec"] for r in basis.orderBy("j").collect()])
    got = {(r["seed"], r["j"]): (r["q"], r["e"]) for r in ops.direction_gain(df, "y", "p", basis, mean).collect()}
    for s in (0, 1):
        c, m = (y[s::2] - mean) @ b.T, (y[s::2] - p[s::2]) @ b.T
        for j in range(8):
            assert got[s, j] == pytest.approx(((c[:, j] ** 2).mean(), (m[:, j] ** 2).mean()))


def test_calibration_rules(spark):
    rows = [
        ("ok", 2, 3, [4, 1, 0], [4, 1]), ("empty", 1, 1, [], []), ("twice", 1, 1, [1, 1], [1]),
        ("negative", 1, 1, [0, -1], [0]), ("range", 4, 1, [0, 1], [0, 1]), ("head", 2, 2, [0, 1], [1, 0]),
    ]
    import hashlib

    sha = lambda v: hashlib.sha256(np.asarray(v, "<i4").tobytes()).hexdigest()
    rows = [(*r, sha(r[3]), sha(r[4])) for r in rows]
    rows += [("order", 1, 1, [2, 0], [2], sha([0, 2]), sha([2])), ("kept", 1, 1, [2, 0], [2], sha([2, 0]), None)]
    df = spark.createDataFrame(rows, "target string, k_pred int, k_oracle int, gain_order array<int>, kept_idx array<int>, gain_order_sha256 string, kept_idx_sha256 string")
    got = {r["target"]: r["failed_rule"] for r in ops.ranks_from_calibration(df).collect()}
    assert got == {
        "order": "order_digest_differs", "kept": "kept_digest_differs", "ok": None, "empty": "empty_order", "twice": "repeated_direction", "negative": "negative_direction",
        "range": "k_pred_out_of_range", "head": "kept_is_not_the_order_head",
    }


def test_gain_by_tiles_and_mse_in_the_same_pass(spark, monkeypatch):
    from fieldgauge.operators import codec

    rng = np.random.default_rng(8)
    y, p, mean = rng.standard_normal((30, 8)), rng.standard_normal((30, 8)), rng.standard_normal(8)
    rows = [(i, i % 2, y[i].tolist(), p[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, seed int, y array<double>, p array<double>").repartition(4)
    basis = dct_basis(spark, 8)
    one = ops.direction_gain(df, "y", "p", basis, mean, with_mse=True).orderBy("seed", "j").collect()
    monkeypatch.setattr(codec, "BROADCAST_BYTES", 64)
    two = ops.direction_gain(df, "y", "p", basis, mean, row=["id"], with_mse=True).orderBy("seed", "j").collect()
    for a, b in zip(one, two, strict=True):
        assert (a["seed"], a["j"]) == (b["seed"], b["j"])
        assert (a["gain"], a["mse"]) == pytest.approx((b["gain"], b["mse"]))
    assert one[0]["mse"] == pytest.approx(((y - p)[::2] ** 2).mean())
    limit = {r["seed"]: r["threshold"] for r in ops.thresholds_of(ops.direction_gain(df, "y", "p", basis, mean, row=["id"], with_mse=True), 8).collect()}
    assert limit[1] == pytest.approx(0.05 * 8 * ((y - p)[1::2] ** 2).mean())
