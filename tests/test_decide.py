import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import boot, decide, replay


def mse(spark, **arms):
    rows = [(a, s, float(v)) for a, vs in arms.items() for s, v in enumerate(vs)]
    return spark.createDataFrame(rows, "arm string, seed int, mse double")


def test_median_of_ratios_is_not_ratio_of_medians(spark):
    got = decide.quality_point(decide.seed_ratios(mse(spark, dense=[1, 2, 100], a=[1.1, 100, 3]))).first()
    assert got["point"] == pytest.approx(1.1)


def test_floor_point(spark):
    floors = spark.createDataFrame([("a", 1.0)], "arm string, floor double")
    dense = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 100.0)], "seed int, mse double")
    assert decide.floor_point(floors, dense).first()["point"] == pytest.approx(0.5)


@pytest.mark.parametrize(
    "q, f, want",
    [
        (1.30, 1.20, "REPRESENTATIONAL_SHORTFALL"), (1.08, 1.02, "OPTIMISATION_OR_GENERALISATION_SHORTFALL"),
        (1.02, 1.00, "TOLERANCE_MET_UNDER_CONVERGENCE"), (1.05, 1.00, "TOLERANCE_MET_UNDER_CONVERGENCE"),
        (1.06, 1.05, "REPRESENTATIONAL_SHORTFALL"),
    ],
)
def test_three_way_verdict(spark, q, f, want):
    assert spark.range(1).select(decide.verdict3(F.lit(q), F.lit(f)).alias("v")).first()["v"] == want


def test_seed_sets_must_match(spark):
    for bad in (dict(dense=[1, 2], a=[1, 2, 3]), dict(dense=[1, 2, 3], a=[1, 2]), dict(dense=[0, 1], a=[1, 1])):
        with pytest.raises(Exception, match="seed sets"):
            decide.seed_ratios(mse(spark, **bad)).collect()


def test_published_seed_ratios(spark):
    # Published per-seed ratios with their median, maximum and count above 1.05.
    ratios = spark.createDataFrame(
        [("a", 0, 0.9746798), ("a", 1, 0.9181681), ("a", 2, 0.9910934), ("b", 0, 0.6180600), ("b", 1, 1.3140997), ("b", 2, 0.7076494)],
        "arm string, seed int, ratio double",
    )
    points = {r["arm"]: r["point"] for r in decide.quality_point(ratios).collect()}
    assert points == {"a": 0.9746798, "b": 0.7076494}
    counts = {r["arm"]: (r["n_above_tolerance"], r["all_within"]) for r in decide.seed_counts(ratios).collect()}
    assert counts == {"a": (0, True), "b": (1, False)}


@pytest.mark.parametrize("factor, verdict, port", [(0.9, "PASS", 0.9), (1.2, "FAIL", 1.2)])
def test_one_family_cannot_rescue_another(spark, factor, verdict, port):
    rows = []
    for s in range(5):
        rows += [("m", "dense", s, 1.0 + s), ("m", "compact", s, 0.8 * (1 + s)), ("f", "dense", s, 2.0 + s), ("f", "compact", s, factor * (2 + s))]
    df = spark.createDataFrame(rows, "family string, arm string, seed int, mse double")
    got = decide.portability(decide.seed_ratios(df, by=["family"])).select("q_port", decide.pass_fail(F.col("q_port")).alias("v")).first()
    assert got["q_port"] == pytest.approx(port) and got["v"] == verdict


def test_cost_direction(spark):
    rows = [("t", "dense", 0, 10.0, 1.0), ("t", "budget", 0, 5.0, 1.1)]
    df = spark.createDataFrame(rows, "target string, scheme string, seed int, bytes double, heldout_error double")
    got = {r["metric"]: r["value"] for r in decide.cost_ratios(decide.summarise(df, ["target", "scheme"], ["bytes", "heldout_error"])).collect()}
    assert got == {"bytes": pytest.approx(2.0), "heldout_error": pytest.approx(0.1)}


def test_epoch_profile_single_epoch_is_its_own_steady_state(spark):
    rows = [("a", 1, 9.0, 1.0, 1.0, 1.0, 5.0), ("b", 1, 9.0, 1.0, 1.0, 1.0, 5.0), ("b", 2, 3.0, 2.0, 2.0, 2.0, 1.0), ("b", 3, 5.0, 2.0, 2.0, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "run string, epoch int, epoch_s double, read_s double, transfer_s double, decode_s double, step_s double")
    got = {r["run"]: r for r in decide.epoch_profile(df, ["run"]).collect()}
    assert got["a"]["steady_epoch_s"] == 9.0 and got["a"]["n_steady"] == 1
    assert got["b"]["steady_epoch_s"] == 4.0 and got["b"]["cold_epoch_s"] == 9.0 and got["b"]["input_s"] == 6.0


def errors(spark, n=24, **factor):
    rows = [(a, s, c, f * (1.0 + c % 5 + s)) for a, f in factor.items() for s in range(3) for c in range(n)]
    return spark.createDataFrame(rows, "arm string, seed int, cluster int, err double")


@pytest.mark.parametrize("draw", ["hash", "pcg64"])
def test_bootstrap_of_a_constant_ratio(spark, draw):
    got = boot.paired_bootstrap(errors(spark, dense=1.0, a=1.04), reps=50, draw=draw).first()
    assert got["lo"] == pytest.approx(1.04) and got["hi"] == pytest.approx(1.04)


def test_bootstrap_matches_numpy_stream(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vals = {(a, s): rng.random(9) + 0.5 for a in ("dense", "a", "floor") for s in range(3)}
    rows = [(a, s, c, float(v[c])) for (a, s), v in vals.items() for c in range(9)]
    df = spark.createDataFrame(rows, "arm string, seed int, cluster int, err double").repartition(5)
    got = {r["arm"]: (r["lo"], r["hi"]) for r in boot.paired_bootstrap(df, reps=200, seed=5, draw="pcg64").collect()}
    idx = np.random.Generator(np.random.PCG64(5)).integers(0, 9, size=(200, 9), dtype=np.int64)
    for arm in ("a", "floor"):
        stat = [np.median([vals[arm, s][i].mean() / vals["dense", s][i].mean() for s in range(3)]) for i in idx]
        assert got[arm] == pytest.approx(tuple(np.quantile(stat, [0.025, 0.975])))


def test_bootstrap_needs_a_complete_grid(spark):
    df = errors(spark, dense=1.0, a=1.0).where("not (arm = 'a' and seed = 1 and cluster = 3)")
    with pytest.raises(Exception, match="exactly one error"):
        boot.paired_bootstrap(df, reps=5).collect()


def test_draw_does_not_depend_on_partitions(spark):
    a = boot.draws(spark, 7, 20).collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        b = boot.draws(spark, 7, 20).collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert sorted(a) == sorted(b) and {r["idx"] for r in a} <= set(range(7))


def test_seed_bootstrap_needs_two_seeds(spark):
    rows = [("t", "dense", 0, 4.0), ("t", "budget", 0, 2.0)]
    df = spark.createDataFrame(rows, "target string, scheme string, seed int, bytes double")
    got = boot.seed_bootstrap(df, ["bytes"], reps=10).first()
    assert got["ratio"] == 2.0 and got["lo"] is None and got["excludes_one"] is None


def test_replay_finds_a_changed_number(spark):
    df = errors(spark, dense=1.0, a=1.04)
    again = replay.recompute(df)
    tampered = again.withColumn("value", F.when(F.col("metric") == "quality", F.col("value") + 0.01).otherwise(F.col("value")))
    assert replay.replay_result(again, again).where("not agrees").count() == 0
    bad = replay.replay_result(tampered, again).where("not agrees").collect()
    assert [r["metric"] for r in bad] == ["quality"]


def test_two_bootstrap_forms_agree(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(f, a, s, c, float(rng.random() + 0.5)) for f in "xy" for a in ("dense", "a", "b") for s in range(4) for c in range(11)]
    df = spark.createDataFrame(rows, "family string, arm string, seed int, cluster int, err double").repartition(3)
    one = {r["arm"]: (r["lo"], r["hi"]) for r in boot.paired_bootstrap(df, reps=60, families=True).collect()}
    means = boot.replicate_means(df, 60, by=["family", "arm", "seed"])
    two = boot.interval(boot.replicate_stats(means, families=True), "stat", ["arm"]).collect()
    assert one == {r["arm"]: pytest.approx((r["lo"], r["hi"])) for r in two}
    with pytest.raises(ValueError, match="seed sets"):
        boot.paired_bootstrap(df.where("not (arm = 'a' and seed = 2)"), reps=5, families=True)


def philox(seed, rep, block, m):
    """The published generator, one number at a time."""
    out = []
    for t in range(m):
        c0, c1, key = t, rep, boot.key_of(seed, block)
        for _ in range(10):
            c0, c1 = ((c0 * 0xD256D193) >> 32) ^ key ^ c1, c0 * 0xD256D193 % 2**32
            key = (key + 0x9E3779B9) % 2**32
        out.append(c0 << 32 | c1)
    return out


def expected_draws(seed, rep, n, size):
    blocks = -(-n // size)
    counts = [n] if blocks == 1 else [0] * blocks
    if blocks > 1:
        for v in philox(seed, rep, -1, n):
            counts[v % n // size] += 1
    return [b * size + v % min(size, n - b * size) for b, m in enumerate(counts) for v in philox(seed, rep, b, m)]


@pytest.mark.parametrize("size", [4, 7, 65536])
def test_draws_in_blocks_against_one_by_one(spark, size):
    from fieldgauge.session import ship_package

    ship_package(spark)
    got = {}
    for r in boot.draws(spark, 19, 12, seed=3, size=size).orderBy("rep", "i").collect():
        got.setdefault(r["rep"], []).append(r["idx"])
    assert got == {rep: expected_draws(3, rep, 19, size) for rep in range(12)}
    rows = [(f"a{a}", s, f"c{c:02}", float(a + c * s + 1)) for a in range(7) for s in range(3) for c in range(19)]
    df = spark.createDataFrame(rows, "arm string, seed int, cluster string, err double").repartition(3)
    means = {(r["rep"], r["arm"], r["seed"]): r["mse"] for r in boot.replicate_means(df, 12, seed=3, size=size).collect()}
    assert len(means) == 12 * 21
    for (rep, arm, s), mse in means.items():
        assert mse == pytest.approx(sum(int(arm[1]) + c * s + 1 for c in got[rep]) / 19)


def test_every_cluster_has_the_same_chance():
    import numpy as np

    n, size, reps = 50, 16, 4000
    held = np.zeros(n)
    for rep in range(reps):
        for b, m in enumerate(boot.block_counts(1, rep, n, size)):
            held += np.bincount(boot.block_draws(1, rep, b, int(m), n, size) + b * size, minlength=n)
    chi = ((held - reps) ** 2 / reps).sum()
    assert held.sum() == reps * n and 25 < chi < 85


def test_replay_names_the_entry_where_a_value_enters(spark):
    from fieldgauge.session import ship_package

    ship_package(spark)
    rows = [(f, a, s, c, k * (1.0 + c % 4 + s)) for f, m in (("x", 1.0), ("y", 1.02)) for a, k in (("dense", 1.0), ("a", 0.9 * m), ("floor", 0.3)) for s in range(3) for c in range(8)]
    errors_ = spark.createDataFrame(rows, "family string, arm string, seed int, cluster int, err double")
    again = replay.record(errors_, reps=20).cache()
    assert replay.replay_graph(again, again).where("status <> 'OK'").count() == 0
    hit = (F.col("entry") == "ratio") & (F.col("family") == "y") & (F.col("arm") == "a")
    changed = again.withColumn("value", F.when(hit, F.col("value") * 2).otherwise(F.col("value")))
    got = {(r["entry"], r["family"], r["seed"]): r["status"] for r in replay.replay_graph(replay.derive(changed, "ratio"), again).where("status <> 'OK'").collect()}
    assert got == {**{("ratio", "y", s): "ENTERS_HERE" for s in range(3)}, ("quality", "y", None): "INHERITED", ("q_port", None, None): "INHERITED", ("verdict", "y", None): "INHERITED"}
    first = replay.first_wrong(replay.replay_graph(changed, again)).first()
    assert (first["entry"], first["family"], first["arm"], first["seed"], first["n_enter"], first["n_inherited"]) == ("ratio", "y", "a", 0, 3, 0)
    fewer = replay.replay_graph(again.where("entry <> 'verdict'"), again).where("status <> 'OK'").collect()
    assert [r["status"] for r in fewer] == ["MISSING"] * 2
