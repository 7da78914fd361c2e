"""Bootstrap draws by blocks and by pieces of a NumPy stream, and the digits they are hashed as."""

import hashlib

import numpy as np
import pytest

from fieldgauge.operators import boot
from fieldgauge.session import ship_package


def test_pcg64_draws_above_two_million(spark):
    ship_package(spark)
    n, reps = 300_007, 7
    want = np.random.Generator(np.random.PCG64(3)).integers(0, n, size=(reps, n), dtype=np.int64)
    got = boot.draws(spark, n, reps, 3, "pcg64").toPandas().sort_values(["rep", "i"])["idx"].to_numpy()
    assert (got.reshape(reps, n) == want).all()
    # a word in three is refused here
    many = 3_000_000_001
    want = np.random.Generator(np.random.PCG64(3)).integers(0, many, size=200_000, dtype=np.int64)
    assert (np.concatenate([boot.pcg64_piece(3, p, many) for p in range(3)])[:200_000] == want).all()


@pytest.mark.parametrize("size", [8, 64])
def test_pcg64_means_by_blocks(spark, size):
    ship_package(spark)
    n, reps = 19, 70
    rows = [(a, s, f"c{c:02d}", float((c * 7 + s) % 5 + len(a))) for a in ("dense", "ab") for s in range(2) for c in range(n)]
    df = spark.createDataFrame(rows, "arm string, seed int, cluster string, err double").repartition(3)
    got = {(r["rep"], r["arm"], r["seed"]): r["mse"] for r in boot.replicate_means(df, reps, 5, "pcg64", size=size).collect()}
    idx = np.random.Generator(np.random.PCG64(5)).integers(0, n, size=(reps, n), dtype=np.int64)
    assert len(got) == reps * 4
    for (rep, arm, s), mse in got.items():
        assert mse == pytest.approx(np.mean([(c * 7 + s) % 5 + len(arm) for c in idx[rep]]))


@pytest.mark.parametrize("band", [1, 48, 1 << 23])
def test_pcg64_draws_are_not_shuffled(spark, monkeypatch, band):
    ship_package(spark)
    monkeypatch.setattr(boot, "BAND", band)  # bands of one block, of two, and one of all
    n, reps = 37, 50
    rows = [(a, s, c, float((c * 7 + s) % 5 + len(a))) for a in ("dense", "ab", "abc") for s in range(1) for c in range(n)]
    df = spark.createDataFrame(rows, "arm string, seed int, cluster int, err double").repartition(3)
    means = boot.replicate_means(df, reps, 5, "pcg64", size=8)
    idx = np.random.Generator(np.random.PCG64(5)).integers(0, n, size=(reps, n), dtype=np.int64)
    got = {(r["rep"], r["arm"]): r["mse"] for r in means.collect()}
    assert len(got) == reps * 3
    assert all(mse == pytest.approx(np.mean([c * 7 % 5 + len(arm) for c in idx[rep]])) for (rep, arm), mse in got.items())
    # the stream is made where the errors are: no exchange and no broadcast holds draws
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "at#" not in "".join(line for line in plan.splitlines() if "collect_list" in line) and "Range" not in plan


def test_pcg64_weights_by_bands():
    n, reps, seed = 100_003, 9, 3
    want = np.random.Generator(np.random.PCG64(seed)).integers(0, n, size=(reps, n), dtype=np.int64)
    pieces = -(-reps * n // boot.PIECE) + 1
    counts = [boot.pcg64_count(seed, p, n) for p in range(pieces)]
    assert counts == [len(boot.pcg64_piece(seed, p, n)) for p in range(pieces)]
    starts = np.concatenate([[0], np.cumsum(counts)])
    for lo, hi in ((0, n), (0, 40_000), (40_000, n)):
        for own in (range(0, reps), range(4, 6)):
            got = [w.copy() for w in boot._pcg64_weights(seed, n, starts, own, lo, hi)]
            assert len(got) == len(own)
            assert all((w == np.bincount(want[rep], minlength=n)[lo:hi]).all() for rep, w in zip(own, got))


def test_pcg64_needs_a_complete_grid(spark):
    ship_package(spark)
    rows = [(a, 0, c, 1.0) for a in ("dense", "ab") for c in range(20) if (a, c) != ("ab", 3)]
    with pytest.raises(Exception, match="exactly one error"):
        boot.replicate_means(spark.createDataFrame(rows, "arm string, seed int, cluster int, err double"), 5, 5, "pcg64", size=8).collect()


def test_block_counts_are_made_by_many_tasks(spark):
    ship_package(spark)
    counts = boot._counted_lots(spark, 1, 64, 100, 16, 64)
    row = counts.where("lot = 0 and block = 3").first()
    assert row["drawn"] == [int(boot.block_counts(1, rep, 100, 16)[3]) for rep in range(64)]
    # one lot, as on many blocks, and still the replicates are counted by several tasks
    assert "Range (0, 64, step=1, splits=32)" in counts._jdf.queryExecution().toString()


def test_numbers_do_not_depend_on_where_they_start():
    whole = boot.numbers(4, 9, 2, 70_000)
    assert (np.concatenate([boot.numbers(4, 9, 2, 30_000), boot.numbers(4, 9, 2, 40_000, 30_000)]) == whole).all()
    # the two words of one number, by plain integers
    c0, c1, key = 69_999, 9, boot.key_of(4, 2)
    for _ in range(boot.ROUNDS):
        c0, c1, key = (c0 * boot.PHILOX >> 32) ^ key ^ c1, c0 * boot.PHILOX % 2**32, (key + boot.KEY_STEP) % 2**32
    assert int(whole[-1]) == c0 << 32 | c1


@pytest.mark.parametrize("lo, hi", [(0, 1), (0, 65_536), (983_040, 1_048_576), (9_999_900, 10_000_100), (5_000_000, 5_065_536), (1, 10**11)])
def test_decimal_text(lo, hi):
    some = np.random.default_rng(1).integers(lo, hi, 500)
    assert boot.decimal_text(some) == ",".join(map(str, some.tolist())).encode()


def test_digest_of_draws_in_blocks(spark):
    ship_package(spark)
    whole = []
    for rep in range(3):
        blocks = [boot.block_draws(1, rep, b, int(m), 30, 8) + b * 8 for b, m in enumerate(boot.block_counts(1, rep, 30, 8))]
        texts = [hashlib.sha256(",".join(map(str, idx.tolist())).encode()).hexdigest() for idx in blocks]
        whole.append(hashlib.sha256("\n".join(texts).encode()).hexdigest())
    leaves = "\n".join(hashlib.sha256(w.encode()).hexdigest() for w in whole)
    assert boot.resample_digest(spark, 30, 3, 1, size=8).first()["root"] == hashlib.sha256(leaves.encode()).hexdigest()


def test_families_share_their_draws(spark):
    ship_package(spark)
    rows = [(f, a, s, c, float((c * k + s) % 7 + 1)) for f, m in (("x", 1), ("y", 2)) for a, k in (("dense", 3), ("a", 3 + m)) for s in range(3) for c in range(9)]
    df = spark.createDataFrame(rows, "family string, arm string, seed int, cluster int, err double").cache()
    got = {(r["family"], r["arm"]): r[2:] for r in boot.paired_bootstrap(df, reps=40, each=True).collect()}
    for family in "xy":
        assert [tuple(r)[1:] for r in boot.paired_bootstrap(df.where(f"family = '{family}'").drop("family"), reps=40).collect()] == [got[family, "a"]]


def test_pcg64_query_makes_all_replicates(spark, tmp_path):
    from fieldgauge.plans.queries import TABLE

    rows = [(k, k % 7, f"p{k % 2}", 1000.0 + 37 * k % 911) for k in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = TABLE["paired_bootstrap_pcg64"](spark, str(tmp_path)).collect()
    idx = np.random.Generator(np.random.PCG64(boot.SEED)).integers(0, 7, size=(boot.REPLICATES, 7), dtype=np.int64)
    ratios = []
    for s in range(3):
        own = [[k for k in range(60) if k % 7 == c] for c in range(7)]
        dense = np.array([np.mean([rows[k][3] / 1000 for k in ks]) for ks in own])
        reduced = np.array([np.mean([rows[k][3] / 1000 * (0.97 + 0.01 * ((k + s) % 7)) for k in ks]) for ks in own])
        ratios.append(reduced[idx].mean(axis=1) / dense[idx].mean(axis=1))
    lo, hi = np.percentile(np.median(ratios, axis=0), [2.5, 97.5])
    assert [tuple(r) for r in got] == [("reduced", pytest.approx(lo, abs=2e-6), pytest.approx(hi, abs=2e-6), 10_000)]
