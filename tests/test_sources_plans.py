import json

import numpy as np
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from fieldgauge.plans import qualify, walk
from fieldgauge.sources import arrays, records, series, snapshots, store


def test_npz_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez(tmp_path / "a.npz", X=x, Y=x + 1, traj=np.array([0, 0, 1, 1]))
    got = arrays.ingest_npz(spark, str(tmp_path)).orderBy("row").collect()
    assert [r["traj"] for r in got] == [0, 0, 1, 1] and got[3]["y"] == (x[3] + 1).tolist()
    np.savez(tmp_path / "b.npz", X=x, Y=x[:2], traj=np.array([0]))
    with pytest.raises(Exception, match="do not match"):
        arrays.ingest_npz(spark, str(tmp_path)).collect()
    np.save(tmp_path / "c.npy", x)
    assert arrays.ingest_npy(spark, str(tmp_path)).count() == 4


def test_snapshot_scan_prunes(spark, tmp_path):
    rows = [(f, r, k, t, [float(t)] * 4) for f in "ab" for r in ("train", "test") for k in range(2) for t in range(6)]
    path = str(tmp_path / "s")
    snapshots.write_snapshots(spark.createDataFrame(rows, snapshots.SNAPSHOTS), path)
    df = snapshots.read_snapshots(spark, path, roles=["train"], frames=[0, 5])
    assert df.count() == 8
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(role" in plan or "PartitionFilters: [role" in plan or "role#" in plan
    assert "PushedFilters: [In(t, [0,5])]" in plan
    narrow = df.select("traj")._jdf.queryExecution().executedPlan().toString()
    assert "field:array" not in narrow


def test_wide_series(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time,s1,s2\n2020-01-02 00:00:00,3.5,4\n2020-01-01 00:00:00,1,2\n")
    got = {(r["series_id"], r["step"]): r["value"] for r in series.read_wide_series(spark, str(tmp_path / "w.csv"), "time").collect()}
    assert got == {("s1", 0): 1.0, ("s1", 1): 3.5, ("s2", 0): 2.0, ("s2", 1): 4.0}


def test_records_and_registries(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"a": {"b": [1, 2]}, "k": 3}, indent=1))
    row = records.read_records(spark, str(tmp_path / "r.json"), "a struct<b: array<int>>, k int").first()
    assert row["a"]["b"] == [1, 2] and row["k"] == 3
    (tmp_path / "m.tsv").write_text("ab\t12\tx/y.pt\n")
    assert records.read_manifest_tsv(spark, str(tmp_path / "m.tsv")).first().asDict() == {"sha256": "ab", "bytes": 12, "path": "x/y.pt"}
    good, bad = {"f": {"sha256": "0" * 64, "bytes": 5}}, {"f": {"sha256": "0" * 63, "bytes": 5}}
    (tmp_path / "g.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(bad))
    assert records.read_digest_registry(spark, str(tmp_path / "g.json")).first()["bytes"] == 5
    with pytest.raises(Exception, match="malformed digest"):
        records.read_digest_registry(spark, str(tmp_path / "b.json")).collect()


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_once(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.write_once(spark.range(3), path)
    store.write_replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


# Known values of the study at two scales: K, slack, median quality, median floor.
GOLDEN = {"0.001": (8, 0.0641, 1.1174, 0.1435), "0.01": (16, 0.1041, 1.0678, 0.0830)}


@pytest.mark.parametrize("scale", list(GOLDEN))
def test_walk_study_golden(spark, scale):
    w = walk.study(spark, f"/root/testdata/sf{scale}", holdout=True)
    got = qualify.qualify(
        walk.predictions(w), w.basis, w.mean, w.width, walk.LADDER, "holdout", "holdout", reps=50
    ).first()
    assert (got["k"], round(got["slack"], 4), round(got["quality"], 4), round(got["floor"], 4)) == GOLDEN[scale]
    assert got["verdict"] == "OPTIMISATION_OR_GENERALISATION_SHORTFALL"


def test_selection_per_seed(spark):
    w = walk.study(spark, "/root/testdata/sf0.01", holdout=True)
    selection, _ = qualify.choose(walk.predictions(w), w.basis, w.mean, w.width, walk.LADDER, "holdout")
    assert [r["selected_k"] for r in selection.orderBy("seed").collect()] == [16, 32, 48]


def test_entry_and_registration(spark):
    df = entry(spark)
    assert df.count() == 1 and "verdict" in df.columns
    assert set(oracle_sql()) <= set(queries())


def test_partition_count_does_not_change_a_result(spark, sf):
    names = ["split_by_trajectory", "pair_next", "gain_order"]
    want = {n: sorted(map(tuple, queries()[n](spark, sf).collect())) for n in names}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for n in names:
            assert sorted(map(tuple, queries()[n](spark, sf).collect())) == want[n]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
