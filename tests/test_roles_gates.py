import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.operators import gates, roles


def keys(spark, n=100, families=("a",), parts=3):
    return spark.createDataFrame([(f, k) for f in families for k in range(n)], "family string, traj int").repartition(parts)


RANGES = {"train": (0, 60), "validation": (60, 80), "selection": (80, 100)}


@pytest.mark.parametrize("method", ["hash", "pcg64"])
def test_split_is_disjoint_complete_and_stable(spark, method):
    one = roles.split_by_trajectory(keys(spark, families="ab"), 5, RANGES, method)
    two = roles.split_by_trajectory(keys(spark, families="ab", parts=7), 5, RANGES, method)
    assert sorted(one.select(*two.columns).collect()) == sorted(two.collect())
    assert roles.check_disjoint(one).count() == 0
    assert roles.reserve(keys(spark, families="ab"), one).count() == 0
    expected = spark.createDataFrame([("train", 120), ("validation", 40), ("selection", 40)], "role string, n_expected bigint")
    assert roles.check_coverage(one, expected).count() == 0


def test_pcg64_permutation(spark):
    # The head of NumPy's permutation(100) with this seed.
    got = roles.split_by_trajectory(keys(spark), 776131, RANGES, "pcg64").orderBy("rank").limit(5).collect()
    assert [r["traj"] for r in got] == [33, 88, 90, 46, 42]


def test_split_digests_are_those_of_the_joined_keys(spark):
    split = roles.split_by_trajectory(keys(spark), 3, RANGES)
    for r in roles.split_digest(split).collect():
        ordered = [str(k["traj"]) for k in split.where(F.col("role") == r["role"]).orderBy("rank").collect()]
        assert r["sha256"] == hashlib.sha256("\n".join(ordered).encode()).hexdigest()
        numbers = np.asarray([int(k) for k in ordered], np.int64)
        raw = roles.split_digest(split.where(F.col("role") == r["role"]), form="int64").first()
        assert raw["sha256"] == hashlib.sha256(numbers.tobytes()).hexdigest()
    with pytest.raises(Exception, match="index_digest"):
        roles.split_digest(split, limit=30).collect()


def tree_of(keys, fan):
    level = [hashlib.sha256(str(k).encode()).hexdigest() for k in keys]
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


@pytest.mark.parametrize("fan", [2, 7, 64])
def test_index_tree_and_proofs(spark, fan):
    rows = [(r, i, 3 * i + n) for r, n in (("a", 1), ("b", 2), ("c", 17), ("d", 130)) for i in range(n)]
    df = spark.createDataFrame(rows, "role string, rank int, traj int").repartition(3)
    got = {r["role"]: (r["n_keys"], r["root"]) for r in roles.index_digest(df, fan=fan).collect()}
    want = {r: [k for q, _, k in rows if q == r] for r in "abcd"}
    assert got == {r: (len(ks), tree_of(ks, fan)) for r, ks in want.items()}
    proofs = df.join(roles.index_proofs(df, fan=fan), ["role", "rank"])
    again = proofs.select("role", "root", roles.index_root(F.col("traj"), F.col("path")).alias("own"), roles.index_root(F.col("traj") + 1, F.col("path")).alias("other")).collect()
    assert len(again) == len(rows) and all(r["own"] == r["root"] == got[r["role"]][1] and r["other"] != r["root"] for r in again)
    some = df.where("traj % 5 = 0").select("role", "rank")
    few = roles.index_proofs(df, fan=fan, wanted=some)
    assert few.count() == some.count() and few.join(proofs, ["role", "rank", "path", "root"], "left_anti").count() == 0
    assert roles.index_digest(df.where("rank < 0"), fan=fan).count() == 0


def test_overlap_is_found(spark):
    split = roles.split_by_trajectory(keys(spark), 3, RANGES).select("family", "traj", "role")
    moved = split.unionByName(spark.createDataFrame([("a", 7, "test")], "family string, traj int, role string"))
    got = roles.check_disjoint(moved).collect()
    assert [r["traj"] for r in got] == [7] and "test" in got[0]["roles"]


def requests(spark, **sets):
    rows = [(name, "a", k) for name, ks in sets.items() for k in (ks or [None])]
    return spark.createDataFrame(rows, "request_id string, family string, traj int")


def test_one_foreign_id_rejects_the_whole_request(spark):
    split = roles.split_by_trajectory(keys(spark), 3, RANGES, "pcg64")
    by_role = {}
    for r in split.collect():
        by_role.setdefault(r["role"], []).append(r["traj"])
    train = split.where("role = 'train'")
    good, mixed = by_role["train"], by_role["train"][:59] + by_role["validation"][:1]
    asked = requests(spark, good=good, mixed=mixed, every=list(range(100)), twice=[good[0], good[0]], empty=[])
    got = {r["request_id"]: r["accepted"] for r in roles.guard_requests(asked, train).collect()}
    assert got == {"good": True, "mixed": False, "every": False, "twice": False, "empty": False}
    assert {r["request_id"] for r in roles.accepted_rows(asked, train).collect()} == {"good"}
    with pytest.raises(roles.Refused):
        roles.require_requests(requests(spark, mixed=mixed), train)


def test_permissions_and_ledger(spark):
    allowed = spark.createDataFrame([("SELECT", "selection"), ("FIT", "train"), ("FIT", "unused")], "stage string, role string")
    asked = spark.createDataFrame([("SELECT", "selection"), ("SELECT", "test")], "stage string, role string")
    assert [r["role"] for r in roles.check_permission(asked, allowed).collect()] == ["test"]
    events = [("FIT", "train", "field_read", 5), ("FIT", "test", "bytes_hashed", 3), ("FIT", "unused", "field_read", 1), ("SELECT", "test", "field_read", 0)]
    ledger = spark.createDataFrame(events, "stage string, role string, event string, n int")
    assert [r["role"] for r in roles.ledger_violations(ledger, allowed).collect()] == ["unused"]
    total = roles.ledger_summary(ledger).where("stage is null and role is null").first()
    assert (total["fields_read"], total["files_hashed"]) == (6, 3)


def test_one_shot(spark, tmp_path):
    marker = str(tmp_path / "marker")
    with pytest.raises(ZeroDivisionError):
        roles.open_once(spark, marker, lambda: 1 / 0)
    with pytest.raises(roles.Refused):
        roles.open_once(spark, marker, lambda: spark.range(1))


def test_shuffled_control_keeps_marginals(spark):
    rows = [(i, ["train", "test", None][i % 3], float(i), float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, role string, x double, y double").repartition(5)
    got = roles.shuffle_within(df, 1, ["id"], "id", blocks=["train", "test"]).collect()
    assert len(got) == 90 and all(r["x"] == r["id"] for r in got)
    for role in ("train", "test"):
        part = [r for r in got if r["role"] == role]
        assert sorted(r["y"] for r in part) == sorted(r["x"] for r in part)
        assert any(r["y"] != r["x"] for r in part)
    assert all(r["y"] == r["x"] for r in got if r["role"] is None)


def test_blocks_with_embargo(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = {r["role"]: r["n"] for r in roles.split_blocks(df, "k", embargo=2).groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 58, "selection": 16, "test": 18}


def test_cohort(spark):
    rows = [(f, r) for f in range(6) for r in ("train", "valid", "test") if not (f == 2 and r == "valid")]
    used = spark.createDataFrame([(0,)], "family int")
    got = roles.select_cohort(spark.createDataFrame(rows, "family int, role string"), used, 3).collect()
    assert sorted(r["family"] for r in got) == [1, 3, 4]


# ---------------------------------------------------------------------------------- gates


def test_fingerprint_both_ways(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 1000)
    (tmp_path / "b.bin").write_bytes(b"")
    small = gates.fingerprint(spark, str(tmp_path), "*.bin").orderBy("path").collect()
    big = gates.fingerprint(spark, str(tmp_path), "*.bin", largest=-1).orderBy("path").collect()
    assert small == big and small[0]["sha256"] == hashlib.sha256(b"x" * 1000).hexdigest()


def test_reconcile_names_every_disagreement(spark):
    kind = "name string, bytes bigint, sha256 string"
    found = spark.createDataFrame([("a", 1, "x"), ("b", 0, "y"), ("c", 2, "z"), ("d", 5, "w")], kind)
    published = spark.createDataFrame([("a", 1, "x"), ("b", 0, "y"), ("c", 3, "q"), ("e", 5, "w")], kind)
    bad = gates.reconcile(found, published)
    got = {(r["name"], r["kind"]) for r in bad.collect()}
    assert got == {("b", "zero_bytes"), ("c", "digest_differs"), ("c", "size_differs"), ("d", "unexpected"), ("e", "missing")}
    assert gates.reconcile_status(bad).first()["status"] == "MISMATCH"
    assert gates.reconcile_status(gates.reconcile(published.where("bytes > 0"), published.where("bytes > 0"))).first()["status"] == "MATCH"
    with pytest.raises(gates.GateFailed):
        gates.require_empty(bad, "manifest")


def test_bound_files(spark):
    kind = "path string, bytes bigint, sha256 string"
    sealed = spark.createDataFrame([("/r/a", 1, "x"), ("/r/b", 1, "y"), ("/r/../s", 1, "z")], kind)
    found = spark.createDataFrame([("/r/a", 1, "x"), ("/r/b", 1, "changed"), ("/r/../s", 1, "z")], kind)
    got = {(r["path"], r["reason"]) for r in gates.verify_bound(found, sealed, "/r").collect()}
    assert got == {("/r/b", "changed_or_missing"), ("/r/../s", "outside_root")}


def test_schema_contract(spark):
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert gates.check_columns(spark.createDataFrame([(1, "x")], "a bigint, b string"), want) == []
    assert gates.check_columns(spark.createDataFrame([(1, 2)], "a int, c int"), want) == ["missing b", "unexpected c", "a is int, not bigint"]


def test_row_gate(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("ok", [1.0, 2.0])] * 2 + [("short", [1.0])] * 2 + [("nan", [1.0, nan])] * 2 + [("inf", [-inf, 1.0])] * 2 + [("few", [1.0, 2.0])] + [("null", None)] * 2
    df = spark.createDataFrame(rows, "g string, x array<double>")
    got = {r["g"]: (r["n_rows"], r["n_bad_length"], r["n_not_finite"]) for r in gates.check_rows(df, ["x"], 2, 2, ["g"]).collect()}
    assert set(got) == {"short", "nan", "inf", "few", "null"} and got["nan"] == (2, 0, 2) and got["short"] == (2, 2, 0)


def test_cell_grid(spark):
    arms = spark.createDataFrame([("dense",), ("small",)], "arm string")
    seeds = spark.createDataFrame([(s,) for s in range(3)], "seed int")
    rows = [("dense", s, True, True, "d") for s in range(3)] + [("small", 0, False, True, "d"), ("small", 1, True, True, None), ("odd", 0, True, True, "d"), ("dense", 2, True, True, "d")]
    traces = spark.createDataFrame(rows, "arm string, seed int, converged boolean, finite boolean, sha256 string")
    got = {(r["arm"], r["seed"]): r["reason"] for r in gates.check_cells(traces, arms, seeds).collect()}
    assert got == {("small", 0): "not_converged", ("small", 1): "no_digest", ("small", 2): "absent", ("odd", 0): "unexpected", ("dense", 2): "repeated"}


def test_array_digest_is_over_little_endian_bytes(spark):
    df = spark.createDataFrame([([1.5, -2.0],)], "v array<double>")
    for dtype, code in (("float32", "<f4"), ("float64", "<f8"), ("int64", "<i8")):
        want = hashlib.sha256(np.asarray([1.5, -2.0]).astype(code).tobytes()).hexdigest()
        assert gates.array_digest(df, "v", dtype).first()["sha256"] == want


def test_collection_digest_sees_order(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "i int, v array<double>")
    swapped = df.withColumn("i", 1 - F.col("i"))
    a, b = (gates.collection_digest(d.repartition(3), "v", "i").first()["root"] for d in (df, swapped))
    assert a != b and a == gates.collection_digest(df.coalesce(1), "v", "i").first()["root"]


def test_record_differences(spark):
    kind = "id int, a int, s struct<b: string, c: array<int>>"
    left = gates.flat_records(spark.createDataFrame([(1, 5, ("x", [1, 2])), (2, None, ("y", None))], kind), ["id"])
    right = gates.flat_records(spark.createDataFrame([(1, 6, ("x", [1, 3])), (2, None, ("y", None))], kind), ["id"])
    diff = gates.diff_records(left, right, ["id"])
    assert {(r["id"], r["path"]) for r in diff.collect()} == {(1, "a"), (1, "s.c")}
    assert gates.first_difference(diff, ["id"]).first()["path"] == "a"
    assert gates.changed_after_seal(left.where("path <> 'a'"), right, ["id"]).count() == 1


def test_stage_chain(spark):
    rows = [(0, "A", "COMPLETE", "p"), (1, "B", "OPEN", "p"), (2, "C", "COMPLETE", "q"), (4, "E", "COMPLETE", "q")]
    df = spark.createDataFrame(rows, "position int, stage string, status string, protocol_sha256 string")
    got = {r["stage"]: r["reason"] for r in gates.check_chain(df).collect()}
    assert got == {"C": "predecessor_not_complete", "E": "no_predecessor"}


def test_paired_control(spark):
    df = spark.createDataFrame([("a", 0, "i", 5), ("b", 0, "i", 5), ("a", 1, "i", 5), ("b", 1, "j", 6), ("a", 2, "i", 5)], "arm string, seed int, init string, n int")
    got = {(r["seed"], r["col"]) for r in gates.check_paired(df, "a", "b", ["init", "n"]).collect()}
    assert got == {(1, "init"), (1, "n"), (2, "init"), (2, "n")}


def test_index_sets(spark):
    order = spark.createDataFrame([(s, r, j) for s in range(4) for r, j in enumerate([2, 0, 1, 3])], "seed int, rank int, j int")
    sets = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (1, 0, 2), (1, 1, 2), (2, 0, 0), (2, 1, 2)], "seed int, pos int, j int")
    k = spark.createDataFrame([(s, 2) for s in range(4)], "seed int, k int")
    got = {r["seed"]: r["reason"] for r in gates.check_index_set(sets, order, k, ["seed"]).collect()}
    assert got == {1: "repeated", 2: "not_the_order_head", 3: "empty"}


def test_proofs_carry_columns_of_the_wanted_keys(spark):
    rows = [(g, i, 100 * i + 7, f"n{i}") for g, n in (("a", 70), ("b", 9), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "role string, rank long, traj long, name string").repartition(4)
    wanted = df.where("rank % 5 = 0").select("role", "rank")
    got = roles.index_proofs(df, fan=4, wanted=wanted, carry=["traj", "name"])
    checked = got.withColumn("found", roles.index_root(F.col("traj"), F.col("path"))).collect()
    roots = {r["role"]: r["root"] for r in roles.index_digest(df, fan=4).collect()}
    assert sorted((r["role"], r["rank"], r["name"]) for r in checked) == sorted((g, i, f"n{i}") for g, i, _, _ in rows if i % 5 == 0)
    assert all(r["found"] == r["root"] == roots[r["role"]] for r in checked)
    alone = roles.index_proofs(df.where("role = 'c'"), fan=4, carry=["name"]).first()
    assert alone["name"] == "n0" and alone["path"] == []


def test_paths_are_not_broadcast(spark):
    rows = [(g, i, 3 * i) for g, n in (("a", 300), ("b", 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "role string, rank long, traj long").repartition(4)
    got = roles.index_proofs(df, fan=4, wanted=df.where("rank % 3 = 0").select("role", "rank"), carry=["traj"])
    checked = got.select("root", roles.index_root(F.col("traj"), F.col("path")).alias("found"))
    assert all(r["found"] == r["root"] for r in checked.collect())
    # as it ran: a path grows by what is beside a node, which no estimate of Spark knows
    lines = checked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    joins = [line for line in lines if "Join" in line and "_up" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
