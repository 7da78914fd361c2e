import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import basis as ops
from fieldgauge.operators import gates


def rows(spark, y, parts=1):
    data = [(i, [float(v) for v in r]) for i, r in enumerate(y)]
    return spark.createDataFrame(data, "pos int, y array<double>").repartition(parts)


def matrix(df, col="vec", order="j"):
    return np.asarray([r[col] for r in df.orderBy(order).collect()])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    return rng.standard_normal((60, 12)) @ np.diag(2.0 ** -np.arange(12)) + 3.0


def test_population_covariance_known_case(spark):
    got = {(r["i"], r["k"]): r["value"] for r in ops.covariance(rows(spark, [(1, 0), (3, 0), (5, 2), (7, 2)]), "y").collect()}
    assert got == {(0, 0): pytest.approx(5.0), (0, 1): pytest.approx(2.0), (1, 1): pytest.approx(1.0)}


@pytest.mark.parametrize("block", [5, 512])
def test_covariance_blocks(spark, data, parts, block):
    c = np.cov(data.T, bias=True)
    for r in ops.covariance(rows(spark, data, parts), "y", block=block).collect():
        assert r["value"] == pytest.approx(c[r["i"], r["k"]], abs=1e-12)


def test_covariance_keeps_precision_far_from_zero(spark):
    y = np.random.default_rng(5).standard_normal((200, 2)) + 1e8
    got = {(r["i"], r["k"]): r["value"] for r in ops.covariance(rows(spark, y, 6), "y").collect()}
    assert got[0, 0] == pytest.approx(y[:, 0].var(), rel=1e-6)


@pytest.mark.parametrize("side, k", [("features", None), ("samples", 11), ("randomized", 12)])
def test_fit_sides_agree(spark, data, side, k):
    fit = ops.fit_basis(rows(spark, data, 4), side=side, row="pos", k=k)
    b, lam = matrix(fit.directions), [r["eigval"] for r in fit.directions.orderBy("j").collect()]
    want = np.sort(np.linalg.eigvalsh(np.cov(data.T, bias=True)))[::-1]
    assert lam == pytest.approx(want[: len(lam)], rel=1e-6, abs=1e-12)
    assert np.abs(b @ b.T - np.eye(len(b))).max() < 1e-6
    c = data - data.mean(0)
    lost = ((c - c @ b[:4].T @ b[:4]) ** 2).sum() / len(c)
    assert lost == pytest.approx(want[4:].sum(), rel=1e-6)
    assert fit.mean == pytest.approx(data.mean(0))
    assert (b[np.arange(len(b)), np.abs(b).argmax(1)] > 0).all()


def test_wide_fields_use_the_sample_side(spark):
    y = np.random.default_rng(2).standard_normal((6, 500))
    fit = ops.fit_basis(rows(spark, y, 3), row="pos", block=64, denom="one")
    b = matrix(fit.directions)
    s = np.linalg.svd(y - y.mean(0), compute_uv=False)
    assert len(b) == 5 and [r["eigval"] for r in fit.directions.orderBy("j").collect()] == pytest.approx(s[:5] ** 2)


def test_side_choice():
    assert ops.choose_side(100, 10) == "features" and ops.choose_side(10, 100) == "samples"
    assert ops.choose_side(10**6, 10**5) == "randomized"


def test_gram_centrings_agree(spark):
    y = np.random.default_rng(3).standard_normal((9, 40)) + 5
    blocks = ops.to_blocks(rows(spark, y, 3), "pos", "y", 16)
    c = y - y.mean(0)
    for how, want in (("none", y @ y.T), ("direct", c @ c.T), ("algebraic", c @ c.T)):
        got = np.asarray([r["g"] for r in ops.row_gram(blocks, 9, "pos", how).orderBy("r").collect()])
        assert np.allclose(got, want)


def test_sign_rule(spark):
    df = spark.createDataFrame([(0, [1.0, -2.0, 2.0]), (1, [0.5, 3.0, -3.0])], "j int, vec array<double>")
    got = {r["j"]: r["vec"] for r in ops.canonical_sign(df).collect()}
    assert got == {0: [-1.0, 2.0, -2.0], 1: [0.5, 3.0, -3.0]}


def test_clusters_are_rotation_free(spark):
    rng = np.random.default_rng(4)
    b = np.linalg.qr(rng.standard_normal((10, 4)))[0].T
    turn = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    lam = [5.0, 2.0, 2.0, 2.0]

    def table(m):
        return spark.createDataFrame([(j, m[j].tolist(), lam[j]) for j in range(4)], "j int, vec array<double>, eigval double")

    turned = b.copy()
    turned[1:] = turn @ b[1:]
    turned[0] *= -1
    one, two = matrix(ops.canonical_clusters(table(b))), matrix(ops.canonical_clusters(table(turned)))
    assert np.allclose(one, two, atol=1e-9)
    assert np.allclose(one[1:].T @ one[1:], b[1:].T @ b[1:])
    ids = [r["cluster"] for r in ops.cluster_ids(table(b)).orderBy("j").collect()]
    assert ids == [0, 1, 1, 1]


def spectrum(spark, values, name="eigval"):
    return spark.createDataFrame([(j, float(v)) for j, v in enumerate(values)], f"j int, {name} double")


def test_energy_rank_has_two_denominators(spark):
    s = spectrum(spark, [90, 9, 0.95, -0.1])
    assert ops.energy_rank(s).first()["k_energy"] == 3
    assert ops.energy_rank(s, 100.0, 0.99).first()["k_energy"] == 2
    lost = ops.energy_rank(s, 200.0).first()
    assert lost["k_energy"] is None and lost["status"] == "failed_energy_rank_unresolved"
    assert ops.energy_rank(s, 99.95, 0.999, resolved=2).first()["status"] == "failed_energy_rank_unresolved"
    assert ops.energy_rank(spectrum(spark, [0, 0])).first()["status"] == "failed_zero_energy"


def test_resolved_rank(spark):
    got = ops.resolved_rank(spectrum(spark, [1, 1e-3, 1e-12, 1e-20], "sigma"), 100, 10).first()
    assert (got["r_gram_resolved"], got["r_svd_nominal"], got["is_sorted"], got["status"]) == (2, 3, True, "ok")
    assert not ops.resolved_rank(spectrum(spark, [1, 2], "sigma"), 2, 2).first()["is_sorted"]
    assert ops.resolved_rank(spectrum(spark, [0, 0], "sigma"), 2, 2).first()["status"] == "failed_invalid_sigma_max"


def test_rank_rules(spark):
    df = spark.createDataFrame([("a", 9, 10), ("b", 10, 10), ("c", 5, 10)], "id string, rank int, n_rows int")
    got = {r["id"]: r["reasons"] for r in ops.check_rank(df, 6).collect()}
    assert got == {"b": ["above_algebraic_bound"], "c": ["below_largest_arm", "artificial_cap"]}


def test_inherited_basis_is_validated(spark):
    good = ops.dct_basis(spark, 16)
    digest = gates.collection_digest(good, "vec", "j", "float64").first()["root"]
    assert ops.load_fixed_basis(good, 16, digest) is good
    with pytest.raises(ValueError, match="orthonormality"):
        ops.load_fixed_basis(good.withColumn("vec", F.transform("vec", lambda v: v * 1.01)), 16)
    with pytest.raises(ValueError, match="width"):
        ops.load_fixed_basis(good, 17)
    with pytest.raises(ValueError, match="digest"):
        ops.load_fixed_basis(good, 16, "0" * 64)


def test_cosine_basis_is_orthonormal(spark):
    assert ops.orthonormality(ops.dct_basis(spark, 64)).first()["max_abs"] < 1e-12
    assert ops.orthonormality(ops.dct_basis(spark, 64), [0, 5, 9]).first()["max_abs"] < 1e-12


def test_oversized_basis_goes_through_the_block_gram(spark, monkeypatch):
    from fieldgauge.operators import codec

    monkeypatch.setattr(codec, "BROADCAST_BYTES", 64)
    skew = ops.dct_basis(spark, 16).withColumn("vec", F.transform("vec", lambda v: v * 1.5))
    assert ops.orthonormality(skew, [1, 4, 9]).first()["max_abs"] == pytest.approx(1.25)
    assert ops.orthonormality(ops.dct_basis(spark, 16)).first()["max_abs"] < 1e-12
