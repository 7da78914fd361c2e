import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import codec, learn, metrics
from fieldgauge.operators.basis import dct_basis

KEEP = [0, 3, 7, 9]


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(7)
    y, p, mu = rng.standard_normal((26, 17)), rng.standard_normal((26, 17)), rng.standard_normal(17)
    b = np.linalg.qr(rng.standard_normal((17, 17)))[0]
    basis = spark.createDataFrame([(j, b[j].tolist(), 0.0) for j in range(17)], "j int, vec array<double>, eigval double")
    df = spark.createDataFrame(
        [(i, i % 2, i % 5, y[i].tolist(), p[i].tolist()) for i in range(26)],
        "id int, seed int, cluster int, y array<double>, p array<double>",
    ).repartition(5)
    return y, p, mu, b, basis, df


def col(df, name, order="id"):
    return np.asarray([r[name] for r in df.orderBy(order).collect()])


def test_three_encoders_agree(spark, case):
    y, p, mu, b, basis, df = case
    want = (y - mu) @ b[KEEP].T
    assert np.allclose(col(codec.encode(df, "y", basis, mu, KEEP), "coef"), want)
    assert np.allclose(col(codec.encode_by_expression(df, "y", basis, mu, ["id"], KEEP), "coef"), want)
    tiles = codec.encode_by_tiles(df, "y", basis, mu, KEEP, "coef", ["id"], tile=5)
    assert np.allclose(col(tiles, "coef"), want)


def test_order_of_the_kept_set_is_the_order_of_coefficients(spark, case):
    y, p, mu, b, basis, df = case
    turned = KEEP[::-1]
    assert np.allclose(col(codec.encode(df, "y", basis, mu, turned), "coef"), (y - mu) @ b[turned].T)
    with pytest.raises(ValueError, match="repeats"):
        codec.encode(df, "y", basis, mu, [0, 0])
    with pytest.raises(ValueError, match="does not hold"):
        codec.encode(df, "y", basis, mu, [0, 99])


def test_oversized_directions_take_the_tile_path(spark, case, monkeypatch):
    y, p, mu, b, basis, df = case
    monkeypatch.setattr(codec, "BROADCAST_BYTES", 100)
    for row in (["id"], None):
        assert np.allclose(col(codec.encode(df, "y", basis, mu, KEEP, row=row), "coef"), (y - mu) @ b[KEEP].T)


def test_decode_and_project(spark, case):
    y, p, mu, b, basis, df = case
    want = (y - mu) @ b[KEEP].T @ b[KEEP] + mu
    coded = codec.encode(df, "y", basis, mu, KEEP)
    assert np.allclose(col(codec.decode(coded, "coef", basis, mu, KEEP), "field"), want)
    assert np.allclose(col(codec.project(df, "y", basis, mu, KEEP), "projected"), want)


def test_floor_uses_the_set_not_a_prefix(spark, case):
    y, p, mu, b, basis, df = case
    r = y - mu
    outside = (r - r @ b[KEEP].T @ b[KEEP]) ** 2
    got = metrics.floor_perp(df, "y", basis, mu, KEEP).first()["floor"]
    prefix = metrics.floor_perp(df, "y", basis, mu, [0, 1, 2, 3]).first()["floor"]
    assert got == pytest.approx(outside.mean()) and abs(got - prefix) > 1e-3
    per = {x["cluster"]: x["floor"] for x in metrics.floor_perp(df, "y", basis, mu, KEEP, ["cluster"]).collect()}
    assert per == {c: pytest.approx(outside[c::5].mean()) for c in range(5)}


def test_floor_is_right_for_a_skew_set(spark, case):
    y, p, mu, b, basis, df = case
    skew = basis.withColumn("vec", F.transform("vec", lambda v: v * 1.5))
    rows = 1.5 * b[KEEP]
    r = y - mu
    want = ((r - r @ rows.T @ rows) ** 2).mean()
    assert metrics.floor_perp(df, "y", skew, mu, KEEP).first()["floor"] == pytest.approx(want)


def test_decomposition_closes(spark, case):
    y, p, mu, b, basis, df = case
    got = metrics.decompose(df, "y", "p", basis, mu, [1, 2, 4, 8, 12, 16], [])
    row = got.first()
    assert row["closure"] < 1e-12
    kept = b[[1, 2, 4, 8, 12, 16]]
    assert row["r_compact"] == pytest.approx((((y - mu) - (p - mu) @ kept.T @ kept) ** 2).mean())


def test_coefficient_loss_equals_field_loss(spark, case):
    y, p, mu, b, basis, df = case
    skew = basis.withColumn("vec", F.transform("vec", lambda v: v * 2 + 0.1))
    rows = 2 * b[KEEP] + 0.1
    coded = codec.encode(df, ["y", "p"], skew, mu, KEEP)
    got = metrics.coeff_loss(coded, "c_y", "c_p", skew, KEEP, []).first()["mse"]
    e = (y - p) @ rows.T
    assert got == pytest.approx(((e @ rows) ** 2).mean())


def test_two_row_errors_and_two_overall_errors(spark, case):
    y, p, mu, b, basis, df = case
    per_row = ((y - p) ** 2).mean(1)
    assert np.allclose(col(df.withColumn("m", metrics.row_mse("y", "p")), "m"), per_row)
    assert np.allclose(col(metrics.row_mse_batch(df, "y", "p", "m"), "m"), per_row)
    clusters = metrics.cluster_mse(df.withColumn("arm", F.lit("a")).withColumn("seed", F.lit(0)), "y", "p")
    flat = metrics.overall_mse(df, "y", "p").first()["mse"]
    even = metrics.mean_of_cluster_means(clusters).first()["mse"]
    assert flat == pytest.approx(per_row.mean())
    assert even == pytest.approx(np.mean([per_row[c::5].mean() for c in range(5)]))


def test_dense_must_be_strictly_better(spark):
    dense = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 1.0)], "family string, seed int, mse double")
    base = spark.createDataFrame([("a", 2.0), ("b", 1.5)], "family string, mse double")
    got = {r["family"]: (r["every_seed_better"], r["median_better"]) for r in metrics.qualify_dense(dense, base).collect()}
    assert got == {"a": (False, True), "b": (True, True)}


def test_store_round_trip(spark, case, tmp_path):
    y, p, mu, b, basis, df = case
    path = str(tmp_path / "store")
    codec.write_store(df, "y", ["id"], basis, mu, KEEP, path)
    assert np.allclose(col(codec.read_store(spark, path), "field"), (y - mu) @ b[KEEP].T @ b[KEEP] + mu, atol=1e-5)
    codec.write_dense_store(df, "y", ["id"], str(tmp_path / "dense"))
    sizes = codec.store_bytes(codec.store_sizes(spark, {"dense": str(tmp_path / "dense"), "reduced": path}))
    assert {r["scheme"] for r in sizes.collect()} == {"dense", "reduced"}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        codec.write_store(df, "y", ["id"], basis, mu, KEEP, path)
    with pytest.raises(ValueError, match="outside"):
        codec.write_store(df, "y", ["id"], basis, mu, [0, 40], str(tmp_path / "x"))
    with pytest.raises(ValueError, match="distinct"):
        codec.write_store(df, "y", ["id"], basis, mu, [1, 1], str(tmp_path / "x"))


def test_linear_learner(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((300, 6))
    w, c = rng.standard_normal((6, 70)), rng.standard_normal(70)
    y = x @ w + c
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(300)], "id int, x array<double>, y array<double>").repartition(6)
    models = learn.fit_linear(df, "x", "y", [0, 1], ["id"], 0.7, ridge=0.0)
    assert np.allclose(models[0].weights, w) and np.allclose(models[1].bias, c)
    got = learn.predict_by_seed(df, "x", models).where("seed = 1")
    assert np.allclose(col(got, "pred"), y)


def test_reduced_linear_learner_is_the_projected_dense_one(spark):
    rng = np.random.default_rng(12)
    x, y = rng.standard_normal((200, 5)), rng.standard_normal((200, 16))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(200)], "id int, x array<double>, y array<double>")
    basis, mu, keep = dct_basis(spark, 16), y.mean(0), [2, 0, 5]
    coded = codec.encode(df, "y", basis, mu, keep)
    dense = learn.fit_linear(df, "x", "y", [3], ["id"])[3]
    small = learn.fit_linear(coded, "x", "coef", [3], ["id"])[3]
    b = np.asarray([r["vec"] for r in basis.orderBy("j").collect()])[keep]
    assert np.allclose(small(x) @ b + mu, (dense(x) - mu) @ b.T @ b + mu)


def test_mlp_gradient_and_descent(spark):
    rng = np.random.default_rng(13)
    layers = [(rng.standard_normal((3, 4)), rng.standard_normal(4)), (rng.standard_normal((4, 2)), rng.standard_normal(2))]
    x, y = rng.standard_normal((5, 3)), rng.standard_normal((5, 2))
    grad, loss = learn.gradient(layers, x, y)
    flat = np.concatenate([np.concatenate([w.ravel(), c]) for w, c in layers])
    for at in (0, 7, 13, len(flat) - 1):
        moved = flat.copy()
        moved[at] += 1e-6
        again = learn.gradient(learn._unflatten(moved, [3, 4, 2]), x, y)[1]
        assert (again - loss) / 1e-6 == pytest.approx(grad[at], rel=1e-3, abs=1e-4)
    x = rng.standard_normal((200, 3))
    y = np.sin(x[:, :1])
    df = spark.createDataFrame([(i % 4 == 0, x[i].tolist(), y[i].tolist()) for i in range(200)], "held boolean, x array<double>, y array<double>")
    model, curve = learn.fit_mlp(df.where("not held"), df.where("held"), "x", "y", hidden=(16,), epochs=8, rate=0.03)
    assert curve[-1] < curve[0] and model(x).shape == (200, 1)
    scored = learn.score(df, "x", model)
    assert scored.where("held").select(metrics.row_mse("y", "pred").alias("m")).agg(F.avg("m")).first()[0] == pytest.approx(min(curve), rel=0.05)


def test_activation_takes_one_tanh(monkeypatch):
    z = np.linspace(-4, 4, 401)
    value, slope = learn.gelu_and_slope(z)
    want = 0.5 * z * (1 + np.tanh(np.sqrt(2 / np.pi) * (z + 0.044715 * z**3)))
    np.testing.assert_allclose(value, want, atol=1e-14)
    np.testing.assert_allclose(slope, np.gradient(value, z), atol=2e-2)
    seen, tanh = [], np.tanh
    monkeypatch.setattr(learn.np, "tanh", lambda a: seen.append(a.shape) or tanh(a))
    layers = [(np.ones((2, 3)), np.zeros(3)), (np.ones((3, 1)), np.zeros(1))]
    learn.gradient(layers, np.ones((5, 2)), np.zeros((5, 1)))
    assert seen == [(5, 3)]
