"""Grams by pairs of row blocks, lifted directions, and the iterated fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgauge.operators import basis, iterate
from fieldgauge.session import ship_package


def table(spark, y, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "row int, y array<double>").repartition(parts)


def gram(rows, n):
    out = np.full((n, n), np.nan)
    for r in rows.collect():
        assert r["n"] == n
        out[r["r"]] = r["g"]
    return out


@pytest.mark.parametrize("side", [7, 64])
@pytest.mark.parametrize("centered", ["none", "direct", "algebraic"])
def test_gram_by_pairs_of_row_blocks(spark, side, centered):
    ship_package(spark)
    y = np.random.default_rng(3).normal(size=(31, 45)) + 2
    y[8:24, 20:40] = 0.0  # whole column blocks that these rows do not have
    blocks = basis.to_blocks(table(spark, y), "row", "y", 10).where("exists(seg, v -> v <> 0)")
    z = y if centered == "none" else y - y.mean(axis=0)
    got = gram(basis.row_gram(blocks, 31, "row", centered, side), 31)
    np.testing.assert_allclose(got, z @ z.T, atol=1e-9)


def test_directions_are_lifted_in_strips(spark):
    ship_package(spark)
    y = np.random.default_rng(4).normal(size=(20, 33)) + 1
    z = y - y.mean(axis=0)
    values, u = np.linalg.eigh(z @ z.T)
    u, sigma = u[:, 1:], np.sqrt(values[1:])
    blocks = basis.to_blocks(table(spark, y), "row", "y", 8)
    for centered, m in ((True, z), (False, y)):
        lifted = {r["j"]: r["vec"] for r in basis.lift_directions(blocks, u, sigma, centered=centered, strip=6).collect()}
        np.testing.assert_allclose(np.array([lifted[j] for j in range(19)]), (m.T @ u / sigma).T, atol=1e-9)


@pytest.mark.parametrize("limit", [None, 100], ids=["shared", "strips"])
def test_iteration_reaches_its_tolerance(spark, monkeypatch, limit):
    ship_package(spark)
    monkeypatch.setattr(iterate, "STRIP", 16)
    monkeypatch.setattr(iterate, "STRIP_BYTES", 8 * 50 * 3)
    r = np.random.default_rng(5)
    turn = np.linalg.qr(r.normal(size=(50, 50)))[0]
    scale = np.concatenate([[9, 9 - 1e-4, 5, 5, 3, 2.9], np.linspace(1, 0.1, 44)])
    y = (r.normal(size=(400, 50)) * np.sqrt(scale)) @ turn.T + 4
    df, mean = table(spark, y), y.mean(axis=0)
    want, vectors = np.linalg.eigh((y - mean).T @ (y - mean))
    found = iterate.leading(df, "y", mean, 5, oversample=3, limit=limit)
    assert found.converged and found.residuals.max() <= 1e-9
    np.testing.assert_allclose(found.values, want[::-1][:5], rtol=1e-9)
    got = np.array([v["vec"] for v in found.directions.orderBy("j").collect()])
    assert np.abs(got @ got.T - np.eye(5)).max() < 1e-12
    assert np.abs(np.abs((got * vectors.T[::-1][:5]).sum(axis=1)) - 1).max() < 1e-6
    short = iterate.leading(df, "y", mean, 5, oversample=1, passes=2, limit=limit)
    assert not short.converged and short.residuals.max() > 1e-9
    with pytest.raises(RuntimeError, match="residual"):
        basis.fit_basis(df, k=5, side="randomized", oversample=1, passes=2)


def test_every_side_keeps_the_same_directions(spark, monkeypatch):
    ship_package(spark)
    r = np.random.default_rng(6)
    y = r.normal(size=(30, 6)) @ r.normal(size=(6, 40)) + 1  # rank six, on both sides of the width
    df = table(spark, y)
    sides = {s: basis.fit_basis(df, side=s, k=10, row="row", denom="one") for s in ("features", "samples", "randomized")}
    monkeypatch.setattr(basis, "DRIVER_SIDE", 8)
    sides["large samples"] = basis.fit_basis(df, side="samples", k=10, row="row", denom="one")
    sides["auto"] = basis.fit_basis(df, k=10, denom="one")
    first = np.array([v["vec"] for v in sides["features"].directions.orderBy("j").collect()])
    for name, got in sides.items():
        rows = got.directions.orderBy("j").collect()
        assert [v["j"] for v in rows] == list(range(6)), name
        np.testing.assert_allclose(np.array([v["vec"] for v in rows]), first, atol=1e-6, err_msg=name)


def test_record_of_a_complete_fit(spark):
    ship_package(spark)
    y = np.vstack([np.eye(4) * 3, -np.eye(4) * 3, [[0, 0, 0, 0]] * 2])  # four equal eigenvalues
    y = np.hstack([y, np.zeros((10, 2))])
    got = basis.complete_basis(table(spark, y), side="randomized", k=6, threshold=0.6)
    rec = got.record.first()
    assert (rec["rank"], rec["n_clusters"], rec["largest_cluster"], rec["k_energy"], rec["status"]) == (4, 1, 4, 3, "exact")
    assert abs(rec["total_energy"] - 72) < 1e-12 and rec["closure_residual"] < 1e-12
    vec = np.array([v["vec"] for v in got.directions.orderBy("j").collect()])
    np.testing.assert_allclose(vec, np.eye(4, 6), atol=1e-9)


def test_many_rows_of_narrow_fields_need_no_gram(spark, monkeypatch):
    ship_package(spark)
    y = np.random.default_rng(8).normal(size=(60, 5)) + 2
    df = table(spark, y)
    first = basis.fit_basis(df, side="samples", row="row", denom="one")
    monkeypatch.setattr(basis, "GRAM_SIDE", 16)
    monkeypatch.setattr(basis, "row_gram", None)  # never formed
    got = basis.fit_basis(df, side="samples", row="row", denom="one")
    np.testing.assert_allclose(got.fit.values, first.fit.values, rtol=1e-9)
    rows = [np.array([v["vec"] for v in b.directions.orderBy("j").collect()]) for b in (got, first)]
    np.testing.assert_allclose(*rows, atol=1e-7)
    assert got.fit.side == "samples" and len(basis.fit_basis(df, k=2, side="samples", row="row").fit.values) == 2
