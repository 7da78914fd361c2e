"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

An entry c counts as the integer floor(1024 c) + 100000, so sums over any number of rows are exact.
Rows are read by three sums that Spark adds up (entries, centred scatter, covariance of the result) and
once more for the result; what leaves a task is one record per width of vectors, of the size of a
scatter matrix at most. With V = L Lᵀ by Cholesky with diagonal pivoting, rotations from the right make
the columns of L orthogonal: their squared norms are the eigenvalues of V and the columns, scaled to
one, its eigenvectors. V is never formed again, so small eigenvalues keep their digits.

Defined cases: a vector that is null, empty or holds null or non-finite entries, or entries beyond
``LARGEST``, gives no rows; vectors of different width are fitted apart, each width as a list of its own;
repeated rows count each and give rows each; a null key is kept; components without variance have no
whitened value and give no rows, so a list of one or of equal vectors has none; an empty table gives no
rows; columns that are not named are ignored. A deviation that does not fit a long is null. Widths above
``WIDEST`` are refused, as one scatter matrix must fit a task and the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.functions.sums import add_blocks

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
LARGEST = 2.0**42
WIDEST = 4096
EPS = 2.0**-52
_LOW = 26


class Whitening(NamedTuple):
    """The fit of one width: x - mean is ``(x - base) - rest / n``; ``axes`` are columns, ``values`` their eigenvalues."""

    n: int
    base: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None


def cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower triangular ``L`` (side × rank) and the pivot order with ``v[order][:, order] = L @ L.T``."""
    a = np.array(v, np.float64)
    side = len(a)
    order, low = np.arange(side), np.zeros((side, side))
    left = np.diag(a).copy()
    least = side * EPS * max(float(left.max(initial=0.0)), 0.0)
    for k in range(side):
        p = k + int(left[order[k:]].argmax())
        if not left[order[p]] > least:
            return low[:, :k], order
        order[[k, p]] = order[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        pivot, below = order[k], order[k + 1 :]
        low[k, k] = np.sqrt(left[pivot])
        low[k + 1 :, k] = (a[below, pivot] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        left[below] -= low[k + 1 :, k] ** 2
    return low, order


def _rounds(columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of disjoint pairs."""
    ring = np.arange(columns + columns % 2)
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        p, q = ring[:half], ring[: half - 1 : -1]
        inside = (p < columns) & (q < columns)
        yield np.minimum(p, q)[inside], np.maximum(p, q)[inside]
        ring[1:] = np.roll(ring[1:], 1)


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` rotated until they are orthogonal to rounding."""
    a = np.array(factor, np.float64)
    small = EPS * np.sqrt(max(a.shape))
    for _ in range(sweeps):
        quiet = True
        for p, q in _rounds(a.shape[1]):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > small * np.sqrt(xx * yy)
            if not turn.any():
                continue
            quiet = False
            p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
            zeta = (yy[turn] - xx[turn]) / (2.0 * xy[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1.0 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if quiet:
            return a
    raise RuntimeError(f"columns are not orthogonal after {sweeps} sweeps")


def eigen(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance and their unit vectors as columns, largest entry positive."""
    low, order = cholesky(v)
    if not low.shape[1]:
        return np.zeros(0), np.zeros((len(v), 0))
    turned = jacobi(low)
    values = (turned * turned).sum(axis=0)
    first = np.argsort(-values, kind="stable")[:k]
    axes = np.zeros((len(v), len(first)))
    axes[order] = turned[:, first] / np.sqrt(values[first])
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(first))] < 0, -1.0, 1.0)
    return values[first], axes


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < LARGEST), F.lit(False)))
    return vectors.select(F.col(key).alias("key"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per width of the vectors: the rows that have it, and their integers."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    wide = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(wide) - wide
    for w in np.unique(wide):
        rows = np.flatnonzero(wide == w)
        entries = flat if len(rows) == len(wide) else flat[(at[rows][:, None] + np.arange(w)).ravel()]
        yield rows, np.floor(SCALE * entries.reshape(len(rows), w)).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, m: Whitening) -> np.ndarray:
    return (x - m.base) - m.rest / m.n


def _lists(kind, rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel(), kind))


def _sums(rows: DataFrame) -> dict[int, Whitening]:
    """Number of rows and exact sums per width."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for at, x in _groups(batch, 0):
                w = x.shape[1]
                low = np.stack([(x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0)])
                n, s = held.get(w, (0, 0))
                held[w] = n + len(at), s + low
        for w, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([w]), pa.array([n]), _lists(pa.int64(), s[:1]), _lists(pa.int64(), s[1:])], names=["width", "n", "high", "low"])

    parts = rows.select("v").mapInArrow(run, "width bigint, n bigint, high array<bigint>, low array<bigint>")
    each = parts.select("width", "n", F.posexplode(F.arrays_zip("high", "low")).alias("j", "s"))
    added = each.groupBy("width", "j").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    fits: dict[int, list] = {}
    for r in added.orderBy("width", "j").collect():
        fits.setdefault(r["width"], []).append((r["n"], (r["high"] << _LOW) + r["low"]))
    if max(fits, default=0) > WIDEST:
        raise ValueError(f"vectors of width {max(fits)}; at most {WIDEST}")
    nothing = np.zeros((0, 0))
    return {
        w: Whitening(s[0][0], np.array([t // n for n, t in s], np.int64), np.array([t % n for n, t in s], np.int64), nothing, nothing, 0.0)
        for w, s in fits.items()
    }


def _scatters(rows: DataFrame, fits: dict[int, Whitening]) -> dict[int, np.ndarray]:
    """The covariance of each width, from entries centred before they are multiplied."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for _, x in _groups(batch, 0):
                z = _centred(x, fits[x.shape[1]])
                held[x.shape[1]] = held.get(x.shape[1], 0.0) + z.T @ z
        for w, s in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(w, w)), pa.array(np.arange(w)), pa.array(np.ones(w, np.int64)), _lists(pa.float64(), s)], names=["width", "i", "n", "row"]
            )

    parts = rows.select("v").mapInArrow(run, "width bigint, i bigint, n bigint, row array<double>")
    out = {w: np.zeros((w, w)) for w in fits}
    for r in add_blocks(parts, ["width", "i"], ["row"]).toLocalIterator():
        out[r["width"]][r["i"]] = r["row"]
    return {w: s / fits[w].n for w, s in out.items()}


def _identity_errors(rows: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """Largest entry of the covariance of the whitened values minus the identity."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for _, x in _groups(batch, 0):
                w = x.shape[1]
                y = project(x, fits[w])
                if not y.shape[1]:
                    continue
                mean = y.mean(axis=0)
                here = {"n": len(y), "mean": mean, "m2": ((y - mean).T @ (y - mean)).ravel()}
                held[w] = merged(held[w], here) if w in held else here
        for w, s in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([w]), pa.array([s["n"]]), _lists(pa.float64(), s["mean"][None]), _lists(pa.float64(), s["m2"][None])], names=["width", "n", "mean", "m2"]
            )

    parts = rows.select("v").mapInArrow(run, "width bigint, n bigint, mean array<double>, m2 array<double>")
    out = {}
    for r in add_blocks(parts, ["width"], ["mean", "m2"], merge=merged).toLocalIterator():
        k = len(r["mean"])
        out[r["width"]] = float(np.abs(np.array(r["m2"]).reshape(k, k) / r["n"] - np.eye(k)).max())
    return out


def merged(a: dict, b: dict) -> dict:
    """Two records of (n, mean, centred scatter) as one."""
    n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
    m2 = a["m2"] + b["m2"] + np.outer(gap, gap).ravel() * (a["n"] * b["n"] / n)
    return {"n": n, "mean": a["mean"] + gap * (b["n"] / n), "m2": m2}


def project(x: np.ndarray, m: Whitening) -> np.ndarray:
    """Whitened values of integer rows, one column per component."""
    return _centred(x, m) @ m.axes / np.sqrt(m.values)


def deviations(x: np.ndarray, m: Whitening) -> list[int | None]:
    """Sum over the dimensions of (n x - S)² as exact integers, None beyond a long."""
    most = 2**63 - 1
    top = int(np.abs(x - m.base).max()) * m.n + m.n
    if top * top * x.shape[1] <= most:
        d = m.n * (x - m.base) - m.rest
        return (d * d).sum(axis=1).tolist()
    d = m.n * (x - m.base).astype(object) - m.rest.astype(object)
    return [int(s) if s <= most else None for s in (d * d).sum(axis=1)]


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> dict[int, Whitening]:
    """One ``Whitening`` per width of the usable vectors."""
    rows = _usable(vectors, key, vector)
    fits = _sums(rows)
    if not fits:
        return {}
    for w, v in _scatters(rows, fits).items():
        values, axes = eigen(v, k)
        fits[w] = fits[w]._replace(axes=axes, values=values, trace=float(np.trace(v)))
    errors = _identity_errors(rows, fits)
    return {w: m._replace(identity_error=errors.get(w)) for w, m in fits.items()}


def whiten(vectors: DataFrame, fits: dict[int, Whitening], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` per usable row and component."""
    rows = _usable(vectors, key, vector)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            for at, x in _groups(batch, 1):
                m = fits[x.shape[1]]
                k = len(m.values)
                if not k:
                    continue
                own = pa.array(np.repeat(at, k))
                size = len(own)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(size, m.n)),
                    pa.array(deviations(x, m), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(project(x, m).ravel()),
                    pa.array(np.tile(m.values / m.trace, len(at))), pa.array(np.full(size, m.identity_error)),
                ], names=names)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
