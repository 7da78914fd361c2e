"""Leading directions of a scatter matrix too large for one machine, to a stated residual.

The search space S and its image under the scatter are tall tables of row blocks ``(b, s, z)``, one block
per ``STRIP`` field entries; D × k numbers are never on the driver unless the vectors to multiply fit the
broadcast bound. Every pass

- brings [S Z] to a triangular factor by a tree of QR factorisations over the tasks,
- solves the small problem that follows from the factor alone: Ritz values, and the true length of every
  residual ‖A x − θ x‖,
- locks the wanted directions whose residual is below the tolerance: they stay as they are and are not
  multiplied again,
- extends the space by the residuals of the others, which are the only vectors that meet the rows.

The iteration ends when all wanted residuals are below the tolerance, and says so; otherwise it says that
it did not.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.functions.arrow import to_lists, to_matrix
from fieldgauge.functions.blocks import Strips, numbered, over_strips
from fieldgauge.functions.sums import add_blocks
from fieldgauge.functions.vectors import doubles
from fieldgauge.session import BROADCAST_BYTES, cut

STRIP = 4096
STRIP_BYTES = 64 * 1024 * 1024
FAN_IN = 8
EPS64 = 2.0**-52


class Found(NamedTuple):
    """``directions`` ``(j, vec)`` and, in their order, eigenvalues of the scatter and relative residuals."""

    directions: DataFrame
    values: np.ndarray
    residuals: np.ndarray
    passes: int
    converged: bool


def _cell(batch: pa.RecordBatch, column: int, at: int) -> np.ndarray:
    return batch.column(column)[at].values.to_numpy(zero_copy_only=False)


def _flat(m: np.ndarray) -> pa.Array:
    return to_lists(m.reshape(1, -1))


def triangle(blocks: DataFrame, widths: dict[str, int], count: int) -> np.ndarray:
    """R of the QR factorisation of the named columns of ``count`` blocks side by side: a tree over the tasks."""
    side = sum(widths.values())

    def squeeze(held, m):
        return np.linalg.qr(m if held is None else np.vstack([held, m]), mode="r")

    def leaves(batches):
        held = None
        for batch in batches:
            for at in range(batch.num_rows):
                held = squeeze(held, np.hstack([_cell(batch, c, at).reshape(-1, w) for c, w in enumerate(widths.values()) if w]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([_flat(held)], names=["r"])

    def nodes(batches):
        held = None
        for batch in batches:
            for at in range(batch.num_rows):
                held = squeeze(held, _cell(batch, 0, at).reshape(-1, side))
        if held is not None:
            yield pa.RecordBatch.from_arrays([_flat(held)], names=["r"])

    factors = blocks.select(*widths).mapInArrow(leaves, "r array<double>")
    tasks = min(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), count) // FAN_IN
    while tasks > FAN_IN:
        factors = factors.repartition(tasks).mapInArrow(nodes, "r array<double>")
        tasks //= FAN_IN
    held = None
    for row in factors.toLocalIterator():
        held = squeeze(held, np.asarray(row["r"]).reshape(-1, side))
    out = np.zeros((side, side))
    out[: len(held)] = held
    return out


def _combined(blocks: DataFrame, take: dict[str, tuple[list[str], np.ndarray]]) -> DataFrame:
    """``(b, …)`` where each new column is a block of the named columns side by side times a small matrix."""
    sources = sorted({c for names, _ in take.values() for c in names})
    share = blocks.sparkSession.sparkContext.broadcast((sources, take))

    def run(batches):
        sources, take = share.value
        for batch in batches:
            for at in range(batch.num_rows):
                rows = batch.column(1)[at].as_py()
                held = {c: _cell(batch, 2 + i, at).reshape(rows, -1) for i, c in enumerate(sources)}
                made = [np.hstack([held[c] for c in names]) @ t for names, t in take.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), *map(_flat, made)], names=["b", "rows", *take])

    schema = "b int, rows int, " + ", ".join(f"{c} array<double>" for c in take)
    return blocks.select("b", "rows", *sources).mapInArrow(run, schema)


def as_directions(blocks: DataFrame, col: str, width: int) -> DataFrame:
    """The columns of a tall table as rows ``(j, vec)``."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                m = _cell(batch, 1, at).reshape(-1, width).T
                b = batch.column(0)[at].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, b, np.int32)), to_lists(m)], names=["j", "b", "seg"])

    pieces = blocks.select("b", col).mapInArrow(run, "j int, b int, seg array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("b", "seg")))
    return pieces.groupBy("j").agg(F.flatten(F.transform(ordered, lambda p: p["seg"])).alias("vec"))


def _cut_strips(z: np.ndarray, strip: int, names: list[str], extra: list[pa.Array]):
    for b, lo in enumerate(range(0, len(z), strip)):
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *extra, pa.array([1]), _flat(z[lo : lo + strip])], names=names)


def image(source: DataFrame, mean: np.ndarray, blocks: DataFrame, col: str, width: int, limit: int | None = None) -> DataFrame:
    """``(b, z)`` = Σ (y−μ)((y−μ)ᵀQ) over all rows, for the tall column ``col`` of ``width`` vectors.

    Vectors within ``limit`` bytes are shared and the rows stay where they are; more of them go by strips,
    each beside a lane of the rows.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    d, sc, strip = len(mean), source.sparkSession.sparkContext, STRIP
    rows = source.select("y") if d * width * 8 <= limit else numbered(source.select("y"))
    if d * width * 8 <= limit:
        q = np.zeros((d, width))
        for r in blocks.select("b", col).toLocalIterator():
            m = np.asarray(r[col]).reshape(-1, width)
            q[r["b"] * strip : r["b"] * strip + len(m)] = m
        share = sc.broadcast((q, mean))

        def run(batches):
            q, mu = share.value
            z = None
            for batch in batches:
                if batch.num_rows:
                    y = to_matrix(batch.column(0)) - mu
                    z = y.T @ (y @ q) if z is None else z + y.T @ (y @ q)
            if z is not None:
                yield from _cut_strips(z, strip, ["b", "n", "z"], [])

        parts = rows.mapInArrow(run, "b int, n bigint, z array<double>")
        return add_blocks(parts, ["b"], ["z"], count=-(-d // strip)).select("b", "z")
    size = max(1, min(width, STRIP_BYTES // (8 * d)))
    table = as_directions(blocks, col, width).select(F.floor(F.col("j") / size).cast("int").alias("strip"), F.col("j").alias("pos"), "vec")
    matrix = Strips(table, width, d, size, -(-width // size))
    share, held = sc.broadcast(mean), []

    def gather(s, b, own, y):
        y = y - share.value
        z = y.T @ (y @ b.T)
        held[:] = [held[0] + z] if held else [z]

    def close(s, b):
        if not held:
            return None
        z = held.pop()
        out = list(_cut_strips(z, strip, ["b", "s", "n", "z"], [pa.array([s], pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([o.column(c) for o in out]) for c in range(4)], names=["b", "s", "n", "z"])

    parts = over_strips(rows, ["_row"], ["y"], matrix, "b int, s int, n bigint, z array<double>", gather, close=close)
    sums = add_blocks(parts, ["b", "s"], ["z"], count=-(-d // strip) * matrix.count).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("s", "z"))).alias("p"))

    def beside(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                strips = [np.asarray(p["z"]).reshape(-1, min(size, width - p["s"] * size)) for p in batch.column(1)[at].as_py()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), _flat(np.hstack(strips))], names=["b", "z"])

    return sums.mapInArrow(beside, "b int, z array<double>")


def _start(source: DataFrame, d: int, width: int, seed: int) -> DataFrame:
    """A random tall table."""
    strip = STRIP

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                rows = min(strip, d - b * strip)
                m = np.random.Generator(np.random.PCG64([seed, b])).standard_normal((rows, width))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([rows], pa.int32()), _flat(m)], names=["b", "rows", "q"])

    count = -(-d // strip)
    tasks = min(count, source.sparkSession.sparkContext.defaultParallelism)
    return source.sparkSession.range(0, count, 1, tasks).mapInArrow(run, "b int, rows int, q array<double>")


def leading(
    df: DataFrame, col: str, mean: np.ndarray, k: int, oversample: int = 10, tolerance: float = 1e-9,
    passes: int = 100, seed: int = 0, limit: int | None = None,
) -> Found:
    """The ``k`` leading eigenvectors of Σ(y−μ)(y−μ)ᵀ; residuals are relative to the largest eigenvalue."""
    source = df.select(doubles(col).alias("y"))
    d = len(mean)
    k = min(k, d)
    block = min(d, k + oversample)
    most = 4 * block
    blocks = cut(_start(source, d, block, seed), "space")
    blocks = cut(blocks.withColumnRenamed("q", "s").join(image(source, mean, blocks, "q", block, limit), "b"), "space")
    width = block
    for used in range(1, passes + 1):
        r = triangle(blocks, {"s": width, "z": width}, -(-d // STRIP))
        r11, r12, r22 = r[:width, :width], r[:width, width:], r[width:, width:]
        u, sv, vt = np.linalg.svd(r11)
        good = sv > sv[0] * 1e-12 if sv[0] > 0 else sv > 0
        p = vt.T[:, good] / sv[good]
        basis, inner, outer = u[:, good], r12 @ p, r22 @ p
        small = basis.T @ inner
        values, w = np.linalg.eigh((small + small.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        inside = inner - basis @ small
        rest = np.vstack([inside, outer]) @ w
        top = max(float(values[0]), 0.0) if len(values) else 0.0
        away = np.sqrt((rest * rest).sum(axis=0)) / (top or 1.0)
        wanted = min(k, len(values))
        open_ = np.flatnonzero(away[: min(block, len(values))] > tolerance)
        converged = not (away[:wanted] > tolerance).any()
        if converged or used == passes or width >= d:
            break
        add, size, turn = np.linalg.svd(rest[:, open_] / away[open_], full_matrices=False)
        new = size > size[0] * 1e-10
        mix = (w[:, open_] / away[open_]) @ (turn.T[:, new] / size[new])
        keep = w[:, : min(block, len(values))] if width + int(new.sum()) > most else w
        onto = np.vstack([-p @ small @ mix, p @ mix])
        blocks = cut(_combined(blocks, {"s": (["s"], p @ keep), "z": (["z"], p @ keep), "q": (["s", "z"], onto)}), "space")
        fresh = image(source, mean, blocks, "q", int(new.sum()), limit).withColumnRenamed("z", "zq")
        width = keep.shape[1] + int(new.sum())
        left = np.eye(width)
        blocks = cut(_combined(blocks.join(fresh, "b"), {"s": (["s", "q"], left), "z": (["z", "zq"], left)}), "space")
    done = _combined(blocks, {"x": (["s"], p @ w[:, :wanted])})
    return Found(as_directions(done, "x", wanted), np.clip(values[:wanted], 0.0, None), away[:wanted], used, bool(converged or width >= d))
