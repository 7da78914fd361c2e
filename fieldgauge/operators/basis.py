"""Mean, covariance and Gram sums over Spark, and the bases built from them.

A basis is a table ``(j, vec array<double>, eigval)``. Only matrices whose side is bounded by
``DRIVER_SIDE`` reach the driver; beyond that the fit is iterated to a stated residual.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldgauge.functions.arrow import to_lists, to_matrix
from fieldgauge.functions.blocks import runs
from fieldgauge.functions.sums import add_blocks, vector_sums
from fieldgauge.functions.vectors import doubles
from fieldgauge.operators.iterate import leading

DRIVER_SIDE = 8192
# A Gram above this side is not solved on the driver where the field width is below it.
GRAM_SIDE = 2048
EPS64 = 2.0**-52


class Fit(NamedTuple):
    """How a basis came about: eigenvalues of the raw scatter, largest relative residual and passes of an iteration."""

    side: str
    width: int
    values: np.ndarray
    residual: float
    passes: int


class Basis(NamedTuple):
    directions: DataFrame
    mean: np.ndarray
    n: int
    fit: Fit | None = None


def width_of(df: DataFrame, col: str) -> int:
    row = df.select(F.size(col).alias("d")).first()
    if row is None:
        raise ValueError("no rows")
    return row["d"]


def vec_mean(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, j, n, mean)`` accumulated in float64."""
    sums = vector_sums(df.withColumn(col, doubles(col)), [col], by, ["s"], lambda m: (m,))
    return sums.select(*by, "j", "n", (F.col("s") / F.col("n")).alias("mean"))


def mean_vector(df: DataFrame, col: str) -> np.ndarray:
    """The mean of one group as a NumPy vector of the field width."""
    rows = vec_mean(df, col).select("j", "mean").toPandas().sort_values("j")
    return rows["mean"].to_numpy()


# ---------------------------------------------------------------------------- D-side sums


def centred_scatter(df: DataFrame, col: str, block: int = 512, width: int | None = None) -> DataFrame:
    """Blocks of Σ(y−μ)(y−μ)ᵀ in one pass: ``(bi, bj, n, mean_i, mean_j, m2)``.

    A task keeps its own count, mean and centred scatter; two records of a block merge exactly,
    so the rows are read once and the shuffle is tasks·D²/2 whatever the number of rows. Where the
    field ``width`` is known, no more tasks merge the blocks than there is work for.
    """
    source = df.select(doubles(col).alias("y"))

    def run(batches):
        n, mean, m2 = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = to_matrix(batch.column(0))
            if y.shape[1] > DRIVER_SIDE:
                raise ValueError(f"D={y.shape[1]} exceeds {DRIVER_SIDE}; use the sample side or 'randomized'")
            k, mu = len(y), y.mean(axis=0)
            centred = y - mu
            scatter = centred.T @ centred
            if mean is None:
                n, mean, m2 = k, mu, scatter
            else:
                gap = mu - mean
                m2 += scatter + np.outer(gap, gap) * (n * k / (n + k))
                mean, n = mean + gap * (k / (n + k)), n + k
        if mean is None:
            return
        edges = range(0, len(mean), block)
        for bi, lo in enumerate(edges):
            for bj, start in enumerate(edges):
                if bj < bi:
                    continue
                rows, cols = slice(lo, lo + block), slice(start, start + block)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([bi], pa.int32()),
                        pa.array([bj], pa.int32()),
                        pa.array([n], pa.int64()),
                        to_lists(mean[None, rows]),
                        to_lists(mean[None, cols]),
                        to_lists(m2[rows, cols].reshape(1, -1)),
                    ],
                    names=["bi", "bj", "n", "mean_i", "mean_j", "m2"],
                )

    def merge(a, b):
        n = a["n"] + b["n"]
        gi, gj = b["mean_i"] - a["mean_i"], b["mean_j"] - a["mean_j"]
        return {
            "n": n,
            "mean_i": a["mean_i"] + gi * (b["n"] / n),
            "mean_j": a["mean_j"] + gj * (b["n"] / n),
            "m2": a["m2"] + b["m2"] + np.outer(gi, gj).ravel() * (a["n"] * b["n"] / n),
        }

    parts = source.mapInArrow(
        run,
        "bi int, bj int, n bigint, mean_i array<double>, mean_j array<double>, m2 array<double>",
    )
    edges = None if width is None else -(-width // block)
    return add_blocks(parts, ["bi", "bj"], ["mean_i", "mean_j", "m2"], merge, count=edges and edges * (edges + 1) // 2)


def covariance(df: DataFrame, col: str, denom: str = "n", block: int = 512) -> DataFrame:
    """Upper-triangle entries ``(i, k, n, value)``; ``denom="one"`` gives the raw centred scatter."""
    cells = centred_scatter(df, col, block).select(
        "bi", "bj", "n", F.size("mean_j").alias("w"), F.posexplode("m2").alias("p", "v")
    )
    i = F.col("bi") * block + F.floor(F.col("p") / F.col("w"))
    k = F.col("bj") * block + F.col("p") % F.col("w")
    value = F.col("v") / F.col("n") if denom == "n" else F.col("v")
    return cells.select(
        i.cast("int").alias("i"), k.cast("int").alias("k"), "n", value.alias("value")
    ).where("i <= k")


def _assemble(blocks: DataFrame, width: int, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    if width > DRIVER_SIDE:
        raise ValueError(f"D={width} exceeds {DRIVER_SIDE}; use the sample side or method='randomized'")
    scatter, mean, n = np.zeros((width, width)), np.zeros(width), 0
    for r in blocks.toLocalIterator():
        a, b = np.asarray(r["mean_i"]), np.asarray(r["mean_j"])
        lo, start = r["bi"] * block, r["bj"] * block
        cell = np.asarray(r["m2"]).reshape(len(a), len(b))
        scatter[lo : lo + len(a), start : start + len(b)] = cell
        scatter[start : start + len(b), lo : lo + len(a)] = cell.T
        mean[lo : lo + len(a)] = a
        n = r["n"]
    return scatter, mean, n


# ------------------------------------------------------------------------- sample-side sums


def to_blocks(df: DataFrame, row: str, col: str, block: int = 4096) -> DataFrame:
    """``(row, blk, seg)``: a wide field cut into column blocks."""
    d = F.size(col)
    starts = F.sequence(F.lit(0), F.floor((d - 1) / block).cast("int"))
    return df.select(F.col(row), doubles(col).alias("_f"), F.explode(starts).alias("blk")).select(
        row, "blk", F.slice("_f", F.col("blk") * block + 1, block).alias("seg")
    )


def _block_means(blocks: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """The mean segment of every column block over ``rows`` rows, absent ones as zeros: one vector of the field width."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for (blk,), part in runs(batch, 1):
                y = to_matrix(part.column(1))
                held[blk] = held.get(blk, 0.0) + y.sum(axis=0)
        for blk, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([1]), to_lists(s[None])], names=["blk", "n", "s"])

    parts = blocks.select(F.col("blk").cast("int").alias("blk"), "seg").mapInArrow(run, "blk int, n bigint, s array<double>")
    return {r["blk"]: np.asarray(r["s"]) / rows for r in add_blocks(parts, ["blk"], ["s"]).toLocalIterator()}


def row_gram(
    blocks: DataFrame, n: int, row: str = "row", centered: str = "none", side: int = 1024
) -> DataFrame:
    """Sample-side Gram YYᵀ as rows ``(r, n, g array)`` with ``row`` = 0..n-1.

    Rows are cut into blocks of ``side``. A task multiplies one pair of row blocks, the later with the
    earlier, over a share of the column blocks, and holds two segments of them and one ``side`` square;
    a row is copied once per row block. A row without some column block has zeros there. ``centered="algebraic"`` removes the column means from the Gram
    itself (G − r1ᵀ − 1rᵀ + ⟨μ,μ⟩) without a centred copy of the block; ``"direct"`` subtracts them first.
    """
    if centered not in ("none", "algebraic", "direct"):
        raise ValueError(f"unknown centring {centered!r}")
    spark = blocks.sparkSession
    count = -(-n // side)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shares = max(1, tasks // (count * (count + 1) // 2))
    means = _block_means(blocks, n) if centered != "none" else {}
    every = float(sum(m @ m for m in means.values()))
    mean = spark.sparkContext.broadcast(means)
    own, other = F.floor(F.col(row) / side).cast("int"), F.col("_other")
    dealt = (
        blocks.select(own.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_other"), F.col(row).cast("int").alias("_at"), F.col("blk").cast("int").alias("blk"), "seg")
        .select(F.least("_own", other).alias("i"), F.greatest("_own", other).alias("k"), F.pmod("blk", F.lit(shares)).alias("share"), "blk", "_at", "seg")
    )
    dealt = dealt.repartition(count * (count + 1) // 2 * shares, "i", "k", "share").sortWithinPartitions("i", "k", "share", "blk", "_at")

    def multiply(batches):
        cell, blk, held, total, seen = None, None, [], None, 0.0

        def product():
            nonlocal seen
            seen += float(mean.value[blk] @ mean.value[blk]) if centered != "none" else 0.0
            at, seg = np.concatenate([h[0] for h in held]), np.vstack([h[1] for h in held])
            sides = []
            for b in cell[:2]:
                y = np.zeros((min(side, n - b * side), seg.shape[1]))
                inside = at // side == b
                y[at[inside] - b * side] = seg[inside]
                sides.append(y)
            a, c = sides
            if centered == "direct":
                a, c = a - mean.value[blk], c - mean.value[blk]
            g = a @ c.T
            if centered == "algebraic":
                mu = mean.value[blk]
                g += mu @ mu - (a @ mu)[:, None] - (c @ mu)[None, :]
            return g

        def record():
            return pa.RecordBatch.from_arrays(
                [pa.array([cell[0]], pa.int32()), pa.array([cell[1]], pa.int32()), pa.array([n]), to_lists(total.reshape(1, -1)), to_lists(np.array([[seen]]))],
                names=["i", "k", "n", "g", "seen"],
            )

        for batch in batches:
            for (i, k, share, b), part in runs(batch, 4):
                if held and ((i, k, share) != cell or b != blk):
                    total = product() if total is None else total + product()
                    held = []
                if (i, k, share) != cell:
                    if total is not None:
                        yield record()
                    cell, total, seen = (i, k, share), None, 0.0
                blk = b
                held.append((part.column(4).to_numpy(), to_matrix(part.column(5))))
        if held:
            total = product() if total is None else total + product()
            yield record()

    squares = dealt.mapInArrow(multiply, "i int, k int, n bigint, g array<double>, seen array<double>")
    if shares > 1:
        squares = add_blocks(squares, ["i", "k"], ["g", "seen"])

    def both_ways(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                i, k = (batch.column(c)[at].as_py() for c in (0, 1))
                # column blocks that none of these rows have still count as minus their mean
                g = batch.column(3)[at].values.to_numpy(zero_copy_only=False).reshape(min(side, n - i * side), -1)
                g = g + (every - batch.column(4)[at].values.to_numpy(zero_copy_only=False)[0])
                for first, second, m in ((i, k, g), (k, i, g.T))[: 1 if i == k else 2]:
                    rows = first * side + np.arange(len(m))
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(np.full(len(m), second, np.int32)), to_lists(m)], names=["r", "k", "seg"])

    pieces = squares.mapInArrow(both_ways, "r int, k int, seg array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("k", "seg")))
    return pieces.groupBy("r").agg(F.lit(n).cast("bigint").alias("n"), F.flatten(F.transform(ordered, lambda p: p["seg"])).alias("g"))


def lift_directions(
    blocks: DataFrame, vectors: np.ndarray, sigma: np.ndarray, row: str = "row", centered: bool = True, strip: int = 512
) -> DataFrame:
    """Directions ``(j, vec)`` = (YᵀU − μ(1ᵀU))/σ.

    The rows of U meet the rows of Y by a join, in strips of ``strip`` directions; a task holds the
    products of one column block with one strip.
    """
    spark = blocks.sparkSession
    count = -(-len(sigma) // strip)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    u = spark.createDataFrame(pa.table({"_at": pa.array(np.arange(len(vectors)), pa.int64()), "_u": to_lists(vectors)}))
    u = u.select("_at", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("strip"), "_u").withColumn("_u", F.slice("_u", F.col("strip") * strip + 1, strip))
    lane = F.pmod(F.col(row), F.lit(max(1, tasks // count))).cast("int")
    met = blocks.select(F.col(row).cast("long").alias("_at"), F.col("blk").cast("int").alias("blk"), "seg", lane.alias("lane")).join(u, "_at")
    dealt = met.select("blk", "strip", "lane", "seg", "_u").repartition(tasks, "blk", "strip", "lane").sortWithinPartitions("blk", "strip", "lane")

    def multiply(batches):
        cell, held, total = None, None, None

        def record():
            return pa.RecordBatch.from_arrays(
                [pa.array([cell[0]], pa.int32()), pa.array([cell[1]], pa.int32()), pa.array([1]), to_lists(held.reshape(1, -1)), to_lists(total[None])],
                names=["blk", "strip", "n", "v", "y"],
            )

        for batch in batches:
            for key, part in runs(batch, 3):
                y, w = to_matrix(part.column(3)), to_matrix(part.column(4))
                if key != cell:
                    if cell is not None:
                        yield record()
                    cell, held, total = key, 0.0, 0.0
                held, total = held + y.T @ w, total + y.sum(axis=0)
        if cell is not None:
            yield record()

    parts = dealt.mapInArrow(multiply, "blk int, strip int, n bigint, v array<double>, y array<double>")
    ones = vectors.sum(axis=0)

    def finish(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                blk, s = (batch.column(c)[at].as_py() for c in range(2))
                lo = s * strip
                some = sigma[lo : lo + strip]
                v = batch.column(3)[at].values.to_numpy(zero_copy_only=False).reshape(-1, len(some))
                if centered:
                    v = v - np.outer(batch.column(4)[at].values.to_numpy(zero_copy_only=False) / len(vectors), ones[lo : lo + strip])
                js = lo + np.arange(len(some), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(js), pa.array(np.full(len(js), blk, np.int32)), to_lists((v / some).T)], names=["j", "blk", "seg"])

    pieces = add_blocks(parts, ["blk", "strip"], ["v", "y"]).mapInArrow(finish, "j int, blk int, seg array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("blk", "seg")))
    return pieces.groupBy("j").agg(F.flatten(F.transform(ordered, lambda p: p["seg"])).alias("vec"))


# --------------------------------------------------------------------------------- fitting


def choose_side(n: int, d: int) -> str:
    """The smaller square side, or the iteration when neither fits the driver."""
    if min(n, d) > DRIVER_SIDE:
        return "randomized"
    return "features" if d <= n else "samples"


def _table(spark: SparkSession, rows: np.ndarray, eigval: np.ndarray) -> DataFrame:
    table = pa.table(
        {
            "j": pa.array(np.arange(len(rows), dtype=np.int32)),
            "vec": to_lists(rows),
            "eigval": pa.array(np.asarray(eigval, dtype=np.float64)),
        }
    )
    return spark.createDataFrame(table)


def _spectrum(spark: SparkSession, j: np.ndarray, eigval: np.ndarray) -> DataFrame:
    """``(j, eigval)`` by Arrow, which the JVM reads itself; rows of a pandas frame would pass Python workers."""
    return spark.createDataFrame(pa.table({"j": pa.array(j, pa.int32()), "eigval": pa.array(eigval, pa.float64())}))


def fit_basis(
    df: DataFrame,
    col: str = "y",
    k: int | None = None,
    side: str = "auto",
    denom: str = "n",
    row: str | None = None,
    block: int = 512,
    oversample: int = 10,
    passes: int = 100,
    seed: int = 0,
    tolerance: float = 1e-9,
) -> Basis:
    """Directions of largest variance, descending, signs fixed; only those the sums can resolve.

    ``side``: ``features`` solves the D×D covariance, ``samples`` the N×N Gram (needs ``row``, the
    0-based row position), ``randomized`` iterates a D×(k+p) space until every residual is below
    ``tolerance`` of the largest eigenvalue, and fails if it is not after ``passes``. Whatever the side,
    a direction stays if its singular value exceeds the largest by sqrt(max(N, D)·eps). Eigenvalues are
    those of the covariance (``denom="n"``) or of the raw centred scatter (``denom="one"``). A sample side
    that is too large for one machine is iterated as well; over fields of a smaller width its Gram has no more
    directions than that, and the search space takes all of them.
    """
    spark = df.sparkSession
    d = width_of(df, col)
    n = df.count() if side in ("auto", "samples") else None
    if side == "auto":
        side = choose_side(n, d)
    residual, used = 0.0, 0
    if side == "features":
        scatter, mean, n = _assemble(centred_scatter(df, col, block, d), d, block)
        values, vectors = np.linalg.eigh(scatter)
        order = np.argsort(-values, kind="stable")
        values = np.clip(values[order], 0.0, None)
        top = resolved(values, n, d)[:k]
        directions = _table(spark, vectors[:, order[top]].T, values[top])
    elif side == "samples" and n <= DRIVER_SIDE and not n > GRAM_SIDE >= d:
        if row is None:
            raise ValueError("the sample side needs the row position column")
        pieces = to_blocks(df, row, col, max(block, 4096))
        gram = np.zeros((n, n))
        for r in row_gram(pieces, n, row, "direct").toLocalIterator():
            gram[r["r"]] = r["g"]
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        order = np.argsort(-values, kind="stable")
        values = np.clip(values[order], 0.0, None)
        top = resolved(values, n, d)[:k]
        lifted = lift_directions(pieces, vectors[:, order[top]], np.sqrt(values[top]), row)
        eig = _spectrum(spark, top, values[top])
        directions = lifted.join(F.broadcast(eig), "j").select("j", "vec", "eigval")
        mean = mean_vector(df, col)
    elif side in ("randomized", "samples"):
        whole = side == "samples" and d <= GRAM_SIDE
        if k is None and not whole:
            raise ValueError("a fit too large for one machine needs k")
        mean = mean_vector(df, col)
        n = df.count() if n is None else n
        found = leading(df, col, mean, d if whole else min(k, n), oversample, tolerance, passes, seed)
        if not found.converged:
            raise RuntimeError(f"residual {found.residuals.max()} above {tolerance} after {found.passes} passes")
        top = resolved(found.values, n, d)[:k]
        eig = _spectrum(spark, top, found.values[top])
        directions = found.directions.join(F.broadcast(eig), "j").select("j", "vec", "eigval")
        residual, used, values = float(found.residuals.max()), found.passes, found.values
    else:
        raise ValueError(f"unknown side {side!r}")
    if denom == "n":
        directions = directions.withColumn("eigval", F.col("eigval") / n)
    return Basis(canonical_sign(directions), mean, n, Fit(side, d, values[top], residual, used))


def resolved(values: np.ndarray, n: int, d: int) -> np.ndarray:
    """Numbers of the eigenvalues of a scatter, descending, that a sum in double precision tells from zero."""
    sigma = np.sqrt(values)
    return np.flatnonzero(sigma > (sigma[0] if len(sigma) else 0.0) * np.sqrt(max(n, d) * EPS64))


class Complete(NamedTuple):
    """``directions`` in canonical form with their ``cluster``, and one row of ``record``."""

    directions: DataFrame
    mean: np.ndarray
    record: DataFrame


def complete_basis(
    df: DataFrame, col: str = "y", k: int | None = None, side: str = "auto", row: str | None = None,
    denom: str = "n", threshold: float = 0.999, cluster_tolerance: float = 1e-10, tie: float = 1e-10, **fit,
) -> Complete:
    """Fit, cut at the resolved rank, turn clusters into their canonical form, and record how it went.

    The energy rank is taken of the full energy Σ‖y−μ‖² of the rows, which no side of the fit changes, so
    the record of the same rows is the same from every side. ``k_energy`` is null, with a status, where
    the directions do not reach the threshold.
    """
    got = fit_basis(df, col, k, side, denom, row, **fit)
    total = total_energy(df, col, got.mean)
    directions = canonical_clusters(got.directions, cluster_tolerance, tie)
    spectrum = _spectrum(df.sparkSession, np.arange(len(got.fit.values)), got.fit.values)
    tagged = cluster_ids(spectrum, cluster_tolerance).groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    sizes = tagged.agg(
        F.count(F.lit(1)).alias("n_clusters"), F.max("m").alias("largest_cluster"), F.count_if(F.col("m") > 1).alias("n_degenerate")
    )
    record = energy_rank(spectrum, total, threshold).crossJoin(sizes).select(
        F.lit(got.fit.side).alias("side"), F.lit(got.n).cast("long").alias("n"), F.lit(got.fit.width).cast("long").alias("d"),
        F.lit(len(got.fit.values)).cast("long").alias("rank"), F.lit(float(np.sqrt(max(got.n, got.fit.width) * EPS64))).alias("rank_tolerance"),
        F.lit(total).alias("total_energy"), F.lit(threshold).alias("threshold"), "k_energy", "resolved_fraction", "discarded_fraction",
        "closure_residual", "status", F.lit(cluster_tolerance).alias("cluster_tolerance"), "n_clusters", "n_degenerate", "largest_cluster",
        F.lit(got.fit.residual).alias("residual"), F.lit(got.fit.passes).cast("long").alias("passes"),
    )
    return Complete(directions, got.mean, record)


# ------------------------------------------------------------------------ canonical form


def canonical_sign(basis: DataFrame) -> DataFrame:
    """Make the component of largest magnitude positive; the first index wins a tie."""
    size = F.transform("vec", lambda v: F.abs(v))
    pivot = F.element_at("vec", F.array_position(size, F.array_max(size)).cast("int"))
    flip = F.when(pivot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return basis.withColumn("vec", F.transform("vec", lambda v: v * flip))


def cluster_ids(basis: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Add ``cluster``: neighbours whose eigenvalue gap over the largest is within ``tolerance``.

    The window runs over the numbers of the directions only; the directions join it.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("j")
    gap = F.try_divide(F.abs(F.lag("eigval").over(order) - F.col("eigval")), F.first("eigval").over(order))
    marked = basis.select("j", F.when(gap > tolerance, 1).otherwise(0).alias("_new"))
    numbered = marked.select("j", F.sum("_new").over(order).alias("cluster"))
    return basis.join(numbered, "j").select(*basis.columns, "cluster")


def projector_rows(b: np.ndarray, tie: float) -> np.ndarray:
    """The pivoted Cholesky factor of the projector bᵀb, row by row; the projector is never formed.

    The factor follows from the space alone. Diagonal entries within ``tie`` of the largest count as
    equal, and the first one is the pivot.
    """
    left = np.einsum("ij,ij->j", b, b)
    rows = np.zeros_like(b)
    for k in range(len(b)):
        pivot = np.flatnonzero(left >= left.max() - tie)[0]
        if left[pivot] <= tie:
            raise ValueError("the directions of a cluster depend on each other")
        row = b[:, pivot] @ b - rows[:k, pivot] @ rows[:k]
        rows[k] = row / np.sqrt(row[pivot])
        left = left - rows[k] ** 2
    return rows


def canonical_clusters(basis: DataFrame, tolerance: float = 1e-10, tie: float = 1e-10) -> DataFrame:
    """Directions that do not depend on how the eigensolver turned a degenerate cluster."""
    tagged = cluster_ids(basis, tolerance)

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1:
            return pdf
        pdf = pdf.sort_values("j")
        return pdf.assign(vec=list(projector_rows(np.vstack(pdf["vec"].to_numpy()), tie)))

    return canonical_sign_singletons(tagged.groupBy("cluster").applyInPandas(fix, tagged.schema))


def canonical_sign_singletons(tagged: DataFrame) -> DataFrame:
    """Apply the sign rule to clusters of one direction; larger clusters are already fixed."""
    size = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    counted = tagged.withColumn("_size", size)
    signed = canonical_sign(counted.withColumn("_raw", F.col("vec")))
    return signed.withColumn(
        "vec", F.when(F.col("_size") == 1, F.col("vec")).otherwise(F.col("_raw"))
    ).drop("_size", "_raw")


# ------------------------------------------------------------------------- spectrum rules


def resolved_rank(spectrum: DataFrame, n: int, d: int) -> DataFrame:
    """One row of ranks from ``(j, sigma)``: Gram-resolved, the nominal SVD count, and checks."""
    order = Window.partitionBy(F.lit(0)).orderBy("j")
    marked = spectrum.select(
        "sigma",
        (F.lag("sigma").over(order) < F.col("sigma")).alias("_rise"),
        (F.isnan("sigma") | (F.abs("sigma") == float("inf")) | (F.col("sigma") < 0)).alias("_bad"),
        F.max("sigma").over(Window.partitionBy(F.lit(0))).alias("_top"),
    )
    shape = float(max(n, d))
    return marked.agg(
        F.max("_top").alias("sigma_max"),
        F.count_if(F.col("sigma") > F.col("_top") * np.sqrt(shape * EPS64)).alias("r_gram_resolved"),
        F.count_if(F.col("sigma") > F.col("_top") * shape * EPS64).alias("r_svd_nominal"),
        F.coalesce(~F.bool_or("_rise"), F.lit(True)).alias("is_sorted"),
        (~F.bool_or("_bad")).alias("is_valid"),
    ).withColumn(
        "status",
        F.when(~(F.col("sigma_max") > 0), "failed_invalid_sigma_max")
        .when(F.col("r_gram_resolved") == 0, "failed_zero_rank")
        .otherwise("ok"),
    )


def energy_rank(
    spectrum: DataFrame, total: float | str = "spectrum", threshold: float = 0.999,
    resolved: int | None = None,
) -> DataFrame:
    """First k whose cumulative energy reaches ``threshold``, from ``(j, eigval)``.

    With a number, ``total`` is the full Frobenius energy of the data and the rule can fail;
    ``"spectrum"`` divides by the clipped spectrum sum instead.
    """
    clipped = spectrum.select("j", F.greatest(F.col("eigval"), F.lit(0.0)).alias("e"))
    whole = Window.partitionBy(F.lit(0))
    run = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = F.sum("e").over(whole)
    denominator = every if total == "spectrum" else F.lit(float(total))
    inside = F.lit(True) if resolved is None else F.col("j") < resolved
    cum = F.try_divide(F.sum(F.when(inside, F.col("e")).otherwise(0.0)).over(run), denominator)
    rows = clipped.withColumn("_cum", cum).withColumn("_all", F.try_divide(every, denominator))
    out = rows.agg(
        F.min(F.when(F.col("_cum") >= threshold, F.col("j") + 1)).alias("k_energy"),
        F.max("_cum").alias("resolved_fraction"),
        F.max("_all").alias("_all"),
    )
    return out.select(
        "k_energy",
        "resolved_fraction",
        (1 - F.col("resolved_fraction")).alias("discarded_fraction"),
        F.abs(F.col("_all") - 1).alias("closure_residual"),
        F.when(F.col("_all").isNull(), "failed_zero_energy")
        .when(F.col("k_energy").isNull(), "failed_energy_rank_unresolved")
        .otherwise("exact")
        .alias("status"),
    )


def total_energy(df: DataFrame, col: str, mean: np.ndarray) -> float:
    """Σ‖y−μ‖² over all rows."""
    from fieldgauge.operators.pairing import center
    from fieldgauge.functions.vectors import energy

    return center(df.select(col), col, mean).agg(F.sum(energy(F.col(col)))).first()[0]


def orthonormality(basis: DataFrame, keep: Sequence[int] | None = None) -> DataFrame:
    """``(max_abs)`` of BBᵀ − I over the basis or the kept rows.

    Directions that fit a broadcast are compared by one matrix product per batch; more of them by
    the sample-side Gram, whose column blocks are added by a shuffle. Only their numbers are put in
    order in one task.
    """
    from fieldgauge.operators.codec import kept_rows

    rows = basis if keep is None else basis.where(F.col("j").isin([int(j) for j in keep]))
    held = kept_rows(basis, keep)
    if held is None:
        order = Window.partitionBy(F.lit(0)).orderBy("j")
        places = rows.select("j", (F.row_number().over(order) - 1).alias("pos"))
        placed = rows.select("j", "vec").join(places, "j").drop("j")
        blocks = to_blocks(placed, "pos", "vec")
        gram = row_gram(blocks, rows.count(), "pos")
        cells = gram.select("r", F.posexplode("g").alias("k", "g"))
        want = F.when(F.col("r") == F.col("k"), 1.0).otherwise(0.0)
        return cells.agg(F.max(F.abs(F.col("g") - want)).alias("max_abs"))
    index = sorted(r["j"] for r in rows.select("j").collect())
    matrix = held if keep is None else held[np.argsort([int(j) for j in keep])]
    share = basis.sparkSession.sparkContext.broadcast((np.asarray(index), matrix))

    def gap(batches):
        for batch in batches:
            if batch.num_rows:
                at, b = share.value
                g = to_matrix(batch.column(1)) @ b.T
                g[np.arange(len(g)), np.searchsorted(at, batch.column(0).to_numpy())] -= 1.0
                yield pa.RecordBatch.from_arrays([pa.array([np.abs(g).max()])], names=["gap"])

    return rows.select(F.col("j").cast("long"), doubles("vec")).mapInArrow(gap, "gap double").agg(
        F.max("gap").alias("max_abs")
    )


def check_rank(ranks: DataFrame, largest_arm: int) -> DataFrame:
    """Violations of ``(rank, n_rows)``: above N−1, below the largest arm, or cut below N−1."""
    bound = F.col("n_rows") - 1
    reasons = F.array_compact(
        F.array(
            F.when(F.col("rank") > bound, F.lit("above_algebraic_bound")),
            F.when(F.col("rank") < largest_arm, F.lit("below_largest_arm")),
            F.when(F.col("rank") < bound, F.lit("artificial_cap")),
        )
    )
    return ranks.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def load_fixed_basis(
    basis: DataFrame, width: int, digest: str | None = None, gate: float = 2e-5
) -> DataFrame:
    """Validate an inherited basis and return it unchanged; it is never refitted."""
    from fieldgauge.operators.gates import collection_digest

    bad = basis.where((F.size("vec") != width) | F.col("j").isNull() | (F.col("j") < 0)).limit(1).count()
    repeated = basis.groupBy("j").count().where("count > 1").limit(1).count()
    if bad or repeated:
        raise ValueError("basis rows have a wrong width or index")
    residual = orthonormality(basis).first()["max_abs"]
    if residual is None or not residual <= gate:
        raise ValueError(f"orthonormality residual {residual} above {gate}")
    if digest is not None:
        found = collection_digest(basis, "vec", "j", "float64").first()["root"]
        if found != digest:
            raise ValueError(f"basis digest {found} differs from {digest}")
    return basis


def dct_basis(spark: SparkSession, width: int) -> DataFrame:
    """The orthonormal DCT-II directions, built by expression; ``eigval`` is null."""
    d = float(width)
    norm = F.when(F.col("j") == 0, F.lit((1 / d) ** 0.5)).otherwise(F.lit((2 / d) ** 0.5))
    grid = F.sequence(F.lit(0), F.lit(width - 1))
    vec = F.transform(
        grid, lambda i: norm * F.cos(F.lit(np.pi) * (2 * i + 1) * F.col("j") / F.lit(2 * d))
    )
    return spark.range(width).select(
        F.col("id").cast("int").alias("j"), vec.alias("vec"), F.lit(None).cast("double").alias("eigval")
    )
