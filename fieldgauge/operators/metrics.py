"""Losses, floors and the error decomposition."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.functions.arrow import append, to_matrix, widened
from fieldgauge.functions.blocks import strips
from fieldgauge.functions.vectors import dot, doubles, minus, squared_error
from fieldgauge.operators.codec import encode, kept_rows, project_by_strips
from fieldgauge.session import cut


def row_mse(y: str, pred: str) -> Column:
    """Mean squared error of one row, in double, without leaving the JVM."""
    return squared_error(doubles(y), doubles(pred)) / F.size(y)


def _scalars(df: DataFrame, shared, sources: Sequence[str], outputs: Sequence[str], fn) -> DataFrame:
    """One double per output next to the other columns, by matrix arithmetic per Arrow batch.

    The vectors go in and do not come back.
    """
    share = df.sparkSession.sparkContext.broadcast(shared)
    rest = [c for c in df.columns if c not in sources]
    schema = widened(df.select(*rest).schema, outputs, T.DoubleType())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mats = [to_matrix(batch.column(batch.schema.get_field_index(s))) for s in sources]
            results = {o: pa.array(v) for o, v in zip(outputs, fn(share.value, *mats))}
            yield append(batch.select(rest), results)

    return df.mapInArrow(run, schema)


def row_mse_batch(df: DataFrame, y: str, pred: str, output: str = "mse") -> DataFrame:
    """The same error by Arrow batches instead of the two vectors: the second opinion."""
    return _scalars(df, None, [y, pred], [output], lambda _, a, b: [((a - b) ** 2).mean(axis=1)])


def cluster_mse(
    df: DataFrame, y: str, pred: str, by: Sequence[str] = ("arm", "seed"), cluster: str = "cluster"
) -> DataFrame:
    """``(*by, cluster, n_rows, err)``: the mean row error of each trajectory."""
    return df.select(*by, cluster, row_mse(y, pred).alias("_e")).groupBy(*by, cluster).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("_e").alias("err")
    )


def overall_mse(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Total squared error over total elements."""
    return (
        df.select(*by, squared_error(doubles(y), doubles(pred)).alias("_e"), F.size(y).alias("_d"))
        .groupBy(*by)
        .agg((F.sum("_e") / F.sum("_d")).alias("mse"), F.count(F.lit(1)).alias("n_rows"))
    )


def mean_of_cluster_means(errors: DataFrame, by: Sequence[str] = ("arm", "seed")) -> DataFrame:
    """The other overall error: every trajectory weighs the same."""
    return errors.groupBy(*by).agg(F.avg("err").alias("mse"), F.count(F.lit(1)).alias("n_clusters"))


def _residuals(df: DataFrame, sources: Sequence[str], basis: DataFrame, mean: np.ndarray, keep: Sequence[int], outputs, fn) -> DataFrame:
    """Row numbers from fields and their centred projections, made by strips of directions."""
    inside = [f"_in{i}" for i in range(len(sources))]
    wide = project_by_strips(df, sources, basis, mean, keep, inside, centred=True)
    return _scalars(wide, np.asarray(mean), [*sources, *inside], outputs, fn)


def _direction_gram(basis: DataFrame, keep: Sequence[int]) -> DataFrame:
    """BBᵀ of the kept directions as a table ``(j, vec)`` of its rows, from pairs of row blocks."""
    from fieldgauge.operators.basis import row_gram, to_blocks

    matrix = strips(basis, keep)
    rows = matrix.table.select(F.col("pos").cast("int").alias("row"), "vec")
    gram = row_gram(to_blocks(rows, "row", "vec"), matrix.k)
    return gram.select(F.col("r").alias("j"), F.col("g").alias("vec"))


def coeff_loss(
    df: DataFrame, coef: str, pred: str, basis: DataFrame, keep: Sequence[int],
    by: Sequence[str] = ("seed",),
) -> DataFrame:
    """Field MSE of the decoded error from coefficients alone: e·(BBᵀ)·eᵀ / (N·D).

    Where the directions are too large to share only their K×K Gram meets the coefficients, by strips
    if that is too large as well.
    """
    b = kept_rows(basis, keep)
    if b is not None:
        width = b.shape[1]

        def form(gram, c, p):
            e = c - p
            return [((e @ gram) * e).sum(axis=1)]

        per_row = _scalars(df.select(*by, coef, pred), b @ b.T, [coef, pred], ["_q"], form)
    else:
        width = basis.agg(F.max(F.size("vec"))).first()[0]
        miss = df.select(*by, minus(doubles(coef), doubles(pred)).alias("_e"))
        turned = encode(miss, "_e", cut(_direction_gram(basis, keep), "gram"), np.zeros(len(keep)), None, ["_ge"])
        per_row = turned.select(*by, dot(F.col("_e"), F.col("_ge")).alias("_q"))
    return per_row.groupBy(*by).agg(
        (F.sum("_q") / (F.count(F.lit(1)) * width)).alias("mse"), F.count(F.lit(1)).alias("n_rows")
    )


def coefficient_mse(df: DataFrame, coef: str, pred: str, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Plain MSE between coefficient vectors."""
    return overall_mse(df, coef, pred, by)


def floor_rows(
    df: DataFrame, y: str, basis: DataFrame, mean: np.ndarray, keep: Sequence[int], output: str = "perp"
) -> DataFrame:
    """Replace the field by its mean energy outside the kept directions: (‖r‖² − 2c·c + cᵀGc)/D.

    The kept set is used as given, never a prefix of the same size; no field is rebuilt.
    """
    b = kept_rows(basis, keep)
    if b is None:
        def rest(mu, field, inside):
            return [((field - mu - inside) ** 2).mean(axis=1)]

        return _residuals(df, [y], basis, mean, keep, [output], rest)

    def outside(shared, field):
        b, gram, mu = shared
        r = field - mu
        c = r @ b.T
        inside = (c * c).sum(axis=1)
        return [((r * r).sum(axis=1) - 2 * inside + ((c @ gram) * c).sum(axis=1)) / r.shape[1]]

    return _scalars(df, (b, b @ b.T, np.asarray(mean)), [y], [output], outside)


def arm_rows(
    df: DataFrame, y: str, pred: str, basis: DataFrame, mean: np.ndarray, keep: Sequence[int]
) -> DataFrame:
    """Replace both vectors by the three row errors of a cell: ``dense``, ``reduced`` (the prediction
    projected on the kept directions) and ``floor`` (the field itself projected)."""
    b = kept_rows(basis, keep)
    if b is None:
        def by_parts(mu, truth, guess, inside, approx):
            r = truth - mu
            return [((truth - guess) ** 2).mean(axis=1), ((r - approx) ** 2).mean(axis=1), ((r - inside) ** 2).mean(axis=1)]

        return _residuals(df, [y, pred], basis, mean, keep, ["dense", "reduced", "floor"], by_parts)

    def errors(shared, truth, guess):
        b, mu = shared
        r, p = truth - mu, guess - mu
        return [
            ((truth - guess) ** 2).mean(axis=1),
            ((r - (p @ b.T) @ b) ** 2).mean(axis=1),
            ((r - (r @ b.T) @ b) ** 2).mean(axis=1),
        ]

    return _scalars(df, (b, np.asarray(mean)), [y, pred], ["dense", "reduced", "floor"], errors)


def floor_perp(
    df: DataFrame, y: str, basis: DataFrame, mean: np.ndarray, keep: Sequence[int],
    by: Sequence[str] = (),
) -> DataFrame:
    """The floor L⊥(S), overall or per ``by`` (for instance per trajectory)."""
    rows = floor_rows(df.select(*by, y), y, basis, mean, keep)
    return rows.groupBy(*by).agg(F.avg("perp").alias("floor"), F.count(F.lit(1)).alias("n_rows"))


def decompose(
    df: DataFrame, y: str, pred: str, basis: DataFrame, mean: np.ndarray, keep: Sequence[int],
    by: Sequence[str] = ("seed",),
) -> DataFrame:
    """Error of the projected prediction = part outside the kept space + part inside; and the gap."""
    b = kept_rows(basis, keep)

    def three(r, inside, approx):
        return [
            ((r - approx) ** 2).mean(axis=1),
            ((r - inside) ** 2).mean(axis=1),
            ((inside - approx) ** 2).mean(axis=1),
        ]

    def parts(shared, truth, guess):
        b, mu = shared
        r, p = truth - mu, guess - mu
        return three(r, (r @ b.T) @ b, (p @ b.T) @ b)

    if b is None:
        rows = _residuals(
            df.select(*by, y, pred), [y, pred], basis, mean, keep, ["_a", "_o", "_i"],
            lambda mu, truth, guess, inside, approx: three(truth - mu, inside, approx),
        )
    else:
        rows = _scalars(df.select(*by, y, pred), (b, np.asarray(mean)), [y, pred], ["_a", "_o", "_i"], parts)
    return rows.groupBy(*by).agg(
        F.avg("_a").alias("r_compact"), F.avg("_o").alias("r_perp"), F.avg("_i").alias("r_parallel")
    ).withColumn("closure", F.abs(F.col("r_compact") - F.col("r_perp") - F.col("r_parallel")))


def persistence(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MSE of predicting no change."""
    return overall_mse(pairs, "y", "x", by)


def qualify_dense(dense: DataFrame, baseline: DataFrame, family: str = "family") -> DataFrame:
    """Per family: is every dense seed, and is the seed median, strictly below persistence?

    ``dense`` is ``(family, seed, mse)``, ``baseline`` is ``(family, mse)``. A family without a
    baseline fails.
    """
    base = baseline.select(family, F.col("mse").alias("persistence"))
    missing = F.raise_error(F.concat(F.lit("no baseline for family "), F.col(family).cast("string"))).cast("double")
    return (
        dense.join(base, family, "left")
        .withColumn("persistence", F.coalesce("persistence", missing))
        .groupBy(family)
        .agg(
            F.first("persistence").alias("persistence"),
            F.median("mse").alias("median_mse"),
            F.bool_and(F.col("mse") < F.col("persistence")).alias("every_seed_better"),
        )
        .withColumn("median_better", F.col("median_mse") < F.col("persistence"))
    )
