"""The whole decision: gains → rung → floors and errors → ratios → interval → verdict."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.operators import boot, decide, metrics, select
from fieldgauge.session import cut


def choose(
    predictions: DataFrame, basis: DataFrame, mean: np.ndarray, width: int, ladder: Sequence[int],
    role: str = "selection", policy: str = "full_dim", tau: float = select.TAU,
    row: Sequence[str] = ("seed", "vec_id"),
) -> tuple[DataFrame, DataFrame]:
    """``(selection, order)`` from one reading of the selection rows; both then follow from the gains."""
    rows = predictions.where(F.col("role") == role)
    gains = cut(select.direction_gain(rows, "y", "p", basis, mean, row=list(row), with_mse=True), "gains")
    order = select.gain_order(gains)
    limits = select.thresholds_of(gains, width, tau)
    return select.select_rung(select.gain_tail(order), ladder, limits, policy), order


def kept_set(selection: DataFrame, order: DataFrame, primary: int) -> list:
    """The ordered index set of the primary seed with its K and slack; as long as K."""
    picked = selection.where(F.col("seed") == primary).select("seed", "selected_k", "slack")
    rows = order.join(picked, "seed").where("rank < selected_k").orderBy("rank")
    return rows.select("j", "selected_k", "slack").collect()


def cell_errors(
    predictions: DataFrame, basis: DataFrame, mean: np.ndarray, keep: Sequence[int], role: str = "test"
) -> DataFrame:
    """``(arm, seed, cluster, n_rows, err)`` for the dense and reduced arms and the floor.

    One pass: the three row errors are made together and summed per trajectory.
    """
    rows = predictions.where(F.col("role") == role).select("seed", F.col("label").alias("cluster"), "y", "p")
    shown = metrics.arm_rows(rows, "y", "p", basis, mean, keep)
    sums = shown.groupBy("seed", "cluster").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in ("dense", "reduced", "floor")]
    )
    return sums.unpivot(["seed", "cluster", "n_rows"], ["dense", "reduced", "floor"], "arm", "err")


def overall(errors: DataFrame) -> DataFrame:
    """Row-weighted error of each cell."""
    return errors.groupBy("arm", "seed").agg(
        (F.sum(F.col("err") * F.col("n_rows")) / F.sum("n_rows")).alias("mse")
    )


def qualify(
    predictions: DataFrame, basis: DataFrame, mean: np.ndarray, width: int, ladder: Sequence[int],
    selection_role: str = "selection", test_role: str = "test", reps: int = boot.REPLICATES,
    primary: int = 0,
) -> DataFrame:
    """One row: K, slack, quality, floor, interval and verdict; the primary seed alone proposes K.

    ``predictions`` is materialised once, since selection and test both read it.
    """
    predictions = cut(predictions)
    selection, order = choose(predictions, basis, mean, width, ladder, selection_role)
    kept = kept_set(selection, order, primary)
    picked, keep = kept[0], [r["j"] for r in kept]
    errors = cut(cell_errors(predictions, basis, mean, keep, test_role))
    points = decide.quality_point(decide.seed_ratios(overall(errors)))
    limits = boot.paired_bootstrap(errors, reps=reps, stored=True)
    both = points.join(limits, "arm").groupBy().agg(
        *[
            F.max(F.when(F.col("arm") == arm, F.col(c))).alias(name)
            for arm, c, name in (
                ("reduced", "point", "quality"), ("reduced", "lo", "quality_lo"), ("reduced", "hi", "quality_hi"),
                ("floor", "point", "floor"), ("floor", "lo", "floor_lo"), ("floor", "hi", "floor_hi"),
            )
        ]
    )
    return both.select(
        F.lit(int(picked["selected_k"])).alias("k"),
        F.lit(float(picked["slack"])).alias("slack"),
        F.lit(keep == list(range(len(keep)))).alias("is_leading_prefix"),
        "quality", "quality_lo", "quality_hi", "floor", "floor_lo", "floor_hi",
        decide.placement(F.col("quality_lo"), F.col("quality_hi")).alias("interval"),
        decide.verdict3(F.col("quality"), F.col("floor")).alias("verdict"),
    )


def primary_set(predictions: DataFrame, walk, primary: int = 0, role: str = "selection") -> tuple[int, list[int]]:
    """K and the ordered index set the primary seed proposes for a walk study."""
    from fieldgauge.plans.walk import LADDER

    selection, order = choose(predictions, walk.basis, walk.mean, walk.width, LADDER, role)
    kept = kept_set(selection, order, primary)
    return kept[0]["selected_k"], [r["j"] for r in kept]
