"""Ratios, medians, counts, cost tables and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Fixed values the results depend on.
TOLERANCE = 1.05


def seed_ratios(
    mse: DataFrame, base: str = "dense", by: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """``(*by, arm, seed, ratio)`` of each arm to the base arm of the same seed.

    ``mse`` is ``(*by, arm, seed, mse)``. A seed missing on either side, or a base that is not
    positive, fails the job when ``strict``; otherwise its ratio is null.
    """
    by = list(by)
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    bases = mse.where(F.col("arm") == base).select(
        *by, "seed", F.col("mse").alias("_base"), F.count(F.lit(1)).over(whole).alias("_wanted")
    )
    arms = mse.where(F.col("arm") != base).withColumn(
        "_held", F.count(F.lit(1)).over(Window.partitionBy(*by, "arm"))
    )
    paired = arms.join(bases, [*by, "seed"], "left")
    bad = F.col("_base").isNull() | (F.col("_held") != F.col("_wanted")) | ~(F.col("_base") > 0)
    broken = F.raise_error(F.lit("seed sets differ or the base is not positive"))
    value = F.col("mse") / F.col("_base")
    if strict:
        ratio = F.when(bad, broken).otherwise(value)
    else:
        ratio = F.when(F.col("_base") > 0, value)
    return paired.select(*by, "arm", "seed", ratio.cast("double").alias("ratio"))


def quality_point(ratios: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """The median over seeds of the ratios; never a ratio of medians."""
    return ratios.groupBy(*by).agg(F.median("ratio").alias("point"), F.count(F.lit(1)).alias("n_seeds"))


def floor_point(floors: DataFrame, dense: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """Median over seeds of floor / dense; ``floors`` is ``(arm, floor)``, ``dense`` is ``(seed, mse)``.

    A floor does not depend on the seed, so the median of its ratios is the floor times the median of the
    reciprocals, one number however many seeds there are. A dense table without a row fails.
    """
    middle = dense.agg(F.median(1 / F.col("mse")).alias("_inverse"))  # one row
    none = F.raise_error(F.lit("the dense table must hold one row per seed")).cast("double")
    ratio = F.col("floor") * F.coalesce("_inverse", none)
    return floors.crossJoin(F.broadcast(middle)).groupBy(*by).agg(F.median(ratio).alias("point"))


def portability(ratios: DataFrame, by: Sequence[str] = ("arm",), family: str = "family") -> DataFrame:
    """Family medians and their maximum, which is the portable quality."""
    medians = quality_point(ratios, [*by, family])
    return medians.groupBy(*by).agg(
        F.max("point").alias("q_port"),
        F.max_by(family, "point").alias("worst_family"),
        F.count(F.lit(1)).alias("n_families"),
    )


def seed_counts(ratios: DataFrame, by: Sequence[str] = ("arm",), tolerance: float = TOLERANCE) -> DataFrame:
    return ratios.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("ratio") > 1).alias("n_above_one"),
        F.count_if(F.col("ratio") > tolerance).alias("n_above_tolerance"),
        F.bool_and(F.col("ratio") <= tolerance).alias("all_within"),
        F.max("ratio").alias("max_ratio"),
    )


# ------------------------------------------------------------------------------ cost tables


def summarise(measurements: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``(*keys, metric, median, min, max, n)`` from one column per metric."""
    long = measurements.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keys), list(metrics), "metric", "value"
    )
    return long.groupBy(*keys, "metric").agg(
        F.median("value").alias("median"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("n"),
    )


def cost_ratios(
    summary: DataFrame, target: Sequence[str] = ("target",), dense: str = "dense", budget: str = "budget",
    error: str = "heldout_error",
) -> DataFrame:
    """dense/budget of the medians per metric, and budget/dense − 1 for the error metric."""
    cells = summary.groupBy(*target, "metric").agg(
        F.max(F.when(F.col("scheme") == dense, F.col("median"))).alias("dense"),
        F.max(F.when(F.col("scheme") == budget, F.col("median"))).alias("budget"),
    )
    held = cells.where(F.col("dense").isNotNull() & F.col("budget").isNotNull())
    saving = F.when(F.col("budget") != 0, F.col("dense") / F.col("budget"))
    excess = F.when(F.col("dense") != 0, F.col("budget") / F.col("dense") - 1)
    return held.withColumn("value", F.when(F.col("metric") == error, excess).otherwise(saving)).withColumn(
        "kind", F.when(F.col("metric") == error, "error_excess").otherwise("dense_over_budget")
    )


def epoch_profile(epochs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First recorded epoch against the median of the rest; ``(…, epoch, epoch_s, read_s, transfer_s, decode_s, step_s)``.

    With a single epoch the steady values are those of that epoch.
    """
    spans = ["epoch_s", "read_s", "transfer_s", "decode_s", "step_s"]
    first = F.min(F.col("epoch")).over(Window.partitionBy(*keys))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    marked = epochs.withColumn("_cold", F.col("epoch") == first).withColumn("_one", n == 1)
    steady = ~F.col("_cold") | F.col("_one")
    medians = [F.median(F.when(steady, F.col(s))).alias(f"steady_{s}") for s in spans]
    return (
        marked.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_cold"), F.col("epoch_s"))).alias("cold_epoch_s"),
            *medians,
            F.min(F.when(steady, F.col("epoch_s"))).alias("steady_min"),
            F.max(F.when(steady, F.col("epoch_s"))).alias("steady_max"),
            F.count_if(steady).alias("n_steady"),
        )
        .withColumn(
            "input_s", F.col("steady_read_s") + F.col("steady_transfer_s") + F.col("steady_decode_s")
        )
    )


def cost_flags(
    ratios: DataFrame, tau: float = 0.05, target: str = "target", memory: str = "peak_memory",
    epoch: str = "steady_epoch_s", inputs: str = "input_s", error: str = "heldout_error",
) -> DataFrame:
    """Per target: no memory/time saving above 1.05 (all targets), input slower (any), error beyond τ."""
    wide = ratios.groupBy(target).agg(
        F.max(F.when(F.col("metric") == memory, F.col("value"))).alias("memory_ratio"),
        F.max(F.when(F.col("metric") == epoch, F.col("value"))).alias("epoch_ratio"),
        F.max(F.when(F.col("metric") == inputs, F.col("budget") - F.col("dense"))).alias("_input"),
        F.max(F.when(F.col("metric") == error, F.col("budget") - (1 + tau) * F.col("dense"))).alias("_err"),
    )
    every = Window.partitionBy(F.lit(0))
    none = (F.coalesce("memory_ratio", F.lit(0.0)) < TOLERANCE) & (F.coalesce("epoch_ratio", F.lit(0.0)) < TOLERANCE)
    return wide.select(
        target,
        "memory_ratio",
        "epoch_ratio",
        F.bool_and(none).over(every).alias("h0a"),
        F.bool_or(F.col("_input") > 0).over(every).alias("h0b"),
        (F.col("_err") > 0).alias("h0c"),
    )


# --------------------------------------------------------------------------------- verdicts


def verdict3(q: Column, f: Column, tolerance: float = TOLERANCE) -> Column:
    return (
        F.when(f >= tolerance, "REPRESENTATIONAL_SHORTFALL")
        .when(q > tolerance, "OPTIMISATION_OR_GENERALISATION_SHORTFALL")
        .otherwise("TOLERANCE_MET_UNDER_CONVERGENCE")
    )


def pass_fail(q: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(q <= tolerance, "PASS").otherwise("FAIL")


# Fixed texts of the reading that goes with an outcome.
INTERPRETATION = {
    "reduced_and_pass": "second_PDE_same_MLP_fresh_retraining_support",
    "reduced_and_fail": "selector_did_not_transfer_to_fresh_retraining_on_this_PDE",
    "full_rank": "no_reduced_supervision_admitted",
}


def interpretation(q: Column, k: Column, width: Column | int, tolerance: float = TOLERANCE) -> Column:
    key = (
        F.when(k == width, "full_rank").when(q <= tolerance, "reduced_and_pass").otherwise("reduced_and_fail")
    )
    out = F.lit(None).cast("string")
    for name, text in INTERPRETATION.items():
        out = F.when(key == name, text).otherwise(out)
    return out


def verdict4(q_gain: Column, q_pod: Column, tolerance: float = TOLERANCE) -> Column:
    gain, pod = q_gain <= tolerance, q_pod <= tolerance
    return (
        F.when(gain & pod, "BOTH_PASS").when(gain, "GAIN_ONLY").when(pod, "POD_ONLY").otherwise("BOTH_FAIL")
    )


def floor_screen(floor: Column, limit: float = TOLERANCE) -> Column:
    """A floor above the limit rejects without training; a floor below proves nothing."""
    return F.when(floor > limit, "REJECTED_BY_FLOOR").otherwise("INCONCLUSIVE")


def placement(lo: Column, hi: Column, threshold: float = TOLERANCE) -> Column:
    return F.when(hi < threshold, "BELOW").when(lo > threshold, "ABOVE").otherwise("CONTAINS")
