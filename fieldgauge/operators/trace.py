"""Training-curve tables: stopping replay, checks, schedules and policy calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgauge.functions import ranking

# Fixed values the results depend on.
PATIENCE = 20
MIN_DELTA = 1e-3

CURVE_EPOCHS = 100_000


def _fold(points: Column, patience: Column, min_delta: Column) -> Column:
    """Walk an epoch-ordered curve once, keeping the running best and the patience counter."""
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("selected"),
        F.lit(0).alias("waited"),
        F.lit(0).alias("stop"),
        F.lit(None).cast("double").alias("low"),
        F.lit(0).alias("low_epoch"),
        F.lit(0).alias("epoch"),
        F.lit(False).alias("undefined"),
    )

    def step(acc, p):
        value, epoch = p["val"], acc["epoch"] + 1
        first, done = acc["epoch"] == 0, acc["stop"] > 0
        gain = F.try_divide(acc["best"] - value, acc["best"])
        better = first | F.coalesce(gain >= min_delta, F.lit(False))
        waited = F.when(better, 0).otherwise(acc["waited"] + 1)
        lower = first | (value < acc["low"])
        moved = F.struct(
            F.when(better, value).otherwise(acc["best"]).alias("best"),
            F.when(better, epoch).otherwise(acc["selected"]).alias("selected"),
            waited.alias("waited"),
            F.when(waited >= patience, epoch).otherwise(0).alias("stop"),
            F.when(lower, value).otherwise(acc["low"]).alias("low"),
            F.when(lower, epoch).otherwise(acc["low_epoch"]).alias("low_epoch"),
            epoch.alias("epoch"),
            (acc["undefined"] | (~first & (acc["best"] <= 0))).alias("undefined"),
        )
        return F.when(done, acc).otherwise(moved)

    return F.aggregate(points, start, step)


def _curves(curves: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One array per curve; its length is an epoch count, which has a ceiling by construction."""
    point = F.struct(F.col("epoch").alias("epoch"), F.col(value).cast("double").alias("val"))
    rows = curves.groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("points"))
    long = F.size("points") > CURVE_EPOCHS
    return rows.withColumn(
        "points", F.when(long, F.raise_error(F.lit("curve above the epoch ceiling"))).otherwise(F.col("points"))
    )


def _finite(points: Column) -> Column:
    return ~F.exists(
        points, lambda p: p["val"].isNull() | F.isnan(p["val"]) | (F.abs(p["val"]) == float("inf"))
    )


def _outcome(rows: DataFrame, keep: Sequence[str], patience: Column, min_delta: Column) -> DataFrame:
    walked = rows.withColumn("_f", _fold(F.col("points"), patience, min_delta))
    stopped = F.col("_f.stop") > 0
    status = F.when(~_finite(F.col("points")), "NONFINITE").when(
        F.col("_f.undefined"), "NONPOSITIVE_BEST"
    )
    return walked.select(
        *keep,
        F.col("_f.selected").alias("selected_epoch"),
        F.col("_f.best").alias("selected_val"),
        F.col("_f.low_epoch").alias("raw_best_epoch"),
        F.col("_f.low").alias("raw_best_val"),
        F.when(stopped, F.col("_f.stop")).otherwise(F.size("points")).alias("stop_epoch"),
        status.when(stopped, "PATIENCE").otherwise("CEILING_REACHED").alias("stop_reason"),
        (status.isNull() & stopped).alias("converged"),
    )


def replay_stopping(
    curves: DataFrame, patience: int = PATIENCE, min_delta: float = MIN_DELTA,
    by: Sequence[str] = ("arm", "seed"), value: str = "val_mse",
) -> DataFrame:
    """Apply the stopping rule to recorded curves ``(*by, epoch, val_mse)``; epochs count from 1.

    An improvement is (best − v)/best ≥ min_delta against the running best and moves both the kept
    epoch and the patience counter. The raw best is the first minimum over the epochs run.
    """
    return _outcome(_curves(curves, by, value), by, F.lit(patience), F.lit(float(min_delta)))


def calibrate_stopping(
    curves: DataFrame, grid: Sequence[tuple[int, float]], max_gap: float = 1.01,
    by: Sequence[str] = ("arm", "seed"), value: str = "val_mse",
) -> DataFrame:
    """Per rule: the worst kept/best gap, the latest stop, and which rule is chosen.

    A rule is admissible when its worst gap is at most ``max_gap``; the admissible rule with the
    smallest latest stop wins. ``max_epochs`` is 1.5 times the latest best epoch, rounded up.
    """
    rules = F.explode(
        F.array(*[F.struct(F.lit(int(p)).alias("patience"), F.lit(float(d)).alias("min_delta")) for p, d in grid])
    )
    rows = _curves(curves, by, value).withColumn("_r", rules).select(*by, "points", "_r.*")
    whole_low = F.aggregate(
        "points", F.lit(float("inf")).cast("double"), lambda a, p: F.least(a, p["val"])
    )
    low_at = F.array_position(F.transform("points", lambda p: p["val"]), whole_low)
    kept = _outcome(
        rows.withColumn("low", whole_low).withColumn("low_at", low_at),
        [*by, "patience", "min_delta", "low", "low_at"],
        F.col("patience"),
        F.col("min_delta"),
    )
    per_rule = kept.groupBy("patience", "min_delta").agg(
        F.max(F.try_divide("selected_val", "low")).alias("max_gap"),
        F.max("stop_epoch").alias("max_stop_epoch"),
        F.ceil(F.max("low_at") * 1.5).cast("long").alias("max_epochs"),
        F.count(F.lit(1)).alias("n_curves"),
    ).withColumn("admissible", F.col("max_gap") <= max_gap)
    order = ranking.Window.partitionBy(F.lit(0)).orderBy(
        F.col("admissible").desc(), "max_stop_epoch", "patience", "min_delta"
    )
    return per_rule.withColumn("chosen", F.col("admissible") & (F.row_number().over(order) == 1))


def check_traces(traces: DataFrame, required: Sequence[str]) -> DataFrame:
    """Traces that miss a field, point past their stop, or alias two checkpoints."""
    absent = [c for c in required if c not in traces.columns]
    if absent:
        raise ValueError(f"the trace table has no column {absent}")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    reason = (
        F.when(F.size(missing) > 0, "missing_field")
        .when(F.col("selected_epoch") > F.col("stop_epoch"), "selected_after_stop")
        .when(F.col("raw_best_epoch") > F.col("stop_epoch"), "raw_best_after_stop")
    )
    if {"selected_sha256", "raw_best_sha256"} <= set(traces.columns):
        reason = reason.when(
            (F.col("selected_epoch") != F.col("raw_best_epoch"))
            & (F.col("selected_sha256") == F.col("raw_best_sha256")),
            "checkpoint_overwritten",
        )
    return traces.withColumn("reason", reason).where("reason is not null")


def compare_traces(traces: DataFrame, replayed: DataFrame, by: Sequence[str] = ("arm", "seed")) -> DataFrame:
    """Recorded fields that differ from the replay; a curve on one side only is listed too."""
    fields = ["selected_epoch", "raw_best_epoch", "stop_epoch", "stop_reason"]
    a = traces.select(*by, F.struct(*fields).alias("recorded"))
    b = replayed.select(*by, F.struct(*fields).alias("replayed"))
    return a.join(b, list(by), "full_outer").where(~F.col("recorded").eqNullSafe(F.col("replayed")))


def check_converged(traces: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """Per group: how many runs hit the ceiling or went non-finite, and whether that blocks."""
    return traces.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if(F.col("stop_reason") == "CEILING_REACHED").alias("n_ceiling"),
        F.count_if(~F.col("stop_reason").isin("CEILING_REACHED", "PATIENCE")).alias("n_nonfinite"),
        F.bool_or(F.col("stop_reason") != "PATIENCE").alias("blocked"),
    )


def batch_order(
    keys: DataFrame, seed: int, epoch: int, size: int, key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``rank`` and ``batch`` of every row in the shuffle of one (seed, epoch)."""
    ranked = ranking.with_position(
        keys.withColumn("_hash", ranking.hash_key(F.lit(f"{seed}:{epoch}"), *key)),
        list(by),
        ranking.hash_bucket(F.col("_hash")),
        ["_hash", *key],
    ).drop("_hash")
    return ranked.withColumn("batch", F.floor(F.col("rank") / size))


def segments(rows: DataFrame, n: str, width: str) -> DataFrame:
    """Split ``n`` epochs into segments of ``width``: ``segment, first_epoch, last_epoch, covered``."""
    total, step = F.col(n), F.col(width)
    count = F.ceil(total / step).cast("int")
    out = rows.withColumn("segment", F.explode(F.sequence(F.lit(0), count - 1)))
    first = F.col("segment") * step + 1
    last = F.least((F.col("segment") + 1) * step, total)
    return out.withColumn("first_epoch", first).withColumn("last_epoch", last).withColumn(
        "exact", total % step == 0
    )


def check_segments(parts: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """Schedules that do not cover every epoch exactly once."""
    order = ranking.Window.partitionBy(*by).orderBy("first_epoch")
    gap = F.col("first_epoch") - F.coalesce(F.lag("last_epoch").over(order), F.lit(0))
    return (
        parts.withColumn("_gap", gap)
        .groupBy(*by)
        .agg(F.max(n).alias("n_epochs"), F.max("last_epoch").alias("last_epoch"),
             F.count_if(F.col("_gap") != 1).alias("n_breaks"))
        .where("n_breaks > 0 or last_epoch <> n_epochs")
    )


def parameter_counts(arms: DataFrame, inputs: str = "d_in", hidden: Sequence[int] = (256, 256), outputs: str = "d_out") -> DataFrame:
    """Weights and biases of a dense network per arm."""
    widths = [F.col(inputs), *[F.lit(h) for h in hidden], F.col(outputs)]
    count = sum((a * b + b for a, b in zip(widths, widths[1:])), F.lit(0))
    return arms.withColumn("n_parameters", count.cast("long"))
