"""From frames and series to (x, y) rows: pairs, windows, scaling, cluster ids, centring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.functions import ranking
from fieldgauge.functions.arrow import to_lists, to_matrix
from fieldgauge.functions.sums import vector_sums
from fieldgauge.functions.vectors import doubles

TRAJECTORY = ("family", "traj")


def pair_next(
    snapshots: DataFrame, field: str = "field", by: Sequence[str] = TRAJECTORY, width: int = 1024
) -> DataFrame:
    """(x, y) from each frame and the following frame of the same trajectory."""
    return (
        ranking.next_in_group(snapshots, by, "t", [field], width)
        .where(F.col(f"next_{field}").isNotNull())
        .withColumnRenamed(field, "x")
        .withColumnRenamed(f"next_{field}", "y")
    )


def pair_strided(
    snapshots: DataFrame,
    stride: int = 5,
    horizon: int | None = 101,
    starts: Sequence[int] | None = None,
    field: str = "field",
    by: Sequence[str] = TRAJECTORY,
) -> DataFrame:
    """(x, y) = frames (t, t+1) for the given starts, or t = 0, stride, … below ``horizon - 1``.

    Without a horizon every trajectory is paired to its end. The join key holds the frame index, so a
    long trajectory spreads over tasks.
    """

    def chosen(t):
        if starts is not None:
            return t.isin(list(starts))
        grid = (t >= 0) & (t % stride == 0)
        return grid if horizon is None else grid & (t < horizon - 1)

    x = snapshots.where(chosen(F.col("t"))).withColumnRenamed(field, "x")
    y = snapshots.where(chosen(F.col("t") - 1)).select(
        *by, (F.col("t") - 1).alias("t"), F.col(field).alias("y")
    )
    return x.join(y, [*by, "t"])


def pair_roll(rows: DataFrame, order: str, field: str = "field", n: int | None = None) -> DataFrame:
    """The leaky comparator: x is the previous row of the whole table, the first row wraps around."""
    n = rows.count() if n is None else n
    ranked = ranking.ordered_position(rows, [], order, "pos", n=n)
    previous = ranked.select(
        F.pmod(F.col("pos") + 1, F.lit(n)).alias("pos"),
        F.col(order).alias(f"from_{order}"),
        F.col(field).alias("x"),
    )
    return ranked.withColumnRenamed(field, "y").join(previous, "pos")


def window_starts(steps: int, look_back: int, horizon: int, stride: int, n_windows: int | None):
    """First steps of the windows; the last admissible start is excluded by the definition."""
    starts = range(0, steps - look_back - horizon, stride)
    return starts if n_windows is None else starts[:n_windows]


def sliding_pairs(
    series: DataFrame,
    look_back: int,
    horizon: int,
    stride: int = 1,
    n_windows: int | None = None,
    steps: int | None = None,
    chunk: int = 4096,
) -> DataFrame:
    """One row per (series, window): ``x`` holds ``look_back`` values, ``y`` the ``horizon`` after.

    ``series`` is ``(series_id, step, value)`` with dense steps from 0. A series is cut into chunks
    that carry the few steps of overlap a window needs, so a long series is never one group.
    """
    span = look_back + horizon
    chunk = max(chunk, span)
    if steps is None:
        steps = series.agg(F.max("step")).first()[0] + 1
    starts = window_starts(steps, look_back, horizon, stride, n_windows)
    if not len(starts):
        raise ValueError("the series is too short for a single window")
    own = F.floor(F.col("step") / chunk)
    tail = (F.col("step") % chunk < span - 1) & (own > 0)
    pieces = (
        series.withColumn("_chunk", F.explode(F.when(tail, F.array(own, own - 1)).otherwise(F.array(own))))
        .groupBy("series_id", "_chunk")
        .agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("_piece"))
        .withColumn("_first", F.col("_piece")[0]["step"])
    )
    lo = F.ceil(F.col("_chunk") * chunk / stride) * stride
    hi = F.least(F.lit(starts[-1]), (F.col("_chunk") + 1) * chunk - 1)
    values = F.transform(F.col("_piece"), lambda p: p["value"])
    at = (F.col("start") - F.col("_first") + 1).cast("int")
    return (
        pieces.where(lo <= hi)
        .withColumn("start", F.explode(F.sequence(lo.cast("long"), hi.cast("long"), F.lit(stride).cast("long"))))
        .select(
            "series_id",
            (F.col("start") / stride).cast("long").alias("win"),
            "start",
            F.slice(values, at, look_back).alias("x"),
            F.slice(values, at + look_back, horizon).alias("y"),
        )
    )


def training_windows(
    steps: int, train_fraction: float, look_back: int, horizon: int, stride: int = 1, n_windows: int | None = None
) -> list[tuple[int, int]]:
    """First row and stop row of each window before the split; none if the split leaves a side empty."""
    starts = list(window_starts(steps, look_back, horizon, stride, n_windows))
    before = starts[: round(train_fraction * len(starts))]
    return [(s, s + look_back + horizon) for s in before] if len(before) < len(starts) else []


def scaler_range(
    mode: str,
    steps: int,
    train_fraction: float,
    look_back: int = 0,
    horizon: int = 0,
    stride: int = 1,
    n_windows: int | None = None,
) -> tuple[int, int]:
    """The half-open step range a scaler may be fitted on: from the first to the last row its windows use."""
    tables = {
        "legacy_raw_fraction": lambda: [(0, int(train_fraction * steps))],
        "train_window_union": lambda: training_windows(steps, train_fraction, look_back, horizon, stride, n_windows),
    }
    if mode not in tables:
        raise ValueError(f"no scaler mode {mode!r}")
    rows = tables[mode]()
    first, stop = min((a for a, _ in rows), default=0), max((b for _, b in rows), default=0)
    if first >= stop or first < 0 or stop > steps:
        raise ValueError(f"rows {first} to {stop} of {steps} cannot fit a scaler")
    return first, stop


def fit_scaler(series: DataFrame, fit: tuple[int, int]) -> DataFrame:
    """``(series_id, mu, sd)`` over the fit range; population deviation plus 1e-8."""
    inside = series.where((F.col("step") >= fit[0]) & (F.col("step") < fit[1]))
    return inside.groupBy("series_id").agg(
        F.avg("value").alias("mu"), (F.stddev_pop("value") + F.lit(1e-8)).alias("sd")
    )


def bad_scalers(scaler: DataFrame) -> DataFrame:
    finite = ~F.isnan("mu") & ~F.isnan("sd") & (F.abs("mu") != float("inf"))
    return scaler.where(~finite | (F.col("sd") <= 0) | (F.col("sd") == float("inf")))


def checked_scalers(scaler: DataFrame) -> DataFrame:
    """The scalers, or a failure that names the first series whose deviation is not positive and finite."""
    good = ~F.isnan("mu") & ~F.isnan("sd") & (F.abs("mu") != float("inf")) & (F.col("sd") > 0) & (F.col("sd") != float("inf"))
    refuse = F.raise_error(F.concat(F.lit("bad scaler of series "), F.col("series_id").cast("string"))).cast("double")
    return scaler.withColumn("sd", F.when(F.coalesce(good, F.lit(False)), F.col("sd")).otherwise(refuse))


def apply_scaler(series: DataFrame, scaler: DataFrame) -> DataFrame:
    """Scaled values; a scaler that is not finite and positive fails, whatever its series holds."""
    joined = series.join(checked_scalers(scaler), "series_id")
    return joined.withColumn("value", (F.col("value") - F.col("mu")) / F.col("sd")).drop("mu", "sd")


def gather(rows: DataFrame, roles: DataFrame, role: str, by: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Rows of one role with the sealed order as the column ``rank``; physical order carries nothing."""
    wanted = roles.where(F.col("role") == role).select(*by, "rank")
    return rows.join(wanted, list(by))


def assign_cluster(rows: DataFrame, key: str, by: Sequence[str] = ("family",)) -> DataFrame:
    """Add ``cluster``: a dense 0-based id over families in order, then keys in order."""
    keys = rows.select(*by, key).distinct()
    sizes = keys.groupBy(*by).count()
    placed = ranking.ordered_position(keys, by, key, "_place")
    ordered = ranking.Window.partitionBy(F.lit(0)).orderBy(*by)
    before = sizes.withColumn(
        "_before",
        F.coalesce(
            F.sum("count").over(ordered.rowsBetween(ranking.Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).drop("count")
    ids = placed.join(before, list(by)).select(
        *by, key, (F.col("_place") + F.col("_before")).alias("cluster")
    )
    return rows.join(ids, [*by, key])


def center(rows: DataFrame, col: str, mean: np.ndarray) -> DataFrame:
    """Subtract the float64 mean vector from ``col``; the rows stay where they are."""
    share = rows.sparkSession.sparkContext.broadcast(np.asarray(mean, dtype=np.float64))
    source = rows.withColumn(col, doubles(col))
    at = source.columns.index(col)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            if batch.num_rows:
                columns[at] = to_lists(to_matrix(columns[at]) - share.value)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return source.mapInArrow(run, source.schema)


def centring_residual(rows: DataFrame, col: str, mean: np.ndarray) -> DataFrame:
    """One row: ‖Σ rows‖, Frobenius norm, their ratio, and whether it stays within 1024 eps."""
    centred = center(rows.select(col), col, mean)
    sums = vector_sums(centred, [col], [], ["s", "ss"], lambda m: (m, m * m))
    limit = 1024 * 2.0**-52
    out = sums.agg(
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("row_sum_l2"),
        F.sqrt(F.sum("ss")).alias("frobenius"),
        F.max(F.abs(F.col("s") / F.col("n"))).alias("column_mean_max_abs"),
    )
    ratio = F.when(F.col("frobenius") > 0, F.col("row_sum_l2") / F.col("frobenius")).otherwise(0.0)
    return out.withColumn("relative", ratio).withColumn("passed", F.col("relative") <= limit)
