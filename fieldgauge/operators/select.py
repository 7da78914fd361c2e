"""Which directions to keep: predictive gain, its tail, and the rung of the ladder that is enough."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldgauge.functions.arrow import to_lists, widened
from fieldgauge.functions.blocks import numbered, over_strips, strips
from fieldgauge.functions.sums import vector_sums
from fieldgauge.functions.vectors import doubles
from fieldgauge.operators import codec
from fieldgauge.operators.codec import kept_rows
from fieldgauge.operators.metrics import overall_mse
from fieldgauge.operators.roles import little_endian

# Fixed values the results depend on.
BASE_LADDER = (2, 4, 8, 16, 32, 48, 64, 96, 128, 256, 512, 1024, 2048, 4096)
TAU = 0.05


def direction_gain(
    rows: DataFrame, y: str, pred: str, basis: DataFrame, mean: np.ndarray,
    by: Sequence[str] = ("seed",), row: Sequence[str] | None = None, with_mse: bool = False,
) -> DataFrame:
    """``(*by, j, n, q, e, gain)``: mean c², mean (c−ĉ)² and their difference per direction.

    Coefficients are reduced to sums inside the task that computes them; they never shuffle.
    ``with_mse`` adds ``mse``, the field error of the group, from the same reading of the rows.
    A basis too large to share goes by strips: a cell of the grid sums the squares of its directions, so
    no coefficient leaves it. ``row`` is not needed for that.
    """
    by = list(by)
    b = kept_rows(basis)
    if b is not None:
        share = rows.sparkSession.sparkContext.broadcast((b, np.asarray(mean, dtype=np.float64)))

        def squares(truth, guess):
            b, mu = share.value
            c = (truth - mu) @ b.T
            miss = (truth - guess) @ b.T
            if not with_mse:
                return c * c, miss * miss
            error = np.zeros_like(c)
            error[:, 0] = ((truth - guess) ** 2).mean(axis=1)
            return c * c, miss * miss, error

        typed = rows.withColumn(y, doubles(y)).withColumn(pred, doubles(pred))
        outputs = ["q", "e", "mse"] if with_mse else ["q", "e"]
        sums = vector_sums(typed, [y, pred], by, outputs, squares)
    else:
        sums = _squares_by_strips(rows, y, pred, basis, mean, by)
    q, e = F.col("q") / F.col("n"), F.col("e") / F.col("n")
    out = [*by, "j", "n", q.alias("q"), e.alias("e"), (q - e).alias("gain")]
    if with_mse and b is not None:
        group = Window.partitionBy(*(by or [F.lit(0)]))
        out.append((F.sum("mse").over(group) / F.col("n")).alias("mse"))
    gains = sums.select(*out)
    if with_mse and b is None:
        gains = gains.join(overall_mse(rows, y, pred, by).drop("n_rows"), by)
    return gains


def _squares_by_strips(rows: DataFrame, y: str, pred: str, basis: DataFrame, mean: np.ndarray, by: list) -> DataFrame:
    """``(*by, j, n, q, e)`` sums on the grid of row lanes and strips of directions."""
    held = numbered(rows.select(*by, y, pred))
    matrix = strips(basis, limit=codec.STRIP_BYTES)
    share, size = rows.sparkSession.sparkContext.broadcast(np.asarray(mean, dtype=np.float64)), matrix.size

    def squares(s, b, own, truth, guess):
        c, miss = (truth - share.value) @ b.T, (truth - guess) @ b.T
        short = ((0, 0), (0, size - len(b)))  # the last strip may hold fewer directions
        wide = [to_lists(np.pad(m * m, short)) for m in (c, miss)]
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(c), s, np.int32)), *wide], names=[*by, "_strip", "_q", "_e"])

    schema = widened(held.select(*by).withColumn("_strip", F.lit(0)).schema, ["_q", "_e"])
    cells = over_strips(held, by, [y, pred], matrix, schema, squares)
    sums = vector_sums(cells, ["_q", "_e"], [*by, "_strip"], ["q", "e"], lambda q, e: (q, e))
    place = (F.col("_strip") * size + F.col("j")).alias("_pos")
    order = Window.partitionBy(F.lit(0)).orderBy("j")
    names = basis.select("j", (F.row_number().over(order) - 1).cast("long").alias("_pos"))
    return sums.select(*by, place.cast("long"), "n", "q", "e").join(names, "_pos").select(*by, "j", "n", "q", "e")


def gain_order(gains: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Add ``gpos`` (gain clipped at 0) and ``rank``: descending, the lower index first on a tie.

    A gain that is null, NaN or infinite fails: it has no place in the order.
    """
    finite = F.abs("gain") < float("inf")  # false for NaN, null for null
    gain = F.when(finite, F.col("gain")).otherwise(F.raise_error(F.lit("a gain is not finite")).cast("double"))
    clipped = gains.withColumn("gpos", F.greatest(gain, F.lit(0.0)))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("gpos").desc(), F.col("j"))
    return clipped.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def gain_tail(order: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """``(*by, k, tail)``: the gain left out when the first k are kept, for k = 0 … R−1.

    The tail at R is zero by definition and is not a row.
    """
    rest = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(F.col("rank").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return order.select(*by, F.col("rank").alias("k"), F.sum("gpos").over(rest).alias("tail"))


def gain_threshold(
    rows: DataFrame, y: str, pred: str, width: int, tau: float = TAU, by: Sequence[str] = ("seed",)
) -> DataFrame:
    """``(*by, mse, tau, threshold)`` = τ·D·MSE of the dense reference on the selection rows."""
    mse = overall_mse(rows, y, pred, by)
    return mse.withColumn("tau", F.lit(float(tau))).withColumn(
        "threshold", F.col("tau") * width * F.col("mse")
    )


def thresholds_of(gains: DataFrame, width: int, tau: float = TAU, by: Sequence[str] = ("seed",)) -> DataFrame:
    """The same thresholds from gains made ``with_mse``."""
    return gains.groupBy(*by).agg(F.first("mse").alias("mse")).withColumn("tau", F.lit(float(tau))).withColumn(
        "threshold", F.col("tau") * width * F.col("mse")
    )


def thresholds_by_tau(thresholds: DataFrame, taus: Sequence[float]) -> DataFrame:
    """One threshold row per tolerance."""
    scaled = thresholds.withColumn("_per", F.col("threshold") / F.col("tau")).drop("tau", "threshold")
    spread = scaled.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    return spread.withColumn("threshold", F.col("tau") * F.col("_per")).drop("_per")


def effective_ladder(rank: int, base: Sequence[int] = BASE_LADDER) -> list[int]:
    """Rungs strictly below the basis rank; at least two must remain."""
    rungs = [k for k in base if k < rank]
    if len(rungs) < 2:
        raise ValueError(f"rank {rank} leaves fewer than two rungs")
    return rungs


def effective_ladders(ranks: DataFrame, base: Sequence[int] = BASE_LADDER) -> DataFrame:
    """The table form: ``(…, rank)`` → one row per rung, with ``ladder_size`` and ``usable``."""
    rungs = F.array(*[F.lit(int(k)) for k in base])
    fit = F.filter(rungs, lambda k: k < F.col("rank"))
    return ranks.withColumn("ladder_size", F.size(fit)).withColumn("usable", F.size(fit) >= 2).withColumn(
        "rung", F.explode_outer(fit)
    )


def select_rung(
    tails: DataFrame, ladder: Sequence[int], thresholds: DataFrame, policy: str = "max_rung",
    by: Sequence[str] = ("seed",), caps: Mapping[str, int] | None = None,
) -> DataFrame:
    """The first rung whose tail is at or below the threshold, one row per group.

    Without such a rung: ``max_rung`` takes the last rung, ``full_dim`` the full width (which must
    be on the ladder), ``fail`` raises. ``caps`` maps a censor reason to the rank that causes it.
    """
    by = list(by)
    rungs = [int(k) for k in ladder]
    if not rungs or rungs != sorted(set(rungs)):
        raise ValueError("the ladder must be increasing")
    if policy not in ("max_rung", "full_dim", "fail"):
        raise ValueError(f"unknown policy {policy!r}")
    keys = [c for c in thresholds.columns if c in by or c == "tau"]
    widths = tails.groupBy(*by).agg((F.max("k") + 1).alias("width"))
    grid = widths.withColumn("rung", F.explode(F.array(*[F.lit(k) for k in rungs])))
    if policy == "full_dim":
        grid = grid.where("rung <= width")
    on_rung = grid.join(tails.withColumnRenamed("k", "rung"), [*by, "rung"], "left").withColumn(
        "tail", F.when(F.col("rung") == F.col("width"), 0.0).otherwise(F.col("tail"))
    )
    limits = thresholds.select(*keys, "threshold", F.lit(0).alias("_all"))
    step = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("rung")
    marked = (
        on_rung.withColumn("_all", F.lit(0)).join(limits, [*by, "_all"])
        .withColumn("ok", F.col("tail") <= F.col("threshold"))
        .withColumn("before", F.lag("tail").over(step))
    )
    picked = marked.groupBy(*keys).agg(
        F.first("threshold").alias("threshold"),
        F.first("width").alias("width"),
        F.count(F.lit(1)).alias("n_rungs"),
        F.count_if("ok").alias("n_feasible"),
        F.max("rung").alias("last_rung"),
        F.count_if(F.col("tail").isNull()).alias("off_width"),
        F.min(F.when(F.col("ok"), F.struct("rung", "tail", "before"))).alias("hit"),
        F.max(F.struct("rung", "tail", "before")).alias("last"),
    )
    wrong = F.when(F.col("off_width") > 0, F.raise_error(F.lit("a rung exceeds the gain width")))
    if policy == "full_dim":
        wrong = wrong.when(
            F.col("last_rung") != F.col("width"), F.raise_error(F.lit("the ladder must hold the full width"))
        )
    if policy == "fail":
        wrong = wrong.when(F.col("hit").isNull(), F.raise_error(F.lit("no rung meets the threshold")))
    use = wrong.otherwise(F.coalesce("hit", "last"))
    reasons = [F.when(F.col("selected_k") == F.col("last_rung"), F.lit("ladder_cap"))]
    for name, rank in (caps or {}).items():
        reasons.append(F.when(F.col("selected_k") == int(rank), F.lit(name)))
    return (
        picked.withColumn("use", use)
        .select(
            *keys,
            "threshold",
            "n_rungs",
            F.col("n_feasible").cast("int").alias("n_feasible"),
            "last_rung",
            F.col("use.rung").alias("selected_k"),
            F.col("use.tail").alias("tail_at_selected"),
            (F.col("threshold") - F.col("use.tail")).alias("slack"),
            F.col("use.before").alias("tail_at_previous"),
            F.col("hit").isNull().alias("used_fallback"),
        )
        .withColumn("censor_reasons", F.array_compact(F.array(*reasons)))
    )


def resolve_ranks(selection: DataFrame, ladder: Sequence[int]) -> DataFrame:
    """Add ``k_prop``, ``k_next`` and ``status``; a censored, off-ladder or top choice is blocked."""
    rungs = [int(k) for k in ladder]
    following = F.lit(None).cast("int")
    for low, high in zip(rungs, rungs[1:]):
        following = F.when(F.col("selected_k") == low, high).otherwise(following)
    status = (
        F.when(F.size("censor_reasons") > 0, "BLOCKED_SELECTOR_CENSORED")
        .when(~F.col("selected_k").isin(rungs), "BLOCKED_RANK_OFF_LADDER")
        .when(following.isNull(), "BLOCKED_NO_K_NEXT")
        .otherwise("RESOLVED")
    )
    ok = F.col("status") == "RESOLVED"
    return selection.withColumn("status", status).withColumn(
        "k_prop", F.when(ok, F.col("selected_k"))
    ).withColumn("k_next", F.when(ok, following))


def selection_stability(selection: DataFrame, order: DataFrame, primary: int = 0) -> DataFrame:
    """Per seed: its own K, the K the primary seed imposes, and how much of the primary set it shares."""
    first = selection.where(F.col("seed") == primary).select(F.col("selected_k").alias("primary_k"))
    primary_k = first.first()["primary_k"]
    kept = order.join(selection.select("seed", "selected_k"), "seed").where("rank < selected_k")
    lead = order.where((F.col("seed") == primary) & (F.col("rank") < primary_k)).select("j").withColumn(
        "_lead", F.lit(1)
    )
    shared = kept.join(lead, "j", "left").groupBy("seed", "selected_k").agg(
        F.coalesce(F.sum("_lead"), F.lit(0)).alias("n_shared")
    )
    return shared.select(
        "seed",
        F.col("selected_k").alias("own_k"),
        F.lit(primary_k).alias("primary_k"),
        "n_shared",
        (F.col("seed") == primary).alias("proposes"),
        (F.col("selected_k") == primary_k).alias("same_k"),
    )


def gain_width(gains: DataFrame, rank: int, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Groups whose number of gains differs from the basis rank."""
    return gains.groupBy(*by).agg(F.count_distinct("j").alias("width")).withColumn(
        "rank", F.lit(rank)
    ).where("width <> rank")


def index_sha256(index: Column) -> Column:
    """Digest of an index set: its 4-byte little-endian integers in order."""
    return F.sha2(F.unhex(F.array_join(F.transform(index, lambda j: little_endian(j, 4)), "")), 256)


def ranks_from_calibration(records: DataFrame) -> DataFrame:
    """Check stored selections and derive their index sets.

    ``records`` is ``(target, k_pred, k_oracle, gain_order array, gain_order_sha256, kept_idx array,
    kept_idx_sha256)``, the digests over 4-byte little-endian integers; one row per target with ``status``
    and the first failed rule. A null digest fails its rule.
    """
    order = F.col("gain_order")

    def differs(name):
        return ~F.coalesce(index_sha256(F.col(name)) == F.col(f"{name}_sha256"), F.lit(False))

    rule = (
        F.when(F.size(order) <= 0, "empty_order")
        .when(F.size(F.array_distinct(order)) != F.size(order), "repeated_direction")
        .when(F.array_min(order) < 0, "negative_direction")
        .when(~F.col("k_pred").between(1, F.size(order)), "k_pred_out_of_range")
        .when(~F.col("k_oracle").between(1, F.size(order)), "k_oracle_out_of_range")
        .when(differs("gain_order"), "order_digest_differs")
        .when(differs("kept_idx"), "kept_digest_differs")
        .when(F.col("kept_idx") != F.slice(order, 1, F.col("k_pred")), "kept_is_not_the_order_head")
    )
    return records.withColumn("failed_rule", rule).withColumn(
        "status", F.when(F.col("failed_rule").isNull(), "OK").otherwise("REJECTED")
    )


def selection_terminal(selection: DataFrame, sets: DataFrame, width: int, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Why no held-out test is needed: no reduction, or the kept set equals the leading prefix."""
    by = list(by)
    held = sets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.max("j").alias("_top"), F.count_distinct("j").alias("_n")
    )
    same = (F.col("_top") == F.col("k") - 1) & (F.col("_n") == F.col("k"))
    return (
        selection.join(held, by)
        .withColumn(
            "terminal",
            F.when(F.col("selected_k") == width, "NO_REDUCED_BUDGET")
            .when(same, "GAIN_SET_EQUALS_POD_SET")
            .otherwise("TEST_NEEDED"),
        )
        .select(*by, "selected_k", "terminal")
    )
