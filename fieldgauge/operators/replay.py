"""Recompute published numbers from stored errors and compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.operators import boot, decide
from fieldgauge.operators.metrics import mean_of_cluster_means
from fieldgauge.session import cut


def recompute(errors: DataFrame, base: str = "dense", reps: int | None = None, seed: int = boot.SEED) -> DataFrame:
    """Every aggregate of a study from ``errors (arm, seed, cluster, err)`` as ``(metric, arm, seed, value)``."""
    mse = mean_of_cluster_means(errors)
    ratios = decide.seed_ratios(mse, base)
    points = decide.quality_point(ratios)
    counts = decide.seed_counts(ratios)
    none = F.lit(None).cast("int")
    out = mse.select(F.lit("mse").alias("metric"), "arm", F.col("seed").cast("int").alias("seed"), F.col("mse").alias("value"))
    out = out.unionByName(
        ratios.select(F.lit("ratio").alias("metric"), "arm", F.col("seed").cast("int").alias("seed"), F.col("ratio").alias("value"))
    )
    out = out.unionByName(points.select(F.lit("quality").alias("metric"), "arm", none.alias("seed"), F.col("point").alias("value")))
    out = out.unionByName(
        counts.select(
            F.lit("n_above_tolerance").alias("metric"), "arm", none.alias("seed"),
            F.col("n_above_tolerance").cast("double").alias("value"),
        )
    )
    if reps:
        limits = boot.paired_bootstrap(errors, base, reps, seed)
        for col in ("lo", "hi"):
            out = out.unionByName(
                limits.select(F.lit(col).alias("metric"), "arm", none.alias("seed"), F.col(col).alias("value"))
            )
    return out


def replay_result(stored: DataFrame, recomputed: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Stored and recomputed values side by side with ``agrees``; relative tolerance, nulls must match."""
    a = stored.select("metric", "arm", "seed", F.col("value").alias("stored"))
    b = recomputed.select(
        F.col("metric").alias("m"), F.col("arm").alias("a"), F.col("seed").alias("s"), F.col("value").alias("again")
    )
    on = (
        F.col("metric").eqNullSafe(F.col("m")) & F.col("arm").eqNullSafe(F.col("a")) & F.col("seed").eqNullSafe(F.col("s"))
    )
    close = F.abs(F.col("stored") - F.col("again")) <= tol * F.greatest(F.abs(F.col("stored")), F.lit(1e-300))
    return a.join(b, on, "full_outer").select(
        F.coalesce("metric", "m").alias("metric"),
        F.coalesce("arm", "a").alias("arm"),
        F.coalesce("seed", "s").alias("seed"),
        "stored",
        "again",
        F.coalesce(close, F.col("stored").eqNullSafe(F.col("again"))).alias("agrees"),
    )


def implementations_agree(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """Rows of either table, doubles rounded, that the other does not hold."""
    def rounded(df):
        return df.select(
            *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        )

    left, right = rounded(a), rounded(b.select(*a.columns))
    return left.exceptAll(right).withColumn("side", F.lit("first")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("second"))
    )


def index_agrees(index: DataFrame, records: DataFrame, key: Sequence[str]) -> DataFrame:
    """Published values against full-precision records at the number of decimals published.

    ``index`` is ``(*key, value, decimals)``, ``records`` is ``(*key, value)``.
    """
    exact = records.select(*key, F.col("value").alias("exact"))
    room = F.lit(0.5) * F.pow(F.lit(10.0), -F.col("decimals")) * (1 + 1e-9)
    return index.join(exact, list(key), "left").withColumn(
        "agrees", F.coalesce(F.abs(F.col("value") - F.col("exact")) <= room, F.lit(False))
    )


def report(results: dict[str, DataFrame], tolerance: float = decide.TOLERANCE) -> DataFrame:
    """One row per study from ``(arm, point, lo, hi, floor)`` tables: numbers, placement, verdict."""
    out = None
    for study, df in results.items():
        row = df.select(
            F.lit(study).alias("study"), "arm", "point", "lo", "hi", "floor",
            decide.placement(F.col("lo"), F.col("hi"), tolerance).alias("interval"),
            decide.floor_screen(F.col("floor"), tolerance).alias("screen"),
            decide.verdict3(F.col("point"), F.col("floor"), tolerance).alias("verdict"),
        )
        out = row if out is None else out.unionByName(row)
    return out


# ----------------------------------------------------------------------- the graph of a record

KEY = ("entry", "family", "arm", "seed")
# Entries in the order they follow from each other, with the entries each is made from.
GRAPH = (
    ("mse", ()), ("ratio", ("mse",)), ("quality", ("ratio",)), ("q_port", ("quality",)),
    ("lo", ()), ("hi", ()), ("interval", ("lo", "hi")), ("verdict", ("quality",)),
)


def _entry(rows: DataFrame, name: str, value: str | None = None, text: str | None = None) -> DataFrame:
    kinds = {"family": "string", "arm": "string", "seed": "int"}
    held = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    number = F.col(value) if value else F.lit(None)
    words = F.col(text) if text else F.lit(None)
    return rows.select(F.lit(name).alias("entry"), *held, number.cast("double").alias("value"), words.cast("string").alias("text"))


def _roots(errors: DataFrame, reps: int, seed: int, base: str) -> DataFrame:
    """The entries that come from the errors themselves: means, and interval ends per family and arm."""
    by = ["family", "arm", "seed"]
    out = _entry(errors.groupBy(*by).agg(F.avg("err").alias("mse")), "mse", "mse")
    means = boot.replicate_means(errors, reps, seed, by=by, stored=True)
    bases = means.where(F.col("arm") == base).select("rep", "family", "seed", F.col("mse").alias("_base"))
    ratios = means.where(F.col("arm") != base).join(bases, ["rep", "family", "seed"])
    stats = ratios.groupBy("rep", "family", "arm").agg(F.median(F.col("mse") / F.col("_base")).alias("stat"))
    ends = boot.interval(stats, "stat", ["family", "arm"])
    return out.unionByName(_entry(ends, "lo", "lo")).unionByName(_entry(ends, "hi", "hi"))


def _derived(name: str, held: DataFrame, base: str, floor: str, tolerance: float) -> DataFrame:
    """One kind of entry from those of ``held`` it depends on."""
    of = lambda entry: held.where(F.col("entry") == entry)
    if name == "ratio":
        mse = of("mse").select("family", "arm", "seed", F.col("value").alias("mse"))
        return _entry(decide.seed_ratios(mse, base, ["family"], strict=False), name, "ratio")
    if name == "quality":
        ratios = of("ratio").select("family", "arm", "seed", F.col("value").alias("ratio"))
        return _entry(decide.quality_point(ratios, ["family", "arm"]), name, "point")
    if name == "q_port":
        return _entry(of("quality").groupBy("arm").agg(F.max("value").alias("q")), name, "q")
    if name == "interval":
        lo = of("lo").select("family", "arm", F.col("value").alias("lo"))
        ends = lo.join(of("hi").select("family", "arm", F.col("value").alias("hi")), ["family", "arm"])
        return _entry(ends.withColumn("p", decide.placement(F.col("lo"), F.col("hi"), tolerance)), name, text="p")
    floors = of("quality").where(F.col("arm") == floor).select("family", F.col("value").alias("f"))
    points = of("quality").where(F.col("arm") != floor).select("family", "arm", F.col("value").alias("q"))
    judged = points.join(floors, "family").withColumn("v", decide.verdict3(F.col("q"), F.col("f"), tolerance))
    return _entry(judged, name, text="v")


def derive(held: DataFrame, after: str | None = None, base: str = "dense", floor: str = "floor", tolerance: float = decide.TOLERANCE) -> DataFrame:
    """``held`` with every entry that depends on ``after`` (or on a root) made anew, in the order of the graph."""
    anew = {after} if after else {name for name, needs in GRAPH if not needs}
    for name, needs in GRAPH:
        if needs and anew & set(needs) and name != after:
            anew.add(name)
            made = _derived(name, held, base, floor, tolerance)
            held = held.where(F.col("entry") != name).unionByName(made)
    return held


def record(errors: DataFrame, reps: int = boot.REPLICATES, seed: int = boot.SEED, base: str = "dense", floor: str = "floor", tolerance: float = decide.TOLERANCE) -> DataFrame:
    """``(entry, family, arm, seed, value, text)``: every number and verdict of a study from its stored errors."""
    return derive(_roots(errors, reps, seed, base), None, base, floor, tolerance)


def replay_graph(
    stored: DataFrame, again: DataFrame, base: str = "dense", floor: str = "floor", tolerance: float = decide.TOLERANCE, tol: float = 1e-9,
) -> DataFrame:
    """Every stored entry beside ``again``, the ``record`` of the errors, and where a wrong value comes from.

    An entry is also made anew from the stored entries it depends on. ``status``: ``OK`` equals ``again``;
    ``INHERITED`` follows from wrong stored entries; ``ENTERS_HERE`` follows from nothing that is stored;
    ``MISSING`` and ``UNEXPECTED`` are on one side only.
    """
    stored = cut(stored.select(*KEY, "value", "text"), "stored")
    local = again.where(F.col("entry").isin([name for name, needs in GRAPH if not needs]))
    for name, needs in GRAPH:
        if needs:
            local = local.unionByName(_derived(name, stored, base, floor, tolerance))

    def side(df, s):
        return df.select(
            F.to_json(F.struct(*KEY)).alias("_key"), F.col("value").alias(s), F.col("text").alias(f"{s}_text"), F.struct(*KEY).alias(f"_{s}")
        )

    rows = side(stored, "stored").join(side(again, "again"), "_key", "full_outer").join(side(local, "local").drop("_local"), "_key", "left")

    def agrees(a, b):
        close = F.abs(F.col(a) - F.col(b)) <= tol * F.greatest(F.abs(F.col(b)), F.lit(1e-300))
        return F.coalesce(close, F.col(a).eqNullSafe(F.col(b))) & F.col(f"{a}_text").eqNullSafe(F.col(f"{b}_text"))

    status = (
        F.when(F.col("_stored").isNull(), "MISSING").when(F.col("_again").isNull(), "UNEXPECTED")
        .when(agrees("stored", "again"), "OK").when(agrees("stored", "local"), "INHERITED").otherwise("ENTERS_HERE")
    )
    order = F.array_position(F.array(*[F.lit(name) for name, _ in GRAPH]), F.col("_own.entry"))
    return rows.withColumn("_own", F.coalesce("_stored", "_again")).select(
        "_own.*", order.alias("step"), "stored", "again", "stored_text", "again_text", status.alias("status")
    )


def first_wrong(graph: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The first entry, in the order of the graph, that is wrong by itself; and how many entries are wrong after it."""
    wrong = F.col("status").isin("ENTERS_HERE", "MISSING", "UNEXPECTED")
    first = F.min(F.when(wrong, F.struct("step", *KEY)))
    held = graph.groupBy(*by).agg(first.alias("_f"), F.count_if(wrong).alias("n_enter"), F.count_if(F.col("status") == "INHERITED").alias("n_inherited"))
    return held.select(*by, *[F.col(f"_f.{c}").alias(c) for c in KEY], "n_enter", "n_inherited")
