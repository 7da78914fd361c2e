"""How the given tables become trajectories, series, curves, matrices and file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgauge.functions import ranking
from fieldgauge.operators import roles

# Twentieths of the users of each family.
WEIGHTS = {"train": 11, "validation": 4, "unused": 2, "test": 3}
SPLIT_SEED = 7


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def family_of(user: Column) -> Column:
    return F.concat(F.lit("f"), (user % 4).cast("string"))


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """``(event_id, family, traj, t, event_type, value)`` with t = days since 2024-01-01."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return read(spark, sf, "events").select(
        "event_id", family_of(F.col("user_id")).alias("family"), F.col("user_id").alias("traj"),
        day.alias("t"), "event_type", "value",
    )


def kinds(spark: SparkSession, sf: str) -> list[str]:
    """The event types there are, in order: the components of a field."""
    found = read(spark, sf, "events").select("event_type").where("event_type is not null").distinct()
    return sorted(r[0] for r in found.collect())


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One field per (user, day): the sum of each event type."""
    sums = [
        F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)) for k in kinds(spark, sf)
    ]
    return user_days(spark, sf).groupBy("family", "traj", "t").agg(F.array(*sums).alias("field"))


def trajectory_keys(spark: SparkSession, sf: str) -> DataFrame:
    users = read(spark, sf, "events").select("user_id").distinct()
    return users.select(family_of(F.col("user_id")).alias("family"), F.col("user_id").alias("traj"))


def trajectory_roles(spark: SparkSession, sf: str) -> DataFrame:
    return roles.split_by_trajectory(trajectory_keys(spark, sf), SPLIT_SEED, weights=WEIGHTS)


def daily_series(spark: SparkSession, sf: str) -> DataFrame:
    """``(series_id, step, value)``: the daily sum of each event type on a dense day grid."""
    ev = user_days(spark, sf)
    sums = ev.groupBy("t", "event_type").agg(F.sum("value").alias("value"))
    lo, hi = ev.agg(F.min("t"), F.max("t")).first()
    grid = spark.range(lo, hi + 1).select(
        F.col("id").cast("int").alias("t"),
        F.explode(F.array(*[F.lit(k) for k in kinds(spark, sf)])).alias("event_type"),
    )
    return grid.join(sums, ["t", "event_type"], "left").select(
        F.col("event_type").alias("series_id"), (F.col("t") - lo).cast("long").alias("step"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as fields of width 4, scaled to comparable magnitudes."""
    cols = [
        F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100,
    ]
    return read(spark, sf, "lineitem").select(F.array(*cols).alias("y"))


def mean_in_order(value: str, order: str) -> Column:
    """The mean of a small group, its sum taken in the order of a key.

    Values that tie by arithmetic then tie in the last bit too, however the rows are split over files and tasks.
    """
    held = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, p: a + p[value]), F.size(held))


def curves(spark: SparkSession, sf: str) -> DataFrame:
    """``(traj, family, epoch, val_mse)``: a user's mean value per active day, one epoch per day."""
    daily = user_days(spark, sf).groupBy("traj", "family", "t").agg(
        (mean_in_order("value", "event_id") + 1.0).alias("val_mse")
    )
    order = ranking.Window.partitionBy("traj").orderBy("t")
    return daily.select("traj", "family", F.row_number().over(order).alias("epoch"), "val_mse")


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as an inventory: name, size and digests of the whole text."""
    return read(spark, sf, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.sha2(F.col("text"), 256).alias("sha256"),
        F.md5(F.col("text")).alias("md5"),
        F.col("source").alias("family"),
        F.col("lang").alias("role"),
    )


def long_pairs(df: DataFrame, *keys: str) -> DataFrame:
    """One row per element of x and y."""
    cells = F.posexplode(F.arrays_zip("x", "y")).alias("j", "_v")
    return df.select(*keys, cells).select(*keys, "j", F.col("_v.x").alias("x"), F.col("_v.y").alias("y"))


SEEDS = (0, 1, 2)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """``(family, seed, cluster, priority, dense, reduced)``: order prices as errors of two families."""
    price = F.col("o_totalprice") / 1000
    seed = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    rows = read(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("priority"),
        price.alias("dense"), seed,
    )
    key, s = F.col("o_orderkey"), F.col("seed")
    mix = F.col("dense") * (F.lit(0.97) + F.lit(0.01) * ((key + s) % 7))
    step = F.col("dense") * (F.lit(0.95) + F.lit(0.02) * ((key + 2 * s) % 6))
    both = F.explode(
        F.array(
            F.struct(F.lit("mix").alias("family"), mix.alias("reduced")),
            F.struct(F.lit("step").alias("family"), step.alias("reduced")),
        )
    )
    return rows.withColumn("_f", both).select("_f.family", "seed", "cluster", "priority", "dense", "_f.reduced")


def run_grid(spark: SparkSession, sf: str) -> DataFrame:
    """``(family, arm, seed, cluster, err)``: complete for every customer with an order."""
    means = runs(spark, sf).groupBy("family", "seed", "cluster").agg(
        F.avg("dense").alias("dense"), F.avg("reduced").alias("reduced")
    )
    return means.unpivot(["family", "seed", "cluster"], ["dense", "reduced"], "arm", "err")


def family_mse(spark: SparkSession, sf: str) -> DataFrame:
    """``(family, arm, seed, mse)`` with the order priority as family and three arms."""
    rows = runs(spark, sf).where("family = 'mix'").groupBy(F.col("priority").alias("family"), "seed").agg(
        F.avg("dense").alias("dense"), F.avg("reduced").alias("reduced"),
        F.avg(F.col("reduced") * 1.01).alias("pod"),
    )
    return rows.unpivot(["family", "seed"], ["dense", "reduced", "pod"], "arm", "mse")


METRICS = ("bytes_on_disk", "peak_memory", "steady_epoch_s", "input_s", "heldout_error")


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Cost rows ``(target, scheme, seed, metrics…)`` from lineitem groups."""
    scheme = F.when(F.col("l_linestatus") == "O", "dense").otherwise("budget")
    return read(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("target"), scheme.alias("scheme"), F.col("l_linenumber").alias("seed")
    ).agg(
        F.sum("l_quantity").alias("bytes_on_disk"), F.max("l_extendedprice").alias("peak_memory"),
        (F.avg("l_extendedprice") / 1000).alias("steady_epoch_s"), (F.avg("l_tax") * 100).alias("input_s"),
        (F.avg("l_discount") * 100).alias("heldout_error"),
    )
