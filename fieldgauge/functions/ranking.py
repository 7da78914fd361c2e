"""Positions inside a group without sorting the group in one task.

Rows go to buckets that follow the sort order, so a row's position is its place in the bucket plus
the size of all earlier buckets. Only the bucket sizes are ever sorted per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

HEX_DIGITS = 3
SPLITS = 255
# A table counted at no more rows than this is ranked without buckets.
ONE_BUCKET = 100_000


def hash_key(seed: int | Column, *cols: Column | str) -> Column:
    """The hex text whose order is the seeded shuffle."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [seed_col.cast("string")] + [
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in cols
    ]
    return F.md5(F.concat_ws(":", *parts))


def hash_bucket(key: Column, digits: int = HEX_DIGITS) -> Column:
    """Buckets that follow the order of a hex key; evenly filled because the key is a hash."""
    return F.substring(key, 1, digits)


def ordered_bucket(
    df: DataFrame, col: str, splits: int | None = None, n: int | None = None
) -> Column | None:
    """Buckets that follow the order of a column, from approximate quantiles of its image as a number.

    Only the balance depends on the quantiles; any splits give the same positions. Nulls come first.
    There are at least four buckets per core of the cluster. None means that the table was counted
    and one bucket is enough.
    """
    if splits is None:
        if n is not None and n <= ONE_BUCKET:
            return None
        splits = max(SPLITS, 4 * df.sparkSession.sparkContext.defaultParallelism)
        smallest = ONE_BUCKET
    else:
        smallest = 0
    at = [i / (splits + 1) for i in range(1, splits + 1)]
    image = _as_number(df, col)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(image, at, 10_000).alias("q")
    ).first()
    if row["n"] <= smallest:
        return None
    edges = np.unique(np.asarray(row["q"] or [], dtype=np.float64))

    @F.pandas_udf(T.IntegerType())
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(dtype=np.float64), side="right"))

    return F.when(F.col(col).isNull(), F.lit(-1)).otherwise(place(image))


def _as_number(df: DataFrame, col: str) -> Column:
    """A double that never falls as the column rises; of a text its first six bytes."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.substring(F.col(col).cast("binary"), 1, 6)
        return F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    return F.col(col).cast("double")


def with_position(
    df: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    name: str = "rank",
) -> DataFrame:
    """Add the 0-based position of every row inside its ``by`` group."""
    tagged = df.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        tagged.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        tagged.withColumn("_nth", F.row_number().over(inside) - 1)
        .join(starts, keys)
        .withColumn(name, (F.col("_start") + F.col("_nth")).cast("long"))
        .drop("_bucket", "_nth", "_start")
    )


def hash_position(
    df: DataFrame, by: Sequence[str], seed: int, key: Sequence[str], name: str = "rank"
) -> DataFrame:
    """Position in the seeded shuffle of ``key`` inside each group."""
    shuffled = df.withColumn("_hash", hash_key(seed, *[F.col(c) for c in key]))
    return with_position(
        shuffled, by, hash_bucket(F.col("_hash")), ["_hash", *key], name
    ).drop("_hash")


def ordered_position(
    df: DataFrame, by: Sequence[str], col: str, name: str = "rank", splits: int | None = None,
    n: int | None = None,
) -> DataFrame:
    """Position by a column inside each group, nulls first; ``n`` is the row count where it is known."""
    bucket = ordered_bucket(df, col, splits, n)
    if bucket is None:
        inside = Window.partitionBy(*(by or [F.lit(0)])).orderBy(col)
        return df.withColumn(name, (F.row_number().over(inside) - 1).cast("long"))
    return with_position(df, by, bucket, [col], name)


def next_in_group(
    df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], width: int = 1024
) -> DataFrame:
    """Attach ``next_<col>`` from the following row of the group (null at the end).

    Groups are cut into runs of ``width`` order values, so a long group is many small windows. The
    head of each later run is copied into the run before it; heads are found from the key columns
    alone, and without any (all groups shorter than a run) the copy is empty.
    """
    keys = [*by, "_run"]
    runs = df.withColumn("_run", F.floor(F.col(order) / F.lit(width)))
    heads = runs.groupBy(*keys).agg(F.min(order).alias("_head"))
    following = F.lead("_head").over(Window.partitionBy(*by).orderBy("_run"))
    ahead = (
        heads.withColumn("_next", following)
        .where(F.col("_next").isNotNull())
        .select(*by, F.col("_next").alias(order), "_run")
    )
    copies = df.join(ahead, [*by, order]).select(*df.columns, "_run", F.lit(True).alias("_copy"))
    rows = runs.withColumn("_copy", F.lit(False)).unionByName(copies)
    after = F.lead(F.struct(*cols)).over(Window.partitionBy(*keys).orderBy(order))
    out = rows.withColumn("_after", after).where(~F.col("_copy"))
    return out.select(*df.columns, *[F.col(f"_after.{c}").alias(f"next_{c}") for c in cols])
