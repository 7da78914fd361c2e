"""Frames of fields: one row per (family, traj, t)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOTS = T.StructType(
    [
        T.StructField("family", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("traj", T.LongType()),
        T.StructField("t", T.IntegerType()),
        T.StructField("field", T.ArrayType(T.FloatType())),
    ]
)


def read_snapshots(
    spark: SparkSession,
    path: str,
    roles: Sequence[str] | None = None,
    frames: Sequence[int] | None = None,
    trajectories: Sequence[int] | None = None,
    schema: T.StructType = SNAPSHOTS,
) -> DataFrame:
    """Scan stored frames; roles prune partitions, frames and trajectories reach the Parquet filter."""
    df = spark.read.schema(schema).parquet(path)
    if roles is not None:
        df = df.where(F.col("role").isin(list(roles)))
    if frames is not None:
        df = df.where(F.col("t").isin([int(t) for t in frames]))
    if trajectories is not None:
        df = df.where(F.col("traj").isin([int(t) for t in trajectories]))
    return df


def write_snapshots(df: DataFrame, path: str) -> None:
    """Create-only write laid out for role and family pruning, ordered so frame filters skip groups.

    Rows of one (family, role) are spread over as many files as tasks hold them.
    """
    (
        df.select("family", "role", "traj", "t", "field")
        .sortWithinPartitions("family", "role", "t")
        .write.mode("errorifexists")
        .partitionBy("family", "role")
        .parquet(path)
    )
