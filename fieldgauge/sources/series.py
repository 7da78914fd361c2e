"""Wide CSV series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.functions import ranking


def read_wide_series(spark: SparkSession, path: str, time_col: str) -> DataFrame:
    """``(series_id, step, value)`` from a header row ``time, s1, s2, …``.

    Only the header is looked at to build the schema; values are 4-byte floats. ``step`` is the
    position of the time value, found without sorting the table in one task.
    """
    names = spark.read.option("header", "true").csv(path).columns
    schema = T.StructType(
        [T.StructField(c, T.StringType() if c == time_col else T.FloatType()) for c in names]
    )
    wide = spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)
    return wide_to_long(wide.withColumn(time_col, F.col(time_col).cast("timestamp_ntz")), time_col)


def wide_to_long(wide: DataFrame, time_col: str) -> DataFrame:
    """Number the time steps, then turn one row per step into one row per (series, step)."""
    seconds = F.unix_micros(F.col(time_col).cast("timestamp"))
    stamped = ranking.ordered_position(wide.withColumn("_at", seconds), [], "_at", "step").drop("_at")
    values = [c for c in wide.columns if c != time_col]
    return stamped.unpivot(["step"], values, "series_id", "value").select("series_id", "step", "value")
