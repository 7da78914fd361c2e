"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write and refuse to touch anything that already exists."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """The per-cluster error artifact: long rows, one folder per (family, arm), create-only."""
    cols = ["family", "arm", "seed", "cluster", "err"]
    write_once(errors.select(*cols), path, ["family", "arm"])
