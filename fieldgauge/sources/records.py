"""JSON records, manifests and digest registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST = "^[0-9a-f]{64}$"

MANIFEST = T.StructType(
    [
        T.StructField("sha256", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """Seals, traces and results: one JSON document per file, or one per line."""
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def parse_records(df: DataFrame, col: str, schema: str) -> DataFrame:
    """JSON text in a column to fields next to the other columns."""
    return df.withColumn("_r", F.from_json(col, schema)).select(*[c for c in df.columns if c != col], "_r.*")


def read_manifest_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``sha256 \\t bytes \\t path`` lines."""
    return spark.read.schema(MANIFEST).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def registry_rows(records: DataFrame, col: str = "files") -> DataFrame:
    """``(name, sha256, bytes)`` from a map column name → (sha256, bytes)."""
    return records.select(F.explode(col).alias("name", "_v")).select(
        "name", F.col("_v.sha256").alias("sha256"), F.col("_v.bytes").alias("bytes")
    )


def malformed_digests(registry: DataFrame) -> DataFrame:
    """Entries whose digest is not 64 lower-case hex digits."""
    return registry.where(~F.coalesce(F.col("sha256").rlike(DIGEST), F.lit(False)))


def read_digest_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file {name: {sha256, bytes}}; reading fails on a malformed digest."""
    entry = "struct<sha256: string, bytes: bigint>"
    text = spark.read.option("wholetext", "true").text(path)
    rows = registry_rows(text.select(F.from_json("value", f"map<string, {entry}>").alias("files")))
    bad = F.raise_error(F.concat(F.lit("malformed digest for "), F.col("name")))
    good = F.coalesce(F.col("sha256").rlike(DIGEST), F.lit(False))
    return rows.withColumn("sha256", F.when(good, F.col("sha256")).otherwise(bad))
