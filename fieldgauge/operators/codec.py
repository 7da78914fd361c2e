"""Encode, decode and project fields with a kept set of directions; the stored form and its size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldgauge.functions.arrow import append, to_lists, to_matrix, widened
from fieldgauge.functions.blocks import add_runs, numbered, over_strips, strips
from fieldgauge.functions.vectors import dot, doubles, minus
from fieldgauge.session import BROADCAST_BYTES

# Directions of one grid cell when all of them are too large to share.
STRIP_BYTES = 64 * 1024 * 1024


def kept_rows(basis: DataFrame, keep: Sequence[int] | None = None) -> np.ndarray | None:
    """The kept directions as a ``[K, D]`` matrix in the order of ``keep``, or None when too large.

    The size is measured before anything is collected.
    """
    rows = basis if keep is None else basis.where(F.col("j").isin([int(j) for j in keep]))
    row = rows.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("vec")).alias("d")).first()
    if row["k"] == 0 or (keep is not None and row["k"] != len(set(keep))):
        raise ValueError("the kept set is empty or names a direction the basis does not hold")
    if keep is not None and len(set(keep)) != len(keep):
        raise ValueError("the kept set repeats a direction")
    if row["k"] * row["d"] * 8 > BROADCAST_BYTES:
        return None
    found = {r["j"]: r["vec"] for r in rows.select("j", "vec").collect()}
    order = sorted(found) if keep is None else [int(j) for j in keep]
    return np.asarray([found[j] for j in order], dtype=np.float64)


def _map(df: DataFrame, share, sources: Sequence[str], outputs: Sequence[str], fn) -> DataFrame:
    """Append array columns computed by one matrix product per Arrow batch."""
    schema = widened(df.schema, outputs)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            mats = [to_matrix(batch.column(batch.schema.get_field_index(s))) for s in sources]
            results = fn(share.value, *mats)
            yield append(batch, {o: to_lists(m) for o, m in zip(outputs, results)})

    return df.mapInArrow(run, schema)


def encode(
    df: DataFrame,
    cols: str | Sequence[str],
    basis: DataFrame,
    mean: np.ndarray,
    keep: Sequence[int] | None = None,
    outputs: Sequence[str] | None = None,
    row: Sequence[str] | None = None,
) -> DataFrame:
    """Append c = (y−μ)B_Sᵀ for each column; directions too large to share go by strips.

    ``row`` is not needed; rows are told apart by a number of their own.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    outputs = list(outputs or [f"c_{c}" if len(cols) > 1 else "coef" for c in cols])
    rows = kept_rows(basis, keep)
    if rows is None:
        return encode_by_strips(df, cols, basis, mean, keep, outputs)
    share = df.sparkSession.sparkContext.broadcast((rows, np.asarray(mean, dtype=np.float64)))

    def product(shared, *mats):
        b, mu = shared
        return [(m - mu) @ b.T for m in mats]

    return _map(df, share, cols, outputs, product)


# ------------------------------------------------------------ directions too large to share


def _vectors(names: Sequence[str]) -> str:
    return ", ".join(f"`{n}` array<double>" for n in names)


def encode_by_strips(
    df: DataFrame, cols: Sequence[str], basis: DataFrame, mean: np.ndarray,
    keep: Sequence[int] | None = None, outputs: Sequence[str] = ("coef",), size: int | None = None,
) -> DataFrame:
    """``encode`` on the grid: each strip gives the coefficients of its directions, a row's strips are joined in order."""
    held = numbered(df)
    matrix = strips(basis, keep, STRIP_BYTES, size)
    share = df.sparkSession.sparkContext.broadcast(np.asarray(mean, dtype=np.float64))

    def product(s, b, own, *mats):
        parts = [to_lists((m - share.value) @ b.T) for m in mats]
        return pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(parts[0]), s, np.int32)), *parts], names=["_row", "_strip", *outputs])

    parts = over_strips(held, ["_row"], cols, matrix, f"_row bigint, _strip int, {_vectors(outputs)}", product)
    ordered = F.array_sort(F.collect_list(F.struct("_strip", *outputs)))
    whole = parts.groupBy("_row").agg(ordered.alias("_p")).select(
        "_row", *[F.flatten(F.col("_p").getField(o)).alias(o) for o in outputs]
    )
    return held.join(whole, "_row").select(*df.columns, *outputs)


def encode_by_tiles(
    df: DataFrame, col: str, basis: DataFrame, mean: np.ndarray, keep: Sequence[int] | None,
    output: str, row: Sequence[str] | None = None, tile: int = 1024,
) -> DataFrame:
    """``encode_by_strips`` of one column by strips of ``tile`` directions."""
    return encode_by_strips(df, [col], basis, mean, keep, [output], tile)


def project_by_strips(
    df: DataFrame, cols: Sequence[str], basis: DataFrame, mean: np.ndarray,
    keep: Sequence[int] | None = None, outputs: Sequence[str] = ("projected",), size: int | None = None,
    centred: bool = False,
) -> DataFrame:
    """``project`` on the grid: a cell encodes and decodes with its strip, a row's strips are added.

    ``centred`` leaves the mean out of the result.
    """
    held = numbered(df)
    matrix = strips(basis, keep, STRIP_BYTES, size)
    share = df.sparkSession.sparkContext.broadcast(np.asarray(mean, dtype=np.float64))

    def lift(s, b, own, *mats):
        parts = [to_lists(((m - share.value) @ b.T) @ b + (share.value if s == 0 and not centred else 0.0)) for m in mats]
        return pa.RecordBatch.from_arrays([own.column(0), *parts], names=["_row", *outputs])

    parts = over_strips(held, ["_row"], cols, matrix, f"_row bigint, {_vectors(outputs)}", lift)
    return held.join(add_runs(parts, "_row", outputs), "_row").select(*df.columns, *outputs)


def decode_by_strips(
    df: DataFrame, col: str, basis: DataFrame, mean: np.ndarray, keep: Sequence[int] | None = None,
    output: str = "field", size: int | None = None,
) -> DataFrame:
    """``decode`` on the grid: a cell gets only the coefficients of its strip."""
    held = numbered(df)
    matrix = strips(basis, keep, STRIP_BYTES, size)
    share = df.sparkSession.sparkContext.broadcast(np.asarray(mean, dtype=np.float64))

    def lift(s, b, own, c):
        return pa.RecordBatch.from_arrays([own.column(0), to_lists(c @ b + (share.value if s == 0 else 0.0))], names=["_row", output])

    parts = over_strips(held, ["_row"], [col], matrix, f"_row bigint, {_vectors([output])}", lift, part=True)
    return held.join(add_runs(parts, "_row", [output]), "_row").select(*df.columns, output)


def decode(
    df: DataFrame, col: str, basis: DataFrame, mean: np.ndarray,
    keep: Sequence[int] | None = None, output: str = "field",
) -> DataFrame:
    """Append ŷ = cB_S + μ."""
    rows = kept_rows(basis, keep)
    if rows is None:
        return decode_by_strips(df, col, basis, mean, keep, output)
    share = df.sparkSession.sparkContext.broadcast((rows, np.asarray(mean, dtype=np.float64)))
    return _map(df, share, [col], [output], lambda s, c: [c @ s[0] + s[1]])


def project(
    df: DataFrame, col: str, basis: DataFrame, mean: np.ndarray,
    keep: Sequence[int] | None = None, output: str = "projected",
) -> DataFrame:
    """Append the projection of a field on the kept directions: encode and decode in one pass."""
    rows = kept_rows(basis, keep)
    if rows is None:
        return project_by_strips(df, [col], basis, mean, keep, [output])
    share = df.sparkSession.sparkContext.broadcast((rows, np.asarray(mean, dtype=np.float64)))

    def lift(shared, y):
        b, mu = shared
        return [((y - mu) @ b.T) @ b + mu]

    return _map(df, share, [col], [output], lift)


def encode_by_expression(
    df: DataFrame, col: str, basis: DataFrame, mean: np.ndarray, row: Sequence[str],
    keep: Sequence[int] | None = None, output: str = "coef",
) -> DataFrame:
    """The same coefficients by built-in array functions only; the second implementation in checks."""
    rows = kept_rows(basis, keep)
    if rows is None or rows.size > 65_536:
        raise ValueError("the expression form serves small K·D")
    mu = F.lit(np.asarray(mean, dtype=np.float64))
    b = F.array(*[F.lit(r) for r in rows])
    centred = minus(doubles(col), mu)
    return df.withColumn(output, F.transform(b, lambda v: dot(v, centred)))


# ------------------------------------------------------------------------------ index sets


def arm_sets(order: DataFrame, ranks: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, arm, pos, j)``: the first K of the gain order ``(rank, j)`` for each arm.

    An arm name starting with ``pod`` takes the prefix {0..K−1} instead.
    """
    items = [(a, int(k), a.startswith("pod")) for a, k in ranks.items()]
    arms = F.explode(
        F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("k"), F.lit(p).alias("prefix"))
                  for a, k, p in items])
    )
    pos = F.when(F.col("_a.prefix"), F.col("j")).otherwise(F.col("rank"))
    return (
        order.withColumn("_a", arms)
        .select(*by, "_a.arm", pos.cast("int").alias("pos"), F.col("j").cast("int").alias("j"), "_a.k")
        .where("pos < k")
        .drop("k")
    )


def is_leading_prefix(sets: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """Whether each ordered set is exactly 0, 1, …, K−1."""
    return sets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.bool_and(F.col("pos") == F.col("j")).alias("is_leading_prefix")
    )


def ordered_set(sets: DataFrame) -> list[int]:
    """One index set in order; its length is a basis rank."""
    return [r["j"] for r in sets.orderBy("pos").select("j").collect()]


# ------------------------------------------------------------------------------- the store


def write_store(
    pairs: DataFrame, col: str, row: Sequence[str], basis: DataFrame, mean: np.ndarray,
    keep: Sequence[int], path: str,
) -> None:
    """A create-only reduced-target store: coefficients, kept directions, mean and index set."""
    keep = [int(j) for j in keep]
    if len(set(keep)) != len(keep) or min(keep, default=-1) < 0:
        raise ValueError("the index set must be distinct and non-negative")
    top = basis.agg(F.max("j")).first()[0]
    if max(keep) > top:
        raise ValueError(f"direction {max(keep)} is outside the basis (0..{top})")
    spark = pairs.sparkSession
    index = spark.createDataFrame(
        pd.DataFrame({"pos": np.arange(len(keep), dtype=np.int32), "j": np.asarray(keep, np.int32)})
    )
    floats = F.col("coef").cast("array<float>").alias("coef")
    index.coalesce(1).write.mode("errorifexists").parquet(f"{path}/index")
    encode(pairs.select(*row, doubles(col).alias(col)), col, basis, mean, keep, row=row).select(
        *row, floats
    ).write.mode("errorifexists").parquet(f"{path}/coefficients")
    basis.where(F.col("j").isin(keep)).select(
        "j", F.col("vec").cast("array<float>").alias("vec")
    ).coalesce(1).write.mode("errorifexists").parquet(f"{path}/directions")
    spark.createDataFrame(pa.table({"mean": to_lists(np.asarray(mean)[None, :])})).select(
        F.col("mean").cast("array<float>").alias("mean")
    ).coalesce(1).write.mode("errorifexists").parquet(f"{path}/mean")


def write_dense_store(pairs: DataFrame, col: str, row: Sequence[str], path: str) -> None:
    pairs.select(*row, F.col(col).cast("array<float>").alias(col)).write.mode(
        "errorifexists"
    ).parquet(f"{path}/fields")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Fields rebuilt from a reduced store."""
    index = [r["j"] for r in spark.read.parquet(f"{path}/index").orderBy("pos").collect()]
    mean = np.asarray(spark.read.parquet(f"{path}/mean").first()["mean"], dtype=np.float64)
    dirs = spark.read.parquet(f"{path}/directions").withColumn("vec", doubles("vec"))
    coefs = spark.read.parquet(f"{path}/coefficients").withColumn("coef", doubles("coef"))
    return decode(coefs, "coef", dirs, mean, index)


def store_bytes(sizes: DataFrame, by: Sequence[str] = ("scheme",), base: str = "dense") -> DataFrame:
    """Bytes per scheme over every file of its container, and the share of the base scheme.

    ``sizes`` is ``(scheme, path, length)``.
    """
    sums = sizes.groupBy(*by).agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n_files"))
    ref = F.max(F.when(F.col("scheme") == base, F.col("bytes"))).over(Window.partitionBy(F.lit(0)))
    return sums.withColumn("share", F.col("bytes") / ref)


def store_sizes(spark: SparkSession, stores: Mapping[str, str]) -> DataFrame:
    """``(scheme, path, length)`` from file metadata; no file is opened for its content."""
    out = None
    for scheme, path in stores.items():
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet").load(path)
            .select(F.lit(scheme).alias("scheme"), "path", "length")
        )
        out = files if out is None else out.unionByName(files)
    return out
