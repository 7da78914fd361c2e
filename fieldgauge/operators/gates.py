"""Integrity gates. Each returns a table of violations; an empty table is a pass."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldgauge.functions.arrow import append
from fieldgauge.functions.vectors import doubles, not_finite
from fieldgauge.operators.roles import index_digest


class GateFailed(RuntimeError):
    """A gate found violations in strict mode."""


def require_empty(violations: DataFrame, what: str) -> None:
    """The strict form of every gate."""
    rows = violations.limit(5).collect()
    if rows:
        raise GateFailed(f"{what}: {[r.asDict() for r in rows]}")


# ------------------------------------------------------------------------------ fingerprints


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, bytes)`` from metadata; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("bytes"))


def fingerprint(spark: SparkSession, path: str, glob: str | None = None, largest: int = 512 * 1024 * 1024) -> DataFrame:
    """``(path, bytes, sha256, md5)``.

    Files up to ``largest`` are hashed in the JVM. Larger ones do not fit a cell; their paths are
    spread over tasks and each is hashed as a stream through the file system Arrow opens for it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    small = reader.load(path).where(F.col("length") <= largest).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")
    )
    big = list_files(spark, path, glob).where(F.col("bytes") > largest)
    return small.unionByName(hash_streams(big))


def hash_streams(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Hash the files at ``path`` in 8 MiB steps, one file at a time per task."""
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        from pyarrow import fs

        for frame in frames:
            rows = []
            for path, size in zip(frame["path"], frame["bytes"]):
                sha, md5 = hashlib.sha256(), hashlib.md5()
                uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
                store, inner = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(inner) as stream:
                    while chunk := stream.read(8 << 20):
                        sha.update(chunk)
                        md5.update(chunk)
                rows.append((path, size, sha.hexdigest(), md5.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256", "md5"])

    return files.select("path", "bytes").repartition(tasks, "path").mapInPandas(
        run, "path string, bytes bigint, sha256 string, md5 string"
    )


def reconcile(found: DataFrame, published: DataFrame, key: str = "name") -> DataFrame:
    """``(name, kind)`` of every disagreement between files found and a published list.

    ``found`` is ``(name, bytes, sha256, family, role)``; ``published`` is ``(name, bytes, sha256)``.
    """
    a = found.select(key, F.col("bytes").alias("fb"), F.col("sha256").alias("fs"), F.lit(1).alias("f"))
    b = published.select(key, F.col("bytes").alias("pb"), F.col("sha256").alias("ps"), F.lit(1).alias("p"))
    both = a.join(b, key, "full_outer")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("f").isNull(), F.lit("missing")),
            F.when(F.col("p").isNull(), F.lit("unexpected")),
            F.when(F.col("fs") != F.col("ps"), F.lit("digest_differs")),
            F.when(F.col("fb") != F.col("pb"), F.lit("size_differs")),
            F.when(F.col("fb") == 0, F.lit("zero_bytes")),
        )
    )
    return both.select(key, F.explode(kinds).alias("kind"))


def duplicate_digests(found: DataFrame, key: str = "name") -> DataFrame:
    """Digests carried by more than one file.

    Names are summarised, not gathered: a digest may be shared by a large part of all files.
    """
    return (
        found.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("n_files"), F.min(key).alias("first_name"))
        .where("n_files > 1")
    )


def incomplete_families(found: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Families without a file for every needed role."""
    held = found.where(F.col("role").isin(list(needed)))
    have = held.groupBy("family").agg(F.count_distinct("role").alias("n_roles"))
    every = found.select("family").distinct()
    return every.join(have, "family", "left").na.fill(0, ["n_roles"]).where(F.col("n_roles") < len(needed))


def nominal_sizes(found: DataFrame, nominal: DataFrame, key: str = "name") -> DataFrame:
    """Files whose size is not the one that was fixed beforehand; ``nominal`` is ``(name, bytes)``."""
    fixed = nominal.select(key, F.col("bytes").alias("nominal"))
    return found.join(fixed, key).where(~F.col("bytes").eqNullSafe(F.col("nominal"))).select(key, "bytes", "nominal")


def role_counts(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Roles that do not have the expected number of files; ``counts`` is ``(role, n_files)``."""
    held = found.groupBy("role").agg(F.count(F.lit(1)).alias("n_found"))
    both = counts.join(held, "role", "full_outer").na.fill(0, ["n_found"])
    return both.where(~F.col("n_files").eqNullSafe(F.col("n_found"))).select("role", "n_files", "n_found")


def reconcile_status(
    violations: DataFrame, found: DataFrame | None = None, needed: Sequence[str] = (),
    nominal: DataFrame | None = None, counts: DataFrame | None = None, key: str = "name",
) -> DataFrame:
    """One row: violations per kind and the overall status.

    With ``found`` repeated digests count, with ``needed`` roles families that lack one, with ``nominal``
    sizes other than those fixed beforehand, and with ``counts`` roles with another number of files.
    """
    kinds = ["missing", "unexpected", "digest_differs", "size_differs", "zero_bytes"]
    row = violations.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    more = {}
    if found is not None:
        more["duplicate_digest"] = duplicate_digests(found, key)
        if needed:
            more["incomplete_family"] = incomplete_families(found, needed)
        if nominal is not None:
            more["nominal_differs"] = nominal_sizes(found, nominal, key)
        if counts is not None:
            more["role_count_differs"] = role_counts(found, counts)
    for kind, rows in more.items():
        row = row.crossJoin(rows.agg(F.count(F.lit(1)).alias(f"n_{kind}")))  # one row each
    total = sum((F.col(f"n_{k}") for k in [*kinds, *more]), F.lit(0))
    return row.withColumn("status", F.when(total == 0, "MATCH").otherwise("MISMATCH"))


def verify_bound(found: DataFrame, sealed: DataFrame, root: str | None = None) -> DataFrame:
    """Sealed files that changed, vanished, or lie outside ``root``."""
    cols = ["path", "bytes", "sha256"]
    changed = sealed.select(*cols).join(found.select(*cols), cols, "left_anti").select(
        "path", F.lit("changed_or_missing").alias("reason")
    )
    if root is None:
        return changed
    inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").contains("/../")
    outside = sealed.where(~inside).select("path", F.lit("outside_root").alias("reason"))
    return changed.unionByName(outside)


# ------------------------------------------------------------------------------ shape gates


def check_columns(df: DataFrame, expected: T.StructType) -> list[str]:
    """Differences between a table's schema and a contract; reads no rows."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    out = [f"missing {n}" for n in want if n not in have]
    out += [f"unexpected {n}" for n in have if n not in want]
    out += [f"{n} is {have[n]}, not {t}" for n, t in want.items() if n in have and have[n] != t]
    return out


def check_groups(meta: DataFrame, expected: DataFrame, key: str, shape: Sequence[str]) -> DataFrame:
    """Groups that are missing, unexpected, or whose shape columns differ from the contract."""
    a = meta.select(key, F.struct(*shape).alias("found"))
    b = expected.select(key, F.struct(*shape).alias("wanted"))
    both = a.join(b, key, "full_outer")
    reason = (
        F.when(F.col("found").isNull(), "missing")
        .when(F.col("wanted").isNull(), "unexpected")
        .when(~F.col("found").eqNullSafe(F.col("wanted")), "shape_differs")
    )
    return both.select(key, reason.alias("reason")).where("reason is not null")


def check_rows(
    rows: DataFrame, vectors: Sequence[str], width: int, per_group: int | None, by: Sequence[str]
) -> DataFrame:
    """Per group: wrong lengths, non-finite rows and a wrong row count; only bad groups are listed."""
    short = F.lit(False)
    wild = F.lit(False)
    for v in vectors:
        short = short | F.coalesce(F.size(v) != width, F.lit(True))
        wild = wild | F.coalesce(not_finite(doubles(v)), F.lit(True))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(short).alias("n_bad_length"),
        F.count_if(wild).alias("n_not_finite"),
    )
    wrong = (F.col("n_bad_length") > 0) | (F.col("n_not_finite") > 0)
    if per_group is not None:
        wrong = wrong | (F.col("n_rows") != per_group)
    return out.where(wrong)


def check_cells(traces: DataFrame, arms: DataFrame, seeds: DataFrame, by: Sequence[str] = ("arm", "seed")) -> DataFrame:
    """Cells of the arm × seed grid that are absent, unexpected, repeated or not good.

    ``traces`` is ``(arm, seed, converged, finite, sha256)``. The arms are a short list and are
    unrolled next to each seed.
    """
    names = [r["arm"] for r in arms.select("arm").distinct().limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 arms")
    grid = seeds.select(
        F.explode(F.array(*[F.lit(a) for a in names])).alias("arm"), "seed", F.lit(1).alias("want")
    )
    have = traces.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and("converged").alias("converged"),
        F.bool_and("finite").alias("finite"),
        F.count_if(F.col("sha256").isNull()).alias("n_without_digest"),
    )
    reason = (
        F.when(F.col("n").isNull(), "absent")
        .when(F.col("want").isNull(), "unexpected")
        .when(F.col("n") > 1, "repeated")
        .when(~F.coalesce("converged", F.lit(False)), "not_converged")
        .when(~F.coalesce("finite", F.lit(False)), "not_finite")
        .when(F.col("n_without_digest") > 0, "no_digest")
    )
    return grid.join(have, list(by), "full_outer").select(*by, reason.alias("reason")).where("reason is not null")


def check_index_set(sets: DataFrame, order: DataFrame, k: DataFrame, by: Sequence[str]) -> DataFrame:
    """Index sets that break a rule: size, repetition, range, or not the head of the gain order.

    ``sets`` is ``(*by, pos, j)``, ``order`` is ``(*by, rank, j)``, ``k`` is ``(*by, k)``.
    """
    by = list(by)
    head = order.select(*by, F.col("rank").alias("pos"), F.col("j").alias("want"))
    width = order.groupBy(*by).agg(F.count(F.lit(1)).alias("width"))
    seen = sets.join(head, [*by, "pos"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("j").alias("n_distinct"),
        F.min("j").alias("low"),
        F.max("j").alias("high"),
        F.count_if(~F.col("j").eqNullSafe(F.col("want"))).alias("n_off_order"),
    )
    reason = (
        F.when(F.col("n").isNull(), "empty")
        .when(F.col("n_distinct") != F.col("n"), "repeated")
        .when(F.col("low") < 0, "negative")
        .when(F.col("high") >= F.col("width"), "out_of_range")
        .when(F.col("n") != F.col("k"), "wrong_size")
        .when(F.col("n_off_order") > 0, "not_the_order_head")
    )
    return k.join(seen, by, "left").join(width, by, "left").select(*by, reason.alias("reason")).where("reason is not null")


# ---------------------------------------------------------------------------------- digests

_DTYPES = {"float32": "<f4", "float64": "<f8", "int32": "<i4", "int64": "<i8"}


def array_digest(df: DataFrame, col: str, dtype: str = "float32", output: str = "sha256") -> DataFrame:
    """Append the sha256 of a vector's little-endian bytes; null for a null vector.

    The bytes of a batch are one buffer with the rows' offsets, hashed in the JVM.
    """
    code = np.dtype(_DTYPES[dtype])
    schema = T.StructType([*df.schema.fields, T.StructField("_bytes", T.BinaryType())])

    def pack(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(col))
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("null element in a vector")
            values = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), dtype=code)
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            at = np.append(0, np.cumsum(sizes)) * code.itemsize
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())
            if lists.null_count:
                held = pc.if_else(lists.is_valid(), held, pa.scalar(None, pa.binary()))
            yield append(batch, {"_bytes": held})

    return df.mapInArrow(pack, schema).withColumn(output, F.sha2("_bytes", 256)).drop("_bytes")


def collection_digest(df: DataFrame, col: str, order: str, dtype: str = "float32", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_keys, root)``: the index tree over the digests of all vectors, at the places ``order``.

    One hash over all bytes would be serial; this one is not, so the two differ in value.
    """
    rows = array_digest(df.select(*by, order, col), col, dtype, "_sha")
    if not by:
        rows, by = rows.withColumn("role", F.lit("all")), ["role"]
    return index_digest(rows, "_sha", by, order)


# ------------------------------------------------------------------------- record comparison


def flat_records(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, path, value)`` with one row per leaf of the remaining columns."""
    leaves: list[tuple[str, str]] = []

    def walk(schema: T.StructType, path: str, shown: str) -> None:
        for f in schema:
            inner = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            label = f"{shown}.{f.name}" if shown else f.name
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, inner, label)
            else:
                leaves.append((label, inner))

    walk(T.StructType([f for f in df.schema if f.name not in key]), "", "")
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("path"),
                    (F.to_json(F.struct(F.col(c).alias("v"))) if _nested(df, c) else F.col(c).cast("string")).alias("value"),
                )
                for label, c in leaves
            ]
        )
    )
    return df.select(*key, cells.alias("_c")).select(*key, "_c.path", "_c.value")


def _nested(df: DataFrame, col: str) -> bool:
    return isinstance(df.select(col).schema[0].dataType, (T.ArrayType, T.MapType))


def diff_records(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, path, left, right)`` for every leaf that differs, missing leaves included."""
    left = a.select(*key, "path", F.col("value").alias("left"), F.lit(1).alias("_a"))
    right = b.select(*key, "path", F.col("value").alias("right"), F.lit(1).alias("_b"))
    both = left.join(right, [*key, "path"], "full_outer")
    same = F.col("left").eqNullSafe(F.col("right")) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.where(~same).drop("_a", "_b")


def first_difference(differences: DataFrame, key: Sequence[str]) -> DataFrame:
    """The first differing leaf of each record in path order."""
    return differences.groupBy(*key).agg(
        F.min("path").alias("path"), F.count(F.lit(1)).alias("n_differences")
    )


def changed_after_seal(sealed: DataFrame, current: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sealed leaves whose current value differs or is gone; later additions are allowed."""
    left = sealed.select(*key, "path", F.col("value").alias("sealed"))
    right = current.select(*key, "path", F.col("value").alias("current"))
    return left.join(right, [*key, "path"], "left").where(~F.col("sealed").eqNullSafe(F.col("current")))


def check_chain(stages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Stages whose predecessor is absent, not complete, or ran under another protocol digest.

    ``stages`` is ``(*by, position, stage, status, protocol_sha256)`` with positions from 0. Each
    stage meets its predecessor by an equi-join on the position, so a long chain is not one task.
    """
    keys = [*by, "position"]
    before = stages.select(
        *by, (F.col("position") + 1).alias("position"), F.struct("status", "protocol_sha256").alias("_b")
    )
    reason = F.when(
        F.col("position") > 0,
        F.when(F.col("_b").isNull(), "no_predecessor")
        .when(F.col("_b.status") != "COMPLETE", "predecessor_not_complete")
        .when(F.col("_b.protocol_sha256") != F.col("protocol_sha256"), "protocol_differs"),
    )
    return stages.join(before, keys, "left").withColumn("reason", reason).where("reason is not null").select(
        *keys, "stage", "reason"
    )


def check_paired(
    traces: DataFrame, a: str, b: str, cols: Sequence[str], by: Sequence[str] = ("seed",)
) -> DataFrame:
    """``(*by, col)`` for control columns on which two arms differ, or that one arm lacks."""
    left = traces.where(F.col("arm") == a).select(*by, F.struct(*cols).alias("_l"))
    right = traces.where(F.col("arm") == b).select(*by, F.struct(*cols).alias("_r"))
    both = left.join(right, list(by), "full_outer")
    kinds = F.array_compact(
        F.array(*[F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in cols])
    )
    return both.select(*by, F.explode(kinds).alias("col"))
