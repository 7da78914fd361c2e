"""Partial sums of vectors and matrices: one small record per task, then an ordinary shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.functions.arrow import group_codes, to_lists, to_matrix

GROUPS_PER_TASK = 1024


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def vector_sums(
    df: DataFrame,
    vectors: Sequence[str],
    by: Sequence[str],
    outputs: Sequence[str],
    fn: Callable[..., Sequence[np.ndarray]],
) -> DataFrame:
    """Sum per-row vectors inside each group.

    ``fn`` maps the matrices of ``vectors`` to one ``[rows, r]`` matrix per output. Returns long
    rows ``(*by, n, j, *outputs)`` holding sums over all rows. Each task emits one record per group
    and flushes when it holds many groups, so memory does not follow the number of groups.
    """
    by, vectors, outputs = list(by), list(vectors), list(outputs)
    schema = ", ".join(
        [f"`{c}` {_type(df, c)}" for c in by]
        + ["n bigint"]
        + [f"`{o}` array<double>" for o in outputs]
    )

    def emit(held, template):
        keys = list(held)
        arrays = [
            pa.array([k[i] for k in keys], type=template[i]) for i in range(len(by))
        ]
        arrays.append(pa.array([held[k][0] for k in keys], type=pa.int64()))
        for o in range(len(outputs)):
            arrays.append(to_lists(np.vstack([held[k][1][o] for k in keys])))
        return pa.RecordBatch.from_arrays(arrays, names=[*by, "n", *outputs])

    def run(batches):
        held: dict = {}
        template = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            mats = [to_matrix(batch.column(batch.schema.get_field_index(v))) for v in vectors]
            results = fn(*mats)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in by]
            template = [c.type for c in cols]
            keys, codes = group_codes(cols, batch.num_rows)
            counts = np.bincount(codes, minlength=len(keys))
            if len(keys) > 1:
                order = np.argsort(codes, kind="stable")
                cuts = np.searchsorted(codes[order], np.arange(len(keys)))
                summed = [np.add.reduceat(m[order], cuts, axis=0) for m in results]
            else:
                summed = [m.sum(axis=0, keepdims=True) for m in results]
            for at, key in enumerate(keys):
                vecs = [s[at] for s in summed]
                if key in held:
                    old = held[key]
                    held[key] = (
                        old[0] + int(counts[at]),
                        [a + b for a, b in zip(old[1], vecs)],
                    )
                else:
                    held[key] = (int(counts[at]), vecs)
            if len(held) >= GROUPS_PER_TASK:
                yield emit(held, template)
                held = {}
        if held:
            yield emit(held, template)

    parts = df.select(*by, *vectors).mapInArrow(run, schema)
    zipped = F.arrays_zip(*[F.col(o) for o in outputs])
    return (
        parts.select(*by, "n", F.posexplode(zipped).alias("j", "_v"))
        .select(*by, "n", "j", *[F.col(f"_v.{o}").alias(o) for o in outputs])
        .groupBy(*by, "j")
        .agg(F.sum("n").alias("n"), *[F.sum(o).alias(o) for o in outputs])
    )


def add_blocks(
    parts: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    merge: Callable[[dict, dict], dict] | None = None,
    tasks: int | None = None,
    fan_in: int = 64,
    count: int | None = None,
) -> DataFrame:
    """Add matrix blocks that share ``keys``; ``n`` is added along with them.

    Blocks of one key are streamed through a task and never held together. Large inputs pass a
    salted level first so that no key receives the blocks of every task. ``merge`` replaces the
    plain addition of two records ``{"n": .., value: array}``. A task without a block costs a Python
    worker too: with ``count``, the number of different keys, there are at most its square of tasks,
    enough that two keys seldom meet in one.
    """
    keys, values = list(keys), list(values)
    spark = parts.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks or (spread if count is None else min(spread, count**2))
    schema = parts.select(*keys, "n", *values).schema
    names = [*keys, "n", *values]

    def plain(a, b):
        return {"n": a["n"] + b["n"], **{v: a[v] + b[v] for v in values}}

    join = merge or plain

    def run(batches):
        held: dict = {}
        types = None
        for batch in batches:
            types = [f.type for f in batch.schema]
            ks = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))]))
            ns = batch.column(len(keys)).to_pylist()
            for r in range(batch.num_rows):
                rec = {"n": ns[r]}
                for i, v in enumerate(values):
                    cell = batch.column(len(keys) + 1 + i)[r].values
                    rec[v] = cell.to_numpy(zero_copy_only=False).copy()
                held[ks[r]] = join(held[ks[r]], rec) if ks[r] in held else rec
        for key, rec in held.items():
            arrays = [pa.array([k], type=t) for k, t in zip(key, types)]
            arrays.append(pa.array([rec["n"]], type=pa.int64()))
            arrays += [to_lists(rec[v][None, :]) for v in values]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    level = parts.select(*names)
    if spark.sparkContext.defaultParallelism > fan_in:
        salted = level.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
        level = salted.repartition(max(tasks, min(spread, tasks * fan_in)), *keys, "_salt").drop("_salt").mapInArrow(run, schema)
    return level.repartition(tasks, *keys).mapInArrow(run, schema)
