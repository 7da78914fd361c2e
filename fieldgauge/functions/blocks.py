"""Products of a table of vectors with a matrix too large to share, on a grid of row lanes and strips.

The matrix is a table of directions cut into strips of bounded size. A cell of the grid is one strip
and one lane of the rows: the strip is copied once per lane, a row once per strip. A task holds the
strip of its cell and streams the rows past it, so its memory is one strip and one Arrow batch, and the
number of lanes follows the tasks of the cluster and not the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldgauge.functions.arrow import to_lists, to_matrix
from fieldgauge.functions.vectors import doubles
from fieldgauge.session import cut


class Strips(NamedTuple):
    """``table`` ``(strip, pos, vec)`` with ``size`` directions a strip; ``k`` directions of width ``d`` in ``count`` strips."""

    table: DataFrame
    k: int
    d: int
    size: int
    count: int


def strips(basis: DataFrame, keep: Sequence[int] | None = None, limit: int = 64 << 20, size: int | None = None) -> Strips:
    """Cut the kept directions, in the order of ``keep`` or of ``j``, into strips of ``limit`` bytes or ``size`` directions."""
    spark = basis.sparkSession
    if keep is None:
        numbers = basis.select("j").withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("j")) - 1)
    else:
        if len(set(keep)) != len(keep):
            raise ValueError("the kept set repeats a direction")
        numbers = spark.createDataFrame(pa.table({"j": pa.array([int(j) for j in keep], pa.int32()), "pos": pa.array(np.arange(len(keep)), pa.int32())}))
    rows = basis.join(numbers, "j").select("pos", doubles("vec").alias("vec"))
    row = rows.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("vec")).alias("d")).first()
    if row["k"] == 0 or (keep is not None and row["k"] != len(keep)):
        raise ValueError("the kept set is empty or names a direction the basis does not hold")
    size = size or max(1, limit // (8 * row["d"]))
    dealt = rows.select(F.floor(F.col("pos") / size).cast("int").alias("strip"), "pos", "vec")
    return Strips(dealt, row["k"], row["d"], size, -(-row["k"] // size))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once with a number ``_row`` that tells its rows apart, equal ones included."""
    return cut(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def lanes_of(df: DataFrame, count: int) -> int:
    """Row lanes beside ``count`` strips, so that the grid has about as many cells as a shuffle has tasks."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return max(1, -(-tasks // count))


def runs(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch in runs of rows that agree in the first ``columns`` (integer) columns."""
    if not batch.num_rows:
        return
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns)])
    edges = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows)
    begin = 0
    for end in edges:
        yield tuple(int(v) for v in keys[:, begin]), batch.slice(begin, end - begin)
        begin = end


def over_strips(
    df: DataFrame, carry: Sequence[str], sources: Sequence[str], matrix: Strips, schema,
    fn: Callable[..., pa.RecordBatch | None], part: bool = False, close: Callable[..., pa.RecordBatch | None] | None = None,
    lanes: int | None = None,
) -> DataFrame:
    """``fn(strip number, strip matrix, carried columns, *source matrices)`` for every batch of rows beside every strip.

    With ``part`` a cell gets only the slice of each source that belongs to its strip: sources are then
    vectors over the directions. ``close(strip number, strip matrix)`` ends a cell. ``df`` is ``numbered``.
    """
    lanes = lanes or lanes_of(df, matrix.count)
    width = len(sources)
    spread = F.explode(F.sequence(F.lit(0), F.lit(matrix.count - 1)))
    lane = F.pmod(F.xxhash64("_row"), F.lit(lanes)).cast("int")
    rows = df.select(*carry, *[doubles(s).alias(f"_v{i}") for i, s in enumerate(sources)], lane.alias("_lane"))
    rows = rows.withColumn("_strip", spread)
    if part:
        rows = rows.withColumns({f"_v{i}": F.slice(f"_v{i}", F.col("_strip") * matrix.size + 1, matrix.size) for i in range(width)})
    kinds = {c: df.schema[c].dataType for c in carry}
    rows = rows.select("_strip", "_lane", F.lit(1).alias("_kind"), F.lit(0).alias("_pos"), *[f"_v{i}" for i in range(width)], *carry)
    empty = [F.lit(None).cast("array<double>").alias(f"_v{i}") for i in range(1, width)]
    held = matrix.table.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select(
        F.col("strip").alias("_strip"), "_lane", F.lit(0).alias("_kind"), F.col("pos").alias("_pos"), F.col("vec").alias("_v0"), *empty,
        *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()],
    )
    cells = matrix.count * lanes
    dealt = held.unionByName(rows).repartition(cells, "_strip", "_lane").sortWithinPartitions("_strip", "_lane", "_kind", "_pos")

    def run(batches):
        cell, pieces, strip = None, [], None
        for batch in batches:
            for (s, lane_, kind, *_), rows_ in runs(batch, 3):
                if (s, lane_) != cell:
                    if close and strip is not None and (out := close(cell[0], strip)) is not None:
                        yield out
                    cell, pieces, strip = (s, lane_), [], None
                if kind == 0:
                    pieces.append(to_matrix(rows_.column(4)))
                    continue
                if strip is None:
                    strip, pieces = np.vstack(pieces), []
                mats = [to_matrix(rows_.column(4 + i)) for i in range(width)]
                out = fn(s, strip, rows_.select(range(4 + width, rows_.num_columns)), *mats)
                if out is not None:
                    yield out
        if close and strip is not None and (out := close(cell[0], strip)) is not None:
            yield out

    return dealt.mapInArrow(run, schema)


def add_runs(parts: DataFrame, row: str, vectors: Sequence[str]) -> DataFrame:
    """Add the vectors of each ``row`` (a long, never null), streamed in row order: ``(row, *vectors)``."""
    vectors = list(vectors)
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = parts.select(row, *vectors).repartition(tasks, row).sortWithinPartitions(row)

    def run(batches):
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            first = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
            sums = [np.add.reduceat(to_matrix(batch.column(1 + i)), first, axis=0) for i in range(len(vectors))]
            found = keys[first]
            if last is not None and found[0] == last:
                for s, h in zip(sums, held):
                    s[0] += h
            elif last is not None:
                yield record([last], [h[None] for h in held])
            if len(found) > 1:
                yield record(found[:-1], [s[:-1] for s in sums])
            last, held = int(found[-1]), [s[-1].copy() for s in sums]
        if last is not None:
            yield record([last], [h[None] for h in held])

    def record(keys, mats):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(to_lists, mats)], names=[row, *vectors])

    return ordered.mapInArrow(run, f"`{row}` bigint, " + ", ".join(f"`{v}` array<double>" for v in vectors))
