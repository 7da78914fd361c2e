"""Merkle manifest of a table: one leaf per row, a tree per group, a tree over the groups' roots.

The rows of a group stand in key order. On every level each run of ``fan`` consecutive nodes is one
parent, the last run may be shorter, until one node is left: the group's subroot. Subroots in group
order grow to the root by the same rule.

A level is a window: columns that lag and lead by fixed offsets, masked by the node's slot in its run
and by the length of the run, are its siblings, and the row of a run's first child hashes the parent.
Rows do not move between the levels of a block of ``fan ** depth`` leaves, so a window holds one block
and never a group. The heads of the blocks are a table ``fan ** depth`` times smaller, on which the
same step runs again.

Defined cases: a null in any column is the field ``-``, apart from empty text; a null key comes first
and a null group is the first group; rows with one key stand in the order of their leaves, so repeated
rows have equal leaves in neighbouring places; texts of any length are hashed whole; an empty table
gives no rows; columns that are not named are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.functions.ranking import ordered_position
from fieldgauge.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 2
# Leaves of a block: FAN ** DEPTH, so that a block stays in the memory of a window.
DEPTH = 10
_STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """A value with its length in front, or ``-``: no two rows share the concatenation of their fields."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to when it is hashed with the siblings of the path."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(path: Column) -> Column:
    """All siblings from the leaf to the root, left to right on each level, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with their 0-based ``pos`` in the group ``g`` by (key, leaf), and the group's size ``n``.

    A range partitioning over all three columns keeps every task equal, also when one group or one key
    has most rows; the places inside the written files then only need the sizes of the files before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, "g", "key", "h").sortWithinPartitions("g", "key", "h")
    here = cut(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "leaves")
    runs = here.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "g", "_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(Window.partitionBy("g")).alias("n"),
    )
    return here.join(runs, ["g", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_start")).drop("_at", "_part", "_first", "_start")


def _levels(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """Add ``block``, the head's hash ``up`` and a step ``s0 … s(depth-1)`` per level to the rows of a block.

    A row carries a node of level l where its place is a multiple of ``fan ** l``.
    """
    size = fan**depth
    block = Window.partitionBy("g", "block").orderBy("pos")
    rows = nodes.withColumn("block", F.floor(F.col("pos") / size)).withColumn("up", F.col("h"))
    for level in range(depth):
        wide = fan**level
        index = F.floor(F.col("pos") / wide)
        slot = index % fan
        count = F.ceil(F.col("n") / wide)
        run = F.least(F.lit(fan), count - (index - slot))
        none = F.lit("")
        left = F.concat(*[F.when(slot >= j, F.lag("up", j * wide).over(block)).otherwise(none) for j in range(fan - 1, 0, -1)])
        right = F.concat(*[F.when(slot + j < run, F.lead("up", j * wide).over(block)).otherwise(none) for j in range(1, fan)])
        node = (F.col("pos") % wide == 0) & (count > 1)
        rows = rows.select("*", F.when(node, F.struct(left.alias("left"), right.alias("right"))).alias(f"s{level}"))
        parent = F.when(slot == 0, digest(F.col("up"), F.col(f"s{level}.right")))
        up = F.when(count > 1, F.when(node, parent)).otherwise(F.col("up"))
        rows = rows.select(*[c for c in rows.columns if c != "up"], up.alias("up"))
    return rows


def _climb(nodes: DataFrame, most: int, close: Callable[[DataFrame], DataFrame], fan: int, deepest: int) -> DataFrame:
    """``nodes`` ``(g, pos, n, h, …)`` with the ``path`` above them and what ``close`` adds to the last node of a group."""
    if most <= 1:
        return close(nodes)
    depth = min(deepest, next(d for d in itertools.count(1) if fan**d >= most))
    size = fan**depth
    rows = _levels(nodes, fan, depth)
    heads = rows.where(F.col("pos") % size == 0).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("up").alias("h"))
    above = _climb(cut(heads, "heads"), -(-most // size), close, fan, deepest)
    above = above.drop("h", "n").withColumnsRenamed({"pos": "block", "path": "_above"})
    # the steps of a row are those of the nearest rows before it that carry its nodes
    upto = Window.partitionBy("g", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"s{level}", ignorenulls=True).over(upto).alias(f"s{level}") for level in range(depth)]
    held = rows.select(*nodes.columns, "block", *steps)
    path = F.filter(F.array(*[f"s{level}" for level in range(depth)]), lambda s: s.isNotNull())
    return held.join(above, ["g", "block"]).withColumn("path", F.concat(path, "_above")).drop("block", "_above", *[f"s{level}" for level in range(depth)])


def build(leaves: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """``leaves`` ``(g, key, h, …)`` with ``path`` (array of (left, right) siblings to the root), ``subroot`` and ``root``.

    ``g`` must not be null and its byte order is the order of the groups.
    """
    if fan < 2 or depth < 1:
        raise ValueError("a tree needs fan >= 2 and depth >= 1")
    nodes = _placed(leaves)
    sizes = nodes.groupBy("g").agg(F.first("n").alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("groups")).first()

    def end(tops: DataFrame) -> DataFrame:
        return tops.withColumn("path", F.array().cast(f"array<{_STEP}>")).withColumn("root", F.col("h"))

    def over_groups(tops: DataFrame) -> DataFrame:
        held = cut(tops.select("g", "h"), "subroots")
        ranked = ordered_position(held, [], "g", "pos", n=sizes["groups"])
        top = ranked.select(F.lit("").alias("g"), "pos", F.lit(sizes["groups"]).cast("bigint").alias("n"), "h", F.col("g").alias("_g"))
        joined = _climb(top, sizes["groups"], end, fan, depth).select(F.col("_g").alias("g"), F.col("h").alias("subroot"), "path", "root")
        return tops.join(joined, "g")

    return _climb(nodes, sizes["most"] or 0, over_groups, fan, depth).drop("n", "pos")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", claimed: dict[str, Column] | None = None, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """``key, leaf, claim, path, subroot, root`` for every row.

    ``claimed`` replaces fields by what somebody says they are; ``claim`` is the leaf of that row, equal
    to ``leaf`` where nothing differs. ``fold(claim, path) == root`` verifies it.
    """
    told = {name: F.col(f"`{name}`") for name in fields}
    g = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(
        g.alias("g"), F.col(key).alias("key"), leaf(list(told.values())).alias("h"),
        leaf(list((told | (claimed or {})).values())).alias("claim"),
    )
    rows = rows.withColumn("claim", F.when(F.col("claim") != F.col("h"), F.col("claim")))
    built = build(cut(rows, "digests"), fan, depth)
    return built.select(F.col("key").alias(key), F.col("h").alias("leaf"), F.coalesce("claim", "h").alias("claim"), "path", "subroot", "root")
