"""Exact near-duplicate vectors by a dual traversal of cover trees.

Equal vectors are counted and kept once. The upper tree divides the distinct vectors: a cell above the
size of a block is dealt to the nearest of a few pivots of its own, level by level, until every cell is a
block. In each block nested levels with halving radii are built: a vector belongs at every level to a
centre within that level's radius. The upper tree is walked against itself from the top; a pair of
nodes is followed only if their balls come nearer than the threshold, so blocks that are far apart never
meet. Then the trees of two near blocks are walked together: a pair of nodes is dropped if the distance
of the centres exceeds the sum of both covering radii and the threshold, taken whole if even the farthest
members are near enough, and opened otherwise. A task gives, per vector, the number of links and the
root of a spanning star; no pair leaves it.

The work between blocks is exact and therefore, on vectors without any structure, quadratic in the
number of distinct vectors; it falls with the share of node pairs the bounds can drop.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different length do not link; repeated rows are counted as vectors of their own; rows
of one id with different vectors have the links and the component of their own vector; a row without an
id is a vector like any, counted by its neighbours, but never names a component, so that a component
without any id has a null name and keeps all its rows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.llm.components import components, hook
from fieldgauge.session import cut

BLOCK = 4096
FAN = 16
SLACK = 1e-9
TILE = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors, too large by rounding at most."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0)) + 1e-8


def radius_of(cosine: float) -> float:
    return float(np.sqrt(2.0 - 2.0 * cosine))


def spread_points(x: np.ndarray, k: int) -> list[int]:
    """``k`` rows, each the farthest from those before: the nested nets of all radii."""
    chosen, far = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)):
        i = int(far.argmax())
        chosen.append(i)
        far = np.minimum(far, distances(x, x[i : i + 1])[:, 0])
    return chosen


def net(x: np.ndarray, rows: np.ndarray, first: int, radius: float, centre: np.ndarray) -> None:
    """Give each of ``rows`` a centre within ``radius``; ``first`` stays a centre. Centres are farther apart than that."""
    rest = rows
    todo = np.concatenate([[first], rows[rows != first]])
    while len(rest):
        some = todo[:TILE]
        near = distances(x[some], x[rest]) <= radius
        open_ = np.ones(len(rest), bool)
        place = {int(r): i for i, r in enumerate(rest)}
        for k, c in enumerate(some):
            at = place.get(int(c))
            if at is None or not open_[at]:
                continue
            take = near[k] & open_
            take[at] = True
            centre[rest[take]] = c
            open_[take] = False
        rest = rest[open_]
        todo = rest


def levels(x: np.ndarray, smallest: float) -> np.ndarray:
    """Per row its centre at each level; radii halve from that of the whole block down to ``smallest``."""
    out = [np.zeros(len(x), np.int64)]
    radius = float(distances(x, x[:1]).max())
    while radius > smallest and len(np.unique(out[-1])) < len(x):
        radius /= 2
        centre = np.arange(len(x))
        order = np.argsort(out[-1], kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(out[-1][order])) + 1):
            if len(rows) > 1:
                net(x, rows, int(out[-1][rows[0]]), radius, centre)
        out.append(centre)
    return np.stack(out, axis=1)


class Tree:
    """The nodes of each level of one block, rows numbered so that every node is a run of rows."""

    def __init__(self, x: np.ndarray, near: np.ndarray):
        near = np.column_stack([near, np.arange(len(x))])  # the last level holds single rows
        self.order = np.lexsort(near.T[::-1])
        x, near = x[self.order], near[self.order]
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.x, self.begin, self.end, self.centre, self.radius, self.child = x, [], [], [], [], []
        for level in range(near.shape[1]):
            fresh = np.ones(len(x), bool)
            fresh[1:] = (near[1:, : level + 1] != near[:-1, : level + 1]).any(axis=1)
            begin = np.flatnonzero(fresh)
            end = np.append(begin[1:], len(x))
            centre = place[near[begin, level]]
            of = np.repeat(centre, end - begin)
            gap = np.sqrt(np.maximum(2.0 - 2.0 * (x * x[of]).sum(axis=1), 0.0)) + 1e-8
            gap[of == np.arange(len(x))] = 0.0
            self.begin.append(begin), self.end.append(end), self.centre.append(centre)
            self.radius.append(np.maximum.reduceat(gap, begin))
        for level in range(len(self.begin) - 1):
            self.child.append(np.append(np.searchsorted(self.begin[level + 1], self.begin[level]), len(self.begin[level + 1])))
        self.depth = len(self.begin)


class Links:
    """Link counts of the rows of two blocks, and stars of what hangs together."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))
        self.sum = np.append(0, np.cumsum(weight))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.root = hook(self.root, i, j)


def traverse(left: Tree, right: Tree, threshold: float, links: Links, shift: int, same: bool) -> None:
    """Walk two trees; rows of ``right`` are numbered from ``shift`` in ``links``. With ``same`` both are one tree."""
    far = radius_of(threshold)
    pairs = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    for level in range(1, max(left.depth, right.depth)):
        la, lb = min(level, left.depth - 1), min(level, right.depth - 1)
        down_a = left.child[la - 1] if level < left.depth else None
        down_b = right.child[lb - 1] if level < right.depth else None
        last = la == left.depth - 1 and lb == right.depth - 1
        found = []
        for a, bs in pairs:
            kids_a = a if down_a is None else np.arange(down_a[a[0]], down_a[a[0] + 1])
            kids_b = bs if down_b is None else np.concatenate([np.arange(down_b[b], down_b[b + 1]) for b in bs])
            for t in range(0, len(kids_a), TILE):
                some = kids_a[t : t + TILE]
                dots = left.x[left.centre[la][some]] @ right.x[right.centre[lb][kids_b]].T
                gap = np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))
                both = left.radius[la][some][:, None] + right.radius[lb][kids_b][None, :]
                alone = both == 0.0
                near = np.where(alone, dots >= threshold, gap <= far + both + SLACK + 1e-8)
                whole = near & (alone | (gap + both + SLACK + 1e-8 <= far))
                _take(left, right, la, lb, some, kids_b, whole, links, shift, same)
                near &= ~whole
                if not last:
                    for r in np.flatnonzero(near.any(axis=1)):
                        found.append((some[r : r + 1], kids_b[near[r]]))
        pairs = found


def _take(left, right, la, lb, some, kids_b, whole, links, shift, same) -> None:
    """All members of these node pairs are linked."""
    r, c = np.nonzero(whole)
    if not len(r):
        return
    a, b = some[r], kids_b[c]
    a0, a1, b0, b1 = left.begin[la][a], left.end[la][a], right.begin[lb][b] + shift, right.end[lb][b] + shift
    add = np.zeros(len(links.count) + 1, np.int64)
    weigh = links.sum[b1] - links.sum[b0]
    np.add.at(add, a0, weigh), np.subtract.at(add, a1, weigh)
    if not same:  # in one tree every pair of nodes is met from both ends
        weigh = links.sum[a1] - links.sum[a0]
        np.add.at(add, b0, weigh), np.subtract.at(add, b1, weigh)
    links.count += np.cumsum(add[:-1])
    links.join(a0, b0)
    for begin, n in ((a0, a1 - a0), (b0, b1 - b0)):  # members of a node hang on its first row
        big = n > 1
        if big.any():
            begin, n = np.unique(np.stack([begin[big], n[big]]), axis=1)
            first = np.repeat(begin, n)
            links.join(first, first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n))


def block_links(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """``id, links, root`` of the rows of one pair of blocks (or of one block with itself)."""
    sides = []
    for _, side in rows.groupby("block", sort=True):
        side = side.sort_values("place")
        sides.append((side, Tree(unit(np.stack(side["embedding"].to_numpy())), np.stack(side["near"].to_numpy()))))
    keys = np.concatenate([s["id"].to_numpy()[t.order] for s, t in sides])
    weight = np.concatenate([s["n"].to_numpy()[t.order] for s, t in sides])
    links = Links(weight)
    same = len(sides) == 1
    traverse(sides[0][1], sides[-1][1], threshold, links, 0 if same else len(sides[0][0]), same)
    count = links.count - weight if same else links.count  # every row meets itself
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, links.root, keys)
    out = pd.DataFrame({"id": keys, "links": count, "root": least[links.root]})
    return out[out["links"] > 0]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, n_links, component_id, kept`` for every row."""
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    good = F.coalesce(
        (F.size(v) > 0)
        & F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
        & F.exists(v, lambda e: e != 0.0),
        F.lit(False),
    )
    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"), F.when(good, v).alias("embedding"),
    ).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    # a class of equal vectors goes by a number of its own, whatever ids its rows have
    classes = rows.where("embedding IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
    )
    distinct = cut(classes.select(F.monotonically_increasing_id().alias("id"), "*", F.size("embedding").alias("width")), "vectors")
    per_width = {r["width"]: r["n"] for r in distinct.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = None
    for width, n in sorted(per_width.items()):
        part = _links(distinct.where(F.col("width") == width).select("id", "n", "embedding"), n, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "id bigint, links bigint, root bigint")
    found = cut(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found, "id", "root").withColumnRenamed("node", "id")
    joined = distinct.select("h1", "h2", "id", "n", "least").join(counts, "id", "left").join(named, "id", "left")
    joined = cut(joined.withColumn("component", F.coalesce("component", "id")), "classes")
    # the name of a component is the smallest id of any of its rows
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = joined.join(smallest, "component").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    ).where("n_links > 0")
    out = rows.select("id", "h1", "h2", F.col("embedding").isNull().alias("bad")).join(per_class, ["h1", "h2"], "left")
    component = F.when(F.col("bad"), F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(key), F.when(F.col("bad"), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), component.isNull()).alias("kept"),
    )


def _upper_levels(distinct: DataFrame, n: int, block: int, fan: int) -> DataFrame:
    """``distinct`` with its ``cell``: vectors go to the nearest pivot of their cell, level by level, until no cell is above ``block``.

    A level samples every cell that is too large, by hash, takes up to ``fan`` pivots of it, half of them
    each the farthest from those before, and moves each vector to the nearest pivot of its own cell; pivots
    meet vectors by a join on the cell, so a task holds those of the cells it meets only. A cell of which
    nine tenths stay together holds vectors that are about equally far apart and stays as it is.
    """
    placed = cut(distinct.select("id", "n", "embedding", F.lit("").alias("cell"), F.lit(n).cast("bigint").alias("m"), F.lit(0).alias("still")), "cells")
    while True:
        large = placed.where((F.col("m") > block) & (F.col("still") == 0))
        sizes = large.groupBy("cell").agg(F.max("m").alias("m"))
        if sizes.limit(1).count() == 0:
            return placed
        ranked = large.where(F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.floor(F.col("m") / (4 * fan)))) == 0)

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id").iloc[: 16 * fan]  # a sample of about 4·fan vectors
            x = unit(np.stack(pdf["embedding"].to_numpy()))
            m = int(pdf["m"].iloc[0])
            k = min(fan, m // block + 1)
            at = sorted({*spread_points(x, -(-k // 2)), *range(min(k // 2, len(x)))})
            return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "pivots": [x[at].ravel()]})

        pivots = ranked.groupBy("cell").applyInPandas(choose, "cell string, pivots array<double>")

        def move(batches):
            for b in batches:
                if not len(b):
                    continue
                cell = b["cell"].to_numpy().astype(object)
                x = unit(np.stack(b["embedding"].to_numpy()))
                for name, at in b.groupby("cell").indices.items():
                    p = b["pivots"].iloc[at[0]]
                    if p is None:  # no vector of the cell was sampled
                        continue
                    near = distances(x[at], np.asarray(p).reshape(-1, x.shape[1])).argmin(axis=1)
                    cell[at] = [f"{name}/{c}" for c in near]
                yield b[["id", "n", "embedding"]].assign(cell=cell, old=b["cell"], was=b["m"])

        moved = large.join(pivots, "cell", "left").select("id", "n", "embedding", "cell", "m", "pivots").mapInPandas(
            move, "id bigint, n bigint, embedding array<double>, cell string, old string, was bigint"
        )
        moved = cut(moved, "moved")
        counts = moved.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
        fresh = moved.join(counts, "cell").select("id", "n", "embedding", "cell", "m", (F.col("m") > 0.9 * F.col("was")).cast("int").alias("still"))
        rest = placed.where(~((F.col("m") > block) & (F.col("still") == 0)))
        placed = cut(rest.unionByName(fresh), "cells")


def _near_blocks(roots: DataFrame, far: float, fan: int) -> DataFrame:
    """``(a, b)`` with a <= b: the blocks whose balls come within ``far``, by walking the upper tree against itself.

    A node of the tree is a prefix of a cell's path; its ball is about one of its blocks and covers all of
    them. From the top down a pair of nodes stays if its balls come near, and only then meets its children.
    """
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, e: acc + e)

    def gap(p, q):
        cosine = dot(p, q) / F.sqrt(dot(p, p) * dot(q, q))
        return F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * cosine, F.lit(0.0)))

    steps = F.split("cell", "/")  # the first step is empty: the root
    depth = roots.agg(F.max(F.size(steps))).first()[0] or 1
    prefix = [F.concat_ws("/", F.slice(steps, 1, at)) for at in range(1, depth + 1)]
    names = [*prefix, F.concat(F.col("cell"), F.lit("#"), F.col("block").cast("string"))]
    pairs = None
    for at, name in enumerate(names):
        tagged = roots.select(name.alias("node"), (names[at - 1] if at else F.lit("")).alias("up"), "block", "embedding", "ball")
        centre = tagged.groupBy("node", "up").agg(F.min_by("embedding", "block").alias("centre"))
        reach = tagged.join(centre.select("node", "centre"), "node").groupBy("node").agg(F.max(gap(F.col("embedding"), F.col("centre")) + F.col("ball")).alias("radius"))
        nodes = cut(centre.join(reach, "node"), "nodes")
        side = lambda s: nodes.select(F.col("node").alias(s), F.col("up").alias(f"up_{s}"), F.col("centre").alias(f"x{s}"), F.col("radius").alias(f"r{s}"))  # noqa: E731, B023
        if pairs is None:
            pairs = side("a").join(side("b"), F.col("up_a") == F.col("up_b"))  # the one root with itself
        else:
            both = pairs.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"))
            pairs = both.join(side("a"), "up_a").join(side("b"), "up_b")
        near = gap(F.col("xa"), F.col("xb")) <= F.col("ra") + F.col("rb") + far + 1e-6
        # a pair of one parent with itself meets its children both ways round: keep one
        pairs = cut(pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    number = lambda c: F.element_at(F.split(c, "#"), -1).cast("long")
    one, two = number("a"), number("b")
    return pairs.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


def _links(distinct: DataFrame, n: int, threshold: float, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``id, links, root`` partial sums over all pairs of blocks that may hold a link."""
    far = radius_of(threshold)
    placed = _upper_levels(distinct, n, block, fan)
    # a cell that no pivot could divide is dealt by hash
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / block))
    placed = placed.select("id", "n", "embedding", F.xxhash64("cell", part).alias("block"), F.col("cell"))

    def build(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id").reset_index(drop=True)
        x = unit(np.stack(b["embedding"].to_numpy()))
        near = levels(x, far / 8)
        return pd.DataFrame({
            "block": b["block"], "place": np.arange(len(b)), "id": b["id"], "n": b["n"], "embedding": b["embedding"],
            "near": list(near), "ball": float(distances(x, x[:1]).max()), "cell": b["cell"],
        })

    schema = "block bigint, place int, id bigint, n bigint, embedding array<double>, near array<bigint>, ball double, cell string"
    trees = cut(placed.groupBy("block").applyInPandas(build, schema), "trees")
    pairs = _near_blocks(cut(trees.where("place = 0").select("block", "embedding", "ball", "cell"), "roots"), far, fan)
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    held = sides.join(trees.select("block", "place", "id", "n", "embedding", "near"), "block")
    return held.groupBy("a", "b").applyInPandas(lambda rows: block_links(rows, threshold), "id bigint, links bigint, root bigint")
