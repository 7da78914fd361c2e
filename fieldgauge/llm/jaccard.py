"""Jaccard join of texts on word shingles with Bayesian candidate pruning.

Texts with the same words are one class, counted and kept once. Classes that share one of ``BANDS``
bands of MinHash values are candidates; a link at the threshold is missed by all bands with a
probability of about 5e-8. Candidates are compared a few MinHash values at a time, and dropped as soon
as the posterior probability (uniform prior) that their similarity reaches the threshold falls below
``TOLERANCE``. What remains is verified exactly on the shingles.

No pair is written for a pair inside a group. Every bucket names its first class by hash, and every
class picks as mates the ``MATES`` that most of its buckets name; mates that pass the pruning tie
classes to groups, which are only units of work.
Inside a group all pairs are compared, block by block, and give counts of links and roots of spanning
stars. Pairs from a bucket that lie in different groups are pruned in blocks of the bucket and those
that remain, few, are verified one by one. Groups and buckets are cut into blocks of ``BLOCK``
classes, so none has to fit a task.

Defined cases: texts of fewer than five words have their words as one shingle; texts without a word,
null ones among them, link with nothing; copies count as linked; rows that share an id but not their
words are compared as one document; an empty table gives no rows; other columns are ignored. Very
long texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.llm import flat
from fieldgauge.llm.components import components, hook
from fieldgauge.session import cut

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
MATES = 3
BLOCK = 256
SHARD = 4096  # classes of small groups or buckets that share a task's group
CHUNK = 1 << 14

_RNG = np.random.Generator(np.random.PCG64(41))
_TIMES = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in text order, the first of each row (n + 1), and two hashes of each row's words."""
    starts, ends, first = flat.words(data, at)
    word = flat.slice_hash(flat.prefix_hash(data), starts, ends)
    n = np.diff(first)
    of_row = np.maximum(n - WORDS + 1, np.minimum(n, 1))
    to = np.append(0, np.cumsum(of_row))
    row = np.repeat(np.arange(len(n)), of_row)
    begin = first[row] + np.arange(len(row)) - to[row]
    key = np.full(len(row), 0x51, np.uint64)
    for j in range(WORDS):
        inside = begin + j < first[row + 1]
        key = np.where(inside, flat.mix(key + word[np.minimum(begin + j, max(len(word) - 1, 0))]), key) if len(word) else key
    place = (np.arange(len(word)) - np.repeat(first[:-1], n) + 1).astype(np.uint64)
    whole = []
    for salt in (0x11, 0x5EED):
        total = np.append(np.uint64(0), np.cumsum(flat.mix(word ^ flat.mix(place * np.uint64(2 * salt + 1))), dtype=np.uint64))
        whole.append(flat.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64)))
    return key, to, np.stack(whole, axis=1)


def signatures(key: np.ndarray, to: np.ndarray) -> np.ndarray:
    """``HASHES`` MinHash values per row; rows without shingles stay zero."""
    out = np.zeros((len(to) - 1, HASHES), np.uint32)
    x = (key >> np.uint64(32)).astype(np.uint32)
    rows = np.flatnonzero(to[1:] > to[:-1])
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(to[rows + 1], to[rows[i]] + CHUNK, "right")))
        part = x[to[rows[i]] : to[rows[j - 1] + 1]]
        begin = to[rows[i:j]] - to[rows[i]]
        held = np.empty_like(part)
        for h in range(HASHES):
            np.multiply(part, _TIMES[h], out=held)
            np.bitwise_xor(held, _FLIP[h], out=held)
            out[rows[i:j], h] = np.minimum.reduceat(held, begin)
        i = j
    return out


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Matches a pair must have after 1, 2, … steps of ``STEP`` values to stay a candidate.

    With a uniform prior the similarity after m matches in n is Beta(m + 1, n - m + 1); its tail above
    the threshold is a binomial sum.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = lambda m: sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))  # noqa: B023, E731
        out.append(next(m for m in range(n + 1) if tail(m) >= tolerance))
    return out


def survive(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (row i of a, row j of b) stay candidates to the end."""
    live, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for k, m in enumerate(least):
        s = slice(k * STEP, (k + 1) * STEP)
        matches[live] += (a[i[live], s] == b[j[live], s]).sum(axis=1, dtype=np.int32)
        live = live[matches[live] >= m]
    return live


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    data, at = flat.texts(column)
    return np.frombuffer(data.tobytes(), kind).reshape(-1, width)


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, w1, w2, signature`` of every row that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, 1):
                k, to, whole = shingles(*flat.texts(part.column(1)))
                rows = np.flatnonzero(np.diff(to))
                sign = signatures(k, to)[rows].astype("<u4").tobytes()
                size = 4 * HASHES
                whole = whole[rows].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()),
                     pa.array([sign[i : i + size] for i in range(0, len(sign), size)], pa.binary())],
                    names=["id", "w1", "w2", "signature"],
                )

    rows = docs.select(F.col(key).cast("bigint").alias("id"), text).where("id IS NOT NULL")
    return rows.mapInArrow(run, "id bigint, w1 bigint, w2 bigint, signature binary")


def sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """``id, shingles`` (sorted distinct hashes, packed) of the documents whose id is in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, 1):
                k, to, _ = shingles(*flat.texts(part.column(1)))
                packed = [np.unique(k[a:b]).tobytes() for a, b in zip(to[:-1], to[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["id", "shingles"])

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(run, "id bigint, shingles binary").dropDuplicates(["id"])


def overlap(packed: list[bytes]) -> np.ndarray:
    """Exact similarity of all pairs of a few sets."""
    each = [np.frombuffer(p, np.uint64) for p in packed]
    size = np.array([len(e) for e in each], np.float64)
    row = np.repeat(np.arange(len(each)), size.astype(np.int64))
    _, which, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    shared = times[which] > 1
    row, which = row[shared], which[shared]
    which = (np.cumsum(times > 1) - 1)[which]
    order = np.argsort(which, kind="stable")
    row, which = row[order], which[order]
    common = np.zeros((len(each), len(each)))
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, 4096):
        a, b = np.searchsorted(which, [lo, lo + 4096])
        part = np.zeros((len(each), 4096), np.float32)
        part[row[a:b], which[a:b] - lo] = 1
        common += part @ part.T
    return common / np.maximum(size[:, None] + size[None, :] - common, 1)


def _group_links(rows: pd.DataFrame, least: list[int], threshold: float) -> pd.DataFrame:
    """Links among the rows of a group, or between two of its blocks."""
    sign = np.frombuffer(b"".join(rows["signature"]), "<u4").reshape(-1, HASHES)
    block, n = rows["block"].to_numpy(), len(rows)
    i, j = np.triu_indices(n, 1)
    if rows["one"].iat[0] != rows["two"].iat[0]:  # one of the blocks may be empty
        apart = block[i] != block[j]
        i, j = i[apart], j[apart]
    live = survive(sign, sign, i, j, least)
    i, j = i[live], j[live]
    if len(i):
        used = np.unique(np.concatenate([i, j]))
        likeness = overlap([rows["shingles"].iat[k] for k in used])
        good = likeness[np.searchsorted(used, i), np.searchsorted(used, j)] >= threshold - 1e-12
        i, j = i[good], j[good]
    weight, ids = rows["n"].to_numpy(), rows["id"].to_numpy()
    count = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
    root = hook(np.arange(n), i, j)
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, ids)
    out = pd.DataFrame({"id": ids, "links": count.astype(np.int64), "root": smallest[root]})
    return out[out["links"] > 0]


def _bucket_pairs(rows: pd.DataFrame, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket (or of two of its blocks) that lie in different groups and survive the pruning."""
    sign = np.frombuffer(b"".join(rows["signature"]), "<u4").reshape(-1, HASHES)
    group, block, ids, band = (rows[c].to_numpy() for c in ("group", "block", "id", "band"))
    i, j = np.triu_indices(len(rows), 1)
    apart = group[i] != group[j]
    if rows["one"].iat[0] != rows["two"].iat[0]:
        apart &= block[i] != block[j]
    i, j = i[apart], j[apart]
    # a pair belongs to the first band it shares
    same = (sign[i].reshape(-1, BANDS, ROWS) == sign[j].reshape(-1, BANDS, ROWS)).all(axis=2)
    own = same.argmax(axis=1) == band[0] if len(i) else np.zeros(0, bool)
    i, j = i[own], j[own]
    live = survive(sign, sign, i, j, least)
    a, b = ids[i[live]], ids[j[live]]
    return np.minimum(a, b), np.maximum(a, b)


def blocked(rows: DataFrame, unit: str, size: DataFrame) -> DataFrame:
    """Rows beside every pair of blocks they have to meet in: ``shard, one, two`` and their own ``block``.

    A unit of at most ``BLOCK`` rows is one block and shares a shard with others; a larger one is cut
    by hash, and a row is repeated once for each block of its unit.
    """
    rows = rows.join(size, unit)
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("one"), F.greatest(k, F.col("block")).alias("two")),
    )
    total = size.agg(F.sum("size")).first()[0] or 0
    shards = int(total // SHARD) + 1
    shard = F.when(parts > 1, F.col(unit)).otherwise(F.pmod(F.xxhash64(unit), F.lit(shards)))
    return rows.withColumn("shard", shard).withColumn("_p", F.explode(pairs)).select("*", "_p.one", "_p.two").drop("_p", "size")


def join(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_links, class_id`` for every row: other rows linked directly, and the smallest id reachable."""
    least = needed(threshold)
    rows = cut(describe(docs, key, text), "signatures")
    named = rows.groupBy("w1", "w2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    named = cut(named, "classes")
    classes = cut(rows.join(named.select("id", "w1", "w2", "n"), ["id", "w1", "w2"]).dropDuplicates(["id"]).select("id", "n", "signature"), "signed")

    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("signature", b * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("bucket")),
    )
    every = classes.select("id", F.inline(bands))
    order = F.xxhash64(F.lit(7), "id")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first")).where("size > 1")
    members = cut(every.join(shared, "bucket"), "members")

    told = members.groupBy("id", "first").agg(F.count(F.lit(1)).alias("times")).where(F.col("first") != order)
    ranked = F.sort_array(F.collect_list(F.struct("times", "first")), asc=False)  # at most one per band
    mates = told.groupBy("id").agg(F.slice(ranked, 1, MATES).alias("m")).select("id", F.explode("m.first").alias("first"))
    signs = classes.select("id", "signature")
    others = signs.select(order.alias("first"), F.col("id").alias("mate"), F.col("signature").alias("other"))
    both = mates.join(signs, "id").join(others, "first")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column(2), HASHES, np.dtype("<u4")), _matrix(batch.column(3), HASHES, np.dtype("<u4"))
            at = np.arange(batch.num_rows)
            yield batch.select(["id", "mate"]).take(pa.array(survive(a, b, at, at, least)))

    ties = both.select("id", "mate", "signature", "other").mapInArrow(prune, "id bigint, mate bigint")
    groups = cut(components(ties, "id", "mate").select(F.col("node").alias("id"), F.col("component").alias("group")), "groups")

    # pairs of a bucket that lie in different groups
    placed = members.select("bucket", "band", "id").join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    mixed = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("bucket", "size")
    meeting = blocked(placed, "bucket", cut(mixed, "mixed")).join(signs, "id")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        found = [_bucket_pairs(b, least) for _, b in rows.sort_values(["bucket", "block"]).groupby("bucket")]
        return pd.DataFrame({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    pairs = meeting.select("shard", "one", "two", "bucket", "band", "block", "id", "group", "signature")
    pairs = cut(pairs.groupBy("shard", "one", "two").applyInPandas(meet, "a bigint, b bigint").distinct(), "pairs")

    alone = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    held = cut(sets(docs, groups.select("id").unionByName(alone).distinct(), key, text), "sets")

    full = groups.join(classes, "id").join(held, "id")
    sizes = cut(groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "sizes")

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        parts = rows.sort_values(["group", "block", "id"]).groupby("group")
        return pd.concat([_group_links(g, least, threshold) for _, g in parts])

    inner = blocked(full, "group", sizes).select("shard", "one", "two", "group", "block", "id", "n", "signature", "shingles")
    linked = inner.groupBy("shard", "one", "two").applyInPandas(inside, "id bigint, links bigint, root bigint")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [len(np.intersect1d(x, y, assume_unique=True)) / max(1, len(np.union1d(x, y)))
                    for x, y in ((np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) for p, q in zip(batch.column(4), batch.column(5)))]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(np.array(like) >= threshold - 1e-12, pa.bool_()))

    side = held.join(classes.select("id", "n"), "id")
    across = pairs.join(side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")), "a").join(
        side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb")), "b")
    crossing = across.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(verify, "a bigint, b bigint, na bigint, nb bigint").select(F.inline(F.array(
        F.struct(F.col("a").alias("id"), F.col("nb").alias("links"), F.col("b").alias("root")),
        F.struct(F.col("b").alias("id"), F.col("na").alias("links"), F.col("a").alias("root")),
    )))
    links = cut(linked.unionByName(crossing), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    tied = components(links, "id", "root").select(F.col("node").alias("id"), "component")
    result = named.join(counts, "id", "left").join(tied, "id", "left").select(
        "w1", "w2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("class_id"),
    ).where("n_links > 0")
    per_row = rows.select("id", "w1", "w2").join(result, ["w1", "w2"]).select("id", "n_links", "class_id").dropDuplicates(["id"])
    out = docs.select(F.col(key).cast("bigint").alias("id")).join(per_row, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("class_id", "id").alias("class_id"))
