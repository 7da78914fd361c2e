"""Removal of byte passages that occur elsewhere, by suffix arrays over shards.

A passage counts from ``LENGTH`` bytes on. Every window of that length holds an anchor: the place in
it whose ``GRAM`` bytes have the least hash (the last such place). Equal windows hold equal anchors at
the same place, so windows can only meet through their anchor, and anchors that occur once in all
texts end the search for theirs. The windows around one anchor are a context, a string of a few
hundred bytes.

Contexts that occur twice or more as a whole are repeated as a whole; they are counted, never
gathered, so copied texts and shared passages cost one row each. Different contexts of one anchor go
to one shard. A shard's suffixes are sorted by induction, its permuted common prefixes computed, and
the windows whose prefix with a neighbour reaches the length are repeated. An anchor with more than
``CROWD`` different contexts does not fit a shard: its windows are counted one by one by their hash.

Matches never cross texts; they are judged on the input. Anchors and contexts meet by 64-bit hashes
(two of them where equality decides), windows in a shard by their bytes.

Defined cases: null text is empty; texts shorter than the length lose nothing; copies of a text of at
least the length lose everything; repeated rows are copies; an empty table gives no rows; other
columns are ignored. Very long texts are read whole, in one task.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.llm import flat, suffixes
from fieldgauge.session import cut

LENGTH = 200
GRAM = 24
CROWD = 4096
SHARD_BYTES = 1 << 20
ALPHABET = 256
SEPARATOR = 0xFF  # in no UTF-8 text


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    grid = np.full(rows * width, np.iinfo(keys.dtype).max, keys.dtype)
    grid[: len(keys)] = keys
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor hash and context hash of all contexts of a slice."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    prefix = flat.prefix_hash(data)
    grams = np.arange(len(data) - GRAM + 1)
    hashes = flat.slice_hash(prefix, grams, grams + GRAM)
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes & ~low) | (low - (grams.astype(np.uint64) & low))
    place = (low - (sliding_least(keys, length - GRAM + 1) & low)).astype(np.int64)
    begin = np.arange(len(place))
    last = np.repeat(at[1:], np.diff(at))[: len(place)] - length
    whole = begin <= last
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (place[1:] != place[:-1]) | (last[1:] != last[:-1])
    first = np.flatnonzero(fresh)
    if not len(first):
        return none
    row = np.searchsorted(at, first, "right") - 1
    stop = np.minimum(np.append(first[1:], len(place)), at[row + 1] - length + 1)
    hashes = hashes[place[first]]
    context = flat.mix(flat.slice_hash(prefix, first, stop - 1 + length) + np.uint64(1))
    return row, first - at[row], stop - first, hashes, context


KEYED = "t bigint, n_bytes bigint"


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """The texts with the two values that stand for a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_b": body, "_t": F.xxhash64(body), "_n": F.octet_length(body).cast("bigint")})


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """``h, c, t, n_bytes, first, windows`` of every context of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, 0):
                row, first, windows, h, c = anchors(*flat.texts(part.column(0)), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), part.column(1).take(pa.array(row)),
                     part.column(2).take(pa.array(row)), pa.array(first), pa.array(windows.astype(np.int32))],
                    names=["h", "c", "t", "n_bytes", "first", "windows"],
                )

    rows = texts.where(F.col("_n") >= length).select("_b", F.col("_t").alias("t"), F.col("_n").alias("n_bytes"))
    return rows.mapInArrow(run, f"h bigint, c bigint, {KEYED}, first bigint, windows int")


def shard_hits(rows: pa.Table, length: int) -> pa.Table:
    """Repeated windows of the contexts of one shard, as runs: ``t, n_bytes, begin, end`` in bytes of the text."""
    order = np.argsort(rows.column("c").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    data, at = flat.texts(rows.column("bytes"))
    t = np.full(len(data) + len(at) - 1, SEPARATOR, np.int64)
    begin = at[:-1] + np.arange(len(at) - 1)
    body = np.ones(len(t), bool)
    body[at[1:] + np.arange(len(at) - 1)] = False
    t[body] = data
    windows = rows.column("windows").to_numpy().astype(np.int64)
    sa = suffixes.suffix_array(t, ALPHABET)
    before, prefix = suffixes.shared_prefixes(t, sa, begin, windows, length)
    hit = prefix >= length
    hit[before[np.flatnonzero(hit)]] = True
    return _runs(rows, begin, windows, hit, length)


def _runs(rows: pa.Table, begin: np.ndarray, windows: np.ndarray, hit: np.ndarray, length: int) -> pa.Table:
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(begin, lo, "right") - 1
    first = rows.column("first").to_numpy()[row]
    return pa.table({
        "t": rows.column("t").take(pa.array(row)), "n_bytes": rows.column("n_bytes").take(pa.array(row)),
        "begin": pa.array(first + lo - begin[row]), "end": pa.array(first + hi - 1 - begin[row] + length),
    })


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``t, n_bytes, spans``: per text that has any, the repeated byte ranges (they may overlap)."""
    texts = _texts(docs.select(text), text)
    every = cut(contexts(texts, length), "anchors")
    again = every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    met = cut(every.join(again, "h"), "met")
    alike = met.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("t", "n_bytes", "first", "windows")).alias("one"))
    alike = cut(alike, "alike")
    kinds = alike.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    whole = met.join(alike.where("copies > 1").select("h", "c"), ["h", "c"], "left_semi").select(
        "t", "n_bytes", F.col("first").alias("begin"), (F.col("first") + F.col("windows") - 1 + length).alias("end")
    )

    wanted = alike.join(kinds, "h").select("h", "c", "copies", "kinds", "one.*")
    per_text = wanted.groupBy("t", "n_bytes").agg(F.collect_list(F.struct("h", "c", "copies", "kinds", "first", "windows")).alias("w"))
    # one of the copies of a text is enough to read its contexts from
    source = texts.select("_b", F.col("_t").alias("t"), F.col("_n").alias("n_bytes")).join(per_text, ["t", "n_bytes"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            # copies of a text arrive one after another
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            fresh = np.append(True, (key[1:] != key[:-1]).any(axis=1)) if len(key) else np.zeros(0, bool)
            if len(key):
                fresh[0] = tuple(key[0]) != seen
                seen = tuple(key[-1])
            batch = batch.filter(pa.array(fresh))
            data, at = flat.texts(batch.column(2))
            data = data.tobytes()
            lists = batch.column(3)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            w = lists.flatten()
            first, windows = w.field("first").to_numpy(), w.field("windows").to_numpy()
            begin = at[row] + first
            bytes_ = [data[a:b] for a, b in zip(begin.tolist(), (begin + windows - 1 + length).tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(w.field(f) for f in ("h", "c", "copies", "kinds")), batch.column(0).take(take), batch.column(1).take(take), w.field("first"), w.field("windows"), pa.array(bytes_, pa.binary())],
                names=["h", "c", "copies", "kinds", "t", "n_bytes", "first", "windows", "bytes"],
            )

    schema = f"h bigint, c bigint, copies bigint, kinds bigint, {KEYED}, first bigint, windows int, bytes binary"
    parts = source.select("t", "n_bytes", "_b", "w").mapInArrow(read, schema).dropDuplicates(["h", "c"])
    parts = cut(parts, "parts")
    total = parts.where(F.col("kinds") <= CROWD).agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = int(total // SHARD_BYTES) + 1
    found = f"{KEYED}, begin bigint, end bigint"
    sharded = (
        parts.where(F.col("kinds") <= CROWD).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
        .groupBy("shard").applyInArrow(lambda rows: shard_hits(rows, length), found)
    )

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat.texts(batch.column(batch.schema.get_field_index("bytes")))
            windows = batch.column(batch.schema.get_field_index("windows")).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(windows)), windows)
            k = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            begin = at[row] + k
            prefix = flat.prefix_hash(data)
            one = flat.slice_hash(prefix, begin, begin + length)
            two = flat.slice_hash(prefix, begin, begin + length // 2)
            column = lambda n: batch.column(batch.schema.get_field_index(n)).take(pa.array(row))
            start = column("first").to_numpy() + k
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), column("t"), column("n_bytes"), pa.array(start), pa.array(start + length)],
                names=["one", "two", "t", "n_bytes", "begin", "end"],
            )

    crowd = parts.where(F.col("kinds") > CROWD)
    loose = crowd.mapInArrow(single, f"one bigint, two bigint, {found}")
    twice = loose.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = loose.join(twice, ["one", "two"], "left_semi").select("t", "n_bytes", "begin", "end")

    spans = whole.unionByName(sharded).unionByName(crowded).distinct()
    return spans.groupBy("t", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by begin as maximal runs; ranges that touch are one run."""
    if not len(begin):
        return begin, end
    reach = np.maximum.accumulate(end)
    fresh = np.append(True, begin[1:] > reach[:-1])
    return begin[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(begin) - 1)]


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, decoded: bool = False) -> DataFrame:
    """``keep`` columns, ``rest`` (bytes left), ``n_bytes, n_removed, n_spans`` for every row.

    With ``decoded`` the rest is a string; of a letter that lost some of its bytes nothing stays.
    """
    spans = cut(repeated_spans(docs, text, length), "spans")
    own = [f"_k{i}" for i in range(len(keep))]
    rows = _texts(docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(keep, own)], F.col(text).alias("_x")), "_x")
    rows = rows.select(*own, "_b", F.col("_t").alias("t"), F.col("_n").alias("n_bytes")).join(spans, ["t", "n_bytes"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            data, at = flat.texts(batch.column(n))
            data = data.tobytes()
            rest, removed, count = [], [], []
            for i, lists in enumerate(batch.column(n + 2)):
                raw = data[at[i] : at[i + 1]]
                if lists.as_py() is None:
                    rest.append(raw), removed.append(0), count.append(0)
                    continue
                lo, hi = merged(lists.values.field("begin").to_numpy(), lists.values.field("end").to_numpy())
                edges = np.concatenate([[0], np.stack([lo, hi], axis=1).ravel(), [len(raw)]]).tolist()
                rest.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append(int((hi - lo).sum())), count.append(len(lo))
            left = pa.array([r.decode(errors="ignore") for r in rest], pa.string()) if decoded else pa.array(rest, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], left, batch.column(n + 1), pa.array(removed, pa.int64()), pa.array(count, pa.int64())],
                names=[*own, "rest", "n_bytes", "n_removed", "n_spans"],
            )

    kinds = ", ".join(f"{o} {docs.schema[c].dataType.simpleString()}" for c, o in zip(keep, own))
    out = rows.select(*own, "_b", "n_bytes", "spans").mapInArrow(run, f"{kinds}, rest {'string' if decoded else 'binary'}, n_bytes bigint, n_removed bigint, n_spans bigint")
    return out.select(*[F.col(o).alias(c) for c, o in zip(keep, own)], "rest", "n_bytes", "n_removed", "n_spans")


