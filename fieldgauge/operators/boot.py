"""Paired cluster bootstrap: one draw per replicate shared by every arm, seed and family.

Clusters stand in blocks of ``BLOCK`` positions. A replicate first draws how many of its n draws fall
into each block, then that many positions inside each: the same n equal chances, but a block needs
nothing of the others. Every number is a function of (seed, replicate, block, counter), so a task makes
the draws of its block where the errors of the block are, counts them into weights, and multiplies
weights by errors. What is shuffled is replicates × blocks × cells, whatever the number of clusters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldgauge.functions.arrow import to_lists
from fieldgauge.functions.ranking import ordered_position
from fieldgauge.session import cut

# Fixed values the results depend on.
REPLICATES = 10_000
SEED = 20260811
BLOCK = 65_536
# The counter-based generator Philox 2x32 of ten rounds: multiplier and key step.
PHILOX, KEY_STEP, ROUNDS = 0xD256D193, 0x9E3779B9, 10

# Numbers made at once: the arrays of a step stay in a core's cache.
STEP = 16_384
# 32-bit words of a PCG64 stream that are read at once.
PIECE = 1 << 17
# The digits of 0000 to 9999, four bytes to a number.
FOUR_DIGITS = (np.arange(10_000)[:, None] // np.array([1000, 100, 10, 1]) % 10 + ord("0")).astype(np.uint8).view(np.uint32).ravel()
# Cells of one product, and replicates whose weights are held at once.
CELLS = 32
HELD = 32
# Errors, and weights, that a task of the PCG64 form holds: the clusters of a band.
BAND = 1 << 23


def key_of(seed: int, block: int) -> int:
    return (seed * KEY_STEP + block + 1) % 2**32


def numbers(seed: int, rep: int, block: int, m: int, start: int = 0) -> np.ndarray:
    """``m`` 64-bit numbers of one replicate and block, counters from ``start``; block -1 draws the blocks."""
    low, half, multiplier = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(PHILOX)
    out, products, held = np.empty(m, np.uint64), np.empty(min(m, STEP), np.uint64), np.empty(min(m, STEP), np.uint64)
    for lo in range(0, m, STEP):
        c0, key = out[lo : lo + STEP], key_of(seed, block)
        product, c1 = products[: len(c0)], held[: len(c0)]
        c0[:] = np.arange(start + lo, start + lo + len(c0), dtype=np.uint64)
        c1[:] = rep
        for _ in range(ROUNDS):
            np.multiply(c0, multiplier, out=product)
            np.right_shift(product, half, out=c0)
            np.bitwise_xor(c0, c1, out=c0)
            np.bitwise_xor(c0, np.uint64(key), out=c0)
            np.bitwise_and(product, low, out=c1)
            key = (key + KEY_STEP) % 2**32
        np.left_shift(c0, half, out=c0)
        np.bitwise_or(c0, c1, out=c0)
    return out


def _remainder(x: np.ndarray, n: int) -> np.ndarray:
    """x mod n; NumPy divides by a constant several times faster than it takes a remainder."""
    if n & (n - 1) == 0:
        return (x & np.uint64(n - 1)).astype(np.int64)
    return (x - x // np.uint64(n) * np.uint64(n)).astype(np.int64)


def block_counts(seed: int, rep: int, n: int, size: int = BLOCK) -> np.ndarray:
    """How many of the n draws of a replicate fall into each block."""
    count = -(-n // size)
    if count == 1:
        return np.array([n])
    held = np.zeros(count, np.int64)
    for lo in range(0, n, BLOCK):
        block = _remainder(numbers(seed, rep, -1, min(BLOCK, n - lo), lo), n) // size
        held += np.bincount(block, minlength=count)
    return held


def block_draws(seed: int, rep: int, block: int, m: int, n: int, size: int = BLOCK) -> np.ndarray:
    """``m`` positions inside a block, from 0."""
    return _remainder(numbers(seed, rep, block, m), min(size, n - block * size))


def _pcg64_words(seed: int, piece: int) -> Iterator[np.ndarray]:
    stream = np.random.PCG64(seed).advance(piece * (PIECE // 2))
    for _ in range(0, PIECE, STEP):
        yield stream.random_raw(STEP // 2).astype("<u8", copy=False).view("<u4")


def pcg64_piece(seed: int, piece: int, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """What ``Generator.integers(0, n)`` makes of one piece of its stream: whether a word is taken depends on the word alone.

    The draws stand in ``out`` where it is given, an array of ``PIECE`` 64-bit integers.
    """
    out, held, m = np.empty(PIECE, np.int64) if out is None else out, np.empty(STEP, np.uint64), 0
    for words in _pcg64_words(seed, piece):
        np.right_shift(np.multiply(words, np.uint64(n), out=held), np.uint64(32), out=held)
        refused = np.flatnonzero(words * np.uint32(n) < 2**32 % n)
        idx = np.delete(held, refused) if len(refused) else held
        out[m : m + len(idx)] = idx
        m += len(idx)
    return out[:m]


def pcg64_count(seed: int, piece: int, n: int) -> int:
    """The number of draws in a piece."""
    return PIECE - sum(int(np.count_nonzero(words * np.uint32(n) < 2**32 % n)) for words in _pcg64_words(seed, piece))


def pcg64_starts(spark: SparkSession, seed: int, reps: int, n: int) -> np.ndarray:
    """The number of draws before each piece of the stream, up to the piece that ends the last replicate."""
    if n >= 2**32:
        raise ValueError("the 32-bit stream serves fewer than 2^32 clusters")

    def count(batches):
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.int64()), pa.array([pcg64_count(seed, p, n) for p in pieces], pa.int64())], names=["piece", "m"])

    held = np.zeros(0, np.int64)
    while (missing := reps * n - int(held.sum())) > 0:
        more = 1 + int(missing / (PIECE * (1 - (2**32 % n) / 2**32)))
        tasks = min(more, 4 * spark.sparkContext.defaultParallelism)
        got = spark.range(len(held), len(held) + more, 1, tasks).mapInArrow(count, "piece bigint, m bigint").toArrow()
        held = np.concatenate([held, got["m"].to_numpy()[np.argsort(got["piece"].to_numpy())]])
    return np.concatenate([[0], np.cumsum(held)])


def _pcg64_draws(seed: int, n: int, starts: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Draws ``lo`` to ``hi`` of the whole stream."""
    first, last = np.searchsorted(starts, lo, side="right") - 1, np.searchsorted(starts, hi, side="left")
    some = np.concatenate([pcg64_piece(seed, p, n) for p in range(first, last)])
    return some[lo - starts[first] : hi - starts[first]]


def _pcg64_weights(seed: int, n: int, starts: np.ndarray, reps: range, lo: int, hi: int) -> Iterator[np.ndarray]:
    """How often each of some replicates in a row drew the clusters ``lo`` to ``hi``; an array holds until the next.

    Their part of the stream is made once, in arrays that are used again; draws are counted no oftener than the
    weights are long.
    """
    at, stop, end = reps.start * n, reps.stop * n, (reps.start + 1) * n
    piece = int(np.searchsorted(starts, at, side="right")) - 1
    weights, made, drawn, m = np.zeros(hi - lo), np.empty(PIECE, np.int64), np.empty(hi - lo + PIECE, np.int64), 0
    while at < stop:
        start, idx = int(starts[piece]), pcg64_piece(seed, piece, n, made)
        piece += 1
        while at < min(start + len(idx), stop):
            upto = min(start + len(idx), end)
            some = idx[at - start : upto - start]
            if hi - lo < n:
                some = some[(some >= lo) & (some < hi)] - lo
            drawn[m : m + len(some)] = some
            m, at = m + len(some), upto
            if at == end or m >= hi - lo:
                weights += np.bincount(drawn[:m], minlength=hi - lo)
                m = 0
            if at == end:
                yield weights
                weights[:] = 0
                end += n


def _check_draw(draw: str) -> None:
    if draw not in ("hash", "pcg64"):
        raise ValueError(f"unknown draw {draw!r}")


def _drawn(spark: SparkSession, seed: int, reps: int, n: int, draw: str, size: int):
    """A function of the replicate that yields its (block, positions from 0 over all clusters) in order."""
    _check_draw(draw)
    starts = pcg64_starts(spark, seed, reps, n) if draw == "pcg64" else None

    def of(rep: int) -> Iterator[tuple[int, np.ndarray]]:
        if starts is not None:
            for lo in range(0, n, size):
                yield lo // size, _pcg64_draws(seed, n, starts, rep * n + lo, rep * n + min(n, lo + size))
            return
        for block, m in enumerate(block_counts(seed, rep, n, size)):
            yield block, block_draws(seed, rep, block, int(m), n, size) + block * size

    return of


def draws(
    spark: SparkSession, n: int, reps: int = REPLICATES, seed: int = SEED, draw: str = "hash", size: int = BLOCK
) -> DataFrame:
    """``(rep, i, idx)``: n cluster positions per replicate, made where they are used.

    ``hash``: counter-based numbers per replicate and block, as the module says. ``pcg64``: the
    ``(reps, n)`` integers of NumPy's generator, each task from the pieces of its stream that it needs.
    """
    of = _drawn(spark, seed, reps, n, draw, size)

    def make(batches):
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                at = 0
                for _, idx in of(rep):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(idx), rep)), pa.array(np.arange(at, at + len(idx))), pa.array(idx)], names=["rep", "i", "idx"]
                    )
                    at += len(idx)

    tasks = min(reps, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, reps, 1, tasks).mapInArrow(make, "rep bigint, i bigint, idx bigint")


def decimal_text(numbers: np.ndarray) -> bytes:
    """The comma-joined decimal text of whole numbers from 0, written four digits at a time from a table."""
    if not len(numbers):
        return b""
    least, most = (len(str(int(m))) for m in (numbers.min(), numbers.max()))
    groups, rest = [], numbers.astype(np.uint64)
    while 4 * len(groups) <= most:  # one place more than digits, for the comma
        above = rest // np.uint64(10_000)
        groups.append(FOUR_DIGITS[(rest - above * np.uint64(10_000)).astype(np.int64)])
        rest = above
    text = np.stack(groups[::-1], axis=1).view(np.uint8)
    places = text.shape[1]
    if least == most:
        text[:, places - most - 1] = ord(",")
        return text[:, places - most - 1 :].tobytes()[1:]
    comma = np.full(len(text), places - 2, np.int8)
    for digits in range(1, most):
        comma -= numbers >= 10**digits
    shown = np.arange(places, dtype=np.int8) >= comma[:, None]
    text = text.ravel()
    text[np.arange(0, len(text), places) + comma] = ord(",")
    return text[shown.ravel()].tobytes()[1:]


def resample_digest(
    spark: SparkSession, n: int, reps: int = REPLICATES, seed: int = SEED, draw: str = "hash", size: int = BLOCK
) -> DataFrame:
    """Digest of the draws: a hash per block of a replicate, of the blocks of a replicate, of all replicates as a tree.

    Draws are hashed where they are made, so no array and no shuffle holds the draws of a replicate.
    """
    from fieldgauge.operators.roles import index_digest

    of = _drawn(spark, seed, reps, n, draw, size)

    def hashed(batches):
        for batch in batches:
            reps_ = batch.column(0).to_pylist()
            whole = []
            for rep in reps_:
                blocks = [hashlib.sha256(decimal_text(idx)).hexdigest() for _, idx in of(rep)]
                whole.append(hashlib.sha256("\n".join(blocks).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(reps_, pa.int64()), pa.array(whole, pa.string())], names=["rep", "sha"])

    tasks = min(reps, 4 * spark.sparkContext.defaultParallelism)
    # the tree reads its leaves several times
    per_rep = cut(spark.range(0, reps, 1, tasks).mapInArrow(hashed, "rep bigint, sha string"), "digests")
    return index_digest(per_rep.withColumn("role", F.lit("draws")), "sha", ["role"], "rep").select(
        F.col("n_keys").alias("replicates"), "root"
    )


def _counted_lots(spark: SparkSession, seed: int, reps: int, n: int, size: int, per_lot: int) -> DataFrame:
    """``(lot, block, drawn)``: the block counts of the replicates of a lot, in their order; every replicate is counted on its own."""

    def count(batches):
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([rep]), pa.array([block_counts(seed, rep, n, size)])], names=["rep", "m"])

    tasks = min(reps, 4 * spark.sparkContext.defaultParallelism)
    each = spark.range(0, reps, 1, tasks).mapInArrow(count, "rep bigint, m array<bigint>")
    lot = F.floor(F.col("rep") / per_lot).cast("int").alias("lot")
    ordered = F.array_sort(F.collect_list(F.struct("rep", "m")))
    counted = each.select(lot, "rep", F.posexplode("m").alias("block", "m"))
    return counted.groupBy("lot", "block").agg(F.transform(ordered, lambda p: p["m"]).alias("drawn"))


def _hash_sums(grid: DataFrame, seed: int, reps: int, n: int, size: int, per_lot: int, blocks: int, chunks: int) -> DataFrame:
    """``(rep, chunk, s)`` of a grid ``(lot, block, chunk, err)``: a task makes the draws of its block, counts and multiplies."""
    spark = grid.sparkSession
    if blocks > 1:
        grid = grid.join(_counted_lots(spark, seed, reps, n, size, per_lot), ["lot", "block"])
    else:
        grid = grid.withColumn("drawn", F.lit(None).cast("array<bigint>"))

    def weighed(lot, block, width, drawn):
        """(replicates, their weights of the block), up to ``HELD`` at a time."""
        own = range(lot * per_lot, min(reps, (lot + 1) * per_lot))
        counts = None if not drawn.is_valid else drawn.values.to_numpy(zero_copy_only=False)
        for lo in range(0, len(own), HELD):
            some = own[lo : lo + HELD]
            weights = np.empty((len(some), width))
            for i, rep in enumerate(some):
                weights[i] = np.bincount(block_draws(seed, rep, block, n if counts is None else int(counts[lo + i]), n, size), minlength=width)
            yield some, weights

    def product(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                lot, block, chunk = (batch.column(c)[at].as_py() for c in range(3))
                width = min(size, n - block * size)
                held = batch.column(3)[at].values.to_numpy(zero_copy_only=False).reshape(width, -1)
                for some, weights in weighed(lot, block, width, batch.column(4)[at]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(some, np.int64)), pa.array(np.full(len(some), chunk, np.int32)), to_lists(weights @ held)], names=["rep", "chunk", "s"]
                    )

    # units of nearly equal work, dealt evenly: a hash would give some tasks several and others none
    lots = -(-reps // per_lot)
    tasks = min(lots * blocks * chunks, 16 * spark.sparkContext.defaultParallelism)
    unit = ((F.col("lot") * blocks + F.col("block")) * chunks + F.col("chunk")) % tasks
    dealt = grid.select("lot", "block", "chunk", "err", "drawn").repartitionById(tasks, unit.cast("int"))
    return dealt.mapInArrow(product, "rep bigint, chunk int, s array<double>")


def _pcg64_sums(grid: DataFrame, seed: int, reps: int, n: int, size: int, wide: int, per_lot: int, bands: int, chunks: int) -> DataFrame:
    """``(rep, chunk, s)`` of a grid ``(lot, block, chunk, err)``, for each band of ``wide`` blocks.

    A task holds the errors of a band and makes the part of the stream that its replicates read, so no draw is
    shuffled: the stream is made once a band.
    """
    spark = grid.sparkSession
    starts = pcg64_starts(spark, seed, reps, n)

    def product(batches):
        unit, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                lot, block, chunk = (batch.column(c)[at].as_py() for c in range(3))
                lo, hi = block // wide * wide * size, min(n, (block // wide + 1) * wide * size)
                if not held:
                    unit = lot, lo, chunk
                if unit != (lot, lo, chunk) or block * size != lo + len(held) * size:
                    raise ValueError("a cluster does not have exactly one error in every cell")
                held.append(batch.column(3)[at].values.to_numpy(zero_copy_only=False).reshape(min(size, n - block * size), -1).T)
                if (block + 1) * size < hi:
                    continue
                errors, held = np.concatenate(held, axis=1), []
                own = range(lot * per_lot, min(reps, (lot + 1) * per_lot))
                sums = np.array([errors @ weights for weights in _pcg64_weights(seed, n, starts, own, lo, hi)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(own, np.int64)), pa.array(np.full(len(own), chunk, np.int32)), to_lists(sums)], names=["rep", "chunk", "s"]
                )
        if held:
            raise ValueError("a cluster does not have exactly one error in every cell")

    tasks = -(-reps // per_lot) * bands * chunks
    unit = (F.col("lot") * bands + F.floor(F.col("block") / wide)) * chunks + F.col("chunk")
    dealt = grid.select("lot", "block", "chunk", "err").repartitionById(tasks, unit.cast("int")).sortWithinPartitions("lot", "chunk", "block")
    return dealt.mapInArrow(product, "rep bigint, chunk int, s array<double>")


def replicate_means(
    errors: DataFrame, reps: int = REPLICATES, seed: int = SEED, draw: str = "hash",
    by: Sequence[str] = ("arm", "seed"), cluster: str = "cluster", stored: bool = False, size: int = BLOCK,
) -> DataFrame:
    """``(rep, *by, mse)``: the mean error of the drawn clusters in every cell.

    The error table is written once unless it is ``stored`` already, since its cells, its clusters and
    its values are all read. A task holds the errors of one block of clusters in up to ``CELLS`` cells and
    goes through its share of the replicates.
    """
    spark, by = errors.sparkSession, list(by)
    if not stored:
        errors = cut(errors.select(*by, cluster, "err"), "errors")
    order = Window.partitionBy(F.lit(0)).orderBy(*by)
    cells = cut(errors.select(*by).distinct().withColumn("cell", (F.row_number().over(order) - 1).cast("long")), "cells")
    m, ids = cells.count(), errors.select(cluster).distinct()
    n = ids.count()
    _check_draw(draw)
    if not n:
        return cells.select(F.lit(None).cast("long").alias("rep"), *by, F.lit(None).cast("double").alias("mse"))
    placed = ordered_position(ids, [], cluster, "idx", n=n)
    named = cells.withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = errors.join(named, same).join(placed, cluster).select(
        F.floor(F.col("idx") / size).cast("int").alias("block"), F.floor(F.col("cell") / CELLS).cast("int").alias("chunk"),
        (F.col("idx") % size).cast("int").alias("at"), (F.col("cell") % CELLS).cast("int").alias("cell"), F.col("err").cast("double").alias("err"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block, chunk = int(pdf["block"].iloc[0]), int(pdf["chunk"].iloc[0])
        shape = min(size, n - block * size), min(CELLS, m - chunk * CELLS)
        slot = pdf["at"].to_numpy() * shape[1] + pdf["cell"].to_numpy()
        if len(slot) != shape[0] * shape[1] or (np.bincount(slot, minlength=len(slot)) != 1).any():
            raise ValueError("a cluster does not have exactly one error in every cell")
        held = np.empty(len(slot))
        held[slot] = pdf["err"].to_numpy()
        return pd.DataFrame({"block": [block], "chunk": [chunk], "err": [held]})

    packed = rows.groupBy("block", "chunk").applyInPandas(pack, "block int, chunk int, err array<double>")
    blocks, chunks = -(-n // size), -(-m // CELLS)
    cores = spark.sparkContext.defaultParallelism
    if draw == "pcg64":
        wide = -(-blocks // -(-blocks // max(1, BAND // (min(m, CELLS) * size))))
        bands = -(-blocks // wide)
        lots = min(reps, max(1, -(-2 * cores // (bands * chunks))))
    else:
        bands, lots = blocks, min(-(-reps // HELD), max(1, -(-4 * cores // (blocks * chunks))))
    per_lot = -(-reps // lots)
    lots = -(-reps // per_lot)
    grid = packed.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    if draw == "pcg64":
        parts = _pcg64_sums(grid, seed, reps, n, size, wide, per_lot, bands, chunks)
    else:
        parts = _hash_sums(grid, seed, reps, n, size, per_lot, blocks, chunks)
    each = parts.select("rep", "chunk", F.posexplode("s").alias("at", "s")).select("rep", (F.col("chunk") * CELLS + F.col("at")).cast("long").alias("cell"), "s")
    if bands > 1:
        each = each.groupBy("rep", "cell").agg(F.sum("s").alias("s"))
    return each.join(F.broadcast(cells) if m <= 10_000 else cells, "cell").select("rep", *by, (F.col("s") / n).alias("mse"))


def interval(stats: DataFrame, col: str, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval with linear interpolation."""
    half = (1 - level) / 2
    q = F.percentile(F.col(col), F.array(F.lit(half), F.lit(1 - half)))
    return stats.groupBy(*by).agg(q.alias("_q"), F.count(F.lit(1)).alias("replicates")).select(
        *by, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"), "replicates"
    )


def replicate_stats(means: DataFrame, base: str = "dense", families: bool = False, each: bool = False) -> DataFrame:
    """The statistic of each replicate: median over seeds of the ratio to the base arm.

    With ``families`` the maximum over families of those medians, with ``each`` one of every family.
    """
    family = ["family"] if families or each else []
    keys = ["rep", *family, "seed"]
    paired = means.groupBy(*keys).agg(
        F.max(F.when(F.col("arm") == base, F.col("mse"))).alias("_base"),
        F.collect_list(F.when(F.col("arm") != base, F.struct("arm", "mse"))).alias("_arms"),
    )
    ratios = paired.select("rep", *family, "_base", F.explode("_arms").alias("_a")).select(
        "rep", *family, F.col("_a.arm").alias("arm"), (F.col("_a.mse") / F.col("_base")).alias("ratio")
    )
    medians = ratios.groupBy("rep", *family, "arm").agg(F.median("ratio").alias("stat"))
    if not families or each:
        return medians
    return medians.groupBy("rep", "arm").agg(F.max("stat").alias("stat"))


def paired_bootstrap(
    errors: DataFrame, base: str = "dense", reps: int = REPLICATES, seed: int = SEED,
    draw: str = "hash", families: bool = False, stored: bool = False, size: int = BLOCK, each: bool = False,
) -> DataFrame:
    """``(arm, lo, hi, replicates)``; a floor is an arm whose error does not depend on the seed.

    With ``each`` one row per family and arm: the families share the draws, which are made once.
    """
    family = ["family"] if families or each else []
    by = [*family, "arm", "seed"]
    if not stored:
        errors, stored = cut(errors.select(*by, "cluster", "err"), "errors"), True
    sets = errors.select(*by).distinct().groupBy(*family, "arm").agg(F.sort_array(F.collect_set("seed")).alias("seeds"))
    of_base = sets.where(F.col("arm") == base).select(*family, F.col("seeds").alias("_base"))
    beside = sets.join(of_base, family, "left") if family else sets.join(of_base, how="left")
    uneven = beside.groupBy("arm").agg(F.bool_and(F.col("seeds").eqNullSafe(F.col("_base"))).alias("same"), F.count(F.lit(1)).alias("n"))
    n = sets.select(*family, F.lit(1)).distinct().count()
    bad = uneven.where(~F.col("same") | (F.col("n") != n)).first()
    if bad is not None:
        raise ValueError(f"{bad['arm']}: seed sets differ from {base}")
    means = replicate_means(errors, reps, seed, draw, by, stored=True, size=size)
    return interval(replicate_stats(means, base, families, each), "stat", [*(family if each else []), "arm"])


def seed_bootstrap(
    measurements: DataFrame, metrics: Sequence[str], target: str = "target", dense: str = "dense",
    budget: str = "budget", reps: int = REPLICATES, seed: int = SEED,
) -> DataFrame:
    """dense/budget ratio of medians per (target, metric) with a paired interval over seeds.

    ``measurements`` is ``(target, scheme, seed, metric…)``. The same drawn seeds serve both
    schemes. With fewer than two seeds the interval is not computable and stays null.
    """
    spark = measurements.sparkSession
    long = measurements.where(F.col("scheme").isin(dense, budget)).unpivot(
        [target, "scheme", "seed"], list(metrics), "metric", "value"
    )
    both = long.groupBy(target, "metric", "seed").agg(
        F.max(F.when(F.col("scheme") == dense, F.col("value"))).alias("d"),
        F.max(F.when(F.col("scheme") == budget, F.col("value"))).alias("b"),
    ).where(F.col("d").isNotNull() & F.col("b").isNotNull())
    w = Window.partitionBy(target, "metric")
    rows = both.withColumn("idx", F.row_number().over(w.orderBy("seed")) - 1).withColumn(
        "n", F.count(F.lit(1)).over(w)
    )
    ratio = F.median("d") / F.greatest(F.median("b"), F.lit(1e-30))
    point = rows.groupBy(target, "metric").agg(ratio.alias("ratio"), F.first("n").alias("n_seeds"))
    sizes = [r["n"] for r in rows.select("n").distinct().collect() if r["n"] >= 2]
    drawn = None
    for n in sizes:
        part = draws(spark, n, reps, seed).select("rep", "idx", F.lit(n).cast("long").alias("n"))
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        empty = F.lit(None).cast("double")
        return point.withColumn("lo", empty).withColumn("hi", empty).withColumn(
            "excludes_one", F.lit(None).cast("boolean")
        )
    stats = rows.join(drawn, ["n", "idx"]).groupBy(target, "metric", "rep").agg(ratio.alias("stat"))
    limits = interval(stats, "stat", [target, "metric"]).drop("replicates")
    return point.join(limits, [target, "metric"], "left").withColumn(
        "excludes_one", (F.col("lo") > 1) | (F.col("hi") < 1)
    )
