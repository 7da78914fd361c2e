"""Splits, role permissions, access ledger and the one-shot gate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldgauge.functions import ranking
from fieldgauge.session import cut

# Keys of a list that one row may hold for its published digest, and children of a node of an index tree.
PLAIN_KEYS = 1_000_000
FAN = 64
PCG64_KEYS = 1_000_000


class Refused(PermissionError):
    """A request or a second opening was refused before any row was read."""


def role_of_rank(ranges: Mapping[str, tuple[int, int]], rank):
    """The role whose half-open rank range holds ``rank``; null when none does."""
    out = F.lit(None).cast("string")
    for role, (lo, hi) in ranges.items():
        out = F.when((rank >= lo) & (rank < hi), F.lit(role)).otherwise(out)
    return out


def split_by_trajectory(
    keys: DataFrame,
    seed: int,
    ranges: Mapping[str, tuple[int, int]] | None = None,
    method: str = "hash",
    by: Sequence[str] = ("family",),
    key: str = "traj",
    weights: Mapping[str, int] | None = None,
) -> DataFrame:
    """``(family, traj, role, rank)``: a seeded shuffle per family cut into contiguous ranges.

    ``ranges`` are rank ranges, and keys outside them get no role; ``weights`` are whole numbers that
    cut every family in proportion, so each key has a role. ``hash`` orders by md5(seed, family, key)
    and works at any size. ``pcg64`` reproduces ``numpy.random.Generator(PCG64(seed + j)).permutation``
    for the j-th family in order.
    """
    by = list(by)
    if (ranges is None) == (weights is None):
        raise ValueError("give either ranges or weights")
    if method == "hash":
        ranked = ranking.hash_position(keys.select(*by, key), by, seed, [*by, key])
    elif method == "pcg64":
        ranked = _pcg64_positions(keys.select(*by, key), seed, by, key)
    else:
        raise ValueError(f"unknown method {method!r}")
    if ranges is not None:
        return ranked.withColumn("role", role_of_rank(ranges, F.col("rank"))).where("role is not null")
    sizes = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    role, edge, total = F.lit(None).cast("string"), sum(weights.values()), sum(weights.values())
    for name, weight in reversed(weights.items()):
        role = F.when(F.col("rank") * total < F.col("_n") * edge, F.lit(name)).otherwise(role)
        edge -= weight
    return ranked.join(sizes, by).withColumn("role", role).drop("_n")


def _pcg64_positions(keys: DataFrame, seed: int, by: list[str], key: str) -> DataFrame:
    families = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy(*by)
    numbered = families.withColumn("offset", F.row_number().over(order) - 1)
    types = ", ".join(f"`{c}` {families.schema[c].dataType.simpleString()}" for c in by)

    def shuffle(frames):
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.n > PCG64_KEYS:
                    raise ValueError("pcg64 serves parity checks; use method='hash' at this size")
                stream = np.random.Generator(np.random.PCG64(seed + int(row.offset)))
                order = stream.permutation(int(row.n))
                out = pd.DataFrame({"natural": order, "rank": np.arange(len(order))})
                for c in by:
                    out[c] = getattr(row, c)
                yield out[[*by, "natural", "rank"]]

    drawn = numbered.mapInPandas(shuffle, f"{types}, natural bigint, rank bigint")
    natural = Window.partitionBy(*by).orderBy(key)
    placed = keys.withColumn("natural", (F.row_number().over(natural) - 1).cast("long"))
    return placed.join(drawn, [*by, "natural"]).drop("natural")


def split_contiguous(rows: DataFrame, order: str, fraction: float, n: int | None = None) -> DataFrame:
    """First int(fraction·n) rows by ``order`` are train, the rest test."""
    n = rows.count() if n is None else n
    ranked = ranking.ordered_position(rows, [], order, n=n)
    cut = int(fraction * n)
    return ranked.withColumn("role", F.when(F.col("rank") < cut, "train").otherwise("test"))


def split_blocks(
    rows: DataFrame,
    order: str,
    fractions: Sequence[float] = (0.6, 0.2, 0.2),
    embargo: int = 0,
    n: int | None = None,
) -> DataFrame:
    """Contiguous train / selection / test blocks; ``embargo`` ranks on each side of a cut are dropped."""
    n = rows.count() if n is None else n
    a, b = int(fractions[0] * n), int((fractions[0] + fractions[1]) * n)
    ranges = {
        "train": (0, a - embargo),
        "selection": (a + embargo, b - embargo),
        "test": (b + embargo, n),
    }
    ranked = ranking.ordered_position(rows, [], order, n=n)
    return ranked.withColumn("role", role_of_rank(ranges, F.col("rank"))).where("role is not null")


def split_ranges(ids: DataFrame, ranges: DataFrame, col: str) -> DataFrame:
    """Role of each id from a table ``(role, lo, hi)`` of half-open id ranges.

    A handful of ranges is folded into one expression; the rows are not shuffled.
    """
    rows = ranges.select("role", "lo", "hi").limit(257).collect()
    if len(rows) > 256:
        raise ValueError("more than 256 id ranges")
    role = F.lit(None).cast("string")
    for r in reversed(rows):  # a role may have several ranges; of overlapping ones the first counts
        role = F.when((F.col(col) >= r["lo"]) & (F.col(col) < r["hi"]), r["role"]).otherwise(role)
    return ids.withColumn("role", role).where("role is not null")


def split_digest(
    roles: DataFrame, key: str = "traj", by: Sequence[str] = ("role",), rank: str = "rank",
    form: str = "text", limit: int = PLAIN_KEYS,
) -> DataFrame:
    """The published digest of a key list in split order: one sha256 over the whole list.

    ``form="text"`` hashes the newline-joined keys without a trailing newline, ``"int64"`` their 8-byte
    little-endian integers. Either needs the list in one row, so a list above ``limit`` keys fails;
    ``index_digest`` has no such bound.
    """
    if form not in ("text", "int64"):
        raise ValueError(f"form={form!r}: text or int64")
    by = list(by)
    value = F.col(key).cast("string") if form == "text" else little_endian(F.col(key))
    counted = roles.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    long = F.raise_error(F.concat(F.lit(f"more than {limit} keys in one list; use index_digest: "), F.col("_n").cast("string")))
    listed = counted.withColumn("_v", F.when(F.col("_n") > limit, long.cast("string")).otherwise(value))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_at"), "_v")))
    joined = F.array_join(F.transform(ordered, lambda p: p["_v"]), "\n" if form == "text" else "")
    return listed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sha2(joined if form == "text" else F.unhex(joined), 256).alias("sha256")
    )


def little_endian(number, size: int = 8) -> Column:
    """The lowest ``size`` bytes of a long, lowest first, as hex."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(7, 7 - size, -1)])


def _levels(roles: DataFrame, key: str, by: list[str], rank: str, fan: int, carry: Sequence[str] = (), stored: bool = False) -> list[DataFrame]:
    """The nodes ``(*by, _at, _h, _m)`` of each level, leaves first; ``_m`` counts the places of a list on that level.

    Leaves keep the columns ``carry``. With ``stored`` the levels above them are written tables.
    """
    sizes = roles.groupBy(*by).agg((F.max(rank) + 1).cast("long").alias("_m"), F.min(rank).alias("_low"))
    most = sizes.agg(F.max("_m").alias("most"), F.min("_low").alias("low")).first()
    if most["low"] is not None and most["low"] < 0:
        raise ValueError("places of a list count from 0")
    # keys are hashed after the join, which may shuffle its rows
    nodes = roles.select(*by, F.col(rank).cast("long").alias("_at"), F.col(key).alias("_key"), *[F.col(c).alias(f"_of_{c}") for c in carry])
    nodes = nodes.join(sizes.select(*by, "_m"), by).withColumn("_h", F.sha2(F.col("_key").cast("string"), 256)).drop("_key")
    out, most = [nodes], most["most"] or 0
    while most > 1:
        run = F.when(F.col("_m") > 1, F.floor(F.col("_at") / fan)).otherwise(F.col("_at"))
        ordered = F.array_sort(F.collect_list(F.struct("_at", "_h")))
        joined = F.sha2(F.array_join(F.transform(F.col("_run"), lambda p: p["_h"]), "\n"), 256)
        nodes = (
            nodes.groupBy(*by, run.cast("long").alias("_up")).agg(ordered.alias("_run"), F.first("_m").alias("_m"))
            .select(*by, F.col("_up").alias("_at"), F.when(F.col("_m") > 1, joined).otherwise(F.col("_run")[0]["_h"]).alias("_h"), F.ceil(F.col("_m") / fan).alias("_m"))
        )
        nodes = cut(nodes, "levels") if stored else nodes
        out.append(nodes)
        most = -(-most // fan)
    return out


def index_digest(roles: DataFrame, key: str = "traj", by: Sequence[str] = ("role",), rank: str = "rank", fan: int = FAN) -> DataFrame:
    """``(*by, n_keys, root)``: the root of a tree over a list of any length, by one rule at every size.

    A leaf is the sha256 of a key, at the place ``rank`` (from 0). Every ``fan`` neighbouring places have a
    parent, the sha256 of their newline-joined digests; places without a key are left out. A list of one
    key is its leaf. A task never holds more than ``fan`` digests.
    """
    by = list(by)
    levels = _levels(roles, key, by, rank, fan)
    counts = roles.groupBy(*by).agg(F.count(F.lit(1)).alias("n_keys"))
    return counts.join(levels[-1].select(*by, F.col("_h").alias("root")), by)


def index_proofs(
    roles: DataFrame, key: str = "traj", by: Sequence[str] = ("role",), rank: str = "rank", fan: int = FAN, wanted: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(*by, rank, *carry, path, root)``: what shows that a key is in the list whose root is published.

    ``path`` has a step per level: the digests left and right of the node in its run, newline-joined.
    ``wanted`` ``(*by, rank)`` asks for some of the keys only; ``carry`` names columns of ``roles`` that come
    along, so that no join has to move the paths. A run goes through a shuffle once, with the path of its
    parent; the paths of its keys are made from it afterwards and for the wanted keys alone.
    """
    by, carry = list(by), list(carry)
    if wanted is None:
        marked = roles.withColumn("_asked", F.lit(True))
    else:
        keys = wanted.select(*by, rank).distinct().withColumn("_asked", F.lit(True))
        marked = roles.join(keys, [*by, rank], "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    levels = _levels(marked, key, by, rank, fan, [*carry, "_asked"], stored=True)
    step = "struct<left:string,right:string>"
    empty = F.array().cast(f"array<{step}>")
    if len(levels) == 1:
        return levels[0].where("_of__asked").select(*by, F.col("_at").alias(rank), *[F.col(f"_of_{c}").alias(c) for c in carry], empty.alias("path"), F.col("_h").alias("root"))
    held = levels[-1].select(*by, "_at", empty.alias("path"), F.col("_h").alias("root"))
    for at in range(len(levels) - 2, -1, -1):
        names = carry if at == 0 else []
        asked = F.col("_of__asked") if at == 0 else F.lit(True)
        up = F.when(F.col("_m") > 1, F.floor(F.col("_at") / fan)).otherwise(F.col("_at")).cast("long")
        node = F.struct("_at", "_h", asked.alias("asked"), *[F.col(f"_of_{c}").alias(c) for c in names])
        runs = levels[at].groupBy(*by, up.alias("_up")).agg(F.array_sort(F.collect_list(node)).alias("_run"), F.first("_m").alias("_m"))
        above = held.withColumnsRenamed({"_at": "_up", "path": "_path"})
        # paths are longer by a run at every level than Spark expects, so it must not choose to broadcast them
        met = runs.where(F.exists("_run", lambda p: p["asked"])).join(above.hint("merge"), [*by, "_up"])
        placed = F.filter(F.transform("_run", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda q: q["p"]["asked"])
        each = met.withColumn("_own", F.explode(placed))
        near = lambda start, count: F.array_join(F.slice(F.col("_run._h"), start, count), "\n")
        beside = F.struct(near(F.lit(1), F.col("_own.i")).alias("left"), near(F.col("_own.i") + 2, F.lit(fan)).alias("right"))
        own = F.when(F.col("_m") > 1, F.array(beside)).otherwise(empty)
        held = each.select(*by, F.col("_own.p._at").alias("_at"), *[F.col(f"_own.p.{c}").alias(c) for c in names], F.concat(own, "_path").alias("path"), "root")
    return held.withColumnRenamed("_at", rank)


def index_root(key: Column, path: Column) -> Column:
    """The root a key and its path lead to."""
    part = lambda text: F.when(text != "", text)
    return F.aggregate(path, F.sha2(key.cast("string"), 256), lambda h, s: F.sha2(F.concat_ws("\n", part(s["left"]), h, part(s["right"])), 256))


def check_disjoint(roles: DataFrame, key: Sequence[str] = ("family", "traj")) -> DataFrame:
    """Keys that appear under more than one role."""
    return (
        roles.groupBy(*key)
        .agg(F.count_distinct("role").alias("n_roles"), F.array_sort(F.collect_set("role")).alias("roles"))
        .where("n_roles > 1")
    )


def check_coverage(roles: DataFrame, expected: DataFrame) -> DataFrame:
    """Roles whose count differs from ``expected (role, n_expected)``."""
    found = roles.groupBy("role").agg(F.count(F.lit(1)).alias("n_found"))
    both = expected.join(found, "role", "full_outer").na.fill(0, ["n_found", "n_expected"])
    return both.where("n_found <> n_expected")


def check_permission(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Requests for a role the stage may not open."""
    return requests.join(permissions, ["stage", "role"], "left_anti")


def guard_requests(
    requests: DataFrame, allowed: DataFrame, request: str = "request_id",
    key: Sequence[str] = ("family", "traj"),
) -> DataFrame:
    """One row per request: id counts and whether the *whole* request is accepted.

    A request with one foreign or repeated id, or with no id at all (a null key), is rejected.
    """
    key = list(key)
    per_id = requests.groupBy(request, *key).agg(F.count(F.lit(1)).alias("_times"))
    marked = per_id.join(
        allowed.select(*key).distinct().withColumn("_ok", F.lit(True)), key, "left"
    )
    empty = F.col(key[-1]).isNull()
    out = marked.groupBy(request).agg(
        F.sum(F.when(~empty, F.col("_times")).otherwise(0)).alias("n_ids"),
        F.count_if(~empty & F.col("_ok").isNull()).alias("n_foreign"),
        F.count_if(~empty & (F.col("_times") > 1)).alias("n_repeated"),
    )
    good = (F.col("n_ids") > 0) & (F.col("n_foreign") == 0) & (F.col("n_repeated") == 0)
    return out.withColumn("accepted", good)


def accepted_rows(requests: DataFrame, allowed: DataFrame, request: str = "request_id",
                  key: Sequence[str] = ("family", "traj")) -> DataFrame:
    """Rows of accepted requests only; nothing of a rejected request passes or is logged."""
    ok = guard_requests(requests, allowed, request, key).where("accepted").select(request)
    return requests.join(ok, request, "left_semi")


def require_requests(requests: DataFrame, allowed: DataFrame, **kw) -> DataFrame:
    """The strict form: raise before the read when any request is rejected."""
    bad = guard_requests(requests, allowed, **kw).where("not accepted").limit(5).collect()
    if bad:
        raise Refused(f"rejected requests: {[r.asDict() for r in bad]}")
    return requests


def check_file_roles(files: DataFrame, markers: Mapping[str, str], path: str = "path") -> DataFrame:
    """Files whose name does not carry the marker of their role."""
    named = F.lit(None).cast("string")
    for role, marker in markers.items():
        named = F.when(F.col(path).contains(marker), F.lit(role)).otherwise(named)
    return files.withColumn("named_role", named).where(
        F.col("named_role").isNull() | (F.col("named_role") != F.col("role"))
    )


def log_access(events: DataFrame, path: str) -> None:
    """Append ledger events; earlier events are never rewritten."""
    events.write.mode("append").parquet(path)


def ledger_summary(ledger: DataFrame, by: Sequence[str] = ("stage", "role")) -> DataFrame:
    """Opened fields and hashed files per level of ``by``, with subtotals."""
    return ledger.rollup(*by).agg(
        F.sum(F.when(F.col("event") == "field_read", F.col("n")).otherwise(0)).alias("fields_read"),
        F.sum(F.when(F.col("event") == "bytes_hashed", F.col("n")).otherwise(0)).alias("files_hashed"),
        F.count(F.lit(1)).alias("n_events"),
    )


def ledger_violations(ledger: DataFrame, permissions: DataFrame, never: str = "unused") -> DataFrame:
    """Field reads of a role the stage may not open, or of the role that must stay closed.

    Hashing the raw bytes of a file is not a field read.
    """
    reads = ledger.where((F.col("event") == "field_read") & (F.col("n") > 0))
    sums = reads.groupBy("stage", "role").agg(F.sum("n").alias("fields_read"))
    allowed = permissions.select("stage", "role").distinct().withColumn("_ok", F.lit(True))
    return (
        sums.join(allowed, ["stage", "role"], "left")
        .where(F.col("_ok").isNull() | (F.col("role") == never))
        .drop("_ok")
    )


def open_once(spark: SparkSession, marker: str, load: Callable[[], DataFrame], note: str = "") -> DataFrame:
    """Consume ``marker``, then build the read. A second call is refused, also after a crash.

    The marker is a create-only write by the one driver; on a store without an atomic
    create-if-absent two drivers must not share a marker.
    """
    row = spark.range(1).select(F.lit(note).alias("note"), F.current_timestamp().alias("opened_at"))
    try:
        row.coalesce(1).write.mode("errorifexists").parquet(marker)
    except Exception as error:
        if "PATH_ALREADY_EXISTS" in str(error):
            raise Refused(f"{marker} is already consumed") from error
        raise
    return load()


def shuffle_within(
    pairs: DataFrame, seed: int, key: Sequence[str], natural: str, col: str = "y",
    block: str = "role", blocks: Sequence[str] | None = None,
) -> DataFrame:
    """Permute ``col`` inside each block; other columns and rows outside the blocks stay."""
    inside = F.col(block).isNotNull() if blocks is None else F.col(block).isin(list(blocks))
    rows = pairs.where(inside)
    place = ranking.ordered_position(rows.drop(col), [block], natural, "_place")
    donor = ranking.hash_position(rows.select(block, *key, col), [block], seed, key, "_place")
    moved = place.join(donor.select(block, "_place", col), [block, "_place"]).drop("_place")
    stay = pairs.where(~F.coalesce(inside, F.lit(False)))
    return moved.unionByName(stay.select(*moved.columns))


def reserve(keys: DataFrame, roles: DataFrame, key: Sequence[str] = ("family", "traj")) -> DataFrame:
    """Keys that belong to no role."""
    return keys.join(roles.select(*key), list(key), "left_anti")


def select_cohort(files: DataFrame, used: DataFrame, n: int, needed: Sequence[str] = ("train", "valid", "test")) -> DataFrame:
    """The first ``n`` unused families, ascending, that own a file for every needed role."""
    fresh = files.where(F.col("role").isin(list(needed))).join(used, "family", "left_anti")
    complete = fresh.groupBy("family").agg(F.count_distinct("role").alias("n_roles"))
    return complete.where(F.col("n_roles") == len(needed)).orderBy("family").limit(n)
