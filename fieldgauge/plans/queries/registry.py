"""Registration, result clean-up and the SQL fragments the checks share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgauge.operators import boot, roles
from fieldgauge.session import shared_folder, ship_package

TABLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def keep(fn):
        name = fn.__name__

        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return tidy(fn(spark, sf), digits)

        TABLE[name] = run
        if sql is not None:
            SQL[name] = with_fragments(sql)
        return fn

    return keep


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers widened, so that both engines print the same values."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        cols.append(c.alias(name))
    return df.select(*cols)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def rd(expr: str, name: str, digits: int = 6) -> str:
    """A rounded SQL column; adding zero removes the sign of a negative zero."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


def _numbers(source: str, out: str) -> str:
    """The 64-bit numbers of (rep, block, counter t) as a column."""
    low = 4294967295
    source = f"""SELECT *, t::UBIGINT AS c0, rep::UBIGINT AS c1, ({boot.key_of(boot.SEED, 0)} + block)::UBIGINT AS key FROM ({source})"""
    for at in range(boot.ROUNDS):
        product, key = f"(c0 * {boot.PHILOX})", f"((key + {at * boot.KEY_STEP % 2**32}) & {low})"
        source = f"SELECT * REPLACE (xor(xor({product} >> 32, {key}), c1) AS c0, {product} & {low} AS c1) FROM ({source})"
    return f"SELECT * EXCLUDE (c0, c1, key), (c0 << 32) | c1 AS {out} FROM ({source})"


def draws(sizes: str, reps: int = boot.REPLICATES) -> str:
    """``n, rep, block, t, idx``: the draws of all replicates for every ``n`` of ``sizes``."""
    per_rep = f"SELECT n, unnest(range({reps})) AS rep FROM ({sizes})"
    above = f"SELECT n, rep, -1 AS block, unnest(range(n)) AS t FROM ({per_rep}) WHERE n > {boot.BLOCK}"
    counts = f"""SELECT n, rep, 0 AS block, n AS m FROM ({per_rep}) WHERE n <= {boot.BLOCK} UNION ALL SELECT n, rep, b AS block, count(*) AS m
        FROM (SELECT n, rep, (v % n::UBIGINT)::BIGINT // {boot.BLOCK} AS b FROM ({_numbers(above, "v")})) GROUP BY ALL"""
    each = f"SELECT n, rep, block, unnest(range(m)) AS t FROM ({counts})"
    return f"""SELECT n, rep, block, t, block * {boot.BLOCK} + (v % least({boot.BLOCK}, n - block * {boot.BLOCK})::UBIGINT)::BIGINT AS idx FROM ({_numbers(each, "v")})"""


def tree_sql(leaves: str, fan: int = roles.FAN) -> str:
    """Recursive CTEs ``lv`` (all nodes) and ``tree (g, n_keys, root)`` over ``leaves`` ``(g, pos, key)``."""
    return f"""lv AS (SELECT g, 0 AS lvl, pos, sha256(key::VARCHAR) AS h, max(pos) OVER (PARTITION BY g) + 1 AS m FROM ({leaves}) UNION ALL
        SELECT g, lvl + 1, pos // {fan}, sha256(string_agg(h, chr(10) ORDER BY pos)), (m + {fan} - 1) // {fan} FROM lv WHERE m > 1 GROUP BY g, lvl, m, pos // {fan}),
    tree AS (SELECT g, count(*) FILTER (lvl = 0) AS n_keys, arg_max(h, lvl) AS root FROM lv GROUP BY g)"""


# ------------------------------------------------------------------------------ fragments

LADDER = (2, 4, 8, 16, 32, 48, 64)

FRAGMENTS: dict[str, str] = {
    # walk fields
    "raw": """SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS pos,
        count(*) OVER () AS n, embedding FROM embeddings""",
    "el": """SELECT vec_id, label, pos, n, unnest(range(len(embedding))) AS i,
        unnest(embedding)::DOUBLE AS e FROM raw""",
    "walk": """SELECT vec_id, label, pos, n, i, sum(e) OVER (PARTITION BY vec_id ORDER BY i) AS y,
        CASE WHEN pos < floor(0.6::DOUBLE * n) THEN 'train' WHEN pos < floor(0.8::DOUBLE * n) THEN 'selection'
             ELSE 'test' END AS role FROM el""",
    "mu": "SELECT i, avg(y) AS m FROM walk WHERE role = 'train' GROUP BY i",
    "seeds": "SELECT unnest([0, 1, 2]) AS seed",
    "dct": """SELECT a.j, b.i, (CASE WHEN a.j = 0 THEN sqrt(1.0::DOUBLE / 64) ELSE sqrt(2.0::DOUBLE / 64) END)
        * cos(pi() * (2 * b.i + 1) * a.j / 128.0::DOUBLE) AS b
        FROM (SELECT unnest(range(64)) AS j) a CROSS JOIN (SELECT unnest(range(64)) AS i) b""",
    "pred": """SELECT s.seed, w.vec_id, w.label, w.pos, w.role, w.i, w.y,
        (0.6::DOUBLE + 0.1::DOUBLE * s.seed) * w.y + (0.4::DOUBLE - 0.1::DOUBLE * s.seed) * o.y AS p
        FROM walk w CROSS JOIN seeds s JOIN walk o ON o.i = w.i AND o.pos = (w.pos + s.seed + 1) % w.n""",
    "coef": """SELECT w.vec_id, w.label, w.role, d.j, sum((w.y - m.m) * d.b) AS c
        FROM walk w JOIN mu m USING (i) JOIN dct d USING (i) GROUP BY ALL""",
    "pcoef": """SELECT p.seed, p.vec_id, p.label, p.role, d.j, sum((p.y - m.m) * d.b) AS c,
        sum((p.p - m.m) * d.b) AS ch FROM pred p JOIN mu m USING (i) JOIN dct d USING (i) GROUP BY ALL""",
    "gains": """SELECT seed, j, count(*) AS n, avg(c * c) AS q, avg((c - ch) * (c - ch)) AS e,
        avg(c * c) - avg((c - ch) * (c - ch)) AS gain FROM pcoef WHERE role = 'selection' GROUP BY seed, j""",
    "ord": """SELECT seed, j, gain, greatest(gain, 0.0::DOUBLE) AS gpos, row_number() OVER (PARTITION BY seed
        ORDER BY greatest(gain, 0.0::DOUBLE) DESC, j) - 1 AS rank FROM gains""",
    "tails": """SELECT seed, rank AS k, sum(gpos) OVER (PARTITION BY seed ORDER BY rank DESC
        ROWS UNBOUNDED PRECEDING) AS tail FROM ord""",
    "thr": """SELECT seed, avg((y - p) * (y - p)) AS mse, 0.05::DOUBLE AS tau,
        0.05::DOUBLE * 64 * avg((y - p) * (y - p)) AS threshold FROM pred WHERE role = 'selection' GROUP BY seed""",
    "ladder": "SELECT unnest([2, 4, 8, 16, 32, 48, 64]) AS rung",
    "rungs": """SELECT h.seed, l.rung, h.threshold, CASE WHEN l.rung = 64 THEN 0.0::DOUBLE ELSE t.tail END AS tail,
        lag(CASE WHEN l.rung = 64 THEN 0.0::DOUBLE ELSE t.tail END) OVER (PARTITION BY h.seed ORDER BY l.rung) AS prev
        FROM thr h CROSS JOIN ladder l LEFT JOIN tails t ON t.seed = h.seed AND t.k = l.rung""",
    "chosen": """SELECT seed, threshold, count(*) AS n_rungs, count(*) FILTER (tail <= threshold) AS n_feasible,
        max(rung) AS last_rung, min(rung) FILTER (tail <= threshold) AS selected_k FROM rungs GROUP BY seed, threshold""",
    "keep0": """SELECT o.j, o.rank AS pos FROM ord o JOIN chosen c USING (seed)
        WHERE o.seed = 0 AND o.rank < c.selected_k""",
    "energy": """SELECT w.vec_id, w.role, w.label, sum((w.y - m.m) * (w.y - m.m)) AS e
        FROM walk w JOIN mu m USING (i) GROUP BY ALL""",
    "rowerr": """SELECT p.seed, p.vec_id, p.label, p.role, d.dense, (e.e - k.cc + k.miss) / 64 AS reduced,
        (e.e - k.cc) / 64 AS floor FROM (SELECT DISTINCT seed, vec_id, label, role FROM pred) p
        JOIN (SELECT seed, vec_id, avg((y - p) * (y - p)) AS dense FROM pred GROUP BY ALL) d USING (seed, vec_id)
        JOIN (SELECT seed, vec_id, sum(c * c) AS cc, sum((c - ch) * (c - ch)) AS miss FROM pcoef
              WHERE j IN (SELECT j FROM keep0) GROUP BY ALL) k USING (seed, vec_id)
        JOIN energy e USING (vec_id)""",
    "cells": """SELECT arm, seed, label AS cluster, count(*) AS n_rows, avg(v) AS err FROM (
        SELECT seed, label, role, unnest(['dense', 'reduced', 'floor']) AS arm, unnest([dense, reduced, floor]) AS v
        FROM rowerr) WHERE role = 'test' GROUP BY ALL""",
    "mses": "SELECT arm, seed, sum(err * n_rows) / sum(n_rows) AS mse FROM cells GROUP BY arm, seed",
    "ratios": """SELECT a.arm, a.seed, a.mse / b.mse AS ratio FROM mses a JOIN mses b
        ON a.seed = b.seed AND b.arm = 'dense' WHERE a.arm <> 'dense'""",
    # frames of events: one vector of five sums per (user, day)
    "ev": """SELECT event_id, user_id AS traj, 'f' || (user_id % 4) AS family,
        date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, event_type, value FROM events""",
    "kinds": """SELECT row_number() OVER (ORDER BY event_type) - 1 AS j, event_type
        FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)""",
    "fr": "SELECT DISTINCT family, traj, t FROM ev",
    "cell": """SELECT f.family, f.traj, f.t, k.j, coalesce(sum(e.value), 0.0) AS v FROM fr f CROSS JOIN kinds k
        LEFT JOIN ev e ON e.traj = f.traj AND e.t = f.t AND e.event_type = k.event_type GROUP BY ALL""",
    "keys": "SELECT DISTINCT family, traj FROM ev",
    "shuffled": """SELECT family, traj, row_number() OVER (PARTITION BY family
        ORDER BY md5('7:' || family || ':' || traj), family, traj) - 1 AS rank FROM keys""",
    "roles": """SELECT family, traj, rank, CASE WHEN rank * 20 < n * 11 THEN 'train' WHEN rank * 20 < n * 15 THEN 'validation'
        WHEN rank * 20 < n * 17 THEN 'unused' ELSE 'test' END AS role
        FROM (SELECT *, count(*) OVER (PARTITION BY family) AS n FROM shuffled)""",
    # daily series per event type
    "days": "SELECT unnest(range((SELECT min(t) FROM ev), (SELECT max(t) + 1 FROM ev))) AS t",
    "series": """SELECT k.event_type AS series_id, row_number() OVER (PARTITION BY k.event_type ORDER BY d.t) - 1 AS step,
        coalesce(s.value, 0.0) AS value FROM days d CROSS JOIN kinds k LEFT JOIN
        (SELECT t, event_type, sum(value) AS value FROM ev GROUP BY ALL) s ON s.t = d.t AND s.event_type = k.event_type""",
    # lineitem matrix
    "li": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(range(4)) AS i,
        unnest([l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100]) AS y FROM lineitem""",
    "lim": "SELECT i, avg(y) AS m, count(*) AS n FROM li GROUP BY i",
    "lic": """SELECT i, k, sum(a * b) / count(*) AS v FROM (
        SELECT unnest(range(16)) // 4 AS i, unnest(range(16)) % 4 AS k,
        unnest([f0 - m0, f0 - m0, f0 - m0, f0 - m0, f1 - m1, f1 - m1, f1 - m1, f1 - m1,
                f2 - m2, f2 - m2, f2 - m2, f2 - m2, f3 - m3, f3 - m3, f3 - m3, f3 - m3]) AS a,
        unnest([f0 - m0, f1 - m1, f2 - m2, f3 - m3, f0 - m0, f1 - m1, f2 - m2, f3 - m3,
                f0 - m0, f1 - m1, f2 - m2, f3 - m3, f0 - m0, f1 - m1, f2 - m2, f3 - m3]) AS b
        FROM (SELECT l_quantity AS f0, l_extendedprice / 1000 AS f1, l_discount * 100 AS f2, l_tax * 100 AS f3 FROM lineitem)
        CROSS JOIN (SELECT avg(l_quantity) AS m0, avg(l_extendedprice / 1000) AS m1, avg(l_discount * 100) AS m2,
                    avg(l_tax * 100) AS m3 FROM lineitem)) GROUP BY i, k""",
    # one curve per user: mean value of each active day, epochs counted from 1
    "curve": """SELECT traj, family, row_number() OVER (PARTITION BY traj ORDER BY t) AS epoch, val FROM
        (SELECT traj, family, t, avg(value) + 1.0::DOUBLE AS val FROM ev GROUP BY ALL)""",
    # run grid at scale: a customer is a cluster, its order prices are the errors
    "runs": """SELECT unnest(['mix', 'step']) AS family, s.seed, o_custkey AS cluster, o_orderpriority AS priority, unnest([
        o_totalprice / 1000, o_totalprice / 1000]) AS dense, unnest([
        o_totalprice / 1000 * (0.97::DOUBLE + 0.01::DOUBLE * ((o_orderkey + s.seed) % 7)),
        o_totalprice / 1000 * (0.95::DOUBLE + 0.02::DOUBLE * ((o_orderkey + 2 * s.seed) % 6))]) AS reduced
        FROM orders CROSS JOIN seeds s""",
    "errgrid": """SELECT family, arm, seed, cluster, avg(v) AS err FROM (SELECT family, seed, cluster, unnest(['dense', 'reduced']) AS arm,
        unnest([dense, reduced]) AS v FROM runs) GROUP BY ALL""",
    "place": "SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS cluster FROM orders)",
    "drawn": f"SELECT rep, idx, count(*) AS w, any_value(n) AS n FROM ({draws('SELECT DISTINCT n FROM place')}) GROUP BY rep, idx",
    "repmse": """SELECT d.rep, g.family, g.arm, g.seed, sum(d.w * g.err) / any_value(d.n) AS mse FROM drawn d JOIN place p ON p.idx = d.idx
        JOIN errgrid g ON g.cluster = p.cluster GROUP BY ALL""",
    "famse": """SELECT family, arm, seed, avg(v) AS mse FROM (SELECT priority AS family, seed, unnest(['dense', 'reduced', 'pod']) AS arm,
        unnest([dense, reduced, reduced * 1.01::DOUBLE]) AS v FROM runs WHERE family = 'mix') GROUP BY ALL""",
    "famratio": """SELECT a.family, a.arm, a.seed, a.mse / b.mse AS ratio FROM famse a JOIN famse b ON b.family = a.family AND b.seed = a.seed
        AND b.arm = 'dense' WHERE a.arm <> 'dense'""",
    "meas": """SELECT l_returnflag AS target, CASE WHEN l_linestatus = 'O' THEN 'dense' ELSE 'budget' END AS scheme, l_linenumber AS seed,
        sum(l_quantity) AS bytes_on_disk, max(l_extendedprice) AS peak_memory, avg(l_extendedprice) / 1000 AS steady_epoch_s,
        avg(l_tax) * 100 AS input_s, avg(l_discount) * 100 AS heldout_error FROM lineitem GROUP BY ALL""",
    "mlong": """SELECT target, scheme, seed, unnest(['bytes_on_disk', 'peak_memory', 'steady_epoch_s', 'input_s', 'heldout_error']) AS metric,
        unnest([bytes_on_disk, peak_memory, steady_epoch_s, input_s, heldout_error]) AS value FROM meas""",
    "file": """SELECT doc_id || '.txt' AS name, strlen(text) AS bytes, sha256(text) AS sha256, md5(text) AS md5,
        source AS family, lang AS role FROM documents""",
}


def with_fragments(sql: str) -> str:
    """Put the fragments a statement names, and those they name, in front of it."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in FRAGMENTS:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(FRAGMENTS[name])
                need.append(name)

    visit(sql)
    head = ", ".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n]})" for n in need)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:]}"
    return f"WITH {head} {body}"
