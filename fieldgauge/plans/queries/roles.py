"""Splits, permissions, ledger."""

from pyspark.sql import functions as F

from fieldgauge.functions import ranking
from fieldgauge.operators import roles as ops
from fieldgauge.plans import tables, walk
from fieldgauge.plans.queries.registry import query, rd, scratch, tree_sql
from fieldgauge.session import cut


@query("SELECT family, traj, role, rank FROM roles")
def split_by_trajectory(spark, sf):
    return tables.trajectory_roles(spark, sf).select("family", "traj", "role", "rank")


@query()
def split_by_trajectory_pcg64(spark, sf):
    keys = tables.trajectory_keys(spark, sf)
    return ops.split_by_trajectory(keys, 776131, method="pcg64", weights=tables.WEIGHTS).select(
        "family", "traj", "role", "rank"
    )


_RANKED = "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rank, count(*) OVER () AS n FROM events"


@query(f"""SELECT event_id, rank, CASE WHEN rank < floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS role FROM ({_RANKED})""")
def split_contiguous(spark, sf):
    events = tables.read(spark, sf, "events").select("event_id")
    return ops.split_contiguous(events, "event_id", 0.7).select("event_id", "rank", "role")


@query(f"""WITH r AS ({_RANKED}), b AS (SELECT *, floor(0.6::DOUBLE * n) AS a, floor(0.8::DOUBLE * n) AS b FROM r)
    SELECT event_id, rank, CASE WHEN rank < a THEN 'train' WHEN rank < b THEN 'selection' ELSE 'test' END AS role FROM b
    WHERE rank < a - 25 OR (rank >= a + 25 AND rank < b - 25) OR rank >= b + 25""")
def split_blocks(spark, sf):
    events = tables.read(spark, sf, "events").select("event_id")
    return ops.split_blocks(events, "event_id", (0.6, 0.2, 0.2), embargo=25).select("event_id", "rank", "role")


@query("""SELECT r.r_name AS role, count(*) AS n, sum(c_custkey)::BIGINT AS key_sum FROM customer c JOIN region r
    ON c.c_custkey // (SELECT max(c_custkey) // 5 + 1 FROM customer) = r.r_regionkey GROUP BY r.r_name""")
def split_ranges(spark, sf):
    customers = tables.read(spark, sf, "customer").select("c_custkey")
    step = customers.agg(F.max("c_custkey")).first()[0] // 5 + 1
    ranges = tables.read(spark, sf, "region").select(
        F.col("r_name").alias("role"), (F.col("r_regionkey") * step).alias("lo"),
        ((F.col("r_regionkey") + 1) * step).alias("hi"),
    )
    got = ops.split_ranges(customers, ranges, "c_custkey")
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("key_sum"))


@query("""SELECT family, role, count(*) AS n_keys, sha256(string_agg(traj::VARCHAR, chr(10) ORDER BY rank)) AS sha256
    FROM roles GROUP BY family, role""")
def split_digest(spark, sf):
    return ops.split_digest(tables.trajectory_roles(spark, sf), by=["family", "role"])


@query("""SELECT family, role, count(*) AS n_keys, sha256(unhex(string_agg(h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2], '' ORDER BY rank))) AS sha256
    FROM (SELECT family, role, rank, printf('%016x', traj) AS h FROM roles) GROUP BY family, role""")
def split_digest_int64(spark, sf):
    return ops.split_digest(tables.trajectory_roles(spark, sf), by=["family", "role"], form="int64")


# All orders of a priority as one list in key order.
_ORDERS = "SELECT o_orderpriority AS g, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS key FROM orders"


def _listed_orders(spark, sf):
    rows = tables.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("role"), "o_orderkey")
    return ranking.ordered_position(rows, ["role"], "o_orderkey")


@query(f"WITH RECURSIVE {tree_sql(_ORDERS)} SELECT g AS role, n_keys, root FROM tree")
def index_digest(spark, sf):
    return ops.index_digest(_listed_orders(spark, sf), "o_orderkey")


@query(f"""WITH RECURSIVE {tree_sql(_ORDERS)}, o AS ({_ORDERS}) SELECT g AS role, key AS o_orderkey, root, key % 7 <> 0 AS verified,
    (SELECT max(lvl) FROM lv x WHERE x.g = tree.g AND x.lvl > 0) AS steps FROM o JOIN tree USING (g) WHERE key % 100 = 0 OR key % 7 = 0""")
def index_proofs(spark, sf):
    """Proofs of every hundredth order, and of every seventh, whose key was changed afterwards."""
    held = cut(_listed_orders(spark, sf), "orders")
    asked = held.where("o_orderkey % 100 = 0 OR o_orderkey % 7 = 0")
    proofs = ops.index_proofs(held, "o_orderkey", wanted=asked, carry=["o_orderkey"])
    claimed = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") + 1).otherwise(F.col("o_orderkey"))
    return proofs.select(
        "role", "o_orderkey", "root", (ops.index_root(claimed, F.col("path")) == F.col("root")).alias("verified"), F.size("path").alias("steps")
    )


@query("""SELECT user_id, count(DISTINCT CASE WHEN date_part('day', ts) <= 15 THEN 'early' ELSE 'late' END) AS n_roles
    FROM events GROUP BY user_id HAVING count(DISTINCT CASE WHEN date_part('day', ts) <= 15 THEN 'early' ELSE 'late' END) > 1""")
def role_overlap(spark, sf):
    half = F.when(F.dayofmonth("ts") <= 15, "early").otherwise("late")
    got = ops.check_disjoint(tables.read(spark, sf, "events").select("user_id", half.alias("role")), ["user_id"])
    return got.select("user_id", "n_roles")


@query("""SELECT coalesce(e.role, f.role) AS role, coalesce(e.n, 0) AS n_expected, coalesce(f.n, 0) AS n_found
    FROM (SELECT unnest(['train', 'validation', 'unused', 'selection']) AS role, unnest([n * 11 // 20, n * 4 // 20, n * 2 // 20, n // 4]) AS n
      FROM (SELECT count(*) AS n FROM keys)) e
    FULL JOIN (SELECT role, count(*) AS n FROM roles GROUP BY role) f ON e.role = f.role
    WHERE coalesce(e.n, 0) <> coalesce(f.n, 0)""")
def role_coverage(spark, sf):
    """Roles against the shares of all users together; families round on their own, and no one has ``selection``."""
    roles = tables.trajectory_roles(spark, sf)
    n = tables.trajectory_keys(spark, sf).count()
    expected = spark.createDataFrame(
        [("train", n * 11 // 20), ("validation", n * 4 // 20), ("unused", n * 2 // 20), ("selection", n // 4)],
        "role string, n_expected bigint",
    )
    return ops.check_coverage(roles, expected).select("role", "n_expected", "n_found")


# Event types stand for stages; the role of the user's trajectory is what the stage asked for.
PERMITTED = (
    ("click", "train"), ("view", "train"), ("view", "validation"), ("signup", "validation"), ("purchase", "test"),
)
_PERMITTED = "(VALUES " + ", ".join(f"('{s}', '{r}')" for s, r in PERMITTED) + ") AS m(stage, role)"


def _permissions(spark):
    return spark.createDataFrame(list(PERMITTED), "stage string, role string")


def _asked(spark, sf):
    ev = tables.user_days(spark, sf).join(tables.trajectory_roles(spark, sf), ["family", "traj"])
    return ev.withColumnRenamed("event_type", "stage")


_ASKED = "SELECT e.event_id, e.event_type AS stage, r.role, e.t, e.traj, e.family FROM ev e JOIN roles r ON r.family = e.family AND r.traj = e.traj"


@query(f"""SELECT a.event_id, a.stage, a.role FROM ({_ASKED}) a
    LEFT JOIN {_PERMITTED} ON m.stage = a.stage AND m.role = a.role WHERE m.stage IS NULL""")
def role_permission(spark, sf):
    return ops.check_permission(_asked(spark, sf), _permissions(spark)).select("event_id", "stage", "role")


# Three consecutive events form one request for the trajectories of their users.
_GUARDED = """WITH q AS (SELECT event_id // 3 AS request_id, event_id, family, traj, count(*) OVER (PARTITION BY event_id // 3, traj) AS times FROM ev),
    g AS (SELECT q.request_id, count(*) AS n_ids, count(DISTINCT q.traj) FILTER (r.traj IS NULL) AS n_foreign,
      count(DISTINCT q.traj) FILTER (q.times > 1) AS n_repeated FROM q LEFT JOIN (SELECT * FROM roles WHERE role <> 'test') r
      ON r.family = q.family AND r.traj = q.traj GROUP BY q.request_id)"""


def _requests(spark, sf):
    request = F.floor(F.col("event_id") / 3).alias("request_id")
    asked = tables.user_days(spark, sf).select(request, "event_id", "family", "traj")
    return asked, tables.trajectory_roles(spark, sf).where("role <> 'test'")


@query(f"{_GUARDED} SELECT *, n_foreign = 0 AND n_repeated = 0 AS accepted FROM g")
def request_guard(spark, sf):
    return ops.guard_requests(*_requests(spark, sf))


@query(f"{_GUARDED} SELECT q.request_id, q.event_id FROM q JOIN g USING (request_id) WHERE n_foreign = 0 AND n_repeated = 0")
def accepted_requests(spark, sf):
    return ops.accepted_rows(*_requests(spark, sf)).select("request_id", "event_id")


_NAMED = """SELECT doc_id, source AS path, lang AS role, CASE WHEN contains(source, '0') THEN 'en'
    WHEN contains(source, '1') THEN 'fr' WHEN contains(source, '2') THEN 'de' END AS named_role FROM documents"""


@query(f"SELECT doc_id, path, role, named_role FROM ({_NAMED}) WHERE named_role IS NULL OR named_role <> role")
def file_role_names(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", F.col("source").alias("path"), F.col("lang").alias("role"))
    return ops.check_file_roles(docs, {"de": "2", "fr": "1", "en": "0"})


_LEDGER = f"SELECT stage, role, CASE WHEN event_id % 3 = 0 THEN 'bytes_hashed' ELSE 'field_read' END AS event, 1 AS n FROM ({_ASKED})"


def _ledger(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "bytes_hashed").otherwise("field_read")
    return _asked(spark, sf).select("stage", "role", kind.alias("event"), F.lit(1).alias("n"))


@query(f"""SELECT stage, role, coalesce(sum(n) FILTER (event = 'field_read'), 0)::BIGINT AS fields_read,
    coalesce(sum(n) FILTER (event = 'bytes_hashed'), 0)::BIGINT AS files_hashed, count(*) AS n_events
    FROM ({_LEDGER}) GROUP BY ROLLUP (stage, role)""")
def ledger_summary(spark, sf):
    path = scratch(spark, "ledger")
    events = _ledger(spark, sf)
    ops.log_access(events.where("event = 'field_read'"), path)
    ops.log_access(events.where("event = 'bytes_hashed'"), path)
    return ops.ledger_summary(spark.read.parquet(path))


@query(f"""SELECT l.stage, l.role, sum(l.n)::BIGINT AS fields_read FROM ({_LEDGER}) l LEFT JOIN {_PERMITTED}
    ON m.stage = l.stage AND m.role = l.role WHERE l.event = 'field_read' AND (m.stage IS NULL OR l.role = 'unused')
    GROUP BY l.stage, l.role""")
def ledger_violations(spark, sf):
    return ops.ledger_violations(_ledger(spark, sf), _permissions(spark))


@query("SELECT c.family, count(DISTINCT c.traj) AS n_traj, true AS second_refused FROM roles c WHERE role = 'test' GROUP BY c.family")
def open_once(spark, sf):
    marker = scratch(spark, "marker")
    rows = ops.open_once(spark, marker, lambda: tables.trajectory_roles(spark, sf).where("role = 'test'"))
    try:
        ops.open_once(spark, marker, lambda: rows)
        refused = False
    except ops.Refused:
        refused = True
    return rows.groupBy("family").agg(F.count_distinct("traj").alias("n_traj")).withColumn(
        "second_refused", F.lit(refused)
    )


@query(f"""WITH a AS (SELECT vec_id, role, row_number() OVER (PARTITION BY role ORDER BY vec_id) AS k FROM (SELECT DISTINCT vec_id, role FROM walk)),
    b AS (SELECT vec_id, role, row_number() OVER (PARTITION BY role ORDER BY md5('11:' || vec_id), vec_id) AS k FROM (SELECT DISTINCT vec_id, role FROM walk))
    SELECT a.vec_id, a.role, w.i AS j, {rd("w.y", "y")} FROM a JOIN b ON a.role = b.role AND a.k = b.k JOIN walk w ON w.vec_id = b.vec_id
    WHERE a.role <> 'test'
    UNION ALL SELECT vec_id, role, i, {rd("y", "y")} FROM walk WHERE role = 'test'""")
def shuffled_control(spark, sf):
    rows, _ = walk.fields(spark, sf)
    out = ops.shuffle_within(
        rows.select("vec_id", "role", "y"), 11, ["vec_id"], "vec_id", blocks=["train", "selection"]
    )
    return out.select("vec_id", "role", F.posexplode("y").alias("j", "y"))


@query("SELECT k.family, k.traj FROM keys k WHERE NOT EXISTS (SELECT 1 FROM roles r WHERE r.family = k.family AND r.traj = k.traj AND r.role <> 'unused')")
def reserve_pool(spark, sf):
    """The keys no role that is opened holds."""
    opened = tables.trajectory_roles(spark, sf).where("role <> 'unused'")
    return ops.reserve(tables.trajectory_keys(spark, sf), opened)


@query("""SELECT o_custkey AS family, count(DISTINCT o_orderstatus) AS n_roles FROM orders
    WHERE o_orderstatus IN ('F', 'O', 'P') AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
    GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 3 ORDER BY o_custkey LIMIT 8""")
def select_cohort(spark, sf):
    orders = tables.read(spark, sf, "orders")
    found = orders.select(F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("role"))
    used = orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("family")).distinct()
    return ops.select_cohort(found, used, 8, ("F", "O", "P"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank FROM events""")
def position_in_trajectory(spark, sf):
    events = tables.read(spark, sf, "events").select("user_id", "event_id")
    return ranking.ordered_position(events, ["user_id"], "event_id")
