"""Fingerprints, reconciliation, shape and consistency gates."""

from pyspark.sql import functions as F

from fieldgauge.functions import ranking
from fieldgauge.operators import gates as ops
from fieldgauge.plans import qualify, tables, walk
from fieldgauge.plans.queries.registry import query, tree_sql
from fieldgauge.session import cut


@query()
def file_fingerprints(spark, sf):
    return ops.fingerprint(spark, sf, "*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256", "md5"
    )


@query("SELECT name, bytes, sha256, md5 FROM file")
def text_fingerprints(spark, sf):
    return tables.files(spark, sf).select("name", "bytes", "sha256", "md5")


# A partial, partly wrong published list derived from the labelled documents.
_PUBLISHED = """SELECT doc_id || CASE WHEN doc_id % 10 = 9 THEN '.dat' ELSE '.txt' END AS name,
    strlen(text) + quality AS bytes, CASE WHEN toxic = 1 THEN md5(text) ELSE sha256(text) END AS sha256
    FROM documents JOIN labels USING (doc_id)"""


def _published(spark, sf):
    docs = tables.read(spark, sf, "documents").join(tables.read(spark, sf, "labels"), "doc_id")
    ending = F.when(F.col("doc_id") % 10 == 9, ".dat").otherwise(".txt")
    return docs.select(
        F.concat(F.col("doc_id").cast("string"), ending).alias("name"),
        (F.octet_length("text") + F.col("quality")).cast("long").alias("bytes"),
        F.when(F.col("toxic") == 1, F.md5("text")).otherwise(F.sha2("text", 256)).alias("sha256"),
    )


_KINDS = f"""SELECT name, unnest(['missing', 'unexpected', 'digest_differs', 'size_differs', 'zero_bytes']) AS kind,
    unnest([fs IS NULL, ps IS NULL, fs <> ps, fb <> pb, fb = 0]) AS hit FROM (
    SELECT coalesce(f.name, p.name) AS name, f.bytes AS fb, f.sha256 AS fs, p.bytes AS pb, p.sha256 AS ps
    FROM file f FULL JOIN ({_PUBLISHED}) p ON f.name = p.name)"""


@query(f"SELECT name, kind FROM ({_KINDS}) WHERE hit")
def manifest_reconcile(spark, sf):
    return ops.reconcile(tables.files(spark, sf), _published(spark, sf))


_COUNTS = ", ".join(f"count(*) FILTER (hit AND kind = '{k}') AS n_{k}" for k in ("missing", "unexpected", "digest_differs", "size_differs", "zero_bytes"))


@query(f"""SELECT 'published' AS list, {_COUNTS}, (SELECT count(*) FROM (SELECT sha256 FROM file GROUP BY sha256 HAVING count(*) > 1)) AS n_duplicate_digest,
    (SELECT count(*) FROM (SELECT family FROM file GROUP BY family HAVING count(DISTINCT role) < (SELECT count(DISTINCT lang) FROM documents))) AS n_incomplete_family,
    (SELECT count(*) FROM documents WHERE doc_id % 97 = 0) AS n_nominal_differs, 1 AS n_role_count_differs, 'MISMATCH' AS status FROM ({_KINDS})
    UNION ALL SELECT 'itself', 0, 0, 0, 0, (SELECT count(*) FROM file WHERE bytes = 0), 0, 0, 0, 0, CASE WHEN (SELECT count(*) FROM file WHERE bytes = 0) = 0 THEN 'MATCH' ELSE 'MISMATCH' END""")
def manifest_status(spark, sf):
    """The published list with every kind of fault, and the files against themselves, first ones of a digest only."""
    files = cut(tables.files(spark, sf), "files")
    needed = [r[0] for r in files.select("role").distinct().collect()]
    number = F.regexp_extract("name", r"^(\d+)", 1).cast("long")
    nominal = files.select("name", (F.col("bytes") + F.when(number % 97 == 0, 1).otherwise(0)).alias("bytes"))
    counts = files.groupBy("role").agg(F.count(F.lit(1)).alias("n_files"))
    wrong = counts.withColumn("n_files", F.col("n_files") + F.when(F.col("role") == "en", 1).otherwise(0))
    bad = ops.reconcile_status(ops.reconcile(files, _published(spark, sf)), files, needed, nominal, wrong)
    first = files.groupBy("sha256").agg(F.min_by(F.struct("name", "bytes"), "name").alias("f")).select("f.*", "sha256").withColumns({"family": F.lit("f"), "role": F.lit("r")})
    own = ops.reconcile_status(
        ops.reconcile(files, files), first, ["r"], files.select("name", "bytes"), first.groupBy("role").agg(F.count(F.lit(1)).alias("n_files"))
    )
    return bad.select(F.lit("published").alias("list"), "*").unionByName(own.select(F.lit("itself").alias("list"), "*"))


@query("SELECT sha256, count(*) AS n_files, min(name) AS first_name FROM file GROUP BY sha256 HAVING count(*) > 1")
def duplicate_digests(spark, sf):
    return ops.duplicate_digests(tables.files(spark, sf))


@query("""SELECT o_custkey AS family, count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN o_orderstatus END) AS n_roles
    FROM orders GROUP BY o_custkey HAVING count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O', 'P') THEN o_orderstatus END) < 3""")
def incomplete_families(spark, sf):
    orders = tables.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("role")
    )
    return ops.incomplete_families(orders, ("F", "O", "P"))


@query(f"""SELECT p.name AS path, 'changed_or_missing' AS reason FROM ({_PUBLISHED}) p
    WHERE NOT EXISTS (SELECT 1 FROM file f WHERE f.name = p.name AND f.bytes = p.bytes AND f.sha256 = p.sha256)""")
def verify_bound(spark, sf):
    found = tables.files(spark, sf).withColumnRenamed("name", "path")
    return ops.verify_bound(found, _published(spark, sf).withColumnRenamed("name", "path"))


@query("""SELECT coalesce(f.user_id, w.user_id) AS user_id, CASE WHEN f.user_id IS NULL THEN 'missing'
    WHEN w.user_id IS NULL THEN 'unexpected' ELSE 'shape_differs' END AS reason
    FROM (SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id) f
    FULL JOIN (SELECT c_custkey AS user_id, 5 AS kinds, 29 AS days FROM customer) w ON f.user_id = w.user_id
    WHERE f.user_id IS NULL OR w.user_id IS NULL OR f.kinds <> w.kinds OR f.days <> w.days""")
def group_schema(spark, sf):
    meta = tables.read(spark, sf, "events").groupBy("user_id").agg(
        F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days")
    )
    expected = tables.read(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit(5).cast("long").alias("kinds"), F.lit(29).cast("long").alias("days")
    )
    return ops.check_groups(meta, expected, "user_id", ["kinds", "days"])


@query("""SELECT family, traj, count(*) AS n_rows, 0 AS n_bad_length, (count(*) FILTER (wild))::BIGINT AS n_not_finite FROM (
    SELECT family, traj, t, bool_or(v > 150) AS wild FROM cell GROUP BY ALL) GROUP BY family, traj
    HAVING count(*) <> 30 OR count(*) FILTER (wild) > 0""")
def row_gate(spark, sf):
    frames = tables.frames(spark, sf)
    spoiled = F.transform("field", lambda v: F.when(v > 150, F.lit(float("nan"))).otherwise(v))
    return ops.check_rows(frames.withColumn("field", spoiled), ["field"], 5, 30, ["family", "traj"])


@query("""WITH have AS (SELECT o_orderpriority AS arm, o_custkey AS seed, count(*) AS n, bool_and(o_orderstatus <> 'P') AS converged,
    bool_and(o_totalprice < 400000) AS finite FROM orders GROUP BY ALL),
    grid AS (SELECT * FROM (SELECT DISTINCT o_orderpriority AS arm FROM orders) CROSS JOIN (SELECT c_custkey AS seed FROM customer))
    SELECT coalesce(g.arm, h.arm) AS arm, coalesce(g.seed, h.seed) AS seed, CASE WHEN h.n IS NULL THEN 'absent'
    WHEN g.arm IS NULL THEN 'unexpected' WHEN h.n > 1 THEN 'repeated' WHEN NOT h.converged THEN 'not_converged' ELSE 'not_finite' END AS reason
    FROM grid g FULL JOIN have h ON g.arm = h.arm AND g.seed = h.seed
    WHERE h.n IS NULL OR g.arm IS NULL OR h.n > 1 OR NOT h.converged OR NOT h.finite""")
def cell_grid(spark, sf):
    orders = tables.read(spark, sf, "orders")
    traces = orders.select(
        F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("seed"),
        (F.col("o_orderstatus") != "P").alias("converged"), (F.col("o_totalprice") < 400000).alias("finite"),
        F.md5(F.col("o_orderkey").cast("string")).alias("sha256"),
    )
    arms = orders.select(F.col("o_orderpriority").alias("arm")).distinct()
    seeds = tables.read(spark, sf, "customer").select(F.col("c_custkey").alias("seed"))
    return ops.check_cells(traces, arms, seeds)


@query("""SELECT c.seed, CASE WHEN c.seed = 1 THEN 'repeated' WHEN c.seed = 2 THEN 'wrong_size' END AS reason
    FROM chosen c WHERE c.seed > 0""")
def index_set_gate(spark, sf):
    w = walk.study(spark, sf)
    selection, order = qualify.choose(walk.predictions(w), w.basis, w.mean, w.width, walk.LADDER)
    ranked = order.select("seed", "rank", "j")
    sets = ranked.join(selection.select("seed", "selected_k"), "seed").where("rank < selected_k")
    first = ranked.where("rank = 0").select("seed", F.col("j").alias("_first"))
    # seed 1 repeats its first direction in the second place; seed 2 loses its last direction
    spoiled = sets.join(first, "seed").select(
        "seed", F.col("rank").alias("pos"),
        F.when((F.col("seed") == 1) & (F.col("rank") == 1), F.col("_first")).otherwise(F.col("j")).alias("j"),
        "selected_k",
    ).where("not (seed = 2 and pos = selected_k - 1)")
    return ops.check_index_set(
        spoiled.drop("selected_k"), ranked, selection.select("seed", F.col("selected_k").alias("k")), ["seed"]
    )


# The little-endian bytes of a 4-byte float from its sign, exponent and fraction.
_BYTES = """SELECT vec_id, label, i, (CASE WHEN e < 0 THEN 2147483648 ELSE 0 END + CASE WHEN e = 0 THEN 0 ELSE (x + 127) * 8388608
    + (abs(e) / pow(2.0::DOUBLE, x) * 8388608 - 8388608)::BIGINT END)::BIGINT AS b FROM (SELECT vec_id, label, i, e,
    CASE WHEN e = 0 THEN 0 WHEN pow(2.0::DOUBLE, floor(log2(abs(e))) + 1) <= abs(e) THEN floor(log2(abs(e))) + 1
         WHEN pow(2.0::DOUBLE, floor(log2(abs(e)))) > abs(e) THEN floor(log2(abs(e))) - 1 ELSE floor(log2(abs(e))) END::BIGINT AS x FROM el)"""
_DIGESTS = f"""SELECT vec_id, label, sha256(unhex(string_agg(printf('%02x%02x%02x%02x', b & 255, (b >> 8) & 255, (b >> 16) & 255, (b >> 24) & 255), '' ORDER BY i))) AS sha256
    FROM ({_BYTES}) GROUP BY vec_id, label"""


@query(f"SELECT vec_id, sha256 FROM ({_DIGESTS})")
def vector_digests(spark, sf):
    return ops.array_digest(tables.read(spark, sf, "embeddings"), "embedding").select("vec_id", "sha256")


@query(f"""WITH RECURSIVE d AS ({_DIGESTS}), {tree_sql("SELECT label AS g, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, sha256 AS key FROM d")}
    SELECT g AS label, n_keys, root FROM tree""")
def collection_digest(spark, sf):
    placed = ranking.ordered_position(tables.read(spark, sf, "embeddings"), ["label"], "vec_id", "pos")
    return ops.collection_digest(placed, "embedding", "pos", by=["label"])


_A = """SELECT o_orderkey, unnest(['custkey', 'priority', 'status']) AS path,
    unnest([o_custkey::VARCHAR, o_orderpriority, o_orderstatus]) AS value FROM orders"""
_B = """SELECT o_orderkey, unnest(['custkey', 'priority', 'status']) AS path, unnest([o_custkey::VARCHAR,
    CASE WHEN o_totalprice > 300000 THEN '9-NONE' ELSE o_orderpriority END, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END]) AS value
    FROM orders WHERE o_totalprice < 450000"""
_DIFF = f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.path, b.path) AS path, a.value AS left, b.value AS right
    FROM ({_A}) a FULL JOIN ({_B}) b ON a.o_orderkey = b.o_orderkey AND a.path = b.path
    WHERE a.value IS DISTINCT FROM b.value OR a.path IS NULL OR b.path IS NULL"""


def _records(spark, sf):
    orders = tables.read(spark, sf, "orders")
    a = orders.select(
        "o_orderkey", F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"), "o_totalprice",
    )
    b = a.where("o_totalprice < 450000").withColumn(
        "priority", F.when(F.col("o_totalprice") > 300000, "9-NONE").otherwise(F.col("priority"))
    ).withColumn("status", F.when(F.col("status") != "P", F.col("status")))
    key = ["o_orderkey"]
    return ops.flat_records(a.drop("o_totalprice"), key), ops.flat_records(b.drop("o_totalprice"), key)


@query(_DIFF)
def record_differences(spark, sf):
    a, b = _records(spark, sf)
    return ops.diff_records(a, b, ["o_orderkey"])


@query(f"SELECT o_orderkey, min(path) AS path, count(*) AS n_differences FROM ({_DIFF}) GROUP BY o_orderkey")
def record_first_difference(spark, sf):
    a, b = _records(spark, sf)
    return ops.first_difference(ops.diff_records(a, b, ["o_orderkey"]), ["o_orderkey"])


@query(f"""SELECT b.o_orderkey, b.path, b.value AS sealed, a.value AS current FROM ({_B}) b
    LEFT JOIN ({_A}) a ON a.o_orderkey = b.o_orderkey AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value""")
def changed_after_seal(spark, sf):
    a, b = _records(spark, sf)
    return ops.changed_after_seal(b, a, ["o_orderkey"])


_CHAIN = """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position, o_orderkey AS stage,
    o_orderstatus AS status, o_orderpriority AS protocol FROM orders"""


@query(f"""SELECT a.o_custkey, a.position, a.stage, CASE WHEN b.status <> 'F' THEN 'predecessor_not_complete' ELSE 'protocol_differs' END AS reason
    FROM ({_CHAIN}) a JOIN ({_CHAIN}) b ON a.o_custkey = b.o_custkey AND a.position = b.position + 1
    WHERE b.status <> 'F' OR b.protocol <> a.protocol""")
def stage_chain(spark, sf):
    orders = tables.read(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("stage"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("OPEN").alias("status"),
        F.col("o_orderpriority").alias("protocol_sha256"),
    )
    return ops.check_chain(ranking.ordered_position(orders, ["o_custkey"], "stage", "position"), ["o_custkey"])


_PAIRED = """SELECT user_id AS seed, event_type AS arm, count(*) AS n, max(CAST(ts AS DATE))::VARCHAR AS last_day,
    bool_or(value > 200) AS large FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL"""


@query(f"""SELECT seed, col FROM (SELECT coalesce(a.seed, b.seed) AS seed, unnest(['n', 'last_day', 'large']) AS col,
    unnest([a.n IS DISTINCT FROM b.n, a.last_day IS DISTINCT FROM b.last_day, a.large IS DISTINCT FROM b.large]) AS hit
    FROM (SELECT * FROM ({_PAIRED}) WHERE arm = 'click') a FULL JOIN (SELECT * FROM ({_PAIRED}) WHERE arm = 'view') b ON a.seed = b.seed) WHERE hit""")
def paired_arms(spark, sf):
    traces = tables.read(spark, sf, "events").groupBy(
        F.col("user_id").alias("seed"), F.col("event_type").alias("arm")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.to_date("ts")).cast("string").alias("last_day"),
        F.bool_or(F.col("value") > 200).alias("large"),
    )
    return ops.check_paired(traces, "click", "view", ["n", "last_day", "large"])
