"""Gains, tails, rungs and ranks."""

from pyspark.sql import functions as F

from fieldgauge.operators import select as ops
from fieldgauge.plans import tables, walk
from fieldgauge.plans.queries.registry import query, rd


def _rows(spark, sf):
    w = walk.study(spark, sf)
    return w, walk.predictions(w).where("role = 'selection'")


def _order(spark, sf):
    w, rows = _rows(spark, sf)
    return w, rows, ops.gain_order(ops.direction_gain(rows, "y", "p", w.basis, w.mean, row=["seed", "vec_id"]))


@query(f"SELECT seed, j, n, {rd('q', 'q')}, {rd('e', 'e')}, {rd('gain', 'gain')} FROM gains")
def direction_gain(spark, sf):
    w, rows = _rows(spark, sf)
    return ops.direction_gain(rows, "y", "p", w.basis, w.mean, row=["seed", "vec_id"])


@query(f"SELECT seed, j, {rd('gpos', 'gpos')}, rank FROM ord")
def gain_order(spark, sf):
    return _order(spark, sf)[2].select("seed", "j", "gpos", "rank")


@query(f"SELECT seed, k, {rd('tail', 'tail')} FROM tails")
def gain_tail(spark, sf):
    return ops.gain_tail(_order(spark, sf)[2])


@query(f"SELECT seed, {rd('mse', 'mse')}, 320 * ((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM embeddings)) + (SELECT count(DISTINCT vec_id) FROM walk WHERE role = 'selection') AS n_rows, {rd('tau', 'tau')}, {rd('threshold', 'threshold')} FROM thr")
def gain_threshold(spark, sf):
    w, rows = _rows(spark, sf)
    return ops.gain_threshold(rows, "y", "p", w.width)


_CHOSEN = f"""SELECT c.seed, {{tau}}{rd("c.threshold", "threshold")}, c.n_rungs, c.n_feasible, c.last_rung, c.selected_k,
    {rd("r.tail", "tail_at_selected")}, {rd("c.threshold - r.tail", "slack")}, {rd("r.prev", "tail_at_previous")},
    false AS used_fallback, CASE WHEN c.selected_k = c.last_rung THEN 'ladder_cap' ELSE '' END AS censor_reasons
    FROM {{src}} c JOIN {{rungs}} r ON r.seed = c.seed AND r.rung = c.selected_k{{on}}"""


@query(_CHOSEN.format(tau="", src="chosen", rungs="rungs", on=""))
def select_rung(spark, sf):
    w, rows, order = _order(spark, sf)
    limits = ops.gain_threshold(rows, "y", "p", w.width)
    got = ops.select_rung(ops.gain_tail(order), walk.LADDER, limits, "full_dim")
    return got.drop("tau").withColumn("censor_reasons", F.concat_ws(",", "censor_reasons"))


@query("""WITH s AS (SELECT h.seed, l.rung, h.threshold, t.tail FROM thr h CROSS JOIN (SELECT unnest([2, 4]) AS rung) l
    JOIN tails t ON t.seed = h.seed AND t.k = l.rung)
    SELECT seed, coalesce(min(rung) FILTER (tail <= threshold), max(rung)) AS selected_k,
    count(*) FILTER (tail <= threshold) = 0 AS used_fallback,
    concat_ws(',', CASE WHEN coalesce(min(rung) FILTER (tail <= threshold), max(rung)) = 4 THEN 'ladder_cap' END,
      CASE WHEN coalesce(min(rung) FILTER (tail <= threshold), max(rung)) = 4 THEN 'basis_cap' END) AS censor_reasons
    FROM s GROUP BY seed""")
def select_rung_censored(spark, sf):
    w, rows, order = _order(spark, sf)
    limits = ops.gain_threshold(rows, "y", "p", w.width)
    got = ops.select_rung(ops.gain_tail(order), (2, 4), limits, "max_rung", caps={"basis_cap": 4})
    return got.select("seed", "selected_k", "used_fallback", F.concat_ws(",", "censor_reasons").alias("censor_reasons"))


@query(_CHOSEN.format(tau=rd("c.tau", "tau") + ", ", src="picks", rungs="steps", on=" AND r.tau = c.tau").replace(
    "FROM picks", "FROM (SELECT seed, tau, threshold, count(*) AS n_rungs, count(*) FILTER (tail <= threshold) AS n_feasible, max(rung) AS last_rung, min(rung) FILTER (tail <= threshold) AS selected_k FROM steps0 GROUP BY ALL)"
).replace("steps r", "steps0 r").replace("SELECT c.seed", """WITH taus AS (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS tau),
    steps0 AS (SELECT r.seed, t.tau, r.rung, r.tail, r.prev, r.threshold * t.tau / 0.05::DOUBLE AS threshold FROM rungs r CROSS JOIN taus t) SELECT c.seed""", 1))
def select_by_tau(spark, sf):
    w, rows, order = _order(spark, sf)
    limits = ops.thresholds_by_tau(ops.gain_threshold(rows, "y", "p", w.width), [0.05, 0.10])
    got = ops.select_rung(ops.gain_tail(order), walk.LADDER, limits, "full_dim")
    return got.withColumn("censor_reasons", F.concat_ws(",", "censor_reasons"))


@query("""SELECT u.user_id, u.rank, count(r.rung) OVER (PARTITION BY u.user_id) AS ladder_size,
    count(r.rung) OVER (PARTITION BY u.user_id) >= 2 AS usable, r.rung FROM
    (SELECT user_id, count(*) AS rank FROM events GROUP BY user_id) u LEFT JOIN
    (SELECT unnest([2, 4, 8, 16, 32, 48, 64, 96, 128, 256, 512, 1024, 2048, 4096]) AS rung) r ON r.rung < u.rank""")
def effective_ladder(spark, sf):
    ranks = tables.read(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("rank"))
    return ops.effective_ladders(ranks)


@query("""WITH n AS (SELECT rung, lead(rung) OVER (ORDER BY rung) AS nxt FROM ladder)
    SELECT c.seed, c.selected_k, CASE WHEN c.selected_k = c.last_rung THEN 'BLOCKED_SELECTOR_CENSORED' ELSE 'RESOLVED' END AS status,
    CASE WHEN c.selected_k <> c.last_rung THEN c.selected_k END AS k_prop, CASE WHEN c.selected_k <> c.last_rung THEN n.nxt END AS k_next
    FROM chosen c JOIN n ON n.rung = c.selected_k""")
def resolve_ranks(spark, sf):
    w, rows, order = _order(spark, sf)
    limits = ops.gain_threshold(rows, "y", "p", w.width)
    got = ops.select_rung(ops.gain_tail(order), walk.LADDER, limits, "full_dim")
    return ops.resolve_ranks(got, walk.LADDER).select("seed", "selected_k", "status", "k_prop", "k_next")


@query("""SELECT c.seed, c.selected_k AS own_k, p.selected_k AS primary_k, count(k.j) AS n_shared, c.seed = 0 AS proposes,
    c.selected_k = p.selected_k AS same_k FROM chosen c CROSS JOIN (SELECT selected_k FROM chosen WHERE seed = 0) p
    JOIN ord o ON o.seed = c.seed AND o.rank < c.selected_k LEFT JOIN keep0 k ON k.j = o.j GROUP BY ALL""")
def selection_stability(spark, sf):
    w, rows, order = _order(spark, sf)
    limits = ops.gain_threshold(rows, "y", "p", w.width)
    got = ops.select_rung(ops.gain_tail(order), walk.LADDER, limits, "full_dim")
    return ops.selection_stability(got, order)


@query("SELECT seed, count(DISTINCT j) AS width, 63 AS rank FROM gains GROUP BY seed")
def gain_width(spark, sf):
    w, rows = _rows(spark, sf)
    return ops.gain_width(ops.direction_gain(rows, "y", "p", w.basis, w.mean, row=["seed", "vec_id"]), w.width - 1)


_CALIBRATION = """SELECT label AS target, list(j ORDER BY s DESC, j) AS gain_order FROM (
    SELECT label, i AS j, avg(y * y) AS s FROM walk GROUP BY label, i) GROUP BY label"""


def _index_sha(index: str) -> str:
    return f"sha256(unhex(array_to_string([h[7:8] || h[5:6] || h[3:4] || h[1:2] FOR h IN [printf('%08x', j) FOR j IN {index}]], '')))"


@query(f"""SELECT target, CASE WHEN target IN (2, 3, 5, 7) THEN 'REJECTED' ELSE 'OK' END AS status,
    CASE target WHEN 7 THEN 'repeated_direction' WHEN 3 THEN 'kept_is_not_the_order_head' WHEN 2 THEN 'order_digest_differs' WHEN 5 THEN 'kept_digest_differs' END AS failed_rule,
    gain_order[1] AS first_direction, {_index_sha("gain_order[1:8]")} AS head_sha256 FROM ({_CALIBRATION})""")
def calibration_ranks(spark, sf):
    from fieldgauge.functions.sums import vector_sums

    rows, _ = walk.fields(spark, sf)
    e = vector_sums(rows, ["y"], ["label"], ["s"], lambda y: (y * y,))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("s") / F.col("n")).alias("s"), "j")))
    records = e.groupBy(F.col("label").alias("target")).agg(F.transform(ordered, lambda p: p["j"]).alias("o"))
    spoiled = F.when(F.col("target") == 7, F.concat(F.slice("o", 1, 63), F.slice("o", 1, 1))).otherwise(F.col("o"))
    kept = F.when(F.col("target") == 3, F.slice("o", 2, 8)).otherwise(F.slice(spoiled, 1, 8))
    records = records.select(
        "target", F.lit(8).alias("k_pred"), F.lit(16).alias("k_oracle"), spoiled.alias("gain_order"), kept.alias("kept_idx"), F.slice("o", 1, 8).alias("head")
    )
    # the digest of target 2's order and of target 5's kept set belong to something else
    signed = records.withColumns({
        "gain_order_sha256": ops.index_sha256(F.when(F.col("target") == 2, F.reverse("gain_order")).otherwise(F.col("gain_order"))),
        "kept_idx_sha256": ops.index_sha256(F.when(F.col("target") == 5, F.reverse("kept_idx")).otherwise(F.col("kept_idx"))),
    })
    return ops.ranks_from_calibration(signed).select(
        "target", "status", "failed_rule", F.col("gain_order")[0].alias("first_direction"), ops.index_sha256(F.col("head")).alias("head_sha256")
    )


@query("""SELECT c.seed, c.selected_k, CASE WHEN c.selected_k = 64 THEN 'NO_REDUCED_BUDGET' WHEN max(o.j) = c.selected_k - 1
    THEN 'GAIN_SET_EQUALS_POD_SET' ELSE 'TEST_NEEDED' END AS terminal FROM chosen c JOIN ord o ON o.seed = c.seed AND o.rank < c.selected_k
    GROUP BY c.seed, c.selected_k""")
def selection_terminal(spark, sf):
    w, rows, order = _order(spark, sf)
    limits = ops.gain_threshold(rows, "y", "p", w.width)
    got = ops.select_rung(ops.gain_tail(order), walk.LADDER, limits, "full_dim")
    sets = order.join(got.select("seed", "selected_k"), "seed").where("rank < selected_k").select("seed", "j")
    return ops.selection_terminal(got, sets, w.width)
