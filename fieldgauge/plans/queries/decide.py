"""Ratios, medians, counts, costs, verdicts; and the whole decision."""

from pyspark.sql import functions as F

from fieldgauge.operators import decide as ops
from fieldgauge.plans import qualify as plan
from fieldgauge.plans import tables, walk
from fieldgauge.plans.queries.registry import draws, query, rd


def _ratios(spark, sf):
    return ops.seed_ratios(tables.family_mse(spark, sf), by=["family"])


@query(f"SELECT family, arm, seed, {rd('ratio', 'ratio')} FROM famratio")
def seed_ratios(spark, sf):
    return _ratios(spark, sf)


@query(f"SELECT family, arm, {rd('median(ratio)', 'point')}, count(*) AS n_seeds FROM famratio GROUP BY family, arm")
def quality_point(spark, sf):
    return ops.quality_point(_ratios(spark, sf), ["family", "arm"])


@query(f"""SELECT f.family AS arm, {rd("median(f.m / 2 / d.mse)", "point")} FROM (SELECT family, avg(mse) AS m FROM famse WHERE arm = 'reduced' GROUP BY family) f
    CROSS JOIN (SELECT seed, avg(mse) AS mse FROM famse WHERE arm = 'pod' GROUP BY seed) d GROUP BY f.family""")
def floor_point(spark, sf):
    mse = tables.family_mse(spark, sf)
    floors = mse.where("arm = 'reduced'").groupBy(F.col("family").alias("arm")).agg((F.avg("mse") / 2).alias("floor"))
    dense = mse.where("arm = 'pod'").groupBy("seed").agg(F.avg("mse").alias("mse"))
    return ops.floor_point(floors, dense)


_PORT = """SELECT arm, max(p) AS q_port, arg_max(family, p) AS worst_family, count(*) AS n_families FROM (
    SELECT arm, family, median(ratio) AS p FROM famratio GROUP BY arm, family) GROUP BY arm"""


@query(f"SELECT arm, {rd('q_port', 'q_port')}, worst_family, n_families FROM ({_PORT})")
def portability(spark, sf):
    return ops.portability(_ratios(spark, sf))


@query(f"SELECT arm, n_families, CASE WHEN q_port <= 1.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({_PORT})")
def portability_verdict(spark, sf):
    return ops.portability(_ratios(spark, sf)).select("arm", "n_families", ops.pass_fail(F.col("q_port")).alias("verdict"))


@query(f"""SELECT arm, count(*) AS n_runs, count(*) FILTER (ratio > 1) AS n_above_one, count(*) FILTER (ratio > 1.005::DOUBLE) AS n_above_tolerance,
    bool_and(ratio <= 1.005::DOUBLE) AS all_within, {rd("max(ratio)", "max_ratio")} FROM famratio GROUP BY arm""")
def seed_counts(spark, sf):
    return ops.seed_counts(_ratios(spark, sf), tolerance=1.005)


@query(f"""SELECT a.family, {rd("median(a.mse / b.mse)", "point")}, count(*) AS n_seeds FROM famse a JOIN famse b ON b.family = a.family AND b.seed = a.seed
    WHERE a.arm = 'reduced' AND b.arm = 'pod' GROUP BY a.family""")
def arm_against_arm(spark, sf):
    mse = tables.family_mse(spark, sf).where("arm <> 'dense'")
    return ops.quality_point(ops.seed_ratios(mse, "pod", ["family"]), ["family"])


@query(f"SELECT target, scheme, metric, {rd('median(value)', 'median')}, {rd('min(value)', 'min')}, {rd('max(value)', 'max')}, count(value) AS n FROM mlong GROUP BY ALL")
def measurement_summary(spark, sf):
    return ops.summarise(tables.measurements(spark, sf), ["target", "scheme"], tables.METRICS)


_COST = """SELECT target, metric, median(value) FILTER (scheme = 'dense') AS dense, median(value) FILTER (scheme = 'budget') AS budget
    FROM mlong GROUP BY target, metric HAVING count(*) FILTER (scheme = 'dense') > 0 AND count(*) FILTER (scheme = 'budget') > 0"""


def _cost(spark, sf):
    return ops.cost_ratios(ops.summarise(tables.measurements(spark, sf), ["target", "scheme"], tables.METRICS))


@query(f"""SELECT target, metric, {rd("dense", "dense")}, {rd("budget", "budget")},
    {rd("CASE WHEN metric = 'heldout_error' THEN budget / dense - 1 ELSE dense / budget END", "value")},
    CASE WHEN metric = 'heldout_error' THEN 'error_excess' ELSE 'dense_over_budget' END AS kind FROM ({_COST})""")
def cost_ratios(spark, sf):
    return _cost(spark, sf)


@query(f"""WITH w AS (SELECT target, max(dense / budget) FILTER (metric = 'peak_memory') AS memory_ratio,
    max(dense / budget) FILTER (metric = 'steady_epoch_s') AS epoch_ratio, max(budget - dense) FILTER (metric = 'input_s') AS i,
    max(budget - 1.05::DOUBLE * dense) FILTER (metric = 'heldout_error') AS e FROM ({_COST}) GROUP BY target)
    SELECT target, {rd("memory_ratio", "memory_ratio")}, {rd("epoch_ratio", "epoch_ratio")},
    bool_and(memory_ratio < 1.05 AND epoch_ratio < 1.05) OVER () AS h0a, bool_or(i > 0) OVER () AS h0b, e > 0 AS h0c FROM w""")
def cost_flags(spark, sf):
    return ops.cost_flags(_cost(spark, sf))


_EPOCHS = """SELECT l_suppkey AS run, date_part('year', l_shipdate) * 12 + date_part('month', l_shipdate) AS epoch, sum(l_extendedprice) / 1000 AS epoch_s,
    sum(l_tax) AS read_s, sum(l_discount) AS transfer_s, sum(l_quantity) / 1000 AS decode_s, count(*)::DOUBLE AS step_s FROM lineitem GROUP BY ALL"""


@query(f"""WITH e AS (SELECT *, epoch = min(epoch) OVER (PARTITION BY run) AS cold, count(*) OVER (PARTITION BY run) = 1 AS one FROM ({_EPOCHS})),
    p AS (SELECT run, max(epoch_s) FILTER (cold) AS cold_epoch_s, median(epoch_s) FILTER (NOT cold OR one) AS steady_epoch_s, median(read_s) FILTER (NOT cold OR one) AS steady_read_s,
    median(transfer_s) FILTER (NOT cold OR one) AS steady_transfer_s, median(decode_s) FILTER (NOT cold OR one) AS steady_decode_s, median(step_s) FILTER (NOT cold OR one) AS steady_step_s,
    min(epoch_s) FILTER (NOT cold OR one) AS steady_min, max(epoch_s) FILTER (NOT cold OR one) AS steady_max, count(*) FILTER (NOT cold OR one) AS n_steady FROM e GROUP BY run)
    SELECT run, {", ".join(rd(c, c) for c in ("cold_epoch_s", "steady_epoch_s", "steady_read_s", "steady_transfer_s", "steady_decode_s", "steady_step_s", "steady_min", "steady_max"))},
    n_steady, {rd("steady_read_s + steady_transfer_s + steady_decode_s", "input_s")} FROM p""")
def epoch_profile(spark, sf):
    epochs = tables.read(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("run"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("epoch")
    ).agg(
        (F.sum("l_extendedprice") / 1000).alias("epoch_s"), F.sum("l_tax").alias("read_s"), F.sum("l_discount").alias("transfer_s"),
        (F.sum("l_quantity") / 1000).alias("decode_s"), F.count(F.lit(1)).cast("double").alias("step_s"),
    )
    return ops.epoch_profile(epochs, ["run"])


# Verdicts over a table of points: every customer is a study, its order statistics are its numbers.
_POINTS = """SELECT o_custkey AS study, 1 + (avg(o_totalprice) - 250000) / 2500000 AS q, 1 + (min(o_totalprice) - 100000) / 1000000 AS f,
    1 + (max(o_totalprice) - 450000) / 1000000 AS hi, 1 + ((max(o_totalprice) + min(o_totalprice)) / 2 - 250000) / 2000000 AS p FROM orders GROUP BY o_custkey"""


def _points(spark, sf):
    return tables.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("study")).agg(
        (1 + (F.avg("o_totalprice") - 250000) / 2500000).alias("q"), (1 + (F.min("o_totalprice") - 100000) / 1000000).alias("f"),
        (1 + (F.max("o_totalprice") - 450000) / 1000000).alias("hi"), (1 + ((F.max("o_totalprice") + F.min("o_totalprice")) / 2 - 250000) / 2000000).alias("p"),
    )


@query(f"""SELECT study, CASE WHEN f >= 1.05 THEN 'REPRESENTATIONAL_SHORTFALL' WHEN q > 1.05 THEN 'OPTIMISATION_OR_GENERALISATION_SHORTFALL'
    ELSE 'TOLERANCE_MET_UNDER_CONVERGENCE' END AS verdict FROM ({_POINTS})""")
def verdict_three_way(spark, sf):
    return _points(spark, sf).select("study", ops.verdict3(F.col("q"), F.col("f")).alias("verdict"))


@query(f"""SELECT study, k, CASE WHEN q <= 1.05 THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN k = 64 THEN 'no_reduced_supervision_admitted'
    WHEN q <= 1.05 THEN 'second_PDE_same_MLP_fresh_retraining_support' ELSE 'selector_did_not_transfer_to_fresh_retraining_on_this_PDE' END AS reading
    FROM (SELECT *, CASE WHEN f > 1.2 THEN 64 ELSE 8 END AS k FROM ({_POINTS}))""")
def verdict_pass_fail(spark, sf):
    rows = _points(spark, sf).withColumn("k", F.when(F.col("f") > 1.2, 64).otherwise(8))
    return rows.select(
        "study", "k", ops.pass_fail(F.col("q")).alias("verdict"), ops.interpretation(F.col("q"), F.col("k"), F.lit(64)).alias("reading")
    )


@query(f"""SELECT study, CASE WHEN q <= 1.05 AND p <= 1.05 THEN 'BOTH_PASS' WHEN q <= 1.05 THEN 'GAIN_ONLY' WHEN p <= 1.05 THEN 'POD_ONLY'
    ELSE 'BOTH_FAIL' END AS verdict FROM ({_POINTS})""")
def verdict_matched_rank(spark, sf):
    return _points(spark, sf).select("study", ops.verdict4(F.col("q"), F.col("p")).alias("verdict"))


@query(f"SELECT study, CASE WHEN f > 1.05 THEN 'REJECTED_BY_FLOOR' ELSE 'INCONCLUSIVE' END AS screen FROM ({_POINTS})")
def floor_screen(spark, sf):
    return _points(spark, sf).select("study", ops.floor_screen(F.col("f")).alias("screen"))


@query(f"SELECT study, CASE WHEN greatest(f, hi) < 1.05 THEN 'BELOW' WHEN least(f, hi) > 1.05 THEN 'ABOVE' ELSE 'CONTAINS' END AS place FROM ({_POINTS})")
def interval_placement(spark, sf):
    lo, hi = F.least("f", "hi"), F.greatest("f", "hi")
    return _points(spark, sf).select("study", ops.placement(lo, hi).alias("place"))


# The draws of the walk study run over label clusters.
_WALK_BOOT = f"""lab AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM cells)),
    dw AS ({draws("SELECT DISTINCT n FROM lab")}),
    rm AS (SELECT d.rep, c.arm, c.seed, avg(c.err) AS mse FROM dw d JOIN lab l ON l.idx = d.idx JOIN cells c ON c.cluster = l.cluster GROUP BY ALL),
    st AS (SELECT a.rep, a.arm, median(a.mse / b.mse) AS s FROM rm a JOIN rm b ON b.rep = a.rep AND b.seed = a.seed AND b.arm = 'dense' WHERE a.arm <> 'dense' GROUP BY ALL),
    ci AS (SELECT arm, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM st GROUP BY arm),
    pt AS (SELECT arm, median(ratio) AS q FROM ratios GROUP BY arm)"""


@query(f"""WITH {_WALK_BOOT}, one AS (SELECT (SELECT q FROM pt WHERE arm = 'reduced') AS q, (SELECT q FROM pt WHERE arm = 'floor') AS f,
    (SELECT lo FROM ci WHERE arm = 'reduced') AS ql, (SELECT hi FROM ci WHERE arm = 'reduced') AS qh,
    (SELECT lo FROM ci WHERE arm = 'floor') AS fl, (SELECT hi FROM ci WHERE arm = 'floor') AS fh)
    SELECT c.selected_k AS k, {rd("c.threshold - r.tail", "slack")}, (SELECT bool_and(j = pos) FROM keep0) AS is_leading_prefix,
    {rd("q", "quality")}, {rd("ql", "quality_lo")}, {rd("qh", "quality_hi")}, {rd("f", "floor")}, {rd("fl", "floor_lo")}, {rd("fh", "floor_hi")},
    CASE WHEN qh < 1.05 THEN 'BELOW' WHEN ql > 1.05 THEN 'ABOVE' ELSE 'CONTAINS' END AS interval,
    CASE WHEN f >= 1.05 THEN 'REPRESENTATIONAL_SHORTFALL' WHEN q > 1.05 THEN 'OPTIMISATION_OR_GENERALISATION_SHORTFALL' ELSE 'TOLERANCE_MET_UNDER_CONVERGENCE' END AS verdict
    FROM chosen c JOIN rungs r ON r.seed = c.seed AND r.rung = c.selected_k CROSS JOIN one WHERE c.seed = 0""")
def qualify(spark, sf):
    w = walk.study(spark, sf)
    return plan.qualify(walk.predictions(w), w.basis, w.mean, w.width, walk.LADDER)
