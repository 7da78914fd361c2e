"""Paired bootstrap with customers as clusters, and the seed bootstrap of cost ratios."""

from fieldgauge.operators import boot as ops
from fieldgauge.plans import tables
from fieldgauge.plans.queries.registry import draws, query, rd, tree_sql

_STATS = """SELECT a.rep, a.family, a.arm, median(a.mse / b.mse) AS s FROM repmse a JOIN repmse b ON b.rep = a.rep AND b.family = a.family
    AND b.seed = a.seed AND b.arm = 'dense' WHERE a.arm <> 'dense' GROUP BY ALL"""


@query(f"""SELECT arm, {rd("quantile_cont(s, 0.025)", "lo")}, {rd("quantile_cont(s, 0.975)", "hi")}, count(*) AS replicates
    FROM (SELECT * FROM ({_STATS}) WHERE family = 'mix') GROUP BY arm""")
def paired_bootstrap(spark, sf):
    errors = tables.run_grid(spark, sf).where("family = 'mix'").drop("family")
    return ops.paired_bootstrap(errors)


@query(f"""SELECT arm, {rd("quantile_cont(s, 0.025)", "lo")}, {rd("quantile_cont(s, 0.975)", "hi")}, count(*) AS replicates
    FROM (SELECT rep, arm, max(s) AS s FROM ({_STATS}) GROUP BY rep, arm) GROUP BY arm""")
def portability_bootstrap(spark, sf):
    return ops.paired_bootstrap(tables.run_grid(spark, sf), families=True)


@query(f"SELECT rep, family, arm, seed, {rd('mse', 'mse', 4)} FROM repmse", digits=4)
def replicate_means(spark, sf):
    return ops.replicate_means(tables.run_grid(spark, sf), by=["family", "arm", "seed"])


@query()
def paired_bootstrap_pcg64(spark, sf):
    errors = tables.run_grid(spark, sf).where("family = 'mix'").drop("family")
    return ops.paired_bootstrap(errors, draw="pcg64")


@query(f"""WITH RECURSIVE dw AS MATERIALIZED ({draws("SELECT DISTINCT n FROM place")}),
    b AS (SELECT rep, block, sha256(string_agg(idx::VARCHAR, ',' ORDER BY t)) AS s FROM dw GROUP BY rep, block),
    k AS (SELECT rep, sha256(string_agg(s, chr(10) ORDER BY block)) AS s FROM b GROUP BY rep),
    {tree_sql("SELECT 'draws' AS g, rep AS pos, s AS key FROM k")}
    SELECT n_keys AS replicates, root FROM tree""")
def resample_digest(spark, sf):
    n = tables.read(spark, sf, "orders").select("o_custkey").distinct().count()
    return ops.resample_digest(spark, n)


_SEED_METRICS = ("bytes_on_disk", "peak_memory", "steady_epoch_s", "input_s")


@query(f"""WITH b AS (SELECT target, metric, seed, max(value) FILTER (scheme = 'dense') AS d, max(value) FILTER (scheme = 'budget') AS b FROM mlong
    WHERE metric <> 'heldout_error' GROUP BY ALL HAVING count(DISTINCT scheme) = 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY target, metric ORDER BY seed) - 1 AS idx, count(*) OVER (PARTITION BY target, metric) AS n FROM b),
    dw AS ({draws("SELECT DISTINCT n FROM p WHERE n >= 2")}),
    st AS (SELECT p.target, p.metric, dw.rep, median(p.d) / greatest(median(p.b), 1e-30) AS s FROM dw JOIN p ON p.n = dw.n AND p.idx = dw.idx GROUP BY ALL),
    ci AS (SELECT target, metric, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM st GROUP BY ALL)
    SELECT x.target, x.metric, {rd("x.ratio", "ratio")}, x.n_seeds, {rd("ci.lo", "lo")}, {rd("ci.hi", "hi")}, ci.lo > 1 OR ci.hi < 1 AS excludes_one
    FROM (SELECT target, metric, median(d) / greatest(median(b), 1e-30) AS ratio, count(*) AS n_seeds FROM p GROUP BY ALL) x JOIN ci USING (target, metric)""")
def seed_bootstrap(spark, sf):
    return ops.seed_bootstrap(tables.measurements(spark, sf), _SEED_METRICS)
