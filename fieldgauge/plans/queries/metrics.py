"""Errors, floors, decomposition, persistence."""

from pyspark.sql import functions as F

from fieldgauge.operators import codec
from fieldgauge.operators import metrics as ops
from fieldgauge.operators import pairing
from fieldgauge.plans import qualify, tables, walk
from fieldgauge.plans.queries.registry import query, rd

KEEP = [0, 3, 7, 9, 1]
_SET = "(0, 3, 7, 9, 1)"
_PRED_ERR = "SELECT seed, vec_id, label, role, avg((y - p) * (y - p)) AS e FROM pred GROUP BY ALL"


def _study(spark, sf):
    w = walk.study(spark, sf)
    return w, walk.predictions(w)


@query(f"SELECT seed, vec_id, {rd('e', 'mse')} FROM ({_PRED_ERR})")
def row_mse(spark, sf):
    _, pred = _study(spark, sf)
    return pred.select("seed", "vec_id", ops.row_mse("y", "p").alias("mse"))


@query(f"SELECT seed, vec_id, {rd('e', 'mse')} FROM ({_PRED_ERR})")
def row_mse_by_batch(spark, sf):
    _, pred = _study(spark, sf)
    return ops.row_mse_batch(pred, "y", "p").select("seed", "vec_id", "mse")


@query(f"SELECT 'dense' AS arm, seed, label AS cluster, count(*) AS n_rows, {rd('avg(e)', 'err')} FROM ({_PRED_ERR}) WHERE role = 'test' GROUP BY seed, label")
def cluster_mse(spark, sf):
    _, pred = _study(spark, sf)
    rows = pred.where("role = 'test'").withColumn("arm", F.lit("dense"))
    return ops.cluster_mse(rows, "y", "p", cluster="label").withColumnRenamed("label", "cluster")


@query(f"SELECT seed, role, {rd('avg(e)', 'mse')}, count(*) AS n_rows FROM ({_PRED_ERR}) GROUP BY seed, role")
def overall_mse(spark, sf):
    _, pred = _study(spark, sf)
    return ops.overall_mse(pred, "y", "p", ["seed", "role"])


@query(f"""SELECT arm, seed, {rd("avg(err)", "mse")}, count(*) AS n_clusters FROM cells GROUP BY arm, seed""")
def mean_of_cluster_means(spark, sf):
    w, pred = _study(spark, sf)
    _, keep = qualify.primary_set(pred, w)
    return ops.mean_of_cluster_means(qualify.cell_errors(pred, w.basis, w.mean, keep))


# A basis that is not orthonormal: twice the cosine rows plus the next one, so BBᵀ matters.
_SKEW = """SELECT a.j, a.i, 2 * a.b + n.b AS b FROM dct a JOIN dct n ON n.i = a.i AND n.j = a.j + 1 WHERE a.j < 8"""


def _skew_basis(w):
    nxt = w.basis.select((F.col("j") - 1).alias("j"), F.col("vec").alias("n"))
    return w.basis.join(nxt, "j").where("j < 8").select(
        "j", F.zip_with("vec", "n", lambda a, b: 2 * a + b).alias("vec"), "eigval"
    )


@query(f"""WITH sk AS MATERIALIZED ({_SKEW}), g AS (SELECT a.j, b.j AS k, sum(a.b * b.b) AS g FROM sk a JOIN sk b USING (i) GROUP BY ALL),
    e AS MATERIALIZED (SELECT p.seed, p.vec_id, s.j, sum((p.y - p.p) * s.b) AS e FROM pred p JOIN sk s USING (i) WHERE p.role = 'test' GROUP BY ALL)
    SELECT a.seed, {rd("sum(a.e * g.g * b.e) / (count(DISTINCT a.vec_id) * 64)", "mse")}, count(DISTINCT a.vec_id) AS n_rows
    FROM e a JOIN g ON g.j = a.j JOIN e b ON b.seed = a.seed AND b.vec_id = a.vec_id AND b.j = g.k GROUP BY a.seed""")
def coefficient_loss(spark, sf):
    w, pred = _study(spark, sf)
    basis = _skew_basis(w)
    keep = list(range(8))
    coded = codec.encode(pred.where("role = 'test'").select("seed", "y", "p"), ["y", "p"], basis, w.mean, keep)
    return ops.coeff_loss(coded, "c_y", "c_p", basis, keep)


@query(f"""SELECT seed, {rd("avg((c - ch) * (c - ch))", "mse")}, count(DISTINCT vec_id) AS n_rows FROM pcoef
    WHERE role = 'selection' AND j IN {_SET} GROUP BY seed""")
def coefficient_mse(spark, sf):
    w, pred = _study(spark, sf)
    coded = codec.encode(pred.where("role = 'selection'").select("seed", "y", "p"), ["y", "p"], w.basis, w.mean, KEEP)
    return ops.coefficient_mse(coded, "c_y", "c_p")


_FLOOR = f"""SELECT e.label, e.role, (e.e - k.cc) / 64 AS f FROM energy e JOIN
    (SELECT vec_id, sum(c * c) AS cc FROM coef WHERE j IN {_SET} GROUP BY vec_id) k USING (vec_id)"""


@query(f"SELECT role, {rd('avg(f)', 'floor')}, count(*) AS n_rows FROM ({_FLOOR}) GROUP BY role")
def floor_perp(spark, sf):
    w = walk.study(spark, sf)
    return ops.floor_perp(w.fields, "y", w.basis, w.mean, KEEP, ["role"])


@query(f"SELECT label, {rd('avg(f)', 'floor')}, count(*) AS n_rows FROM ({_FLOOR}) WHERE role = 'test' GROUP BY label")
def floor_per_trajectory(spark, sf):
    w = walk.study(spark, sf)
    return ops.floor_perp(w.fields.where("role = 'test'"), "y", w.basis, w.mean, KEEP, ["label"])


@query(f"""SELECT s.seed, {rd("s.a", "r_compact")}, {rd("s.o", "r_perp")}, {rd("s.p", "r_parallel")}, 0.0::DOUBLE AS closure FROM (
    SELECT k.seed, avg((e.e - k.cc + k.miss) / 64) AS a, avg((e.e - k.cc) / 64) AS o, avg(k.miss / 64) AS p FROM energy e JOIN
    (SELECT seed, vec_id, sum(c * c) AS cc, sum((c - ch) * (c - ch)) AS miss FROM pcoef WHERE j IN {_SET} GROUP BY ALL) k
    USING (vec_id) WHERE e.role = 'test' GROUP BY k.seed) s""")
def error_decomposition(spark, sf):
    w, pred = _study(spark, sf)
    return ops.decompose(pred.where("role = 'test'"), "y", "p", w.basis, w.mean, KEEP)


_MOVES = """SELECT a.family, a.traj, a.t, avg((a.v - b.v) * (a.v - b.v)) AS e FROM cell a JOIN cell b
    ON b.family = a.family AND b.traj = a.traj AND b.t = a.t + 1 AND b.j = a.j GROUP BY ALL"""


@query(f"SELECT family, {rd('avg(e) / 1000', 'mse')}, count(*) AS n_rows FROM ({_MOVES}) GROUP BY family")
def persistence(spark, sf):
    pairs = pairing.pair_strided(tables.frames(spark, sf), stride=1, horizon=None)
    return ops.persistence(pairs, ["family"]).withColumn("mse", F.col("mse") / 1000)


@query(f"SELECT traj, {rd('avg(e) / 1000', 'mse')}, count(*) AS n_rows FROM ({_MOVES}) GROUP BY traj")
def persistence_per_trajectory(spark, sf):
    pairs = pairing.pair_strided(tables.frames(spark, sf), stride=1, horizon=None)
    return ops.persistence(pairs, ["traj"]).withColumn("mse", F.col("mse") / 1000)


# The reference predictor of a family: shrink the current frame by a seed-dependent factor.
_SHRUNK = """SELECT a.family, s.seed, avg(((0.2::DOUBLE + 0.3::DOUBLE * s.seed) * a.v - b.v) * ((0.2::DOUBLE + 0.3::DOUBLE * s.seed) * a.v - b.v)) AS mse FROM cell a
    JOIN cell b ON b.family = a.family AND b.traj = a.traj AND b.t = a.t + 1 AND b.j = a.j CROSS JOIN seeds s GROUP BY a.family, s.seed"""


@query(f"""SELECT d.family, {rd("max(p.mse) / 1000", "persistence")}, {rd("median(d.mse) / 1000", "median_mse")},
    bool_and(d.mse < p.mse) AS every_seed_better, median(d.mse) < max(p.mse) AS median_better FROM ({_SHRUNK}) d
    JOIN (SELECT family, avg(e) AS mse FROM ({_MOVES}) GROUP BY family) p USING (family) GROUP BY d.family""")
def dense_qualification(spark, sf):
    pairs = pairing.pair_strided(tables.frames(spark, sf), stride=1, horizon=None)
    spread = pairs.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    guess = F.transform("x", lambda v: (F.lit(0.2) + F.lit(0.3) * F.col("seed")) * v)
    dense = ops.overall_mse(spread.withColumn("p", guess), "y", "p", ["family", "seed"])
    got = ops.qualify_dense(dense, ops.persistence(pairs, ["family"]))
    return got.withColumn("persistence", F.col("persistence") / 1000).withColumn("median_mse", F.col("median_mse") / 1000)
