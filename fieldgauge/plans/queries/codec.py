"""Encode, decode, project, index sets."""

from pyspark.sql import functions as F

from fieldgauge.operators import codec as ops
from fieldgauge.plans import qualify, walk
from fieldgauge.plans.queries.registry import query, rd

KEEP = [0, 3, 7, 9, 1]
_KEPT = "(VALUES (0, 0), (1, 3), (2, 7), (3, 9), (4, 1)) AS s(pos, j)"


@query(f"SELECT c.vec_id, s.pos, {rd('c.c', 'c')} FROM coef c JOIN {_KEPT} ON s.j = c.j")
def encode(spark, sf):
    w = walk.study(spark, sf)
    coded = ops.encode(w.fields.select("vec_id", "y"), "y", w.basis, w.mean, KEEP)
    return coded.select("vec_id", F.posexplode("coef").alias("pos", "c"))


@query(f"SELECT c.vec_id, c.j AS pos, {rd('c.c', 'c')} FROM coef c")
def encode_by_tiles(spark, sf):
    w = walk.study(spark, sf)
    coded = ops.encode_by_tiles(
        w.fields.select("vec_id", "y"), "y", w.basis, w.mean, None, "coef", tile=24
    )
    return coded.select("vec_id", F.posexplode("coef").alias("pos", "c"))


@query(f"SELECT c.vec_id, s.pos, {rd('c.c', 'c')} FROM coef c JOIN {_KEPT} ON s.j = c.j")
def encode_by_expression(spark, sf):
    w = walk.study(spark, sf)
    coded = ops.encode_by_expression(w.fields.select("vec_id", "y"), "y", w.basis, w.mean, ["vec_id"], KEEP)
    return coded.select("vec_id", F.posexplode("coef").alias("pos", "c"))


@query(f"""SELECT c.vec_id, d.i, {rd("m.m + sum(c.c * d.b)", "v")} FROM coef c JOIN {_KEPT} ON s.j = c.j JOIN dct d ON d.j = c.j
    JOIN mu m ON m.i = d.i GROUP BY c.vec_id, d.i, m.m""")
def decode(spark, sf):
    w = walk.study(spark, sf)
    coded = ops.encode(w.fields.select("vec_id", "y"), "y", w.basis, w.mean, KEEP)
    back = ops.decode(coded.select("vec_id", "coef"), "coef", w.basis, w.mean, KEEP)
    return back.select("vec_id", F.posexplode("field").alias("i", "v"))


@query(f"""SELECT c.seed, c.vec_id, d.i, {rd("m.m + sum(c.ch * d.b)", "v")} FROM pcoef c JOIN {_KEPT} ON s.j = c.j JOIN dct d ON d.j = c.j
    JOIN mu m ON m.i = d.i GROUP BY c.seed, c.vec_id, d.i, m.m""")
def project(spark, sf):
    w = walk.study(spark, sf)
    pred = walk.predictions(w).select("seed", "vec_id", "p")
    return ops.project(pred, "p", w.basis, w.mean, KEEP).select(
        "seed", "vec_id", F.posexplode("projected").alias("i", "v")
    )


@query(f"""SELECT c.seed, c.vec_id, d.i, {rd("m.m + sum(c.ch * d.b)", "v")} FROM pcoef c JOIN {_KEPT} ON s.j = c.j JOIN dct d ON d.j = c.j
    JOIN mu m ON m.i = d.i GROUP BY c.seed, c.vec_id, d.i, m.m""")
def project_by_strips(spark, sf):
    w = walk.study(spark, sf)
    pred = walk.predictions(w).select("seed", "vec_id", "p")
    lifted = ops.project_by_strips(pred, ["p"], w.basis, w.mean, KEEP, size=2)
    return lifted.select("seed", "vec_id", F.posexplode("projected").alias("i", "v"))


@query("""SELECT seed, 'gain' AS arm, rank AS pos, j FROM ord WHERE rank < 16 UNION ALL
    SELECT seed, 'gain_next', rank, j FROM ord WHERE rank < 32 UNION ALL
    SELECT seed, 'pod_prefix', j, j FROM ord WHERE j < 16""")
def arm_sets(spark, sf):
    w = walk.study(spark, sf)
    _, order = qualify.choose(walk.predictions(w), w.basis, w.mean, w.width, walk.LADDER)
    return ops.arm_sets(order, {"gain": 16, "gain_next": 32, "pod_prefix": 16}, ["seed"])


@query("""SELECT seed, arm, count(*) AS k, bool_and(pos = j) AS is_leading_prefix FROM (
    SELECT seed, 'gain' AS arm, rank AS pos, j FROM ord WHERE rank < 4 UNION ALL
    SELECT seed, 'pod_prefix', j, j FROM ord WHERE j < 16) GROUP BY seed, arm""")
def leading_prefix(spark, sf):
    w = walk.study(spark, sf)
    _, order = qualify.choose(walk.predictions(w), w.basis, w.mean, w.width, walk.LADDER)
    sets = ops.arm_sets(order, {"gain": 4, "pod_prefix": 16}, ["seed"])
    return ops.is_leading_prefix(sets, ["seed", "arm"])
