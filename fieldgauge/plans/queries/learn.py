"""Scoring and learners."""

import numpy as np
from pyspark.sql import functions as F

from fieldgauge.operators import codec
from fieldgauge.operators import learn as ops
from fieldgauge.operators import pairing
from fieldgauge.operators.basis import fit_basis
from fieldgauge.plans import tables
from fieldgauge.plans.queries.registry import query, rd
from fieldgauge.session import cut


class RunningSum:
    """A fixed linear model: multiplication by the upper triangle of ones."""

    def __call__(self, x):
        return x @ np.triu(np.ones((x.shape[1], x.shape[1])))


@query(f"SELECT vec_id, i, {rd('y', 'v')} FROM walk")
def batch_scoring(spark, sf):
    rows = tables.read(spark, sf, "embeddings").select("vec_id", "embedding")
    return ops.score(rows, "embedding", RunningSum()).select("vec_id", F.posexplode("pred").alias("i", "v"))


_IN = "('0x' || substr(md5(s.seed || ':' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT < 0.8::DOUBLE * 4294967296"


@query(f"""SELECT s.seed, {rd("regr_slope(l_extendedprice / 1000, l_quantity)", "weight")}, {rd("regr_intercept(l_extendedprice / 1000, l_quantity)", "bias")}
    FROM lineitem CROSS JOIN seeds s WHERE {_IN} GROUP BY s.seed""")
def linear_fit(spark, sf):
    pairs = tables.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array("l_quantity").alias("x"), F.array(F.col("l_extendedprice") / 1000).alias("y")
    )
    models = ops.fit_linear(pairs, "x", "y", [0, 1, 2], ["l_orderkey", "l_linenumber"], 0.8, ridge=0.0)
    return spark.createDataFrame(
        [(s, float(m.weights[0, 0]), float(m.bias[0])) for s, m in models.items()], "seed int, weight double, bias double"
    )


@query("""SELECT s.seed, count(*) AS n_rows, 0.0::DOUBLE AS max_gap FROM (SELECT a.traj, a.t FROM fr a JOIN fr b ON b.traj = a.traj AND b.t = a.t + 1)
    CROSS JOIN seeds s GROUP BY s.seed""")
def linear_reduced_targets(spark, sf):
    """A linear learner on reduced targets predicts the projection of the dense learner."""
    # the fits and the predictions read their pairs about ten times
    pairs = cut(pairing.pair_strided(tables.frames(spark, sf), stride=1, horizon=None), "pairs")
    fitted = fit_basis(pairs, "y")
    keep = [0, 2]
    coded = cut(codec.encode(pairs, "y", fitted.directions, fitted.mean, keep), "coded")
    key = ["traj", "t"]
    dense = ops.fit_linear(pairs, "x", "y", [0, 1, 2], key)
    reduced = ops.fit_linear(coded, "x", "coef", [0, 1, 2], key)
    both = ops.predict_by_seed(coded, "x", dense, "dense")
    both = codec.project(both, "dense", fitted.directions, fitted.mean, keep, "dense_kept")
    small = ops.predict_by_seed(coded, "x", reduced, "c").select(*key, "seed", "c")
    small = codec.decode(small, "c", fitted.directions, fitted.mean, keep, "reduced")
    joined = both.join(small, [*key, "seed"])
    gap = F.array_max(F.zip_with("dense_kept", "reduced", lambda a, b: F.abs(a - b)))
    return joined.groupBy("seed").agg(F.count(F.lit(1)).alias("n_rows"), F.max(gap).alias("max_gap"))


@query()
def mlp_fit(spark, sf):
    """Validation curve of a small network on (quantity, discount, tax) → price."""
    rows = tables.read(spark, sf, "lineitem").select(
        F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("x"),
        F.array(F.col("l_extendedprice") / 1000).alias("y"),
        ops.in_subsample(0, ["l_orderkey", "l_linenumber"], 0.8).alias("fit"),
    )
    _, curve = ops.fit_mlp(rows.where("fit"), rows.where("not fit"), "x", "y", hidden=(16, 16), epochs=6, rate=0.02)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(curve)], "epoch int, val_mse double")
