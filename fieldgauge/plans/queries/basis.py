"""Means, covariances, Grams and bases."""

import numpy as np
from pyspark.sql import functions as F

from fieldgauge.functions import ranking
from fieldgauge.functions.vectors import dot
from fieldgauge.operators import basis as ops
from fieldgauge.plans import tables, walk
from fieldgauge.plans.queries.registry import query, rd
from fieldgauge.session import cut


@query(f"SELECT label, i AS j, count(*) AS n, {rd('avg(y)', 'mean')} FROM walk GROUP BY label, i")
def vector_mean(spark, sf):
    rows, _ = walk.fields(spark, sf)
    return ops.vec_mean(rows, "y", ["label"])


@query(f"SELECT i, k, (SELECT max(n) FROM lim) AS n, {rd('v', 'value')} FROM lic WHERE i <= k")
def covariance(spark, sf):
    return ops.covariance(tables.matrix(spark, sf), "y", block=3)


@query(f"""SELECT a.i, b.i AS k, count(*) AS n, {rd("sum((a.y - ma.m) * (b.y - mb.m))", "value", 5)} FROM walk a JOIN walk b ON a.vec_id = b.vec_id AND a.i <= b.i
    JOIN mu ma ON ma.i = a.i JOIN mu mb ON mb.i = b.i WHERE a.role = 'train' GROUP BY a.i, b.i""", digits=5)
def raw_scatter(spark, sf):
    w = walk.study(spark, sf)
    return ops.covariance(w.fields.where("role = 'train'"), "y", denom="one", block=24)


# Sample-side Gram: a row per day, a column per user; N stays below D as users grow.
_DAYU = "SELECT t, traj, sum(value) AS v FROM ev GROUP BY t, traj"


def _day_blocks(spark, sf):
    """``(row, blk, seg)`` with blocks of 64 users; a missing (day, user) is zero."""
    ev = tables.user_days(spark, sf).groupBy("t", "traj").agg(F.sum("value").alias("v"))
    days = ev.select("t").distinct()
    n = days.count()
    rows = ranking.ordered_position(days, [], "t", "row")
    users = ranking.ordered_position(ev.select("traj").distinct(), [], "traj", "col")
    d = users.count()
    block = 64
    cells = ev.join(rows, "t").join(users, "traj").select(
        F.col("row").cast("int").alias("row"), F.floor(F.col("col") / block).cast("int").alias("blk"),
        (F.col("col") % block).cast("int").alias("at"), "v",
    )
    width = F.least(F.lit(block), F.lit(d) - F.col("blk") * block).cast("int")
    held = F.map_from_entries(F.collect_list(F.struct("at", "v")))
    grid = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0.0)))
    got = cells.groupBy("row", "blk").agg(held.alias("_m"))
    return got.select("row", "blk", grid.alias("seg")), n, d


@query(f"""SELECT a.t - (SELECT min(t) FROM ev) AS r, b.t - (SELECT min(t) FROM ev) AS k, {rd("sum(a.v * b.v) / 1000", "g", 4)}
    FROM ({_DAYU}) a JOIN ({_DAYU}) b ON a.traj = b.traj GROUP BY a.t, b.t""", digits=4)
def sample_gram(spark, sf):
    blocks, n, _ = _day_blocks(spark, sf)
    got = ops.row_gram(blocks, n)
    return got.select("r", F.posexplode("g").alias("k", "g")).withColumn("g", F.col("g") / 1000).where("g <> 0")


_CENTRED = """SELECT d.t, u.traj, coalesce(x.v, 0) - u.s / (SELECT count(DISTINCT t) FROM ev) AS v FROM (SELECT DISTINCT t FROM ev) d
    CROSS JOIN (SELECT traj, sum(value) AS s FROM ev GROUP BY traj) u LEFT JOIN ({}) x ON x.t = d.t AND x.traj = u.traj""".format(_DAYU)


@query(f"""SELECT a.t - (SELECT min(t) FROM ev) AS r, b.t - (SELECT min(t) FROM ev) AS k, {rd("sum(a.v * b.v) / 1000", "g", 4)}
    FROM ({_CENTRED}) a JOIN ({_CENTRED}) b ON a.traj = b.traj GROUP BY a.t, b.t""", digits=4)
def lean_centred_gram(spark, sf):
    blocks, n, _ = _day_blocks(spark, sf)
    got = ops.row_gram(blocks, n, centered="algebraic")
    return got.select("r", F.posexplode("g").alias("k", "g")).withColumn("g", F.col("g") / 1000)


@query(f"SELECT t - (SELECT min(t) FROM ev) AS r, dense_rank() OVER (ORDER BY traj) - 1 AS col, {rd('v', 'v', 4)} FROM ({_CENTRED})", digits=4)
def lifted_directions(spark, sf):
    """The centred data rebuilt as UΣVᵀ from the Gram's eigenvectors and the lifted directions."""
    blocks, n, _ = _day_blocks(spark, sf)
    gram = np.zeros((n, n))
    for r in ops.row_gram(blocks, n, centered="algebraic").toLocalIterator():
        gram[r["r"]] = r["g"]
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    sigma = np.sqrt(np.clip(values, 0, None))
    keep = np.flatnonzero(sigma > sigma.max() * 1e-7)
    lifted = ops.lift_directions(blocks, vectors[:, keep], sigma[keep])
    weights = spark.createDataFrame(
        [(int(p), int(r), float(vectors[r, j] * sigma[j])) for p, j in enumerate(keep) for r in range(n)],
        "j int, r int, w double",
    )
    cells = lifted.select("j", F.posexplode("vec").alias("col", "v")).join(weights, "j")
    return cells.groupBy("r", "col").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def _moments(df, top="n"):
    """Power sums of the spectrum, scaled by the largest trace so that they print well."""
    total = df.agg(
        F.sum("eigval").alias("m1"), F.sum(F.col("eigval") ** 2).alias("m2"),
        F.sum(F.col("eigval") ** 3).alias("m3"), F.sum(F.col("eigval") ** 4).alias("m4"),
    )
    return total.select(
        "m1", (F.col("m2") / F.col("m1") ** 2).alias("m2"), (F.col("m3") / F.col("m1") ** 3).alias("m3"),
        (F.col("m4") / F.col("m1") ** 4).alias("m4"),
    )


# tr(C), tr(C²), tr(C³), tr(C⁴) determine the spectrum of a 4×4 covariance.
_TRACES = """WITH c2 AS (SELECT a.i, b.k, sum(a.v * b.v) AS v FROM lic a JOIN lic b ON a.k = b.i GROUP BY a.i, b.k),
    c3 AS (SELECT a.i, b.k, sum(a.v * b.v) AS v FROM c2 a JOIN lic b ON a.k = b.i GROUP BY a.i, b.k),
    tr AS (SELECT (SELECT sum(v) FROM lic WHERE i = k) AS m1, (SELECT sum(v) FROM c2 WHERE i = k) AS m2,
    (SELECT sum(v) FROM c3 WHERE i = k) AS m3, (SELECT sum(a.v * b.v) FROM c2 a JOIN c2 b ON a.i = b.k AND a.k = b.i) AS m4)"""
_POWERS = f"""{_TRACES} SELECT {rd("m1", "m1")}, {rd("m2 / m1 ** 2", "m2")}, {rd("m3 / m1 ** 3", "m3")}, {rd("m4 / m1 ** 4", "m4")} FROM tr"""


@query(_POWERS)
def basis_spectrum(spark, sf):
    return _moments(ops.fit_basis(tables.matrix(spark, sf)).directions)


@query(_POWERS)
def basis_spectrum_randomized(spark, sf):
    return _moments(ops.fit_basis(tables.matrix(spark, sf), k=4, side="randomized").directions)


# Two copies of the centred lineitem matrix side by side, one a little longer, and a faint third: pairs of close eigenvalues.
_EPS = 1e-4


@query(f"""{_TRACES}, w AS (SELECT m1, m2, m3, m4, 1 + (1 + {_EPS}) ** 2 AS a, 1 + (1 + {_EPS}) ** 4 AS b, 1 + (1 + {_EPS}) ** 6 AS c, 1 + (1 + {_EPS}) ** 8 AS d FROM tr)
    SELECT {rd("m1 * a", "m1")}, {rd("m2 * b / (m1 * a) ** 2", "m2")}, {rd("m3 * c / (m1 * a) ** 3", "m3")}, {rd("m4 * d / (m1 * a) ** 4", "m4")},
    8 AS rank, true AS within FROM w""")
def basis_iterated(spark, sf):
    """Eight of sixteen directions by iteration: every eigenvalue has a neighbour 2e-4 away."""
    rows = tables.matrix(spark, sf)
    mean = ops.mean_vector(rows, "y")
    centre = F.zip_with("y", F.lit(mean), lambda a, b: a - b)

    def placed(at, factor):
        zeros = lambda m: F.array_repeat(F.lit(0.0), m)
        return F.concat(zeros(4 * at), F.transform(F.col("c"), lambda v: v * F.lit(factor)), zeros(12 - 4 * at))

    wide = rows.select(centre.alias("c")).select(F.explode(F.array(placed(0, 1.0), placed(1, 1.0 + _EPS), placed(2, 0.01))).alias("y"))
    got = ops.fit_basis(wide, k=8, side="randomized", oversample=1, denom="one")
    return _moments(got.directions.withColumn("eigval", F.col("eigval") * 3 / got.n)).select(
        "*", F.lit(got.fit.values.size).cast("long").alias("rank"), F.lit(got.fit.residual <= 1e-9).alias("within")
    )


# Three order features on planes of their own: the scatter is V·1 on each plane, so every eigenvalue is double and the
# eigensolver may turn its two directions at will; the canonical ones are the axes. Six of twelve entries stay empty.
_FEATURES = """SELECT f, sum((v - m) * (v - m)) AS e, count(*) AS n FROM (SELECT f, v, avg(v) OVER (PARTITION BY f) AS m FROM (
    SELECT unnest([0, 1, 2]) AS f, unnest([o_totalprice / 10000, (o_orderkey % 7)::DOUBLE, (o_custkey % 5)::DOUBLE]) AS v FROM orders)) GROUP BY f"""
_SIDES = ("features", "samples", "randomized")


def _planes(spark, sf):
    orders = tables.read(spark, sf, "orders")
    v = F.array((F.col("o_totalprice") / 10000).cast("double"), (F.col("o_orderkey") % 7).cast("double"), (F.col("o_custkey") % 5).cast("double"))
    rows = orders.select(v.alias("y"))
    mean = ops.mean_vector(rows, "y")
    half = 0.5**0.5

    def field(f, sign):
        c = (F.col("y")[f] - float(mean[f])) * half
        return F.array(*[c if i == f else sign * c if i == f + 4 else F.lit(0.0) for i in range(12)])

    return rows.select(F.explode(F.array(*[field(f, sign) for f in range(3) for sign in (1.0, -1.0)])).alias("y"))


@query(f"""WITH v AS MATERIALIZED ({_FEATURES}), d AS (SELECT e, f, unnest([0, 1]) AS t, n FROM v),
    c AS (SELECT row_number() OVER (ORDER BY e DESC, f, t) AS k, sum(e) OVER (ORDER BY e DESC, f, t) / (SELECT sum(e) FROM d) AS part FROM d)
    SELECT side, 6 * (SELECT max(n) FROM v) AS n, 12 AS d, 6 AS rank, {rd("(SELECT sum(e) FROM d) / 1000", "total_energy", 4)},
    (SELECT min(k) FROM c WHERE part >= 0.7) AS k_energy, 'exact' AS status, 3 AS n_clusters, 3 AS n_degenerate, 2 AS largest_cluster, true AS within
    FROM (SELECT unnest(['features', 'samples', 'randomized']) AS side)""", digits=4)
def complete_fit(spark, sf):
    """Rank, energy rank and clusters of the same fields from three sides."""
    fields = cut(_planes(spark, sf), "planes")
    out = None
    for side in _SIDES:
        # the record must not depend on the side, and the sample side is too large for one machine here
        rows = fields.withColumn("row", F.monotonically_increasing_id()) if side == "samples" else fields
        record = ops.complete_basis(rows, k=8, side=side, row="row", threshold=0.7, oversample=2, cluster_tolerance=1e-9).record
        record = record.select(
            "side", "n", "d", "rank", (F.col("total_energy") / 1000).alias("total_energy"), "k_energy", "status", "n_clusters", "n_degenerate",
            "largest_cluster", ((F.col("residual") <= 1e-9) & (F.col("closure_residual") < 1e-9)).alias("within"),
        )
        out = record if out is None else out.unionByName(record)
    return out


@query(f"""WITH v AS ({_FEATURES}), r AS (SELECT f, row_number() OVER (ORDER BY e DESC) - 1 AS rank FROM v)
    SELECT 2 * rank + t AS j, f + 4 * t AS i, 1.0::DOUBLE AS v FROM r CROSS JOIN (SELECT unnest([0, 1]) AS t)""")
def complete_directions(spark, sf):
    """The canonical directions are axes, whatever pair of directions the iteration ended with."""
    got = ops.complete_basis(_planes(spark, sf), k=6, side="randomized", oversample=2, cluster_tolerance=1e-9)
    return got.directions.select("j", F.posexplode("vec").alias("i", "v")).where(F.abs("v") > 1e-7)


@query(f"SELECT i, k, {rd('v', 'value')} FROM lic")
def basis_rebuilds_covariance(spark, sf):
    rows = ops.fit_basis(tables.matrix(spark, sf)).directions
    left = rows.select("j", "eigval", F.posexplode("vec").alias("i", "a"))
    right = rows.select("j", F.posexplode("vec").alias("k", "b"))
    return left.join(right, "j").groupBy("i", "k").agg(F.sum(F.col("eigval") * F.col("a") * F.col("b")).alias("value"))


@query(f"""SELECT {rd("sum((y - m) * (y - m)) / 64", "energy", 4)}, count(DISTINCT vec_id) AS n FROM walk JOIN mu USING (i) WHERE role = 'train'""", digits=4)
def basis_sample_side(spark, sf):
    """The sample-side fit of the training fields: its spectrum sums to the full energy."""
    rows, _ = walk.fields(spark, sf)
    train = rows.where("role = 'train'").select(F.col("pos").cast("int").alias("pos"), "y")
    got = ops.fit_basis(train, side="samples", denom="one", row="pos")
    return got.directions.agg((F.sum("eigval") / 64).alias("energy"), F.lit(got.n).cast("long").alias("n"))


def _walk_spectrum(spark, sf):
    """Energies of the cosine directions on the training rows, in descending order."""
    from fieldgauge.operators.codec import encode
    from fieldgauge.functions.sums import vector_sums

    w = walk.study(spark, sf)
    coded = encode(w.fields.where("role = 'train'").select("y"), "y", w.basis, w.mean)
    e = vector_sums(coded, ["coef"], [], ["e"], lambda c: (c * c,)).select(F.col("j").alias("d"), "e")
    order = ranking.Window.partitionBy(F.lit(0)).orderBy(F.col("e").desc(), "d")
    return w, e.select((F.row_number().over(order) - 1).alias("j"), F.col("e").alias("eigval"), F.sqrt("e").alias("sigma"))


_SPECTRUM = """SELECT row_number() OVER (ORDER BY sum(c * c) DESC, j) - 1 AS j, sum(c * c) AS e FROM coef WHERE role = 'train' GROUP BY j"""


@query(f"""WITH s AS ({_SPECTRUM}), c AS (SELECT j, sum(e) OVER (ORDER BY j) / (SELECT sum(energy.e) FROM energy WHERE role = 'train') AS f FROM s)
    SELECT min(j + 1) FILTER (f >= 0.99) AS k_energy, {rd("max(f)", "resolved_fraction")}, {rd("1 - max(f)", "discarded_fraction")},
    {rd("abs(max(f) - 1)", "closure_residual")}, 'exact' AS status FROM c""")
def energy_rank_full(spark, sf):
    w, spectrum = _walk_spectrum(spark, sf)
    total = ops.total_energy(w.fields.where("role = 'train'"), "y", w.mean)
    return ops.energy_rank(spectrum, total, 0.99)


@query(f"""WITH s AS ({_SPECTRUM}), c AS (SELECT j, sum(e) OVER (ORDER BY j) / sum(e) OVER () AS f FROM s)
    SELECT min(j + 1) FILTER (f >= 0.999) AS k_energy, {rd("max(f)", "resolved_fraction")}, {rd("1 - max(f)", "discarded_fraction")},
    {rd("abs(max(f) - 1)", "closure_residual")}, 'exact' AS status FROM c""")
def energy_rank_spectrum(spark, sf):
    return ops.energy_rank(_walk_spectrum(spark, sf)[1])


@query(f"""WITH s AS ({_SPECTRUM}), t AS (SELECT sqrt(e) AS sigma, max(sqrt(e)) OVER () AS top FROM s)
    SELECT {rd("max(top)", "sigma_max")}, count(*) FILTER (sigma > top * sqrt(greatest(64, (SELECT count(DISTINCT vec_id) FROM walk WHERE role = 'train')) * 2.220446049250313e-16)) AS r_gram_resolved,
    count(*) FILTER (sigma > top * greatest(64, (SELECT count(DISTINCT vec_id) FROM walk WHERE role = 'train')) * 2.220446049250313e-16) AS r_svd_nominal,
    true AS is_sorted, true AS is_valid, 'ok' AS status FROM t""")
def resolved_rank(spark, sf):
    w, spectrum = _walk_spectrum(spark, sf)
    return ops.resolved_rank(spectrum, int(w.n * 0.6), w.width)


@query(f"""WITH s AS ({_SPECTRUM}), g AS (SELECT j, e, abs(lag(e) OVER (ORDER BY j) - e) / first_value(e) OVER (ORDER BY j) AS gap FROM s)
    SELECT j, sum(CASE WHEN gap > 0.001::DOUBLE THEN 1 ELSE 0 END) OVER (ORDER BY j) AS cluster FROM g""")
def degenerate_clusters(spark, sf):
    return ops.cluster_ids(_walk_spectrum(spark, sf)[1].select("j", "eigval"), 1e-3).drop("eigval")


@query("SELECT a.i AS j, b.i AS k, CASE WHEN a.i = b.i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dot FROM lim a CROSS JOIN lim b")
def canonical_clusters(spark, sf):
    """Canonical rows of a fitted basis stay orthonormal; one forced cluster of all directions."""
    rows = ops.fit_basis(tables.matrix(spark, sf)).directions
    fixed = ops.canonical_clusters(rows, tolerance=10.0).select("j", "vec")
    other = fixed.select(F.col("j").alias("k"), F.col("vec").alias("w"))
    pairs = fixed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).join(other, "k")
    return pairs.select("j", "k", F.round(dot(F.col("vec"), F.col("w")), 6).alias("dot"))


@query(f"""SELECT vec_id, i, {rd("e * CASE WHEN top < 0 THEN -1 ELSE 1 END", "v")} FROM (
    SELECT vec_id, i, e, first_value(e) OVER (PARTITION BY vec_id ORDER BY abs(e) DESC, i) AS top FROM el)""")
def canonical_sign(spark, sf):
    rows = tables.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return ops.canonical_sign(rows).select("vec_id", F.posexplode("vec").alias("i", "v"))


_LABEL_MEANS = "SELECT label, i, avg(y) AS v FROM walk GROUP BY label, i"


@query(f"""SELECT {rd("max(abs(d - CASE WHEN a = b THEN 1 ELSE 0 END))", "max_abs")} FROM (
    SELECT x.label AS a, y.label AS b, sum(x.v * y.v) AS d FROM ({_LABEL_MEANS}) x JOIN ({_LABEL_MEANS}) y USING (i) GROUP BY ALL)""")
def orthonormality(spark, sf):
    """How far the mean fields of the labels are from an orthonormal set."""
    rows, _ = walk.fields(spark, sf)
    means = ops.vec_mean(rows, "y", ["label"])
    vec = F.transform(F.array_sort(F.collect_list(F.struct("j", "mean"))), lambda p: p["mean"])
    return ops.orthonormality(means.groupBy(F.col("label").alias("j")).agg(vec.alias("vec")))


@query("""SELECT user_id, n_rows, rank, concat_ws(',', CASE WHEN rank > n_rows - 1 THEN 'above_algebraic_bound' END,
    CASE WHEN rank < 12 THEN 'below_largest_arm' END, CASE WHEN rank < n_rows - 1 THEN 'artificial_cap' END) AS reasons FROM (
    SELECT user_id, count(*) AS n_rows, count(DISTINCT CAST(ts AS DATE)) AS rank FROM events GROUP BY user_id)
    WHERE rank > n_rows - 1 OR rank < 12 OR rank < n_rows - 1""")
def rank_admissible(spark, sf):
    ranks = tables.read(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.to_date("ts")).alias("rank")
    )
    return ops.check_rank(ranks, 12).withColumn("reasons", F.concat_ws(",", "reasons"))


@query(f"SELECT j, {rd('sum(c * c) / count(*)', 'energy')} FROM coef WHERE role = 'train' GROUP BY j")
def inherited_basis(spark, sf):
    """A stored basis is validated, not refitted, and then used for the training energies."""
    from fieldgauge.operators.codec import encode
    from fieldgauge.functions.sums import vector_sums

    w = walk.study(spark, sf)
    fixed = ops.load_fixed_basis(w.basis, w.width)
    coded = encode(w.fields.where("role = 'train'").select("y"), "y", fixed, w.mean)
    sums = vector_sums(coded, ["coef"], [], ["e"], lambda c: (c * c,))
    return sums.select("j", (F.col("e") / F.col("n")).alias("energy"))


@query(f"SELECT d.j, d.i, {rd('d.b', 'v')}, n.n AS n_fields FROM dct d CROSS JOIN (SELECT count(*) AS n FROM embeddings) n")
def cosine_basis(spark, sf):
    raw = tables.read(spark, sf, "embeddings")
    width = ops.width_of(raw, "embedding")
    return ops.dct_basis(spark, width).select("j", F.posexplode("vec").alias("i", "v")).withColumn(
        "n_fields", F.lit(raw.count()).cast("long")
    )
