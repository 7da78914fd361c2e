"""Pairs, windows, scaling, ids, centring."""

from pyspark.sql import functions as F

from fieldgauge.functions.vectors import doubles, flatten_masked
from fieldgauge.operators import pairing as ops
from fieldgauge.plans import tables, walk
from fieldgauge.plans.queries.registry import query, rd

_PAIRS = """SELECT a.family, a.traj, a.t, a.j, {x}, {y} FROM cell a
    JOIN (SELECT family, traj, t, lead(t) OVER (PARTITION BY family, traj ORDER BY t) AS nt FROM fr) n
      ON n.family = a.family AND n.traj = a.traj AND n.t = a.t
    JOIN cell b ON b.family = a.family AND b.traj = a.traj AND b.t = n.nt AND b.j = a.j"""


@query(_PAIRS.format(x=rd("a.v", "x"), y=rd("b.v", "y")))
def pair_next(spark, sf):
    return tables.long_pairs(ops.pair_next(tables.frames(spark, sf), width=8), "family", "traj", "t")


_STRIDED = """SELECT a.family, a.traj, a.t, a.j, {x}, {y} FROM cell a
    JOIN cell b ON b.family = a.family AND b.traj = a.traj AND b.t = a.t + 1 AND b.j = a.j WHERE {ts}"""


@query(_STRIDED.format(x=rd("a.v", "x"), y=rd("b.v", "y"), ts="a.t >= 0 AND a.t % 5 = 0"))
def pair_strided(spark, sf):
    pairs = ops.pair_strided(tables.frames(spark, sf), stride=5, horizon=None)
    return tables.long_pairs(pairs, "family", "traj", "t")


@query(_STRIDED.format(x=rd("a.v", "x"), y=rd("b.v", "y"), ts="a.t IN (0, 4, 8)"))
def pair_starts(spark, sf):
    pairs = ops.pair_strided(tables.frames(spark, sf), starts=[0, 4, 8])
    return tables.long_pairs(pairs, "family", "traj", "t")


@query(f"""SELECT a.vec_id, b.vec_id AS from_vec_id, a.i AS j, {rd("b.y", "x")}, {rd("a.y", "y")}
    FROM walk a JOIN walk b ON a.i = b.i AND a.pos = (b.pos + 1) % a.n""")
def pair_roll(spark, sf):
    rows, n = walk.fields(spark, sf)
    rolled = ops.pair_roll(rows.select("vec_id", F.col("y").alias("field")), "vec_id", n=n)
    return tables.long_pairs(rolled, "vec_id", "from_vec_id")


LOOK_BACK, HORIZON = 5, 3


def _windows(stride: int, n: int | None = None) -> str:
    cap = "" if n is None else f" AND s.step < {n * stride}"
    return f"""SELECT s.series_id, s.step // {stride} AS win, o.k AS j, CASE WHEN o.k < {LOOK_BACK} THEN 'x' ELSE 'y' END AS part,
        {rd("v.value", "value")} FROM series s CROSS JOIN (SELECT unnest(range({LOOK_BACK + HORIZON})) AS k) o
        JOIN series v ON v.series_id = s.series_id AND v.step = s.step + o.k
        WHERE s.step % {stride} = 0 AND s.step < (SELECT count(*) FROM days) - {LOOK_BACK + HORIZON}{cap}"""


def _long(windows):
    both = F.concat(F.col("x"), F.col("y"))
    return windows.select("series_id", "win", F.posexplode(both).alias("j", "value")).select(
        "series_id", "win", "j", F.when(F.col("j") < LOOK_BACK, "x").otherwise("y").alias("part"), "value"
    )


@query(_windows(2))
def sliding_windows(spark, sf):
    return _long(ops.sliding_pairs(tables.daily_series(spark, sf), LOOK_BACK, HORIZON, 2, chunk=8))


@query(_windows(3, 4))
def sliding_windows_first_n(spark, sf):
    return _long(ops.sliding_pairs(tables.daily_series(spark, sf), LOOK_BACK, HORIZON, 3, n_windows=4))


_SCALED = """, fit AS (SELECT series_id, avg(value) AS mu, stddev_pop(value) + 1e-8::DOUBLE AS sd FROM series
    WHERE step < {stop} GROUP BY series_id)
    SELECT s.series_id, s.step, {value} FROM series s JOIN fit f USING (series_id)"""


def _scaled(stop: str) -> str:
    return "WITH one AS (SELECT 1 AS one)" + _SCALED.format(stop=stop, value=rd("(s.value - f.mu) / f.sd", "value"))


def _scale(spark, sf, mode):
    series = tables.daily_series(spark, sf)
    steps = series.agg(F.max("step")).first()[0] + 1
    fit = ops.scaler_range(mode, steps, 0.8, LOOK_BACK, HORIZON, 2)
    scaler = ops.fit_scaler(series, fit)
    return ops.apply_scaler(series, scaler)


@query(_scaled("floor(0.8::DOUBLE * (SELECT count(*) FROM days))"))
def scale_by_raw_fraction(spark, sf):
    return _scale(spark, sf, "legacy_raw_fraction")


@query(_scaled(
    f"2 * (round_even(0.8::DOUBLE * ceil(((SELECT count(*) FROM days) - {LOOK_BACK + HORIZON}) / 2.0), 0) - 1) + {LOOK_BACK + HORIZON}"
))
def scale_by_train_windows(spark, sf):
    return _scale(spark, sf, "train_window_union")


@query(f"""SELECT r.rank, c.family, c.traj, c.t, c.j, {rd("c.v", "v")} FROM cell c
    JOIN roles r ON r.family = c.family AND r.traj = c.traj WHERE r.role = 'validation'""")
def gather_sealed_order(spark, sf):
    got = ops.gather(tables.frames(spark, sf), tables.trajectory_roles(spark, sf), "validation")
    return got.select("rank", "family", "traj", "t", F.posexplode("field").alias("j", "v"))


@query("""SELECT family, traj, t, dense_rank() OVER (ORDER BY family, traj) - 1 AS cluster FROM fr""")
def assign_cluster(spark, sf):
    frames = tables.user_days(spark, sf).select("family", "traj", "t").distinct()
    return ops.assign_cluster(frames, "traj").select("family", "traj", "t", "cluster")


@query("SELECT name, family, dense_rank() OVER (ORDER BY family, name) - 1 AS cluster FROM file WHERE family IS NOT NULL")
def assign_cluster_text(spark, sf):
    """Names as text keys: ids follow the order of the text, not of the numbers in it."""
    rows = tables.files(spark, sf).select("name", "family").where("family is not null")
    return ops.assign_cluster(rows, "name").select("name", "family", "cluster")


@query(f"SELECT w.vec_id, w.i AS j, {rd('w.y - m.m', 'y')} FROM walk w JOIN mu m USING (i)")
def center_fields(spark, sf):
    w = walk.study(spark, sf)
    return ops.center(w.fields.select("vec_id", "y"), "y", w.mean).select(
        "vec_id", F.posexplode("y").alias("j", "y")
    )


@query(f"""SELECT true AS passed, {rd("sqrt(sum((w.y - m.m) * (w.y - m.m)))", "frobenius")}
    FROM walk w JOIN mu m USING (i) WHERE w.role = 'train'""")
def centring_gate(spark, sf):
    w = walk.study(spark, sf)
    return ops.centring_residual(w.fields.where("role = 'train'"), "y", w.mean).select("passed", "frobenius")


@query(f"""SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS j, {rd("e", "v")}
    FROM el WHERE e > 0""")
def masked_flatten(spark, sf):
    raw = tables.read(spark, sf, "embeddings")
    field = doubles("embedding")
    kept = flatten_masked(field, F.transform(field, lambda v: v > 0))
    return raw.select("vec_id", F.posexplode(kept).alias("j", "v"))
