"""Curves: stopping replay, checks, schedules, policy calibration."""

from pyspark.sql import functions as F

from fieldgauge.operators import trace as ops
from fieldgauge.plans import tables
from fieldgauge.plans.queries.registry import query, rd

PATIENCE, MIN_DELTA = 4, 0.02


def _walked(rules: str, keys: str = "") -> str:
    """The stopping rule as a recursive query over epochs, one state per (curve, rule)."""
    k = "".join(f", w.{c}" for c in keys.split(",") if c)
    first = "".join(f", r.{c}" for c in keys.split(",") if c)
    return f"""WITH RECURSIVE rule AS ({rules}), st AS (
      SELECT c.traj{first}, 1 AS epoch, c.val AS best, 1 AS sel, 0 AS waited, 0 AS stop, c.val AS low, 1 AS low_epoch FROM curve c CROSS JOIN rule r WHERE c.epoch = 1
      UNION ALL
      SELECT w.traj{k}, c.epoch, CASE WHEN (w.best - c.val) / w.best >= r.min_delta THEN c.val ELSE w.best END,
        CASE WHEN (w.best - c.val) / w.best >= r.min_delta THEN c.epoch ELSE w.sel END,
        CASE WHEN (w.best - c.val) / w.best >= r.min_delta THEN 0 ELSE w.waited + 1 END,
        CASE WHEN (w.best - c.val) / w.best < r.min_delta AND w.waited + 1 >= r.patience THEN c.epoch ELSE 0 END,
        least(w.low, c.val), CASE WHEN c.val < w.low THEN c.epoch ELSE w.low_epoch END
      FROM st w JOIN curve c ON c.traj = w.traj AND c.epoch = w.epoch + 1 JOIN rule r ON {" AND ".join(f"r.{c} = w.{c}" for c in keys.split(",") if c) or "true"}
      WHERE w.stop = 0),
    fin AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY traj{"".join(f", {c}" for c in keys.split(",") if c)} ORDER BY epoch DESC) = 1)"""


_ONE = _walked(f"SELECT {PATIENCE} AS patience, {MIN_DELTA}::DOUBLE AS min_delta")
_RESULT = f"""SELECT traj, sel AS selected_epoch, {rd("best", "selected_val")}, low_epoch AS raw_best_epoch, {rd("low", "raw_best_val")},
    epoch AS stop_epoch, CASE WHEN stop > 0 THEN 'PATIENCE' ELSE 'CEILING_REACHED' END AS stop_reason, stop > 0 AS converged FROM fin"""


def _replayed(spark, sf):
    return ops.replay_stopping(tables.curves(spark, sf), PATIENCE, MIN_DELTA, ["traj"])


@query(f"{_ONE} {_RESULT}")
def replay_stopping(spark, sf):
    return _replayed(spark, sf)


@query(f"""{_ONE} SELECT traj, CASE WHEN sel % 5 = 0 THEN 'missing_field' WHEN sel % 5 = 1 THEN 'selected_after_stop' ELSE 'checkpoint_overwritten' END AS reason
    FROM fin WHERE sel % 5 IN (0, 1) OR sel <> low_epoch""")
def trace_checks(spark, sf):
    rows = _replayed(spark, sf)
    kind = F.col("selected_epoch") % 5
    spoiled = rows.select(
        "traj", F.when(kind == 1, F.col("stop_epoch") + 1).otherwise(F.col("selected_epoch")).alias("selected_epoch"),
        "raw_best_epoch", "stop_epoch", F.when(kind != 0, F.col("stop_reason")).alias("stop_reason"),
        F.lit("a").alias("selected_sha256"), F.lit("a").alias("raw_best_sha256"),
    )
    needed = ["selected_epoch", "raw_best_epoch", "stop_epoch", "stop_reason"]
    return ops.check_traces(spoiled, needed).select("traj", "reason")


@query(f"{_ONE} SELECT traj, epoch + 1 AS recorded_stop, epoch AS replayed_stop FROM fin WHERE stop > 0 AND epoch % 2 = 0")
def trace_against_replay(spark, sf):
    rows = _replayed(spark, sf)
    wrong = F.col("converged") & (F.col("stop_epoch") % 2 == 0)
    recorded = rows.withColumn("stop_epoch", F.when(wrong, F.col("stop_epoch") + 1).otherwise(F.col("stop_epoch")))
    return ops.compare_traces(recorded, rows, ["traj"]).select(
        "traj", F.col("recorded.stop_epoch").alias("recorded_stop"), F.col("replayed.stop_epoch").alias("replayed_stop")
    )


@query(f"""{_ONE} SELECT k.family, count(*) AS n_runs, count(*) FILTER (stop = 0) AS n_ceiling, 0 AS n_nonfinite, bool_or(stop = 0) AS blocked
    FROM fin JOIN keys k ON k.traj = fin.traj GROUP BY k.family""")
def convergence_gate(spark, sf):
    rows = _replayed(spark, sf).join(tables.trajectory_keys(spark, sf), "traj")
    return ops.check_converged(rows, ["family"])


@query("""SELECT event_id, row_number() OVER (ORDER BY md5('3:2:' || event_id), event_id) - 1 AS rank,
    (row_number() OVER (ORDER BY md5('3:2:' || event_id), event_id) - 1) // 256 AS batch FROM events""")
def batch_order(spark, sf):
    events = tables.read(spark, sf, "events").select("event_id")
    return ops.batch_order(events, 3, 2, 256, ["event_id"])


_SEGMENTS = """SELECT traj, n, 4 AS width, s.s AS segment, s.s * 4 + 1 AS first_epoch, least((s.s + 1) * 4, n) AS last_epoch, n % 4 = 0 AS exact
    FROM (SELECT traj, max(epoch) AS n FROM curve GROUP BY traj) c JOIN (SELECT unnest(range(1000)) AS s) s ON s.s * 4 < c.n"""


def _segments(spark, sf):
    lengths = tables.curves(spark, sf).groupBy("traj").agg(F.max("epoch").alias("n")).withColumn("width", F.lit(4))
    return ops.segments(lengths, "n", "width")


@query(_SEGMENTS)
def epoch_segments(spark, sf):
    return _segments(spark, sf)


@query(f"""SELECT traj, max(n) AS n_epochs, max(last_epoch) AS last_epoch, CASE WHEN n % 3 = 1 THEN 1 ELSE 0 END AS n_breaks FROM ({_SEGMENTS})
    WHERE NOT (n % 3 = 1 AND segment = 1) GROUP BY traj, n HAVING (n % 3 = 1 AND n > 8) OR max(last_epoch) <> n""")
def segment_coverage(spark, sf):
    # schedules of 3m+1 epochs lose their second segment
    parts = _segments(spark, sf).where("not (n % 3 = 1 and segment = 1)")
    return ops.check_segments(parts, ["traj"], "n")


@query("""SELECT user_id, d_in, d_out, (d_in * 256 + 256 + 256 * 256 + 256 + 256 * d_out + d_out)::BIGINT AS n_parameters FROM (
    SELECT user_id, count(*) AS d_in, count(DISTINCT CAST(ts AS DATE)) AS d_out FROM events GROUP BY user_id)""")
def parameter_counts(spark, sf):
    arms = tables.read(spark, sf, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("d_in"), F.count_distinct(F.to_date("ts")).alias("d_out")
    )
    return ops.parameter_counts(arms)


GRID = [(2, 0.001), (4, 0.02), (8, 0.1)]
_RULES = "SELECT unnest([2, 4, 8]) AS patience, unnest([0.001::DOUBLE, 0.02::DOUBLE, 0.1::DOUBLE]) AS min_delta"


@query(f"""{_walked(_RULES, "patience,min_delta")}, low AS (SELECT traj, min(val) AS low, arg_min(epoch, (val, epoch)) AS at FROM curve GROUP BY traj),
    per AS (SELECT patience, min_delta, max(best / l.low) AS gap, max(epoch) AS stop_at, ceil(max(l.at) * 1.5)::BIGINT AS me, count(*) AS n
      FROM fin f JOIN low l USING (traj) GROUP BY patience, min_delta)
    SELECT patience, {rd("min_delta", "min_delta")}, {rd("gap", "max_gap")}, stop_at AS max_stop_epoch, me AS max_epochs, n AS n_curves, gap <= 3.0 AS admissible,
    gap <= 3.0 AND row_number() OVER (ORDER BY gap <= 3.0 DESC, stop_at, patience, min_delta) = 1 AS chosen FROM per""")
def stopping_calibration(spark, sf):
    return ops.calibrate_stopping(tables.curves(spark, sf), GRID, 3.0, ["traj"])
