"""Readers and sinks, each round-tripped through the shared folder."""

from pyspark.sql import functions as F

from fieldgauge.functions.vectors import doubles, squared_error
from fieldgauge.operators import codec
from fieldgauge.plans import qualify, tables, walk
from fieldgauge.plans.queries.registry import query, rd, scratch
from fieldgauge.sources import arrays, records, series, snapshots, store


@query(f"""SELECT c.family, c.traj, c.t, c.j, {rd("c.v::FLOAT", "v", 3)} FROM cell c JOIN roles r
    ON r.family = c.family AND r.traj = c.traj WHERE r.role = 'train' AND c.t >= 0 AND c.t % 5 = 0""", digits=3)
def snapshot_scan(spark, sf):
    path = scratch(spark, "snapshots")
    frames = tables.frames(spark, sf).join(tables.trajectory_roles(spark, sf), ["family", "traj"])
    snapshots.write_snapshots(frames.withColumn("field", F.col("field").cast("array<float>")), path)
    last = tables.user_days(spark, sf).agg(F.max("t")).first()[0]
    got = snapshots.read_snapshots(spark, path, roles=["train"], frames=range(0, last + 1, 5))
    return got.select("family", "traj", "t", F.posexplode("field").alias("j", "v"))


@query(f"SELECT vec_id AS traj, i AS j, {rd('e', 'x')}, {rd('y::FLOAT', 'y')} FROM (SELECT vec_id, i, y FROM walk) JOIN (SELECT vec_id, i, e FROM el) USING (vec_id, i)")
def npz_ingest(spark, sf):
    raw = tables.read(spark, sf, "embeddings")
    rows = raw.select(F.col("vec_id").alias("traj"), F.col("embedding").alias("x"), doubles("embedding").alias("y"))
    got = arrays.decode_npz(arrays.pack_npz(walk.running_sums(rows, "y"), "traj", "x", "y"))
    return tables.long_pairs(got, "traj")


@query(f"SELECT series_id, step, {rd('value::FLOAT', 'value', 3)} FROM series", digits=3)
def wide_series_scan(spark, sf):
    path = scratch(spark, "wide")
    daily = tables.daily_series(spark, sf)
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("step") * 86400)
    wide = daily.groupBy(F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("time")).pivot(
        "series_id", tables.kinds(spark, sf)
    ).agg(F.first("value"))
    wide.write.option("header", "true").csv(path)
    return series.read_wide_series(spark, path, "time")


@query("""SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT) AS sum_k, max((props->>'$.k')::BIGINT) AS max_k
    FROM events GROUP BY event_type""")
def record_parse(spark, sf):
    parsed = records.parse_records(tables.read(spark, sf, "events").select("event_type", "props"), "props", "k int")
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k")
    )


@query("SELECT o_orderkey, o_orderstatus, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders", digits=2)
def record_files(spark, sf):
    path = scratch(spark, "records")
    orders = tables.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    orders.write.json(path)
    return records.read_records(spark, path, orders.schema, lines=True)


@query("SELECT sha256, bytes, name AS path FROM file")
def manifest_scan(spark, sf):
    path = scratch(spark, "manifest")
    tables.files(spark, sf).select("sha256", "bytes", "name").write.option("sep", "\t").csv(path)
    return records.read_manifest_tsv(spark, path)


@query("""SELECT f.name, f.bytes, CASE WHEN l.toxic = 1 THEN upper(f.sha256) ELSE f.sha256 END AS sha256,
    coalesce(l.toxic = 1, false) AS malformed FROM file f LEFT JOIN labels l ON l.doc_id || '.txt' = f.name""")
def registry_scan(spark, sf):
    toxic = tables.read(spark, sf, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "toxic"
    )
    listed = tables.files(spark, sf).join(toxic, "name", "left")
    sha = F.when(F.col("toxic") == 1, F.upper("sha256")).otherwise(F.col("sha256"))
    text = F.to_json(F.create_map("name", F.struct(sha.alias("sha256"), "bytes")))
    kind = "map<string, struct<sha256: string, bytes: bigint>>"
    rows = records.registry_rows(listed.select(F.from_json(text, kind).alias("files")))
    bad = records.malformed_digests(rows).select("name", F.lit(True).alias("malformed"))
    return rows.join(bad, "name", "left").na.fill(False, ["malformed"])


@query("SELECT count(*) AS n_rows, true AS refused FROM fr")
def write_once(spark, sf):
    path = scratch(spark, "once")
    frames = tables.user_days(spark, sf).select("family", "traj", "t").distinct()
    store.write_once(frames, path)
    try:
        store.write_once(frames, path)
        refused = False
    except Exception as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(refused).alias("refused"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def write_replace(spark, sf):
    path = scratch(spark, "replace")
    events = tables.read(spark, sf, "events")
    store.write_replace(events.select("user_id"), path)
    store.write_replace(events.select("event_type"), path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT w.vec_id, {rd("avg((w.y - s.y) * (w.y - s.y))", "mse", 5)} FROM walk w JOIN (
    SELECT c.vec_id, d.i, m.m + sum(c.c * d.b) AS y FROM coef c JOIN dct d USING (j) JOIN mu m USING (i)
    WHERE c.j IN (0, 3, 7, 9, 1) GROUP BY c.vec_id, d.i, m.m) s USING (vec_id, i) WHERE w.role = 'train'
    GROUP BY w.vec_id""", digits=5)
def reduced_store(spark, sf):
    path = scratch(spark, "store")
    w = walk.study(spark, sf)
    train = w.fields.where("role = 'train'").select("vec_id", "y")
    codec.write_store(train, "y", ["vec_id"], w.basis, w.mean, [0, 3, 7, 9, 1], path)
    back = codec.read_store(spark, path).select("vec_id", "field")
    return train.join(back, "vec_id").select(
        "vec_id", (squared_error(F.col("y"), F.col("field")) / F.size("y")).alias("mse")
    )


@query(f"""WITH sizes AS (SELECT label, 'dense' AS scheme, count(*) * 64 * 4 AS bytes FROM embeddings GROUP BY label
    UNION ALL SELECT label, 'reduced', count(*) * 16 * 4 FROM embeddings GROUP BY label
    UNION ALL SELECT NULL, 'reduced', 16 * 64 * 4 + 64 * 4 + 16 * 4)
    SELECT scheme, sum(bytes)::BIGINT AS bytes, count(*) AS n_files,
    {rd("sum(bytes) / max(CASE WHEN scheme = 'dense' THEN sum(bytes) END) OVER ()", "share")}
    FROM sizes GROUP BY scheme""")
def store_sizes(spark, sf):
    rows = tables.read(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    width, k = 64, 16
    dense = rows.select(F.lit("dense").alias("scheme"), (F.col("n") * width * 4).alias("length"))
    part = rows.select(F.lit("reduced").alias("scheme"), (F.col("n") * k * 4).alias("length"))
    rest = spark.range(1).select(
        F.lit("reduced").alias("scheme"), F.lit(k * width * 4 + width * 4 + k * 4).cast("long").alias("length")
    )
    return codec.store_bytes(dense.unionByName(part).unionByName(rest))


@query(f"SELECT 'walk' AS family, arm, seed, cluster, {rd('err', 'err')} FROM cells WHERE arm = 'reduced'")
def error_artifact(spark, sf):
    path = scratch(spark, "errors")
    w = walk.study(spark, sf)
    pred = walk.predictions(w)
    _, keep = qualify.primary_set(pred, w)
    errors = qualify.cell_errors(pred, w.basis, w.mean, keep)
    store.write_errors(errors.withColumn("family", F.lit("walk")), path)
    return spark.read.parquet(path).where("arm = 'reduced'").select("family", "arm", "seed", "cluster", "err")
