"""Queries on sources, quality metrics, projects, jobs and streams."""

from __future__ import annotations

import os
import struct
import uuid

from pyspark.sql import functions as F

from levelgrid.functions import geometry as g
from levelgrid.functions.geometry import clean
from levelgrid.operators import metrics as Q, normalize as N
from levelgrid.plans import catalog as C
from levelgrid.queries.inputs import DUCK, SPARK, load, plan_sql, plan_tables, points_m, scan_points, sql, wall_segments
from levelgrid.queries.plans import BASE, D, GRID, OPENS, documents, r6
from levelgrid.queries.registry import query
from levelgrid.queries.scans import OP, _OP, order_points, r
from levelgrid.queries.walls import PLAN, WALLS, _LONG, lay, long_lines
from levelgrid.session import settle, workspace
from levelgrid.sources import tables
from levelgrid.streaming import jobs as S
from levelgrid.streaming import keyed as K

MAGIC = b"LGPTS\0\0\1"
num = lambda c="plan_id": F.substring(c, 2, 9).cast("int")


# Blobs of points, one per customer class, built as hex text by Spark and decoded again.
def le(c, kind):
    """Little-endian hex of an int or float column."""
    h = F.lpad(F.hex(c.cast("int")), 8, "0") if kind == "i" else None
    return F.concat(*[F.substring(h, 7 - 2 * i, 2) for i in range(4)])


@query("read_pts_blobs", "SELECT concat('b', CAST(o_orderkey % 300 AS STRING)) AS file, count(*) AS n, CAST(sum(o_orderkey % 8) AS DOUBLE) AS sx, 1.0 AS z FROM orders WHERE o_orderkey % 300 <> 7 GROUP BY 1")
def read_pts_blobs(spark, sf):
    o = load(spark, sf, "orders").select(F.concat(F.lit("b"), (F.col("o_orderkey") % 300).cast("string")).alias("path"), "o_orderkey")
    # f32 words of 0..7 and of 1, in file byte order.
    words = F.array(*[F.lit(struct.pack("<f", float(k)).hex()) for k in range(8)])
    at = F.concat(F.get(words, (F.col("o_orderkey") % 8).cast("int")), F.lit(struct.pack("<f", 0.0).hex()), F.lit(struct.pack("<f", 1.0).hex()))
    body = o.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(at)), "").alias("xyz"))
    magic = F.when(F.col("path") == "b7", "0" * 16).otherwise(MAGIC.hex())
    blobs = body.select("path", F.unhex(F.concat(magic, le(F.col("n"), "i"), F.lit("00000000"), "xyz")).alias("content"))
    p = tables.decode_pts(blobs, MAGIC)
    return p.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("sx"), F.max(F.col("z").cast("double")).alias("z"))


@query("write_cloud", f"SELECT scan_id, count(*) AS points, {r('sum(round(z, 3))', 'z', 2)} FROM ({points_m()}) p GROUP BY 1")
def write_cloud(spark, sf):
    pts = scan_points(spark, sf)
    ids = pts.select("scan_id").distinct()
    cloud = N.Normalized(pts, ids, ids, ids)
    batch = tables.write_cloud(cloud, f"{workspace(spark)}/clouds")
    back = tables.read_cloud(spark, batch)
    return back["points"].groupBy("scan_id").agg(F.count(F.lit(1)).alias("points"), clean(F.sum(F.round("z", 3)), 2).alias("z"))


@query("resolve_files", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'missing' ELSE 'present' END AS status FROM part")
def resolve_files(spark, sf):
    p = load(spark, sf, "part")
    name = F.concat(F.lit("scan"), F.col("p_partkey").cast("string"), F.lit(".glb"))
    manifest = p.select(name.alias("file"), "p_partkey", F.lit("plan").alias("kind"))
    files = p.filter("p_partkey % 3 <> 0").select(name.alias("file"))
    return tables.resolve_files(manifest, files).select(F.col("p_partkey").alias("id"), "status")


@query("read_projects", "SELECT md5(CAST(c_custkey AS STRING)) AS id, c_name AS name FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 7 <> 0")
def read_projects(spark, sf):
    c = load(spark, sf, "customer")
    text = F.to_json(F.struct(F.when(F.col("c_custkey") % 7 == 0, "x").otherwise(F.md5(F.col("c_custkey").cast("string"))).alias("id"), F.col("c_name").alias("name")))
    text = F.when(F.col("c_custkey") % 4 == 0, F.lit("{broken")).otherwise(text)
    path = f"{workspace(spark)}/read-projects/{uuid.uuid4().hex}"
    c.select(text.alias("value")).write.text(path)
    return tables.read_projects(spark, path).select("id", "name")


# Quality: detected lattices are the true ones moved or thickened by the plan number.
def shifted_walls(spark, sf):
    w = wall_segments(spark, sf)
    return w.withColumn("thickness", F.col("thickness") + F.when(num() % 2 == 0, 0.0).otherwise(0.02))


@query("thickness_mae", f"SELECT plan_id, {r('CASE WHEN s % 2 = 0 THEN 0 ELSE 0.02 END', 'mae')}, (SELECT count(*) FROM ({WALLS}) w WHERE w.plan_id = b.plan_id) AS walls FROM ({BASE}) b")
def thickness_mae(spark, sf):
    m = Q.thickness_mae(shifted_walls(spark, sf).withColumn("pred_id", F.col("wall_id")), wall_segments(spark, sf).withColumn("truth_id", F.col("wall_id")), PLAN)
    return m.select("plan_id", r6("mae").alias("mae"), "walls")


# Area of a lattice of walls of thickness t: the bars, less what crossings, T joints and corners count twice, and the
# four round outer corners.
_LATTICE = lambda t: f"((ny + 1) * 5 * nx * ({t}) + (nx + 1) * 4 * ny * ({t}) - ({t}) * ({t}) * ((nx - 1) * (ny - 1) + (nx - 1) + (ny - 1) + 1) + pi() * ({t}) * ({t}) / 4)"


@query("wall_area", f"SELECT plan_id, {r(_LATTICE('t'), 'area')} FROM ({BASE}) b")
def wall_area(spark, sf):
    return Q.wall_area(wall_segments(spark, sf), PLAN).select("plan_id", r6("area").alias("area"))


@query("wall_iou", f"SELECT plan_id, {r('CASE WHEN s % 2 = 0 THEN 1 ELSE ' + _LATTICE('t') + ' / ' + _LATTICE('t + 0.02') + ' END', 'iou')} FROM ({BASE}) b")
def wall_iou(spark, sf):
    return Q.wall_iou(shifted_walls(spark, sf), wall_segments(spark, sf), PLAN).select("plan_id", r6("iou").alias("iou"))


def truth_rooms(spark, sf):
    k = lay(spark, sf, "grid_r")
    at = lambda dx, dy: F.struct((5.0 * F.col("i") + dx).alias("x"), (4.0 * F.col("j") + dy).alias("y"))
    name = F.concat(F.lit("r"), (F.col("j") * F.col("nx") + F.col("i") + 1).cast("string"))
    return k.select(*PLAN, name.alias("truth_id"), F.array(at(0, 0), at(5, 0), at(5, 4), at(0, 4)).alias("ring"))


@query("room_iou", f"SELECT plan_id, {r('4.0 / 6.0', 'room_iou')}, CAST(nx * ny AS BIGINT) AS rooms FROM ({BASE}) b WHERE nx = 1 UNION ALL SELECT plan_id, {r('(4.0 / 6.0 * nx) / nx', 'x').split(' AS ')[0]}, nx * ny FROM ({BASE}) b WHERE nx > 1")
def room_iou(spark, sf):
    t = truth_rooms(spark, sf)
    # Every room is moved by a metre: 16 of 24 square metres are shared.
    p = t.select(*PLAN, F.col("truth_id").alias("pred_id"), F.transform("ring", lambda q: F.struct((q["x"] + 1.0).alias("x"), q["y"].alias("y"))).alias("ring"))
    return Q.room_iou(p, t, keys=PLAN).select("plan_id", r6("room_iou").alias("room_iou"), "rooms")


@query("opening_scores", f"SELECT plan_id, nx AS matches, {r('nx / (2.0 * nx)', 'precision')}, {r('nx / (2.0 * nx)', 'recall')} FROM ({BASE}) b")
def opening_scores(spark, sf):
    from levelgrid.operators.openings import point_on_wall

    o = settle(point_on_wall(lay(spark, sf, "openings"), wall_segments(spark, sf), PLAN).select(*PLAN, "opening_id", "kind", "x", "y", "width"))
    p = o.withColumn("x", F.col("x") + F.when(F.col("kind") == "door", 0.2).otherwise(0.3)).withColumnRenamed("opening_id", "pred_id")
    s = Q.opening_scores(p, o.withColumnRenamed("opening_id", "truth_id"), PLAN)
    return s.select("plan_id", "matches", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("frame_angle_error", "SELECT p_partkey AS id, round(least(abs(p_size * 7 - p_partkey) % 90.0, 90.0 - abs(p_size * 7 - p_partkey) % 90.0), 6) + 0.0 AS error FROM part")
def frame_angle_error(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), r6(Q.frame_angle_error(F.col("p_size") * F.lit(7.0), F.col("p_partkey").cast("double"))).alias("error"))


@query("stair_iou", f"SELECT plan_id, {r('(2.8 - (s % 5) * 0.1) / (2.8 + (s % 5) * 0.1)', 'iou')} FROM ({BASE}) b")
def stair_iou(spark, sf):
    b = lay(spark, sf, "base")
    at = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    d = (F.col("s") % 5) * 0.1
    ring = lambda up: F.array(at(1.0, 0.4 + up), at(2.2, 0.4 + up), at(2.2, 3.2 + up), at(1.0, 3.2 + up))
    return Q.stair_iou(b.select("plan_id", ring(F.lit(0.0)).alias("truth_ring"), ring(d).alias("pred_ring"))).select("plan_id", r6("iou").alias("iou"))


@query("run_lengths", f"SELECT plan_id, CAST(xb - xa + yb - ya AS DOUBLE) AS length, CAST(CASE WHEN ya = yb THEN (xb - xa) / 5 ELSE (yb - ya) / 4 END AS BIGINT) AS walls FROM ({_LONG}) q")
def run_lengths(spark, sf):
    return Q.run_lengths(wall_segments(spark, sf), PLAN).select("plan_id", r6("length").alias("length"), "walls")


@query("tape_check", f"SELECT plan_id, name, CASE name WHEN 'x' THEN 5.0 * nx ELSE 4.0 * ny END AS closest, {r('CASE name WHEN $$x$$ THEN 0.02 ELSE 0.3 END', 'error')}, name = 'x' AS ok FROM ({BASE}) b, (VALUES ('x'), ('y')) v(name)")
def tape_check(spark, sf):
    runs = long_lines(spark, sf).select("plan_id", (F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1")).alias("length"))
    b = lay(spark, sf, "base")
    at = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("length_m"))
    refs = b.select("plan_id", F.explode(F.array(at("x", 5.0 * F.col("nx") + 0.02), at("y", 4.0 * F.col("ny") - 0.3))).alias("r")).select("plan_id", "r.*", F.lit(None).cast("double").alias("tolerance_m"))
    t = Q.tape_check(runs, refs, ["plan_id"])
    return t.select("plan_id", "name", "closest", r6("error").alias("error"), "ok")


@query("level_count_check", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, s_suppkey % 2 = 0 AS ok FROM supplier")
def level_count_check(spark, sf):
    b = lay(spark, sf, "base").select("plan_id", F.when(F.col("s") % 2 == 0, 1).otherwise(2).alias("levels"))
    return Q.level_count_check(lay(spark, sf, "levels"), b, ["plan_id"]).select("plan_id", "ok")


@query("opens_check", "SELECT concat('C', CAST(c_custkey AS STRING)) AS scan_id, CAST(coalesce(n, 0) AS BIGINT) AS points, coalesce(n, 0) > 0 OR c_custkey % 9 = 0 AS opens FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def opens_check(spark, sf):
    sid = lambda c: F.concat(F.lit("C"), F.col(c).cast("string")).alias("scan_id")
    c = load(spark, sf, "customer")
    pts = load(spark, sf, "orders").select(sid("o_custkey"))
    return Q.opens_check(c.select(sid("c_custkey")), pts, c.filter("c_custkey % 9 = 0").select(sid("c_custkey"))).select("scan_id", "points", "opens")


# Projects: customers; revisions: their orders.
_REV = "SELECT o_custkey AS project_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM {orders}"


@query("retain_revisions", f"SELECT project_id, o_orderkey, CAST(revision AS INT) AS revision FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY revision DESC) AS k FROM ({_REV.format(orders='orders')}) r) q WHERE k <= 5")
def retain_revisions(spark, sf):
    return C.retain_revisions(sql(spark, sf, _REV), 5).select("project_id", "o_orderkey", F.col("revision").cast("int").alias("revision"))


@query("recent_projects", "SELECT o_custkey AS project_id FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1 ORDER BY max(o_orderdate) DESC, o_custkey LIMIT 10")
def recent_projects(spark, sf):
    touches = load(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("ts"))
    kept = load(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("project_id"))
    kept = kept.unionByName(touches.filter("project_id % 3 <> 0").select("project_id")).distinct()
    return C.recent_projects(touches, kept).select("project_id")


@query("latest_by_source", "SELECT file_id, version_id, project_id FROM (SELECT concat('f', CAST(o_custkey % 40 AS STRING)) AS file_id, o_orderpriority AS version_id, o_orderkey AS project_id, row_number() OVER (PARTITION BY o_custkey % 40, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P') q WHERE k = 1")
def latest_by_source(spark, sf):
    p = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("file_id"), F.col("o_orderpriority").alias("version_id"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "P").alias("has_source"),
    )
    return C.latest_by_source(p).select("file_id", "version_id", "project_id")


@query("apply_saves", """WITH RECURSIVE s AS (SELECT o_custkey AS plan_id, o_orderkey AS save_id, o_orderdate AS ts, o_orderkey % 3 AS m FROM orders),
    a(plan_id, rev, ts, save_id) AS (SELECT DISTINCT plan_id, 0::BIGINT, TIMESTAMP '1900-01-01', -1::BIGINT FROM s UNION ALL
        SELECT n.plan_id, n.rev, n.ts, n.save_id FROM (SELECT a.plan_id, a.rev + 1 AS rev, s.ts, s.save_id, row_number() OVER (PARTITION BY a.plan_id ORDER BY s.ts, s.save_id) AS k FROM a JOIN s ON s.plan_id = a.plan_id AND s.m = a.rev AND (s.ts, s.save_id) > (a.ts, a.save_id)) n WHERE n.k = 1)
    SELECT plan_id, save_id, rev AS revision, TRUE AS accepted FROM a WHERE rev > 0
    UNION ALL SELECT s.plan_id, s.save_id, (SELECT max(a.rev) FROM a WHERE a.plan_id = s.plan_id AND (a.ts, a.save_id) < (s.ts, s.save_id)), FALSE
    FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.plan_id = s.plan_id AND a.save_id = s.save_id)""")
def apply_saves(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("save_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % 3).alias("if_match"))
    ok, lost = C.apply_saves(o.select("plan_id", F.lit(0).alias("revision")).distinct(), o)
    lost = lost.select("plan_id", "save_id", F.col("current_revision").alias("revision"), F.lit(False).alias("accepted"))
    return ok.withColumn("accepted", F.lit(True)).unionByName(lost)


@query("describe", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS project_id, s_name AS name, 0 AS revision, 'Level 1' AS level FROM supplier")
def describe(spark, sf):
    p = load(spark, sf, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("project_id"), F.col("s_name").alias("name"))
    return C.describe(p, documents(spark, sf)).select("project_id", "name", "revision", F.get("levels", F.lit(0))["name"].alias("level"))


@query("strip_legacy_shells", f"SELECT plan_id, CASE WHEN s % 4 = 0 THEN 0 ELSE 1 END AS levels, CASE WHEN s % 2 = 0 AND s % 4 <> 0 THEN 1 ELSE 0 END AS issues FROM ({BASE}) b")
def strip_legacy_shells(spark, sf):
    from levelgrid.plans import schemas

    n = num()
    t = plan_tables(spark, sf)
    bare = t.map(lambda name, df: df if name == "levels" else df.filter(n % 4 != 0))
    d = documents(spark, sf, bare)
    kinds = schemas.PLAN["detection"].dataType
    issue = F.array(F.struct(F.lit("i1").alias("id"), F.lit("warning").alias("severity"), F.lit("open_gap").alias("code"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("levelId"), F.lit(None).cast("string").alias("elementId")))
    source = F.struct(F.lit("s.glb").alias("filename"), F.lit("glb").alias("format"), F.lit(1.0).alias("unitScaleToMeters"), F.lit("z").alias("upAxis"), F.lit(0.0).alias("manhattanAngleDeg"), F.lit(False).alias("linked"))
    d = d.withColumn("detection", F.struct(source.alias("source"), F.when(n % 2 == 0, issue).otherwise(F.array().cast(kinds["issues"].dataType)).alias("issues")))
    return C.strip_legacy_shells(d).select("plan_id", F.size("levels").alias("levels"), F.size("detection.issues").alias("issues"))


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'odd' END"


@query("import_status", f"""SELECT o_orderkey AS project_id, CASE WHEN st = 'running' AND NOT live THEN 'error' WHEN st <> 'odd' THEN st WHEN live THEN 'running' ELSE 'none' END AS import_state, CASE WHEN st = 'running' AND NOT live THEN 'The import was interrupted.' ELSE '' END AS import_error FROM (SELECT o_orderkey, {_STATE} AS st, o_orderkey % 3 = 0 AS live FROM orders) q""")
def import_status(spark, sf):
    o = load(spark, sf, "orders")
    jobs = o.select(F.col("o_orderkey").alias("project_id"), F.expr(_STATE).alias("state"), F.lit(10).alias("progress"), F.lit("").alias("error"))
    live = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("project_id"), F.concat(F.lit("j"), F.col("o_orderkey").cast("string")).alias("job_id"))
    return C.import_status(jobs, live).select("project_id", "import_state", "import_error")


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query("active_runs", f"""SELECT run_id FROM (SELECT event_id AS run_id, event_type = 'click' AS running, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts, event_id) AS k, ts FROM events) q WHERE CASE WHEN running THEN k = 1 ELSE epoch({_NOW}) - epoch(ts) <= 600 END""")
def active_runs(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("project_id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), F.col("ts").cast("timestamp").alias("started"), F.col("ts").cast("timestamp").alias("finished"))
    return C.active_runs(e, "2024-01-20 00:00:00").select("run_id")


# Streams: a bounded folder of the given files driven to its end.
def stream(spark, sf, table):
    schema = load(spark, sf, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def run(spark, df, mode, keys=None):
    return S.run_to_table(df, mode, f"{workspace(spark)}/streams/{uuid.uuid4().hex}", keys)


_SV = "SELECT concat('S', CAST(o_custkey % 4 AS STRING)) AS scan_id, CAST(floor(x / 0.5) AS BIGINT) AS vx, CAST(floor(y / 0.5) AS BIGINT) AS vy, CAST(floor(z / 0.5) AS BIGINT) AS vz, count(*) AS n, CAST(sum(CAST(round_even(x * 1000000.0, 0) AS BIGINT)) AS DOUBLE) / count(*) / 1000000.0 AS sx FROM (SELECT o_custkey, ((o_orderkey * 137) % 8000) / 1000.0 AS x, ((o_orderkey * 7919 + o_custkey) % 6000) / 1000.0 AS y, ((o_orderkey * 31) % 2700) / 1000.0 AS z FROM orders) p GROUP BY 1, 2, 3, 4"


@query("stream_voxels", f"SELECT scan_id, vx, vy, vz, n, {r('sx', 'x', 9)} FROM ({_SV}) q")
def stream_voxels(spark, sf):
    o = stream(spark, sf, "orders")
    k = lambda e: (F.expr(e) / 1000.0).cast("double")
    p = o.select(F.concat(F.lit("S"), (F.col("o_custkey") % 4).cast("string")).alias("scan_id"), k("(o_orderkey * 137) % 8000").alias("x"), k("(o_orderkey * 7919 + o_custkey) % 6000").alias("y"), k("(o_orderkey * 31) % 2700").alias("z"))
    out = run(spark, S.stream_voxels(p, 0.5), "update", ["scan_id", "vx", "vy", "vz"])
    return out.select("scan_id", "vx", "vy", "vz", "n", clean(F.col("x"), 9).alias("x"))


_ES = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'running' END"


def job_events(spark, sf):
    return stream(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.expr(_ES).alias("state"), F.col("value").alias("progress"), F.col("ts").cast("timestamp").alias("ts"))


@query("stream_job_state", f"""SELECT job_id, arg_min(state, CASE WHEN state <> 'running' THEN seq ELSE 1000000000 - seq END) AS state, bool_or(state <> 'running') AS finished, count(*) AS updates FROM (SELECT user_id AS job_id, event_id AS seq, {_ES} AS state FROM events) e GROUP BY 1""")
def stream_job_state(spark, sf):
    return run(spark, S.stream_job_state(job_events(spark, sf)), "update", ["job_id"]).select("job_id", "state", "finished", "updates")


@query("stream_cancel", "SELECT event_id AS seq, coalesce(ts >= first_at, FALSE) AS cancelled FROM events LEFT JOIN (SELECT user_id, min(ts) AS first_at FROM events WHERE event_type = 'error' GROUP BY 1) c USING (user_id)")
def stream_cancel(spark, sf):
    c = stream(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"))
    first = run(spark, S.stream_first_cancels(c), "update", ["job_id"])
    return run(spark, S.stream_cancel(job_events(spark, sf), first), "append").select("seq", "cancelled")


@query("stream_transfers", "SELECT o_custkey AS transfer_id, CAST(sum(o_orderkey) AS BIGINT) AS bytes, count(*) AS chunks, sum(o_orderkey) > 60000 AS rejected FROM orders GROUP BY 1")
def stream_transfers(spark, sf):
    o = stream(spark, sf, "orders").select(F.col("o_custkey").alias("transfer_id"), F.col("o_orderkey").alias("bytes"))
    return run(spark, S.stream_transfers(o, 60000), "update", ["transfer_id"]).select("transfer_id", "bytes", "chunks", "rejected")


_TS = "%Y-%m-%d %H:%M:%S"
stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("stream_stalled", f"""SELECT job_id, strftime(min(ts), '{_TS}') AS start, strftime(max(ts) + INTERVAL 10 MINUTE, '{_TS}') AS stalled_at, count(*) AS updates FROM (
    SELECT *, sum(b) OVER (PARTITION BY job_id ORDER BY ts, seq) AS k FROM (SELECT user_id AS job_id, event_id AS seq, ts, {_ES} AS state, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS b FROM events) e) s
    GROUP BY job_id, k HAVING NOT bool_or(state <> 'running') AND max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_stalled(spark, sf):
    return run(spark, S.stream_stalled(job_events(spark, sf)), "append").select("job_id", stamp("start").alias("start"), stamp("stalled_at").alias("stalled_at"), "updates")


@query("stream_scan_stats", f"SELECT event_type AS scan_id, strftime(date_trunc('hour', ts), '{_TS}') AS start, count(*) AS points FROM events GROUP BY 1, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_scan_stats(spark, sf):
    e = stream(spark, sf, "events").select(F.col("event_type").alias("scan_id"), F.col("event_id").alias("point_id"), F.col("ts").cast("timestamp").alias("ts"))
    return run(spark, S.stream_scan_stats(e), "append").select("scan_id", stamp("start").alias("start"), "points")


# Keyed state that ends: all rows come in one batch, then the timers that the watermark has passed.
_JOB_FEED = f"""WITH e AS (SELECT user_id AS job_id, event_id AS seq, ts, {_ES} AS state, value AS progress FROM events),
    f AS (SELECT job_id, min(seq) FILTER (state <> 'running') AS fin FROM e GROUP BY 1), k AS (SELECT e.*, fin FROM e JOIN f USING (job_id) WHERE fin IS NULL OR seq <= fin),
    j AS (SELECT job_id, arg_max(state, seq) AS state, arg_max(progress, seq) AS progress, count(*) AS updates, max(fin) IS NOT NULL AS over, epoch_ms(max(ts)) + 3600000 <= (SELECT epoch_ms(max(ts)) - 600000 FROM events) AS quiet FROM k GROUP BY 1)"""


@query("stream_job_feed", _JOB_FEED + f" SELECT job_id, CASE WHEN NOT over AND quiet THEN 'error' ELSE state END AS state, {r('progress', 'progress')}, updates, over OR quiet AS finished FROM j")
def stream_job_feed(spark, sf):
    out = run(spark, K.stream_job_feed(job_events(spark, sf), idle="1 hour"), "update", ["job_id"])
    return out.select("job_id", "state", clean(F.col("progress")).alias("progress"), "updates", "finished")


@query("stream_transfer_feed", """WITH e AS (SELECT o_custkey AS transfer_id, o_orderkey AS seq, o_orderstatus = 'F' AS last, o_orderdate AS ts, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS total FROM orders),
    f AS (SELECT transfer_id, min(seq) FILTER (last OR total > 60000) AS fin FROM e GROUP BY 1), k AS (SELECT e.*, fin FROM e JOIN f USING (transfer_id) WHERE fin IS NULL OR seq <= fin)
    SELECT transfer_id, CAST(max(total) AS BIGINT) AS bytes, count(*) AS chunks, max(total) > 60000 AS rejected, max(fin) IS NOT NULL OR epoch_ms(max(ts)::TIMESTAMP) + 86400000 <= (SELECT epoch_ms(max(o_orderdate)::TIMESTAMP) - 600000 FROM orders) AS finished FROM k GROUP BY 1""")
def stream_transfer_feed(spark, sf):
    o = stream(spark, sf, "orders").select(F.col("o_custkey").alias("transfer_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("bytes"), (F.col("o_orderstatus") == "F").alias("last"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return run(spark, K.stream_transfer_feed(o, 60000), "update", ["transfer_id"])


# A scan is over with its last urgent order; those that the watermark has passed are given out.
_OVER = "SELECT concat('S', CAST(o_custkey % 40 AS STRING)) AS scan_id, max(o_orderdate) AS ended FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"


@query("stream_scan_voxels", f"""SELECT scan_id, vx, vy, vz, n, {r('sx', 'x', 9)} FROM ({_SV.replace('% 4', '% 40')}) q JOIN ({_OVER}) o USING (scan_id)
    WHERE epoch_ms(ended::TIMESTAMP) + 600000 <= (SELECT epoch_ms(max(o_orderdate)::TIMESTAMP) - 600000 FROM orders)""")
def stream_scan_voxels(spark, sf):
    o = stream(spark, sf, "orders")
    k = lambda e: (F.expr(e) / 1000.0).cast("double")
    scan, ts = F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("scan_id"), F.col("o_orderdate").cast("timestamp").alias("ts")
    p = o.select(scan, k("(o_orderkey * 137) % 8000").alias("x"), k("(o_orderkey * 7919 + o_custkey) % 6000").alias("y"), k("(o_orderkey * 31) % 2700").alias("z"), ts)
    out = run(spark, K.stream_scan_voxels(p, o.filter("o_orderpriority = '1-URGENT'").select(scan, ts), 0.5, 4), "append")
    return out.select("scan_id", "vx", "vy", "vz", "n", clean(F.col("x"), 9).alias("x"))
