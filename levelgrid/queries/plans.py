"""Queries on plan documents: geometry, rooms, validation, lookups, corrections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelgrid.functions import geometry as g
from levelgrid.functions.geometry import clean
from levelgrid.plans import corrections as J, documents as doc, lookup as L, rooms as R, validate as V
from levelgrid.queries.inputs import DUCK, SPARK, load, plan_sql, plan_tables, seeds, sql, wall_segments
from levelgrid.queries.registry import query
from levelgrid.queries.scans import r
from levelgrid.queries.walls import CP, LI, PLAN, SEG, WALLS, _CP, _SEG, lay, line_points
from levelgrid.session import settle, workspace
from levelgrid.sources import tables

D = plan_sql(DUCK)
BASE, GRID, VERTS, OPENS, FIX = D["base"], D["grid_r"], D["vertices"], D["openings"], D["fixtures"]
r6 = lambda c: clean(F.col(c) if isinstance(c, str) else c)

# Pairs of segments: each customer segment with a shifted copy of itself.
_TWO = f"SELECT seg, x1, y1, x2, y2, x1 + 0.25 AS x3, y1 - 0.5 AS y3, x1 + 1.75 AS x4, y1 + 2.0 AS y4 FROM ({SEG}) s"


def two(spark, sf):
    s = sql(spark, sf, _SEG)
    return s.withColumns({"x3": F.col("x1") + 0.25, "y3": F.col("y1") - 0.5, "x4": F.col("x1") + 1.75, "y4": F.col("y1") + 2.0})


@query("vector_scalars", f"""SELECT seg, {r('x1 * x2 + y1 * y2', 'dot')}, {r('x1 * y2 - y1 * x2', 'cross')}, {r('sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))', 'dist')},
    {r('CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE (x2 - x1) / sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) END', 'ux')}, {r('0 - y1', 'lx')}, {r('x1 * 0.5 - y1 * sqrt(3) / 2', 'rx')}, abs(x1 - x2) <= 1e-9 AND abs(y1 - y2) <= 1e-9 AS same FROM ({SEG}) s""")
def vector_scalars(spark, sf):
    a, b = g.xy("x1", "y1"), g.xy("x2", "y2")
    s = sql(spark, sf, _SEG)
    return s.select("seg", r6(g.dot(a, b)).alias("dot"), r6(g.cross(a, b)).alias("cross"), r6(g.dist(a, b)).alias("dist"), r6(g.unit(g.sub(b, a)).x).alias("ux"), r6(g.left(a).x).alias("lx"), r6(g.rotate(a, 60.0).x).alias("rx"), g.same_point(a, b).alias("same"))


_DEN = "((x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3))"
_T = f"(((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / {_DEN})"
_U = f"(((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / {_DEN})"


@query("line_intersections", f"""SELECT seg, {r(_T, 't')}, CASE WHEN {_T} BETWEEN -1e-9 AND 1 + 1e-9 AND {_U} BETWEEN -1e-9 AND 1 + 1e-9 THEN TRUE ELSE FALSE END AS meets,
    {r('((x3 - x1) * (x2 - x1) + (y3 - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))', 'foot')} FROM ({_TWO}) s WHERE abs({_DEN}) >= 1e-9""")
def line_intersections(spark, sf):
    a, b, c, d = (g.xy(f"x{i}", f"y{i}") for i in range(1, 5))
    s = two(spark, sf).withColumn("t", g.line_param(a, g.sub(b, a), c, g.sub(d, c))).filter("t is not null")
    t, _ = g.segment_params(a, b, c, d)
    return s.select("seg", r6("t").alias("t"), t.isNotNull().alias("meets"), r6(g.foot_param(c, a, b)).alias("foot"))


_CL = "least(1.0, greatest(0.0, ((x3 - x1) * (x2 - x1) + (y3 - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0)))"


@query("segment_distances", f"""SELECT seg, {r('sqrt((x3 - px) * (x3 - px) + (y3 - py) * (y3 - py))', 'gap')} FROM (SELECT *, x1 + (x2 - x1) * coalesce(t, 0) AS px, y1 + (y2 - y1) * coalesce(t, 0) AS py FROM (SELECT *, {_CL} AS t FROM ({_TWO}) s) q) p""")
def segment_distances(spark, sf):
    a, b, c = g.xy("x1", "y1"), g.xy("x2", "y2"), g.xy("x3", "y3")
    return two(spark, sf).select("seg", r6(g.distance_to_segment(c, a, b)).alias("gap"))


@query("joint_angles", f"SELECT seg, {r('degrees(acos(least(1.0, greatest(-1.0, ((x2 - x1) * (x4 - x1) + (y2 - y1) * (y4 - y1)) / (sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) * sqrt((x4 - x1) * (x4 - x1) + (y4 - y1) * (y4 - y1)))))))', 'angle', 4)}, CAST(floor(x1 / 4 + 0.5) AS BIGINT) AS half_up FROM ({_TWO}) s WHERE x1 <> x2 OR y1 <> y2")
def joint_angles(spark, sf):
    a, b, d = g.xy("x1", "y1"), g.xy("x2", "y2"), g.xy("x4", "y4")
    s = two(spark, sf).filter("x1 <> x2 or y1 <> y2")
    return s.select("seg", clean(g.joint_angle_deg(a, b, d), 4).alias("angle"), g.js_round(F.col("x1") / 4).alias("half_up"))


# An L-shaped ring per part: a by b with a notch of half of each.
def rings(spark, sf):
    p = load(spark, sf, "part")
    a, b = F.col("p_size") + 1.0, F.col("p_partkey") % 17 + 2.0
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    ring = F.array(at(z, z), at(z, z), at(a, z), at(a, b / 2), at(a / 2, b / 2), at(a / 2, b), at(z, b), at(z, z))
    return p.select(F.col("p_partkey").alias("id"), a.alias("a"), b.alias("b"), ring.alias("ring"))


_AB = "SELECT p_partkey AS id, p_size + 1.0 AS a, p_partkey % 17 + 2.0 AS b FROM part"


@query("ring_measures", f"SELECT id, {r('a * b * 0.75', 'area')}, {r('(0 + a + a + a / 2 + a / 2 + 0) / 6', 'cx')}, 6 AS points FROM ({_AB}) q")
def ring_measures(spark, sf):
    s = rings(spark, sf).withColumn("clean", g.dedupe_ring(F.col("ring")))
    return s.select("id", r6(g.ring_area(F.col("clean"))).alias("area"), r6(g.ring_centroid(F.col("clean")).x).alias("cx"), F.size("clean").alias("points"))


@query("point_in_ring", f"SELECT id, k, CASE WHEN x >= 0 AND x < a AND y >= 0 AND y < b AND NOT (x >= a / 2 AND y >= b / 2) THEN TRUE ELSE FALSE END AS inside FROM (SELECT *, a * k / 7.0 - 0.25 AS x, b * ((k * 3) % 8) / 7.0 AS y FROM ({_AB}) q, (SELECT unnest(generate_series(0, 7)) AS k) s) p")
def point_in_ring(spark, sf):
    s = rings(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")))
    p = g.P(F.col("a") * F.col("k") / 7.0 - 0.25, F.col("b") * ((F.col("k") * 3) % 8) / 7.0)
    return s.select("id", "k", g.point_in_ring(p, F.col("ring")).alias("inside"))


@query("closest_on_ring", f"SELECT id, {r('a', 'x')}, {r('b / 4', 'y')}, {r('1.0', 'gap')} FROM ({_AB}) q")
def closest_on_ring(spark, sf):
    s = rings(spark, sf)
    p = g.P(F.col("a") + 1.0, F.col("b") / 4)
    c = g.closest_on_ring(p, F.col("ring"))
    return s.select("id", r6(c.x).alias("x"), r6(c.y).alias("y"), r6(g.distance_to_ring(p, F.col("ring"))).alias("gap"))


@query("clip_convex", f"SELECT id, {r('a / 2 * (b / 3)', 'area')} FROM ({_AB}) q")
def clip_convex(spark, sf):
    s = rings(spark, sf)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, z = F.col("a"), F.col("b"), F.lit(0.0)
    one = F.array(at(z, z), at(a, z), at(a, b), at(z, b))
    other = F.array(at(a / 2, -b), at(a * 2, -b), at(a * 2, b / 3), at(a / 2, b / 3))
    s = s.withColumn("cut", g.clip_convex(one, other))
    return s.select("id", r6(g.ring_area(F.col("cut"))).alias("area"))


@query("wall_polygons", f"""SELECT plan_id, wall_id, {r("len * t - (CASE WHEN dega = 3 THEN CASE WHEN la THEN t * t / 8 ELSE t * t / 4 END WHEN dega = 4 THEN t * t / 4 ELSE 0 END) - (CASE WHEN degb = 3 THEN CASE WHEN lb THEN t * t / 8 ELSE t * t / 4 END WHEN degb = 4 THEN t * t / 4 ELSE 0 END)", 'area', 9)} FROM (
    SELECT plan_id, concat('w', CAST(j * nx + i + 1 AS STRING)) AS wall_id, t, 5 AS len, i > 0 AS la, i + 1 < nx AS lb, CAST(i > 0 AS INT) + 1 + CAST(j > 0 AS INT) + CAST(j < ny AS INT) AS dega, 1 + CAST(i + 1 < nx AS INT) + CAST(j > 0 AS INT) + CAST(j < ny AS INT) AS degb FROM ({D['grid_h']}) h
    UNION ALL SELECT plan_id, concat('w', CAST(nx * (ny + 1) + j * (nx + 1) + i + 1 AS STRING)), t, 4, j > 0, j + 1 < ny, CAST(j > 0 AS INT) + 1 + CAST(i > 0 AS INT) + CAST(i < nx AS INT), 1 + CAST(j + 1 < ny AS INT) + CAST(i > 0 AS INT) + CAST(i < nx AS INT) FROM ({D['grid_u']}) u) q""")
def wall_polygons(spark, sf):
    t = plan_tables(spark, sf)
    return R.wall_polygons(t.vertices, t.walls).select("plan_id", "wall_id", clean(F.abs(g.ring_area(F.col("ring"))), 9).alias("area"))


@query("max_join_spike", f"SELECT plan_id, {r('t / 2 * sqrt(2)', 'spike')} FROM ({BASE}) b")
def max_join_spike(spark, sf):
    t = plan_tables(spark, sf)
    return R.max_join_spike(t.vertices, t.walls, R.wall_polygons(t.vertices, t.walls)).select("plan_id", r6("spike").alias("spike"))


@query("free_faces", f"SELECT plan_id, {r('(5 - t) * (4 - t)', 'area')}, {r('5 * i + t / 2', 'min_x')}, {r('4 * j + t / 2', 'min_y')} FROM ({GRID}) r")
def free_faces(spark, sf):
    t = plan_tables(spark, sf)
    f = R.free_faces(R.wall_polygons(t.vertices, t.walls))
    b = g.ring_bounds(F.col("ring"))
    return f.select("plan_id", r6("area").alias("area"), r6(b["min_x"]).alias("min_x"), r6(b["min_y"]).alias("min_y"))


# Plans with a separator have their first room cut in two halves.
@query("cut_faces", f"""SELECT plan_id, {r('CASE WHEN s % 4 = 1 AND i = 0 AND j = 0 THEN (5 - t) * (4 - t) / 2 ELSE (5 - t) * (4 - t) END', 'area')} FROM ({GRID}) r
    UNION ALL SELECT plan_id, {r('(5 - t) * (4 - t) / 2', 'area')} FROM ({BASE}) b WHERE s % 4 = 1""")
def cut_faces(spark, sf):
    t = plan_tables(spark, sf)
    return R.cut_faces(t.vertices, t.walls, t.separators).select("plan_id", r6("area").alias("area"))


_ROOM = f"SELECT plan_id, concat('r', CAST(j * nx + i + 1 AS STRING)) AS room_id, (5 - t) * (4 - t) AS area, i, j, nx, ny, s, t FROM ({GRID}) r"


def rooms_of(spark, sf, t=None, cut=False):
    t = plan_tables(spark, sf) if t is None else t
    return R.rooms(t.vertices, t.walls, seeds(t), t.separators if cut else None)


@query("rooms", f"SELECT plan_id, room_id, {r('area', 'area')}, {r('5 * i + 2.5', 'x')}, {r('4 * j + 2', 'y')} FROM ({_ROOM}) q")
def rooms(spark, sf):
    return rooms_of(spark, sf)[0].select("plan_id", "room_id", r6("area").alias("area"), r6("x").alias("x"), r6("y").alias("y"))


# Seeds shifted: every third plan loses its first seed, every fifth one has two seeds in a room.
@query("room_issues", f"""SELECT plan_id, 'r1' AS element_id, 'room_seed_lost' AS code FROM ({BASE}) b WHERE s % 3 = 0 UNION ALL SELECT plan_id, CASE WHEN s % 3 = 0 THEN 'r9' ELSE 'r1' END, 'room_not_split' FROM ({BASE}) b WHERE s % 5 = 0 AND s % 3 <> 0""")
def room_issues(spark, sf):
    t = plan_tables(spark, sf)
    n = F.substring("plan_id", 2, 9).cast("int")
    s = seeds(t)
    first = F.col("room_id") == "r1"
    s = s.withColumn("y", F.when(first & (n % 3 == 0), -5.0).otherwise(F.col("y")))
    more = s.filter(first & (n % 5 == 0)).withColumns({"room_id": F.lit("r9"), "x": F.col("x") + 0.5, "y": F.lit(2.0)})
    _, issues = R.rooms(t.vertices, t.walls, s.unionByName(more))
    return issues.select("plan_id", "element_id", "code")


@query("room_bounds", f"SELECT plan_id, 'plan' AS source, {r('5 - t', 'width')}, {r('4 - t', 'depth')}, {r('(5 - t) * (4 - t)', 'area')} FROM ({BASE}) b WHERE s % 2 = 0 UNION ALL SELECT plan_id, CASE WHEN s % 3 = 0 THEN 'scan' ELSE 'none' END, CASE WHEN s % 3 = 0 THEN 3.0 ELSE -1.0 END, CASE WHEN s % 3 = 0 THEN 2.0 ELSE -1.0 END, CASE WHEN s % 3 = 0 THEN 6.0 ELSE -1.0 END FROM ({BASE}) b WHERE s % 2 = 1")
def room_bounds(spark, sf):
    t = plan_tables(spark, sf)
    n = F.substring("plan_id", 2, 9).cast("int")
    faces = R.free_faces(R.wall_polygons(t.vertices, t.walls.filter(n % 2 == 0)))
    box = t.levels.filter(n % 3 == 0).select(*PLAN, F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(3.0).alias("max_x"), F.lit(2.0).alias("max_y"))
    b = R.room_bounds(faces, t.levels, box)
    return b.select("plan_id", "source", *[F.coalesce(r6(c), F.lit(-1.0)).alias(c) for c in ("width", "depth", "area")])


_OUT = f"SELECT plan_id, 'f3' AS fixture_id, 'The block at x=' || printf('%.2f', x) || ' m, y=2.00 m, 0.50 m by 0.50 m, is outside the room.' AS message FROM ({FIX}) f WHERE fixture_id = 'f3' UNION ALL SELECT plan_id, 'f2', 'The sofa at x=2.50 m, y=3.00 m, 2.00 m by 0.90 m, is outside the room.' FROM ({BASE}) b WHERE s % 4 <> 0"


def first_rooms(spark, sf):
    b = lay(spark, sf, "base").withColumn("h", F.col("t").cast("double") / 2.0)
    at = lambda dx, dy, sx, sy: F.struct((dx + sx * F.col("h")).alias("x"), (dy + sy * F.col("h")).alias("y"))
    return b.select(*PLAN, F.array(at(0.0, 0.0, 1, 1), at(5.0, 0.0, -1, 1), at(5.0, 4.0, -1, -1), at(0.0, 4.0, 1, -1)).alias("ring"))


@query("outside_items", _OUT)
def outside_items(spark, sf):
    return L.outside_items(plan_tables(spark, sf).fixtures, first_rooms(spark, sf)).select("plan_id", "fixture_id", "message")


@query("read_plans", f"SELECT plan_id, CAST(2 AS INT) AS version, 1 AS levels, CAST((nx + 1) * (ny + 1) + CASE WHEN s % 4 = 1 THEN 2 ELSE 0 END AS INT) AS vertices, CAST(nx * (ny + 1) + (nx + 1) * ny AS INT) AS walls, FALSE AS refused FROM ({BASE}) b WHERE s % 10 < 6 UNION ALL SELECT plan_id, -1, -1, -1, -1, TRUE FROM ({BASE}) b WHERE s % 10 >= 6")
def read_plans(spark, sf):
    text = tables.plan_json(documents(spark, sf))
    n = F.substring("plan_id", 2, 9).cast("int") % 10
    # A wrong version, and fields the schema lacks at three depths.
    spoils = {9: ('"schemaVersion":2', '"schemaVersion":1'), 8: (r'"vertices":\[\{', '"vertices":[{"odd":1,'), 7: (r'"sheet":\{', '"sheet":{"odd":1,'), 6: (r'"titleBlock":\{', '"titleBlock":{"odd":1,')}
    value = F.col("value")
    for k, (a, b) in spoils.items():
        value = F.when(n == k, F.regexp_replace("value", a, b)).otherwise(value)
    path = f"{workspace(spark)}/read-plans/{uuid.uuid4().hex}"
    text.select("plan_id", value.alias("value")).write.json(path)
    good, bad = tables.read_plan_lines(spark, path)
    size = lambda c: F.size(F.col("levels")[0][c])
    a = good.select("plan_id", F.col("schemaVersion").alias("version"), F.size("levels").alias("levels"), size("vertices").alias("vertices"), size("walls").alias("walls"), F.lit(False).alias("refused"))
    none = [F.lit(-1).alias(c) for c in ("version", "levels", "vertices", "walls")]
    return a.unionByName(bad.select("plan_id", *none, F.lit(True).alias("refused")))


def documents(spark, sf, t=None):
    t = plan_tables(spark, sf) if t is None else t
    names = t.levels.select("plan_id", F.concat(F.lit("Plan "), "plan_id").alias("name")).distinct()
    return doc.assemble_plans(t, names)


@query("write_plans", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, concat('P', CAST(s_suppkey AS STRING)) AS name, 'm' AS units, 'A3' AS paper, TRUE AS same FROM supplier")
def write_plans(spark, sf):
    names = load(spark, sf, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("plan_id"))
    plans = doc.blank_plans(names.withColumn("name", F.col("plan_id")))
    text = tables.plan_json(plans)
    path = f"{workspace(spark)}/write-plans/{uuid.uuid4().hex}"
    tables.write_plans(plans, path)
    back, _ = tables.read_plan_lines(spark, path)
    again = tables.plan_json(back).withColumnRenamed("value", "v2")
    at = lambda p: F.get_json_object("value", p)
    return text.join(again, "plan_id").select("plan_id", at("$.sheet.titleBlock.project").alias("name"), at("$.units").alias("units"), at("$.sheet.paper").alias("paper"), (F.col("value") == F.col("v2")).alias("same"))


@query("assemble_plans", f"SELECT plan_id, CAST(nx * ny AS INT) AS rooms, CAST(2 * nx AS INT) AS openings, 'v1' AS first_vertex, CASE WHEN s % 3 = 0 THEN 1.0 ELSE 0.0 END AS stair_dir FROM ({BASE}) b")
def assemble_plans(spark, sf):
    t = plan_tables(spark, sf)
    t = t.with_(stairs=t.stairs.withColumn("direction", F.struct(F.lit(0.0).alias("x"), F.lit(7.0).alias("y"))))
    d = documents(spark, sf, t).withColumn("l", F.col("levels")[0])
    v = F.filter("l.vertices", lambda x: x["id"].startswith("v"))
    return d.select("plan_id", F.size("l.rooms").alias("rooms"), F.size("l.openings").alias("openings"), F.get(v, F.lit(0))["id"].alias("first_vertex"), F.coalesce(F.get(F.col("l.stairs"), F.lit(0))["direction"]["y"], F.lit(0.0)).alias("stair_dir"))


@query("explode_plans", f"SELECT plan_id, 'walls' AS part, count(*) AS n FROM ({WALLS}) w GROUP BY 1 UNION ALL SELECT plan_id, 'fixtures', count(*) FROM ({FIX}) f GROUP BY 1")
def explode_plans(spark, sf):
    t = doc.explode_plans(settle(documents(spark, sf)))
    n = lambda df, p: df.groupBy("plan_id").agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("n"))
    return n(t.walls, "walls").unionByName(n(t.fixtures, "fixtures"))


# Case files: one JSON text per document row, told apart by op.
@query("read_vectors", "SELECT CASE doc_id % 3 WHEN 0 THEN 'rooms' WHEN 1 THEN 'snap' ELSE 'pick' END AS op, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def read_vectors(spark, sf):
    d = load(spark, sf, "documents")
    op = F.when(F.col("doc_id") % 3 == 0, "rooms").when(F.col("doc_id") % 3 == 1, "snap").otherwise("pick")
    text = d.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("name"), op.alias("op"), F.struct("text").alias("input"), F.struct("n_chars").alias("expect"))).alias("value"))
    v = text.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in ("name", "op", "input", "expect")])
    return v.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("expect", "$.n_chars").cast("bigint")).alias("chars"))


@query("changed_walls", f"""SELECT plan_id, wall_id, CASE WHEN s % 4 = 0 THEN 'missing' WHEN s % 4 = 1 THEN 'thickness' ELSE 'moved' END AS reason FROM ({WALLS}) w JOIN (SELECT plan_id AS pid, s FROM ({BASE}) b) b ON b.pid = w.plan_id
    WHERE (s % 4 < 2 AND wall_id = 'w1') OR (s % 4 = 2 AND (a = 'v1' OR b = 'v1'))""".replace("a = 'v1' OR b = 'v1'", "w.a = 'v1' OR w.b = 'v1'"))
def changed_walls(spark, sf):
    t = plan_tables(spark, sf)
    n = F.substring("plan_id", 2, 9).cast("int") % 4
    one = F.col("wall_id") == "w1"
    walls = t.walls.filter(~(one & (n == 0))).withColumn("thickness", F.when(one & (n == 1), 0.33).otherwise(F.col("thickness")))
    verts = t.vertices.withColumn("x", F.when((n == 2) & (F.col("vertex_id") == "v1"), F.col("x") - 0.5).otherwise(F.col("x")))
    return doc.changed_walls(t, t.with_(walls=walls, vertices=verts)).select("plan_id", "wall_id", "reason")


@query("symbol_dim", f"SELECT plan_id, fixture_id, CASE WHEN symbol = 'toilet' THEN 'fixture' ELSE 'furniture' END AS dim_role, CASE symbol WHEN 'toilet' THEN 0.4 WHEN 'sofa' THEN 2.0 ELSE 0.6 END AS dim_width FROM ({FIX}) f")
def symbol_dim(spark, sf):
    dim = F.broadcast(doc.symbol_dim(spark))
    f = plan_tables(spark, sf).fixtures.select("plan_id", "fixture_id", "symbol")
    return f.join(dim, "symbol").select("plan_id", "fixture_id", F.col("role").alias("dim_role"), F.col("width").alias("dim_width"))


# Spoiled plans: one fault per plan, by its number.
def spoiled(spark, sf):
    t = plan_tables(spark, sf)
    n = F.substring("plan_id", 2, 9).cast("int") % 10
    put = lambda df, k, c, cond, v: df.withColumn(c, F.when((n == k) & cond, v).otherwise(F.col(c)))
    w1, o1, f1 = F.col("wall_id") == "w1", F.col("opening_id") == "o1", F.col("fixture_id") == "f1"
    walls = put(put(put(t.walls, 1, "b", w1, F.col("a")), 2, "b", w1, F.lit("v99")), 3, "thickness", w1, F.lit(1.6))
    opens = put(put(put(put(t.openings, 4, "head", o1, F.lit(0.0)), 5, "wall_id", o1, F.lit("w99")), 6, "width", o1, F.lit(5.0)), 7, "kind", o1, F.lit("hatch"))
    fix = put(t.fixtures, 8, "fixture_id", f1, F.lit("v1"))
    verts = put(t.vertices, 9, "x", F.col("vertex_id") == "v1", F.lit(float("nan")))
    stairs = t.stairs.withColumn("to_elevation", F.lit(0.0))
    return t.with_(walls=walls, openings=opens, fixtures=fix, vertices=verts, stairs=stairs)


def _at(k, element, rule):
    return f"SELECT plan_id, '{element}' AS element_id, '{rule}' AS rule FROM ({BASE}) b WHERE s % 10 = {k}"


@query("check_unique_ids", _at(8, "v1", "duplicate_id"))
def check_unique_ids(spark, sf):
    return V.check_unique_ids(spoiled(spark, sf)).select("plan_id", "element_id", "rule")


@query("check_references", f"{_at(1, 'w1', 'wall_same_vertex')} UNION ALL {_at(2, 'w1', 'wall_missing_vertex')} UNION ALL {_at(5, 'o1', 'opening_missing_wall')}")
def check_references(spark, sf):
    return V.check_references(spoiled(spark, sf)).select("plan_id", "element_id", "rule")


@query("check_openings", f"{_at(4, 'o1', 'head_below_sill')} UNION ALL {_at(6, 'o1', 'wider_than_wall')} UNION ALL {_at(1, 'o1', 'wider_than_wall')}")
def check_openings(spark, sf):
    return V.check_openings(spoiled(spark, sf)).select("plan_id", "element_id", "rule")


@query("check_stairs", f"SELECT plan_id, 's1' AS element_id, 'does_not_rise' AS rule FROM ({BASE}) b WHERE s % 3 = 0")
def check_stairs(spark, sf):
    return V.check_stairs(spoiled(spark, sf)).select("plan_id", "element_id", "rule")


@query("check_fields", f"{_at(3, 'w1', 'walls.thickness range')} UNION ALL {_at(7, 'o1', 'openings.kind known')} UNION ALL {_at(9, 'v1', 'vertices.x finite')}")
def check_fields(spark, sf):
    return V.check_fields(spoiled(spark, sf)).select("plan_id", "element_id", "rule")


@query("validate", f"SELECT plan_id, count(*) AS violations FROM (SELECT plan_id FROM ({BASE}) b WHERE s % 10 <> 0 UNION ALL SELECT plan_id FROM ({BASE}) b WHERE s % 10 = 1 UNION ALL SELECT plan_id FROM ({BASE}) b WHERE s % 3 = 0) q GROUP BY 1")
def validate(spark, sf):
    return V.validate(spoiled(spark, sf)).groupBy("plan_id").agg(F.count(F.lit(1)).alias("violations"))


_RAW = """SELECT concat('P', CAST(user_id AS STRING)) AS plan_id, event_id AS arrival, CASE event_type WHEN 'error' THEN 'open_gap' WHEN 'click' THEN 'units_guessed' WHEN 'view' THEN 'mezzanine' ELSE 'non_manhattan' END AS code,
    CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'loud' END AS severity, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('m', CAST(event_id AS STRING)) END AS message, CASE WHEN event_id % 5 = 0 THEN '9x' ELSE 'w1' END AS element_id FROM {events}"""


@query("consolidate_issues", f"""SELECT plan_id, code, CASE WHEN severity = 'info' THEN 'info' ELSE 'warning' END AS severity, CASE WHEN message = '' THEN replace(code, '_', ' ') ELSE message END AS message, CASE WHEN element_id = '9x' THEN '-' ELSE element_id END AS element_id FROM (
    SELECT *, row_number() OVER (PARTITION BY plan_id, code ORDER BY arrival) AS k FROM ({_RAW.format(events='events')}) e WHERE code <> 'mezzanine') q WHERE k = 1""")
def consolidate_issues(spark, sf):
    c = V.consolidate_issues(sql(spark, sf, _RAW))
    return c.select("plan_id", "code", "severity", "message", F.coalesce("element_id", F.lit("-")).alias("element_id"))


@query("check_exports", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'The export record needs a value for fileId.' WHEN 1 THEN 'The export record cannot hold a URL or a token (name).' WHEN 2 THEN 'savedAt must be an ISO date and time.' ELSE 'fine' END AS reason FROM events""")
def check_exports(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id") % 5
    rec = e.select(
        "event_id", F.when(k == 0, " ").otherwise("f1").alias("fileId"), F.lit("v1").alias("versionId"), F.lit("d1").alias("folderId"),
        F.when(k == 1, "https://x").otherwise(F.col("event_type")).alias("name"), F.when(k == 2, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("savedAt"),
    )
    return V.check_exports(rec).select("event_id", F.coalesce("reason", F.lit("fine")).alias("reason"))


# Lookups.
@query("lookup", f"""SELECT plan_id, point_id, 'vertex' AS kind, 'v1' AS item, 0.05 AS distance FROM (SELECT plan_id, 1 AS point_id FROM ({BASE}) b) q UNION ALL SELECT plan_id, 2, 'opening', 'o1', 0.05 FROM ({BASE}) b UNION ALL SELECT plan_id, 3, 'wall', 'w1', 0.02 FROM ({BASE}) b UNION ALL SELECT plan_id, 4, 'room', 'r1', 0.0 FROM ({BASE}) b""")
def lookup(spark, sf):
    t = plan_tables(spark, sf)
    rooms = settle(rooms_of(spark, sf, t)[0])
    at = lambda i, x, y: F.struct(F.lit(i).alias("point_id"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    q = t.levels.select(*PLAN, F.explode(F.array(at(1, 0.05, 0.0), at(2, 2.4, 0.05), at(3, 4.0, 0.02), at(4, 4.4, 1.2))).alias("p")).select(*PLAN, "p.*")
    hits = L.lookup(q, L.pick_features(t, rooms), 0.08)
    return hits.filter("rank = 1").select("plan_id", "point_id", "kind", "item", r6("distance").alias("distance"))


# Cursors on all walls and vertices of every plan: 1 a corner, 2 a wall, 3 the inner or right outer wall at x = 5,
# 4 nothing but the grid, 5 a turned ray, 6 below the plan and out of reach of any extension, 7 left of the south wall,
# 8 its middle, where a quarter of the plans have a vertex (u1, on one line with v1), 9 and 10 one guide each.
# Of vertices on one guide the least id is named.
@query("snap", f"""SELECT plan_id, point_id, CASE WHEN point_id = 8 AND s % 4 = 1 THEN 'vertex' ELSE kind END AS kind, x, y, CASE WHEN point_id IN (8, 10) AND s % 4 = 1 THEN 'u1' WHEN point_id = 3 THEN concat('w', CAST(nx * (ny + 1) + 2 AS STRING)) WHEN point_id IN (6, 9) THEN least('v2', concat('v', CAST(nx + 3 AS STRING)), CASE WHEN ny = 2 THEN concat('v', CAST(2 * nx + 4 AS STRING)) ELSE 'v2' END) ELSE item END AS item FROM (SELECT plan_id, s, nx, ny FROM ({BASE}) b) b,
    (VALUES (1, 'vertex', 0.0::DOUBLE, 0.0::DOUBLE, 'v1'), (2, 'foot', 4.0, 0.0, 'w1'), (3, 'foot', 5.0, 1.5, ''), (4, 'grid', 1.23, 1.46, '-'), (5, 'angle', 1.5, 1.5, '-'), (6, 'alignment', 5.0, -2.5, 'v2'), (7, 'extension', -1.0, 0.0, 'w1'), (8, 'midpoint', 2.5, 0.0, 'w1'), (9, 'alignment', 5.0, -2.5, 'v2'), (10, 'alignment', -2.5, 0.0, 'v1')) v(point_id, kind, x, y, item)""")
def snap(spark, sf):
    t = plan_tables(spark, sf)
    at = lambda i, x, y, d=None: F.struct(F.lit(i).alias("point_id"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.5).alias("px"), F.lit(0.5).alias("py"), F.lit(d).cast("double").alias("dir_x"), F.lit(d).cast("double").alias("dir_y"))
    spots = [(0.03, 0.04), (4.0, 0.05), (4.96, 1.5), (1.2321, 1.4621), (1.502, 1.498, 1.0), (4.96, -2.5), (-1.0, 0.04), (2.46, 0.03), (5.07, -2.5), (-2.5, 0.06)]
    q = t.levels.select(*PLAN, F.explode(F.array(*[at(i, *p) for i, p in enumerate(spots, 1)])).alias("p")).select(*PLAN, "p.*")
    s = L.snap(q, t, 100.0)
    return s.select("plan_id", "point_id", "kind", r6("x").alias("x"), r6("y").alias("y"), F.coalesce("item", F.lit("-")).alias("item"))


_SHAPES = f"""SELECT plan_id, 'vertex' AS kind, vertex_id AS item, x AS x0, y AS y0, x AS x1, y AS y1 FROM ({VERTS}) v UNION ALL SELECT plan_id, 'fixture', fixture_id, CASE WHEN rotation_deg = 90 THEN x - depth / 2 ELSE x - width / 2 END, CASE WHEN rotation_deg = 90 THEN y - width / 2 ELSE y - depth / 2 END,
    CASE WHEN rotation_deg = 90 THEN x + depth / 2 ELSE x + width / 2 END, CASE WHEN rotation_deg = 90 THEN y + width / 2 ELSE y + depth / 2 END FROM ({FIX}) f UNION ALL SELECT plan_id, 'text', text_id, x, y, x, y FROM ({D['texts']}) t"""


@query("items_in_box", f"SELECT plan_id, mode AS box_id, kind, item FROM ({_SHAPES}) s, (VALUES ('window'), ('crossing')) m(mode) WHERE CASE WHEN mode = 'window' THEN x0 >= -0.5 AND y0 >= -0.5 AND x1 <= 2.6 AND y1 <= 3.3 ELSE x1 >= -0.5 AND y1 >= -0.5 AND x0 <= 2.6 AND y0 <= 3.3 END")
def items_in_box(spark, sf):
    t = plan_tables(spark, sf)
    b = t.levels.select(*PLAN, F.explode(F.array(F.lit("window"), F.lit("crossing"))).alias("mode")).withColumns({"box_id": F.col("mode"), "min_x": F.lit(-0.5), "min_y": F.lit(-0.5), "max_x": F.lit(2.6), "max_y": F.lit(3.3)})
    hits = L.items_in_box(b, L.selection_shapes(t))
    return hits.filter("kind in ('vertex', 'fixture', 'text')").select("plan_id", "box_id", "kind", "item")


@query("clear_distance", f"SELECT plan_id, {r('4 - t', 'clear')}, 1.0 AS side FROM ({BASE}) b")
def clear_distance(spark, sf):
    t = plan_tables(spark, sf)
    nx = lay(spark, sf, "base").select(*PLAN, F.lit("w1").alias("wall_id"), F.concat(F.lit("w"), (F.col("nx") + 1).cast("string")).alias("other_id"))
    return L.clear_distance(nx, t).select("plan_id", r6("clear").alias("clear"), "side")


@query("parallel_neighbors", f"""SELECT plan_id, concat('w', CAST(j * nx + i + 1 AS STRING)) AS wall_id, 'left' AS side, concat('w', CAST((j + 1) * nx + i + 1 AS STRING)) AS other_id, {r('4 - t', 'clear')} FROM ({D['grid_h']}) h WHERE j < ny
    UNION ALL SELECT plan_id, concat('w', CAST(j * nx + i + 1 AS STRING)), 'right', concat('w', CAST((j - 1) * nx + i + 1 AS STRING)), {r('4 - t', 'clear')} FROM ({D['grid_h']}) h WHERE j > 0
    UNION ALL SELECT plan_id, concat('w', CAST(nx * (ny + 1) + j * (nx + 1) + i + 1 AS STRING)), 'right', concat('w', CAST(nx * (ny + 1) + j * (nx + 1) + i + 2 AS STRING)), {r('5 - t', 'clear')} FROM ({D['grid_u']}) u WHERE i < nx
    UNION ALL SELECT plan_id, concat('w', CAST(nx * (ny + 1) + j * (nx + 1) + i + 1 AS STRING)), 'left', concat('w', CAST(nx * (ny + 1) + j * (nx + 1) + i AS STRING)), {r('5 - t', 'clear')} FROM ({D['grid_u']}) u WHERE i > 0""")
def parallel_neighbors(spark, sf):
    return L.parallel_neighbors(plan_tables(spark, sf)).select("plan_id", "wall_id", "side", "other_id", r6("clear").alias("clear"))


@query("resolve_refs", f"SELECT plan_id, segment, \"end\", x, 0.0 AS y FROM (SELECT plan_id FROM ({BASE}) b) b, (VALUES (0, 'a', 0.0::DOUBLE), (0, 'b', 2.05), (1, 'a', 2.05), (1, 'b', 2.95)) v(segment, \"end\", x)")
def resolve_refs(spark, sf):
    t = plan_tables(spark, sf)
    return L.resolve_refs(V.dimension_refs(t.dimensions), t).select("plan_id", "segment", "end", r6("x").alias("x"), r6("y").alias("y"))


@query("opening_rect", f"""SELECT o.plan_id, o.opening_id, {r('w.x1 + 5 * o."offset" - o.width / 2', 'min_x')}, {r('w.y1 - w.thickness / 2', 'min_y')}, {r('o.width * w.thickness', 'area')} FROM ({OPENS}) o JOIN ({WALLS}) w USING (plan_id, wall_id)""")
def opening_rect(spark, sf):
    o = L.opening_rect(plan_tables(spark, sf))
    b = g.ring_bounds(F.col("ring"))
    return o.select("plan_id", "opening_id", r6(b["min_x"]).alias("min_x"), r6(b["min_y"]).alias("min_y"), r6(F.abs(g.ring_area(F.col("ring")))).alias("area"))


@query("offset_along_wall", f"SELECT seg, {r('coalesce(least(1 - h, greatest(h, t)), 0.5)', 'off')} FROM (SELECT *, least(0.49, 0.9 / 2.0 / nullif(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0)) AS h, ((x3 - x1) * (x2 - x1) + (y3 - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0) AS t FROM ({_TWO}) s WHERE x1 <> x2 OR y1 <> y2) q")
def offset_along_wall(spark, sf):
    s = two(spark, sf).filter("x1 <> x2 or y1 <> y2").withColumns({"x": F.col("x3"), "y": F.col("y3"), "width": F.lit(0.9)})
    return L.offset_along_wall(s).select("seg", r6("offset").alias("off"))
