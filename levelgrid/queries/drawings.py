"""Queries on drawings, corrections, placement and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from levelgrid.functions import geometry as g
from levelgrid.functions.geometry import clean
from levelgrid.operators import masks as M
from levelgrid.plans import corrections as J, documents as doc, drawing as W, placement as P
from levelgrid.queries.inputs import DUCK, SPARK, load, plan_sql, plan_tables, sql, wall_segments
from levelgrid.queries.plans import BASE, D, FIX, GRID, OPENS, VERTS, first_rooms, r6, rooms_of
from levelgrid.queries.registry import query
from levelgrid.queries.scans import BX, boxes, r
from levelgrid.queries.walls import PLAN, WALLS, lay
from levelgrid.session import settle

_ID = lambda e: f"CAST({e} AS STRING)"
num = lambda: F.substring("plan_id", 2, 9).cast("int")


# Automatic chains: south and north sides carry the nx + 1 lattice vertices
# (the south side also u1, the side y = 4 also u2, on plans with a separator).
@query("dimension_chains", f"""SELECT plan_id, kind, segments FROM (SELECT plan_id, 'exterior-south-overall' AS kind, 1 AS segments FROM ({BASE}) b WHERE s % 7 <> 0
    UNION ALL SELECT plan_id, 'exterior-south-segments', nx + CASE WHEN s % 4 = 1 THEN 1 ELSE 0 END FROM ({BASE}) b UNION ALL SELECT plan_id, 'exterior-east-segments', ny FROM ({BASE}) b
    UNION ALL SELECT plan_id, 'exterior-west-overall', 1 FROM ({BASE}) b UNION ALL SELECT plan_id, 'exterior-south-openings', nx FROM ({BASE}) b UNION ALL SELECT plan_id, 'exterior-north-openings', nx FROM ({BASE}) b) q""")
def dimension_chains(spark, sf):
    c = W.dimension_chains(plan_tables(spark, sf)).groupBy("plan_id", F.col("dimension_id").alias("kind")).agg(F.count(F.lit(1)).alias("segments"))
    return c.filter("kind in ('exterior-south-overall', 'exterior-south-segments', 'exterior-east-segments', 'exterior-west-overall', 'exterior-south-openings', 'exterior-north-openings')")


@query("room_dimension_chains", f"""SELECT plan_id, concat('room-r', {_ID('j * nx + i + 1')}, '-', k) AS dimension_id FROM ({GRID}) r, (VALUES ('width'), ('depth')) v(k) WHERE (k = 'width' AND round(4 * j + t / 2, 6) - CAST(4 * j AS DOUBLE) <= 0.05) OR (k = 'depth' AND round(5 * i + t / 2, 6) - CAST(5 * i AS DOUBLE) <= 0.05)""")
def room_dimension_chains(spark, sf):
    t = plan_tables(spark, sf)
    c = W.dimension_chains(t, settle(rooms_of(spark, sf, t)[0]))
    return c.filter("dimension_id like 'room-%'").select("plan_id", "dimension_id")


@query("sync_dimensions", f"SELECT plan_id, 1 AS manual, CASE WHEN s % 7 = 0 THEN 0 ELSE 1 END AS south FROM ({BASE}) b")
def sync_dimensions(spark, sf):
    t = W.sync_dimensions(plan_tables(spark, sf))
    return t.dimensions.groupBy("plan_id").agg(F.count_if(~F.col("auto")).cast("int").alias("manual"), F.count_if(F.col("dimension_id") == "exterior-south-overall").cast("int").alias("south"))


@query("dimension_report", f"SELECT plan_id, segment, length, text, label_x, 0.5 AS label_y FROM (SELECT plan_id FROM ({BASE}) b) b, (VALUES (0, 2.05::DOUBLE, '205', 1.025::DOUBLE), (1, 0.9, '90', 2.5)) v(segment, length, text, label_x)")
def dimension_report(spark, sf):
    d = W.dimension_report(plan_tables(spark, sf))
    return d.select("plan_id", "segment", r6("length").alias("length"), "text", r6("label_x").alias("label_x"), r6("label_y").alias("label_y"))


@query("room_schedule", f"SELECT plan_id, concat('r', {_ID('j * nx + i + 1')}) AS room_id, concat('Room ', {_ID('i + 1')}) AS name, {_ID('j * nx + i + 1')} AS number, CAST(round((5 - t) * (4 - t) * 10, 6) AS BIGINT) AS tenths, {r('5 * i + 2.5', 'label_x')} FROM ({GRID}) r WHERE t <> 0.15")
def room_schedule(spark, sf):
    s = W.room_schedule(rooms_of(spark, sf)[0])
    thick = lay(spark, sf, "base").filter("s % 4 <> 1").select(*PLAN)
    text = F.rint(F.regexp_extract("area_text", "^([0-9.]+) m²$", 1).cast("double") * 10)
    # Areas of these plans are whole tenths only after rounding: compare the text with the number it stands for.
    return s.join(thick, PLAN, "left_semi").select("plan_id", "room_id", "name", "number", F.when(F.abs(text - F.col("area") * 10) <= 0.5 + 1e-9, F.rint(F.round(F.col("area") * 10, 6))).cast("bigint").alias("tenths"), r6("label_x").alias("label_x"))


@query("content_bounds", f"""SELECT plan_id, {r('least(0 - t / 2, 0.05, CASE WHEN s % 5 = 0 THEN 0 - s % 3 - 0.25 ELSE 0 END)', 'min_x')}, {r('0 - t / 2', 'min_y')}, {r('5 * nx + t / 2', 'max_x')}, {r('4 * ny + t / 2', 'max_y')} FROM ({BASE}) b""")
def content_bounds(spark, sf):
    return W.content_bounds(plan_tables(spark, sf)).select("plan_id", *[r6(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


_SHEET = """SELECT concat('P', CAST(p_partkey AS STRING)) AS plan_id, 'L1' AS level_id, CAST(0 AS DOUBLE) AS min_x, CAST(0 AS DOUBLE) AS min_y, CAST(p_size AS DOUBLE) AS max_x, CAST(p_partkey % 30 + 1 AS DOUBLE) AS max_y, CASE p_partkey % 2 WHEN 0 THEN 'A4' ELSE 'A3' END AS paper,
    CASE p_partkey % 3 WHEN 0 THEN 'portrait' ELSE 'landscape' END AS orientation, CASE p_partkey % 5 WHEN 0 THEN 50 ELSE 100 END AS scale, 'A-' AS sheet_number FROM {part}"""
_SH = f"""SELECT *, CAST(greatest(1, ceil(greatest(0, round(max_x * 1000 / scale - 20, 9)) / greatest(1, dw - 20))) AS BIGINT) AS nc, CAST(greatest(1, ceil(greatest(0, round(max_y * 1000 / scale - 20, 9)) / greatest(1, dh - 20))) AS BIGINT) AS nr FROM (
    SELECT *, CASE WHEN orientation = 'landscape' THEN h ELSE w END - 46 AS dw, CASE WHEN orientation = 'landscape' THEN w ELSE h END - 86 AS dh FROM (SELECT *, CASE paper WHEN 'A4' THEN 210 ELSE 297 END AS w, CASE paper WHEN 'A4' THEN 297 ELSE 420 END AS h FROM ({_SHEET.format(part='part')}) p) q) s"""


@query("sheet_tiles", f"""SELECT plan_id, CAST(k AS INT) AS tile, max_x * 1000 / scale <= dw + 0.5 AND max_y * 1000 / scale <= dh + 0.5 AS fits, {r('(k % nc) * greatest(1, dw - 20) / (1000.0 / scale)', 'win_x0')}, {r('(k % nc) * greatest(1, dw - 20) / (1000.0 / scale) + dw / (1000.0 / scale)', 'win_x1')},
    CASE WHEN nc * nr = 1 THEN 'A-' WHEN k < 26 THEN 'A-' || chr(CAST(97 + k AS INT)) ELSE 'A-' || chr(CAST(97 + (k - 26) // 26 AS INT)) || chr(CAST(97 + (k - 26) % 26 AS INT)) END AS sheet FROM (SELECT *, unnest(generate_series(0, nc * nr - 1)) AS k FROM ({_SH}) s) q""")
def sheet_tiles(spark, sf):
    t = W.sheet_tiles(sql(spark, sf, _SHEET))
    return t.select("plan_id", "tile", "fits", r6("win_x0").alias("win_x0"), r6("win_x1").alias("win_x1"), "sheet")


@query("net_wall_area", f"""SELECT w.plan_id, w.wall_id, {r('coalesce(sum(o.width), 0) * any_value(w.thickness)', 'cut')} FROM ({WALLS}) w LEFT JOIN ({OPENS}) o USING (plan_id, wall_id) GROUP BY 1, 2""")
def net_wall_area(spark, sf):
    return W.net_wall_area(plan_tables(spark, sf)).select("plan_id", "wall_id", r6(F.col("gross") - F.col("net")).alias("cut"))


@query("stair_treads", f"SELECT plan_id, k AS tread, 1.0 AS xa, 2.0 AS xb, {r('0.5 + 2.8 * k / 12', 'y')} FROM ({BASE}) b, (SELECT unnest(generate_series(1, 11)) AS k) t WHERE s % 3 = 0")
def stair_treads(spark, sf):
    t = W.stair_treads(plan_tables(spark, sf).stairs)
    return t.select("plan_id", F.col("tread").cast("bigint").alias("tread"), r6(F.least("x1", "x2")).alias("xa"), r6(F.greatest("x1", "x2")).alias("xb"), r6("y1").alias("y"))


# Corrections: one op per plan.
def ops_of(spark, sf, **cols):
    b = lay(spark, sf, "base").select(*PLAN, F.lit(1).alias("seq"))
    return b.withColumns(cols)




@query("set_thickness", f"SELECT plan_id, CASE WHEN s % 4 = 3 THEN {r('t', 'x').split(' AS ')[0]} ELSE round(0.3 + (s % 4) / 10.0, 6) END AS thickness, s % 4 = 3 AS refused FROM ({BASE}) b")
def set_thickness(spark, sf):
    v = F.when(num() % 4 == 3, 1.6).otherwise(0.3 + (num() % 4) / 10.0)
    t, rej = J.set_thickness(plan_tables(spark, sf), ops_of(spark, sf, target=F.lit("w1"), p_thickness=v))
    refused = rej.select("plan_id").withColumn("refused", F.lit(True))
    return t.walls.filter("wall_id = 'w1'").join(refused, "plan_id", "left").select("plan_id", r6("thickness").alias("thickness"), F.coalesce("refused", F.lit(False)).alias("refused"))


@query("apply_patches", f"""SELECT plan_id, 'hall' AS room, 'hi' AS text, 45.0::DOUBLE AS turn, CASE WHEN s % 2 = 0 THEN 0.8 ELSE 0.9 END AS width, CASE WHEN s % 2 = 0 THEN '-' ELSE 'Opening width must be shorter than its wall' END AS reason, -0.25::DOUBLE AS vx FROM ({BASE}) b""")
def apply_patches(spark, sf):
    t = plan_tables(spark, sf)
    t, _ = J.rename_rooms(t, ops_of(spark, sf, target=F.lit("r1"), p_name=F.lit("hall"), p_number=F.lit(None).cast("string")))
    t, _ = J.set_texts(t, ops_of(spark, sf, target=F.lit("t1"), p_text=F.lit("hi")))
    none = F.lit(None).cast("double")
    t, _ = J.set_fixtures(t, ops_of(spark, sf, target=F.lit("f1"), p_rotation_deg=F.lit(45.0), p_width=none, p_depth=none))
    t, rej = J.set_openings(t, ops_of(spark, sf, target=F.lit("o1"), p_width=F.when(num() % 2 == 0, 0.8).otherwise(9.0)))
    t, _ = J.move_vertices(t, ops_of(spark, sf, target=F.lit("v1"), p_x=F.lit(-0.25), p_y=F.lit(0.0)))
    a = t.rooms.filter("room_id = 'r1'").select("plan_id", F.col("name").alias("room")).join(t.texts.select("plan_id", "text"), "plan_id")
    a = a.join(t.fixtures.filter("fixture_id = 'f1'").select("plan_id", F.col("rotation_deg").alias("turn")), "plan_id").join(t.openings.filter("opening_id = 'o1'").select("plan_id", "width"), "plan_id")
    a = a.join(rej.select("plan_id", "reason"), "plan_id", "left").join(t.vertices.filter("vertex_id = 'v1'").select("plan_id", F.col("x").alias("vx")), "plan_id")
    return a.withColumn("reason", F.coalesce("reason", F.lit("-")))


@query("remove_selection", f"""SELECT b.plan_id, count(w.wall_id) AS walls, (SELECT count(*) FROM ({OPENS}) o WHERE o.plan_id = b.plan_id) - 1 AS openings, 0 AS dimensions, (SELECT count(*) FROM ({VERTS}) v WHERE v.plan_id = b.plan_id) - 1 - CASE WHEN any_value(b.s) % 4 = 1 THEN 0 ELSE 0 END AS vertices
    FROM ({BASE}) b JOIN ({WALLS}) w ON w.plan_id = b.plan_id AND w.a <> 'v1' AND w.b <> 'v1' GROUP BY b.plan_id""")
def remove_selection(spark, sf):
    ids = lay(spark, sf, "base").select(*PLAN, F.lit("v1").alias("id"))
    t = J.remove_selection(plan_tables(spark, sf), ids)
    n = lambda df, c: df.groupBy("plan_id").agg(F.count(F.lit(1)).alias(c))
    out = n(t.walls, "walls").join(n(t.openings, "openings"), "plan_id", "left").join(n(t.dimensions, "dimensions"), "plan_id", "left").join(n(t.vertices, "vertices"), "plan_id", "left")
    return out.select("plan_id", "walls", F.coalesce("openings", F.lit(0)).alias("openings"), F.coalesce("dimensions", F.lit(0)).cast("int").alias("dimensions"), F.coalesce("vertices", F.lit(0)).alias("vertices"))


@query("move_selection", f"SELECT plan_id, 1.0::DOUBLE AS v1x, 0.5::DOUBLE AS v1y, 6.0::DOUBLE AS v2x, 2.0::DOUBLE AS f1x, 3.5::DOUBLE AS r1x FROM ({BASE}) b")
def move_selection(spark, sf):
    item = lambda k, i: F.struct(F.lit(k).alias("kind"), F.lit(i).alias("id"))
    ops = ops_of(spark, sf, items=F.array(item("wall", "w1"), item("fixture", "f1"), item("room", "r1")), p_dx=F.lit(1.0), p_dy=F.lit(0.5))
    t, _ = J.move_selection(plan_tables(spark, sf), ops)
    v = lambda i, *c: t.vertices.filter(F.col("vertex_id") == i).select("plan_id", *[F.col(x).alias(f"{i}{x}") for x in c])
    return v("v1", "x", "y").join(v("v2", "x"), "plan_id").join(t.fixtures.filter("fixture_id = 'f1'").select("plan_id", F.col("x").alias("f1x")), "plan_id").join(t.rooms.filter("room_id = 'r1'").select("plan_id", F.col("seed.x").alias("r1x")), "plan_id")


@query("move_walls", f"SELECT plan_id, vertex_id, CASE WHEN vertex_id LIKE 'v%' AND y = 0 THEN x ELSE x END AS x, CASE WHEN vertex_id LIKE 'v%' AND y = 0 THEN -0.5 ELSE y END AS y FROM ({VERTS}) v")
def move_walls(spark, sf):
    t, _ = J.move_walls(plan_tables(spark, sf), ops_of(spark, sf, target=F.lit("w1"), p_dx=F.lit(0.7), p_dy=F.lit(-0.5)))
    return t.vertices.select("plan_id", "vertex_id", r6("x").alias("x"), r6("y").alias("y"))


@query("apply_lengths", f"SELECT plan_id, vertex_id, CASE WHEN x >= 5 THEN x + 1 ELSE x END AS x, {r('y', 'y')} FROM ({VERTS}) v")
def apply_lengths(spark, sf):
    ref = lambda i: F.struct(F.lit("vertex").alias("type"), F.lit(i).alias("id"), F.lit(None).cast("string").alias("edge"))
    t, _ = J.apply_lengths(plan_tables(spark, sf), ops_of(spark, sf, a=ref("v1"), b=ref("v2"), p_length=F.lit(6.0)))
    return t.vertices.select("plan_id", "vertex_id", r6("x").alias("x"), r6("y").alias("y"))


@query("length_openings", f"""SELECT plan_id, opening_id, {r('CASE WHEN i = 0 THEN CASE WHEN kind = $$door$$ THEN 2.5 / 6 ELSE 1.25 / 6 END ELSE "offset" END', 'off')} FROM (SELECT *, CASE WHEN opening_id IN ('o1', concat('o', {_ID('nx + 1')})) THEN 0 ELSE 1 END AS i FROM ({OPENS}) o JOIN (SELECT plan_id, nx FROM ({BASE}) b) b USING (plan_id)) q""")
def length_openings(spark, sf):
    ref = lambda i: F.struct(F.lit("vertex").alias("type"), F.lit(i).alias("id"), F.lit(None).cast("string").alias("edge"))
    t, _ = J.apply_lengths(plan_tables(spark, sf), ops_of(spark, sf, a=ref("v1"), b=ref("v2"), p_length=F.lit(6.0)))
    return t.openings.select("plan_id", "opening_id", r6("offset").alias("off"))


@query("set_thickness_from_face", f"SELECT plan_id, {r('(t - 0.3) / 2', 'y')}, 0.3 AS thickness FROM ({BASE}) b")
def set_thickness_from_face(spark, sf):
    t, _ = J.set_thickness_from_face(plan_tables(spark, sf), ops_of(spark, sf, target=F.lit("w1"), p_thickness=F.lit(0.3), p_keep=F.lit("left")))
    v = t.vertices.filter("vertex_id = 'v1'").select("plan_id", r6("y").alias("y"))
    return v.join(t.walls.filter("wall_id = 'w1'").select("plan_id", "thickness"), "plan_id")


@query("set_clear_distance", f"SELECT plan_id, {r('(4 - t) - 3', 'y')} FROM ({BASE}) b")
def set_clear_distance(spark, sf):
    other = F.concat(F.lit("w"), (1 + num() % 3 + 1).cast("string"))
    t, _ = J.set_clear_distance(plan_tables(spark, sf), ops_of(spark, sf, target=F.lit("w1"), other=other, p_distance=F.lit(3.0)))
    return t.vertices.filter("vertex_id = 'v1'").select("plan_id", r6("y").alias("y"))


@query("set_opening_edge", f"SELECT plan_id, CASE WHEN s % 2 = 0 THEN 1.2 ELSE 0.9 END AS width, CASE WHEN s % 2 = 0 THEN 0.53 ELSE 0.5 END AS off, s % 2 = 1 AS refused FROM ({BASE}) b")
def set_opening_edge(spark, sf):
    t, rej = J.set_opening_edge(plan_tables(spark, sf), ops_of(spark, sf, target=F.lit("o1"), p_edge=F.lit("end"), p_amount=F.when(num() % 2 == 0, 0.3).otherwise(7.0)))
    return t.openings.filter("opening_id = 'o1'").join(rej.select("plan_id", F.lit(True).alias("refused")), "plan_id", "left").select("plan_id", r6("width").alias("width"), r6("offset").alias("off"), F.coalesce("refused", F.lit(False)).alias("refused"))


@query("rehost_openings", f"SELECT plan_id, concat('w', {_ID('nx * ny + 1')}) AS wall_id, 0.24 AS off FROM ({BASE}) b")
def rehost_openings(spark, sf):
    wall = F.concat(F.lit("w"), ((1 + num() % 3) * (1 + num() % 2) + 1).cast("string"))
    t, _ = J.rehost_openings(plan_tables(spark, sf), ops_of(spark, sf, target=F.lit("o1"), p_wall=wall, p_x=F.lit(1.2), p_y=F.lit(3.0)))
    return t.openings.filter("opening_id = 'o1'").select("plan_id", "wall_id", r6("offset").alias("off"))


@query("snap_rotation", "SELECT p_partkey AS id, CAST(floor(p_size * 3.7 / 15 + 0.5) * 15 AS DOUBLE) AS turn FROM part")
def snap_rotation(spark, sf):
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), J.snap_rotation(F.col("p_size") * F.lit(3.7)).cast("double").alias("turn"))


# Toilets reach the lower wall in plans with thick walls only, sofas the upper wall in all plans, blocks none.
@query("snap_fixtures", f"""SELECT plan_id, fixture_id, CASE WHEN fixture_id = 'f1' THEN 1.9 ELSE x END::DOUBLE AS x,
    {r("CASE WHEN fixture_id = 'f1' AND t >= 0.19 THEN t / 2 + 0.35 WHEN fixture_id = 'f2' THEN 4 - t / 2 - 0.45 ELSE y END", 'y')},
    CASE WHEN fixture_id = 'f1' AND t >= 0.19 THEN 180.0 WHEN fixture_id = 'f2' THEN 0.0 ELSE rotation_deg END::DOUBLE AS turn FROM ({FIX}) f JOIN (SELECT plan_id, t FROM ({BASE}) b) c USING (plan_id)""")
def snap_fixtures(spark, sf):
    t = plan_tables(spark, sf)
    t = t.with_(fixtures=t.fixtures.withColumn("x", F.when(F.col("fixture_id") == "f1", 1.9).otherwise(F.col("x"))))
    s = J.snap_fixtures(t, 0.56)
    return s.fixtures.select("plan_id", "fixture_id", r6("x").alias("x"), r6("y").alias("y"), r6("rotation_deg").alias("turn"))


@query("split_walls", f"SELECT plan_id, (SELECT count(*) FROM ({WALLS}) w WHERE w.plan_id = b.plan_id) + 1 AS walls, 2.0::DOUBLE AS mid_x, {r('(0.5 - 0.4) / 0.6', 'off')} FROM ({BASE}) b")
def split_walls(spark, sf):
    t, _ = J.split_walls(plan_tables(spark, sf), ops_of(spark, sf, target=F.lit("w1"), p_t=F.lit(0.4)))
    n = t.walls.groupBy("plan_id").agg(F.count(F.lit(1)).alias("walls"))
    host = t.walls.filter("wall_id = 'w1'").select(*PLAN, F.col("b").alias("vertex_id")).join(t.vertices, [*PLAN, "vertex_id"]).select("plan_id", r6("x").alias("mid_x"))
    return n.join(host, "plan_id").join(t.openings.filter("opening_id = 'o1'").select("plan_id", r6("offset").alias("off")), "plan_id")


@query("merge_walls", f"SELECT plan_id, (SELECT count(*) FROM ({WALLS}) w WHERE w.plan_id = b.plan_id) - CASE WHEN nx > 1 THEN 1 ELSE 0 END AS walls, CASE WHEN nx > 1 THEN 0.25 ELSE 0.5 END AS off FROM ({BASE}) b")
def merge_walls(spark, sf):
    t, _ = J.merge_walls(plan_tables(spark, sf), ops_of(spark, sf, target=F.lit("w1")))
    n = t.walls.groupBy("plan_id").agg(F.count(F.lit(1)).alias("walls"))
    # The merged wall may run either way: take the offset from its nearer end.
    return n.join(t.openings.filter("opening_id = 'o1'").select("plan_id", r6(F.least(F.col("offset"), 1.0 - F.col("offset"))).alias("off")), "plan_id")


@query("place_openings", f"SELECT plan_id, {r('(t / 2 + 0.5 + 0.45) / 5', 'off')}, 'o' || {_ID('2 * nx + 1')} AS opening_id FROM ({BASE}) b WHERE s % 2 = 0")
def place_openings(spark, sf):
    ops = ops_of(spark, sf, target=F.lit("w1"), p_kind=F.lit("door"), p_end=F.lit("a"), p_distance=F.when(num() % 2 == 0, 0.5).otherwise(4.5), p_width=F.lit(0.9), p_swing_side=F.lit("positive"))
    before = plan_tables(spark, sf)
    t, _ = J.place_openings(before, ops)
    new = t.openings.join(before.openings.select(*PLAN, "opening_id"), [*PLAN, "opening_id"], "left_anti")
    return new.select("plan_id", r6("offset").alias("off"), "opening_id")


@query("add_dimensions", f"SELECT plan_id, CASE WHEN s % 2 = 0 THEN 'd2' ELSE '-' END AS dimension_id, CASE WHEN s % 2 = 0 THEN '-' ELSE 'Unknown vertex v999' END AS reason FROM ({BASE}) b")
def add_dimensions(spark, sf):
    ref = lambda i: F.struct(F.lit("vertex").alias("type"), i.alias("id"), F.lit(None).cast("string").alias("edge"))
    last = F.when(num() % 2 == 0, "v2").otherwise("v999")
    t, rej = J.add_dimensions(plan_tables(spark, sf), ops_of(spark, sf, refs=F.array(ref(F.lit("v1")), ref(last)), p_offset=F.lit(0.4)))
    new = t.dimensions.filter("dimension_id <> 'd1'").select("plan_id", "dimension_id")
    return lay(spark, sf, "base").select("plan_id").join(new, "plan_id", "left").join(rej.select("plan_id", "reason"), "plan_id", "left").select("plan_id", F.coalesce("dimension_id", F.lit("-")).alias("dimension_id"), F.coalesce("reason", F.lit("-")).alias("reason"))


@query("clone_selection", f"SELECT plan_id, (SELECT count(*) FROM ({WALLS}) w WHERE w.plan_id = b.plan_id) + 1 AS walls, 2 * nx + 1 AS openings, 0.5::DOUBLE AS x, (SELECT count(*) FROM ({FIX}) f WHERE f.plan_id = b.plan_id) + 1 AS fixtures FROM ({BASE}) b")
def clone_selection(spark, sf):
    ids = lay(spark, sf, "base").select(*PLAN, F.explode(F.array(F.lit("w1"), F.lit("f1"))).alias("id"))
    before = plan_tables(spark, sf)
    t = J.clone_selection(before, ids)
    n = lambda df, c: df.groupBy("plan_id").agg(F.count(F.lit(1)).alias(c))
    new = t.vertices.join(before.vertices.select(*PLAN, "vertex_id"), [*PLAN, "vertex_id"], "left_anti").groupBy("plan_id").agg(F.min("x").alias("x"))
    return n(t.walls, "walls").join(n(t.openings, "openings"), "plan_id").join(new, "plan_id").join(n(t.fixtures, "fixtures"), "plan_id")


@query("allocate_ids", f"SELECT plan_id, prefix, n, prefix || {_ID('n + CASE prefix WHEN $$o$$ THEN 2 * nx ELSE nx * ny END')} AS id FROM ({BASE}) b, (VALUES ('o', 1), ('o', 2), ('r', 1)) v(prefix, n)")
def allocate_ids(spark, sf):
    at = lambda p, n: F.struct(F.lit(p).alias("prefix"), F.lit(n).alias("n"))
    want = lay(spark, sf, "base").select(*PLAN, F.explode(F.array(at("o", 1), at("o", 2), at("r", 1))).alias("w")).select(*PLAN, "w.*")
    return J.allocate_ids(plan_tables(spark, sf), want).select("plan_id", "prefix", "n", "id")


@query("weld_vertices", f"SELECT plan_id, vertex_id AS id, CASE WHEN CAST(substring(vertex_id, 2) AS INT) % 2 = 0 THEN vertex_id ELSE '-' END AS vertex_id FROM ({VERTS}) v")
def weld_vertices(spark, sf):
    t = plan_tables(spark, sf)
    far = F.when(F.substring("vertex_id", 2, 9).cast("int") % 2 == 0, 0.04).otherwise(0.06)
    pts = t.vertices.select(*PLAN, F.col("vertex_id").alias("id"), (F.col("x") + far).alias("x"), "y")
    return J.weld_vertices(pts, t.vertices).select("plan_id", "id", F.coalesce("vertex_id", F.lit("-")).alias("vertex_id"))


@query("offset_wall", f"SELECT plan_id, wall_id, {r('y1 - CASE WHEN x1 = x2 THEN 0 ELSE thickness / 2 END', 'y1')}, {r('x1 + CASE WHEN x1 = x2 THEN thickness / 2 ELSE 0 END', 'x1')} FROM ({WALLS}) w")
def offset_wall(spark, sf):
    w = wall_segments(spark, sf).select(*PLAN, "wall_id", "thickness", F.col("x1").alias("px"), F.col("y1").alias("py"), F.col("x2").alias("qx"), F.col("y2").alias("qy"), F.lit("left").alias("location"))
    return J.offset_wall(w).select("plan_id", "wall_id", r6("y1").alias("y1"), r6("x1").alias("x1"))


@query("add_rectangles", f"SELECT plan_id, (SELECT count(*) FROM ({WALLS}) w WHERE w.plan_id = b.plan_id) + 3 AS walls, (SELECT count(*) FROM ({VERTS}) v WHERE v.plan_id = b.plan_id) + 2 AS vertices, nx * ny + 1 AS rooms FROM ({BASE}) b")
def add_rectangles(spark, sf):
    ops = ops_of(spark, sf, p_x1=F.lit(0.0), p_y1=F.lit(0.0), p_x2=F.lit(5.0), p_y2=F.lit(-4.0), p_thickness=F.lit(0.2), p_mode=F.lit("centerline"))
    t, _ = J.add_rectangles(plan_tables(spark, sf), ops)
    n = lambda df, c: df.groupBy("plan_id").agg(F.count(F.lit(1)).alias(c))
    return n(t.walls, "walls").join(n(t.vertices, "vertices"), "plan_id").join(n(t.rooms, "rooms"), "plan_id")


# Three ops per plan; in every third plan the second one is refused, which refuses all.
# Every fifth plan has no ops. All walls are shown with their plans' named rooms; the straight run of w1 moves with it.
@query("apply_ops", f"""SELECT plan_id, wall_id, {r("CASE WHEN done AND wall_id = 'w1' THEN 0.4 ELSE thickness END", 'thickness')}, {r("y1 - CASE WHEN done AND y1 = 0 THEN 0.5 ELSE 0 END", 'y1')}, CASE WHEN done THEN 1 ELSE 0 END AS halls, s % 3 = 0 AND s % 5 <> 0 AS refused
    FROM ({WALLS}) w JOIN (SELECT plan_id, s, s % 3 <> 0 AND s % 5 <> 0 AS done FROM ({BASE}) b) c USING (plan_id)""")
def apply_ops(spark, sf):
    b = lay(spark, sf, "base")
    thick = F.when(num() % 3 == 0, "9.0").otherwise("0.4")
    one = lambda q, op, args: F.struct(F.lit(q).alias("seq"), F.lit(op).alias("op"), args.alias("args"))
    ops = b.select(*PLAN, F.explode(F.array(
        one(1, "set_room_name", F.lit('{"roomId": "r1", "name": "hall"}')), one(2, "set_wall_thickness", F.concat(F.lit('{"wallId": "w1", "thickness": '), thick, F.lit("}"))),
        one(3, "move_wall", F.lit('{"wallId": "w1", "dx": 0.0, "dy": -0.5}')))).alias("o")).select(*PLAN, "o.*")
    t, rej = J.apply_ops(plan_tables(spark, sf), ops.filter(num() % 5 != 0))
    ends = t.vertices.select(*PLAN, F.col("vertex_id").alias("a"), r6("y").alias("y1"))
    out = t.walls.join(ends, [*PLAN, "a"]).select("plan_id", "wall_id", r6("thickness").alias("thickness"), "y1")
    out = out.join(t.rooms.groupBy("plan_id").agg(F.count_if(F.col("name") == "hall").cast("int").alias("halls")), "plan_id")
    return out.join(rej.select("plan_id", F.lit(True).alias("refused")).distinct(), "plan_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))


# Placement.
@query("frame_bounds", f"SELECT scan_id, CASE WHEN k = 0 THEN 'The overhead view has no six-number metric frame.' WHEN k = 1 THEN 'The overhead view has an invalid metric frame.' ELSE '-' END AS error, CASE WHEN k < 2 THEN 0.0 ELSE {r('size_x * (size_y + 1)', 'x').split(' AS ')[0]} END AS area FROM (SELECT *, CAST(substring(scan_id, 2) AS INT) % 4 AS k FROM ({BX}) b) q")
def frame_bounds(spark, sf):
    k = F.substring("scan_id", 2, 9).cast("int") % 4
    z = F.lit(0.0)
    six = F.array(F.lit(1.0), F.lit(2.0), F.col("size_x"), z, z, F.col("size_y") + 1.0)
    nums = F.when(k == 0, F.slice(six, 1, 5)).when(k == 1, F.array(F.lit(float("nan")), z, z, z, z, z)).otherwise(six)
    f = P.frame_bounds(boxes(spark, sf).withColumn("numbers", nums))
    return f.select("scan_id", F.coalesce("error", F.lit("-")).alias("error"), F.coalesce(r6("area"), F.lit(0.0)).alias("area"))


@query("visible_only", f"SELECT plan_id, fixture_id FROM ({FIX}) f WHERE x >= 0 AND x < 2 AND y >= 0 AND y < 3.5")
def visible_only(spark, sf):
    t = plan_tables(spark, sf)
    fr = P.frame_bounds(t.levels.select(*PLAN, F.array(*[F.lit(v) for v in (0.0, 0.0, 2.0, 0.0, 0.0, 3.5)]).alias("numbers")))
    return P.visible_only(t.fixtures, fr).select("plan_id", "fixture_id")


@query("apply_labels", f"SELECT plan_id, fixture_id, CASE WHEN fixture_id = 'f3' AND s % 2 = 0 THEN 'stove' ELSE symbol END AS symbol, CASE WHEN fixture_id = 'f3' AND s % 2 = 0 THEN 'fixture' ELSE role END AS role FROM ({FIX}) f JOIN (SELECT plan_id, s FROM ({BASE}) b) b USING (plan_id)")
def apply_labels(spark, sf):
    t = plan_tables(spark, sf)
    good = 'Here: {"labels": [{"id": "f3", "symbol": "stove"}, {"id": "f1", "symbol": "chair"}, {"id": "f3x", "symbol": "sofa"}]} done'
    replies = t.levels.select(*PLAN, F.when(num() % 2 == 0, F.lit(good)).otherwise(F.lit("no labels")).alias("reply"))
    f, _ = P.apply_labels(t.fixtures, replies)
    return f.select("plan_id", "fixture_id", "symbol", "role")


# A camera straight above the plan: a 90 degree view from 10 m, looking down.
def camera(df):
    near, far = 1.0, 100.0
    proj = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, -(far + near) / (far - near), -1.0, 0, 0, -2 * far * near / (far - near), 0]
    world = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 2.0, 3.0, 10.0, 1.0]
    return df.select("shot_id", F.array(*[F.lit(float(v)) for v in proj]).alias("projection"), F.array(*[F.lit(float(v)) for v in world]).alias("matrix_world"), F.lit(0.0).alias("floor_z"))


def shots(spark, sf):
    return load(spark, sf, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 50).cast("string")).alias("shot_id"), "p_partkey", (F.col("p_size") / 50.0).alias("nx"), (F.col("p_partkey") % 21 / 20.0).alias("ny"))


@query("pixel_to_floor", f"SELECT p_partkey AS id, {r('2 + (p_size / 50.0 * 2 - 1) * 10', 'x')}, {r('3 + (1 - p_partkey % 21 / 20.0 * 2) * 10', 'y')} FROM part")
def pixel_to_floor(spark, sf):
    s = shots(spark, sf)
    cams = P.camera_matrices(camera(s.select("shot_id").distinct()))
    p = P.pixel_to_floor(s.join(cams, "shot_id"), F.col("nx"), F.col("ny"))
    return p.select(F.col("p_partkey").alias("id"), r6("px").alias("x"), r6("py").alias("y"))


@query("fixture_pose", f"SELECT p_partkey AS id, {r('0.1 * 20', 'w')}, {r('0.05 * 20', 'd')}, CASE p_partkey % 2 WHEN 0 THEN 0.0 ELSE 90.0 END AS turn FROM part")
def fixture_pose(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    s = shots(spark, sf).withColumns({"back": F.when(even, "up").otherwise("left"), "span_x": F.when(even, 0.1).otherwise(0.05), "span_y": F.when(even, 0.05).otherwise(0.1)})
    cams = P.camera_matrices(camera(s.select("shot_id").distinct()))
    p = P.fixture_pose(s.join(cams, "shot_id"))
    return p.select(F.col("p_partkey").alias("id"), r6("pose_w").alias("w"), r6("pose_d").alias("d"), r6("pose_rot").alias("turn"))


@query("parse_fixture_replies", f"SELECT plan_id, CASE WHEN s % 4 = 0 THEN 'rejected' WHEN s % 4 = 1 THEN 'rejected' ELSE 'sofa' END AS symbol, CASE WHEN s % 4 < 2 THEN 0.0 ELSE 2.0 END AS x, CASE WHEN s % 4 < 2 THEN 0.0 WHEN s % 4 = 2 THEN 0.6 ELSE 1.0 END AS confidence, CASE WHEN s % 4 < 2 THEN 0.0 ELSE 2.0 END AS width FROM ({BASE}) b")
def parse_fixture_replies(spark, sf):
    b = lay(spark, sf, "base")
    text = (
        F.when(num() % 4 == 0, F.lit("nothing here")).when(num() % 4 == 1, F.lit('{"fixtures": [{"symbol": "sofa", "nx": 1.5, "ny": 0.5}]}'))
        .when(num() % 4 == 2, F.lit('see {"fixtures": [{"symbol": "sofa", "nx": 0.5, "ny": 0.5}, {"symbol": "lamp"}]} end'))
        .otherwise(F.lit('{"fixtures": [{"symbol": "sofa", "nx": "0.5", "ny": 0.5, "spanX": 0.9, "spanY": 0.9, "back": "up", "confidence": 7}]}'))
    )
    replies = b.select(*PLAN, F.lit("c1").alias("shot_id"), text.alias("reply"))
    good, bad = P.parse_fixture_replies(replies, camera(b.select(F.lit("c1").alias("shot_id")).distinct()))
    return good.select("plan_id", "symbol", r6("x").alias("x"), "confidence", "width").unionByName(bad.select("plan_id", F.lit("rejected").alias("symbol"), *[F.lit(0.0).alias(c) for c in ("x", "confidence", "width")]))


@query("merge_detected_level", f"SELECT plan_id, 'L1' AS level_id, 'Level 1' AS name, 'D2' AS detected_level, 2 AS fixtures FROM ({BASE}) b")
def merge_detected_level(spark, sf):
    t = plan_tables(spark, sf)
    at = lambda i, e: F.struct(F.lit(f"D{i}").alias("level_id"), F.lit(i).alias("level_index"), F.lit(e).alias("elevation"), F.lit(2.6).alias("ceiling_height"))
    found = t.levels.select("plan_id", F.explode(F.array(at(1, 2.9), at(2, 0.2), at(3, -3.0))).alias("d")).select("plan_id", "d.*")
    m = P.merge_detected_level(t.levels, found)
    fx = t.fixtures.filter("fixture_id <> 'f3'").withColumn("level_id", F.lit("D2"))
    n = P.replace_elements(t.fixtures, fx, m).groupBy("plan_id").agg(F.count(F.lit(1)).cast("int").alias("fixtures"))
    return m.select("plan_id", "level_id", "name", "detected_level").join(n, "plan_id")


@query("placement_report", f"SELECT plan_id, s % 5 = 0 AS block, s % 4 <> 0 AS sofa FROM ({BASE}) b WHERE s % 5 = 0 OR s % 4 <> 0")
def placement_report(spark, sf):
    p = P.placement_report(plan_tables(spark, sf).fixtures, first_rooms(spark, sf))
    return p.select("plan_id", F.col("report").contains("The block at").alias("block"), F.col("report").contains("The sofa at").alias("sofa"))


# Masks: one 64 by 48 picture per supplier with a floor and two painted boxes.
_PX = """SELECT concat('M', CAST(s_suppkey AS STRING)) AS image_id, s_suppkey AS s, 64 AS width, 48 AS height FROM {supplier}"""


def pixels(spark, sf):
    d = sql(spark, sf, _PX)
    p = d.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(63))))
    box = (F.col("row").between(10, 19)) & (F.col("col").between(5, 24))
    two = (F.col("row").between(30, 39)) & (F.col("col") >= 40) & (F.col("col") < 46 + F.col("s") % 10)
    floor = F.col("s") % 5 != 0
    pick = lambda t, s, f: F.when(box, t).when(two, s).when(floor, f).otherwise(F.lit(0)) + F.col("col") % 3
    return p.select("image_id", "width", "height", "row", "col", pick(220, 60, 230).alias("r"), pick(60, 180, 230).alias("g"), pick(60, 75, 230).alias("b"), "s")


_NAME = "CASE WHEN row BETWEEN 10 AND 19 AND col BETWEEN 5 AND 24 THEN 'toilet' WHEN row BETWEEN 30 AND 39 AND col >= 40 AND col < 46 + s % 10 THEN 'sink' WHEN s % 5 <> 0 THEN 'floor' ELSE 'outside' END"
_PIX = f"SELECT *, {_NAME} AS name FROM (SELECT *, unnest(generate_series(0, 63)) AS col FROM (SELECT *, unnest(generate_series(0, 47)) AS row FROM ({_PX.format(supplier='supplier')}) p) q) r"


@query("nearest_palette", f"SELECT image_id, name, count(*) AS n FROM ({_PIX}) p GROUP BY 1, 2")
def nearest_palette(spark, sf):
    return M.nearest_palette(pixels(spark, sf)).groupBy("image_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("nearest_centroid", """SELECT vec_id, arg_min(label, d * 1000 + label / 1000000.0) AS nearest FROM (SELECT e.vec_id, c.label, round(list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::DOUBLE - c.v[i]) * (e.embedding[i]::DOUBLE - c.v[i]))), 9) AS d FROM embeddings e,
    (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, round(avg(embedding[i]::DOUBLE), 9) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) s GROUP BY label, i) q GROUP BY label) c) z GROUP BY vec_id""")
def nearest_centroid(spark, sf):
    e = load(spark, sf, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return M.nearest_centroid(e, c).select("vec_id", "nearest")


@query("floor_gate", f"SELECT image_id, s % 5 <> 0 AS accepted, CAST(count_if(name = 'floor') AS BIGINT) AS floor_pixels FROM ({_PIX}) p GROUP BY 1, 2")
def floor_gate(spark, sf):
    ok, no = M.floor_gate(M.nearest_palette(pixels(spark, sf)))
    return ok.select("image_id", F.lit(True).alias("accepted"), "floor_pixels").unionByName(no.select("image_id", F.lit(False).alias("accepted"), "floor_pixels"))


def components(spark, sf):
    px = pixels(spark, sf)
    return M.mask_components(M.nearest_palette(px), px.select("image_id", "width", "height").distinct())


@query("mask_components", f"SELECT image_id, name AS symbol, count(*) AS area FROM ({_PIX}) p WHERE name IN ('toilet', 'sink') GROUP BY 1, 2")
def mask_components(spark, sf):
    return components(spark, sf).groupBy("image_id", "symbol", "component").agg(F.count(F.lit(1)).alias("area")).drop("component")


def mask_boxes_of(spark, sf):
    fr = sql(spark, sf, _PX).select("image_id", "width", "height", *[F.lit(v).alias(n) for n, v in (("ox", 0.0), ("oy", 0.0), ("xx", 6.3), ("xy", 0.0), ("yx", 0.0), ("yy", 4.7))])
    return M.mask_boxes(components(spark, sf), fr)


@query("mask_boxes", f"""SELECT concat('M', {_ID('s_suppkey')}) AS image_id, symbol, {r('w', 'width')}, {r('d', 'depth')}, {r('x', 'x')}, {r('y', 'y')}, 'fixture' AS role FROM (SELECT s_suppkey, 'toilet' AS symbol, 1.9 AS w, 0.9 AS d, 1.45 AS x, 3.25 AS y FROM supplier UNION ALL
    SELECT s_suppkey, 'sink', (5 + s_suppkey % 10) / 10.0, 0.9, (40 + (45 + s_suppkey % 10)) / 20.0, 1.25 FROM supplier) q""")
def mask_boxes(spark, sf):
    m = mask_boxes_of(spark, sf)
    return m.select("image_id", "symbol", r6("width").alias("width"), r6("depth").alias("depth"), r6("x").alias("x"), r6("y").alias("y"), "role")


@query("snap_boxes", f"SELECT concat('M', {_ID('s_suppkey')}) AS image_id, 0.25::DOUBLE AS x, 2.0::DOUBLE AS y FROM supplier")
def snap_boxes(spark, sf):
    d = sql(spark, sf, _PX)
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    rooms = d.select("image_id", F.array(at(0.0, 0.0), at(5.0, 0.0), at(5.0, 4.0), at(0.0, 4.0)).alias("ring"))
    b = d.select("image_id", F.lit("b1").alias("box_id"), (0.3 + (F.col("s") % 7) / 100.0).alias("x"), F.lit(2.0).alias("y"), F.lit(0.0).alias("rotation_deg"), F.lit(0.5).alias("width"), F.lit(0.6).alias("depth"))
    return M.snap_boxes(b, rooms).select("image_id", r6("x").alias("x"), r6("y").alias("y"))
