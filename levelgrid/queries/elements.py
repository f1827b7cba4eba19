"""Queries on openings, columns, stairs and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from levelgrid.functions import geometry as g
from levelgrid.functions import hulls
from levelgrid.functions.geometry import clean
from levelgrid.operators import fixtures as X, openings as O
from levelgrid.queries.inputs import DUCK, SPARK, load, plan_sql, sql, wall_segments
from levelgrid.queries.registry import query
from levelgrid.queries.scans import TRI, _TRI, r
from levelgrid.queries.walls import LI, PLAN, WALLS, lay, line_points
from levelgrid.session import settle

D = plan_sql(DUCK)
r6 = lambda c: clean(F.col(c) if isinstance(c, str) else c)
WALL = [*PLAN, "wall_id"]


def levels_of(spark, sf):
    return lay(spark, sf, "levels").select(*PLAN, "elevation", "ceiling_height")


def frames_of(spark, sf):
    return settle(O.wall_frames(wall_segments(spark, sf), levels_of(spark, sf), PLAN))


_FR = f"""SELECT *, CAST(greatest(1, ceil(length / 0.02)) AS INT) AS cols, CAST(greatest(1, ceil((2.7::DOUBLE - 0.05 - 0.05) / 0.02)) AS INT) AS rows FROM (SELECT *, CASE WHEN y1 = y2 THEN x2 - x1 ELSE y2 - y1 END AS length FROM ({WALLS}) w) f"""
_PW = f"""SELECT p.plan_id, w.wall_id, ((p.x - w.x1) * (w.x2 - w.x1) + (p.y - w.y1) * (w.y2 - w.y1)) / w.length AS u, p.z, w.cols, w.rows FROM ({LI}) p JOIN ({_FR}) w ON p.plan_id = w.plan_id AND
    CASE WHEN w.y1 = w.y2 THEN abs(p.y - w.y1) ELSE abs(p.x - w.x1) END <= w.thickness / 2.0 + 0.05 AND CASE WHEN w.y1 = w.y2 THEN p.x - w.x1 ELSE p.y - w.y1 END BETWEEN -0.02 AND w.length + 0.02 AND p.z BETWEEN 0.05 AND 2.7::DOUBLE - 0.05"""


@query("project_to_walls", f"SELECT plan_id, wall_id, count(*) AS n, {r('sum(u)', 'sum_u', 4)}, {r('sum(z)', 'sum_z', 4)} FROM ({_PW}) q GROUP BY 1, 2")
def project_to_walls(spark, sf):
    p = O.project_to_walls(line_points(spark, sf), frames_of(spark, sf), PLAN)
    return p.groupBy("plan_id", "wall_id").agg(F.count(F.lit(1)).alias("n"), clean(F.sum("u"), 4).alias("sum_u"), clean(F.sum("z"), 4).alias("sum_z"))


_CELL = f"SELECT plan_id, wall_id, CAST(least(rows - 1, greatest(0, floor((z - 0.05) / 0.02))) AS INT) AS row, CAST(least(cols - 1, greatest(0, floor(u / 0.02))) AS INT) AS col, count(*) AS points, count(*) >= 2 AS solid FROM ({_PW}) q GROUP BY 1, 2, 3, 4"


@query("elevation_raster", _CELL)
def elevation_raster(spark, sf):
    p = O.project_to_walls(line_points(spark, sf), frames_of(spark, sf), PLAN)
    return O.elevation_raster(p, PLAN, every=True).select("plan_id", "wall_id", "row", "col", "points", "solid")


@query("elevation_raster_mesh", f"SELECT plan_id, wall_id, CAST(51 * 51 AS BIGINT) AS cells, 50 AS c0, 100 AS c1, 48 AS r0, 98 AS r1 FROM ({WALLS}) w")
def elevation_raster_mesh(spark, sf):
    # Two triangles make a 1 m square on each wall; its filled cells must be all of the square.
    w = wall_segments(spark, sf)
    d = g.unit(g.sub(g.xy("x2", "y2"), g.xy("x1", "y1")))
    at = lambda u, z: (F.col("x1") + d.x * u, F.col("y1") + d.y * u, F.lit(z))
    tri = lambda *p: F.struct(*[v.alias(f"{c}{n}") for c, q in zip("abc", p) for n, v in zip("xyz", q)])
    t = w.select(*PLAN, F.explode(F.array(tri(at(1.0, 1.0), at(2.0, 1.0), at(2.0, 2.0)), tri(at(1.0, 1.0), at(2.0, 2.0), at(1.0, 2.0)))).alias("t")).select(*PLAN, "t.*")
    m = O.elevation_raster_mesh(t, frames_of(spark, sf), PLAN)
    return m.groupBy("plan_id", "wall_id").agg(F.count(F.lit(1)).alias("cells"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))


# A raster per supplier: 40 columns and 60 rows with one opening and some specks.
_GRID = "SELECT concat('P', CAST(s_suppkey AS STRING)) AS wall_id, s_suppkey AS s, 60 AS rows, 40 AS cols FROM {supplier}"
_OPEN = "(col >= 8 + s % 5 AND col < 8 + s % 5 + 10 + s % 22 AND row >= s % 12 AND row < s % 12 + 15 + s % 31)"
_SOLID_D = f"""SELECT wall_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM (SELECT *, unnest(generate_series(0, 59)) AS row FROM (SELECT *, unnest(generate_series(0, 39)) AS col FROM ({_GRID.format(supplier='supplier')}) a) b) c
    WHERE (NOT {_OPEN} AND (row * 7 + col * 3 + s) % 11 <> 0) OR ({_OPEN} AND (row * 5 + col + s) % 37 = 0)"""


def solid_of(spark, sf):
    dims = sql(spark, sf, _GRID)
    cells = dims.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(59))))
    keep = F.expr(f"(NOT {_OPEN} AND (row * 7 + col * 3 + s) % 11 <> 0) OR ({_OPEN} AND (row * 5 + col + s) % 37 = 0)")
    return cells.filter(keep).select("wall_id", "row", "col"), dims.select("wall_id", "rows", "cols")


def holes(solid, dims):
    """What stays empty after closing."""
    return O.morph_open(O.empty_cells(O.cell_runs(solid, ["wall_id"]), dims, ["wall_id"]), dims, ["wall_id"])


_CROSS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dr, dc)"
_DIL = f"SELECT DISTINCT wall_id, row + dr AS row, col + dc AS col FROM ({_SOLID_D}) s, {_CROSS} WHERE row + dr BETWEEN 0 AND 59 AND col + dc BETWEEN 0 AND 39"
_ALL = "SELECT wall_id, s, row, unnest(generate_series(0, 39)) AS col FROM (SELECT *, unnest(generate_series(0, 59)) AS row FROM ({g}) a) b".format(g=_GRID.format(supplier="supplier"))
_CLOSED = f"""SELECT wall_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col FROM (SELECT a.wall_id, a.row, a.col, count(*) AS need, count(d.wall_id) AS have FROM (SELECT wall_id, row, col, row + dr AS r2, col + dc AS c2 FROM ({_ALL}) g, {_CROSS} WHERE row + dr BETWEEN 0 AND 59 AND col + dc BETWEEN 0 AND 39) a
    LEFT JOIN ({_DIL}) d ON d.wall_id = a.wall_id AND d.row = a.r2 AND d.col = a.c2 GROUP BY 1, 2, 3) q WHERE need = have"""


@query("morph_close", _CLOSED)
def morph_close(spark, sf):
    solid, dims = solid_of(spark, sf)
    return O.morph_close(solid, dims, ["wall_id"]).select("wall_id", "row", "col")


_VOID = f"SELECT wall_id, CAST(col AS INT) AS col, CAST(min(row) AS INT) AS z0, CAST(max(row) AS INT) AS z1 FROM (SELECT a.wall_id, a.row, a.col FROM ({_ALL}) a ANTI JOIN ({_CLOSED}) c ON c.wall_id = a.wall_id AND c.row = a.row AND c.col = a.col) e GROUP BY 1, 2 HAVING count(*) >= 18 AND max(row) - min(row) + 1 >= 18"


@query("column_voids", _VOID)
def column_voids(spark, sf):
    solid, dims = solid_of(spark, sf)
    return O.column_voids(holes(solid, dims), ["wall_id"])


_GROUPS = f"""SELECT wall_id, void, count(*) AS columns, min(col) AS c0, max(col) AS c1, CAST(floor(median(z0)) AS INT) AS z0, CAST(floor(median(z1)) AS INT) AS z1 FROM (
    SELECT *, CAST(sum(b) OVER (PARTITION BY wall_id ORDER BY col) AS BIGINT) AS void FROM (SELECT *, CASE WHEN col > lag(col) OVER w + 1 OR abs(z0 - lag(z0) OVER w) > 4 OR abs(z1 - lag(z1) OVER w) > 4 THEN 1 ELSE 0 END AS b FROM ({_VOID}) v WINDOW w AS (PARTITION BY wall_id ORDER BY col)) q) g
    GROUP BY 1, 2 HAVING count(*) >= 12 AND floor(median(z1)) > floor(median(z0))"""


def groups_of(spark, sf):
    solid, dims = solid_of(spark, sf)
    empty = settle(holes(solid, dims))
    return empty, dims, settle(O.group_voids(O.column_voids(empty, ["wall_id"]), ["wall_id"], least=12))


@query("group_voids", _GROUPS)
def group_voids(spark, sf):
    return groups_of(spark, sf)[2]


_METRICS = f"""SELECT wall_id, void, {r('CASE WHEN z0 <= 1 THEN 0.0 ELSE 0.05 + z0 * 0.02 END', 'sill')}, {r('least(1.3, CASE WHEN z1 >= 58 THEN 1.3 ELSE 0.05 + (z1 + 1) * 0.02 END)', 'head')}, {r('(c1 - c0 + 1) * 0.02', 'width')}, {r('least((c0 + c1 + 1) * 0.02 / 2.0, 0.8)', 'center')},
    {r('1.0 - (SELECT count(*) FROM (' + _CLOSED + ') c WHERE c.wall_id = g.wall_id AND c.col BETWEEN g.c0 AND g.c1 AND c.row BETWEEN g.z0 AND g.z1) / ((c1 - c0 + 1) * (z1 - z0 + 1))', 'ratio')} FROM ({_GROUPS}) g WHERE (c1 - c0 + 1) * 0.02 < 0.8"""


@query("void_metrics", _METRICS)
def void_metrics(spark, sf):
    empty, dims, groups = groups_of(spark, sf)
    fr = dims.withColumns({"length": F.lit(0.8), "ceiling_height": F.lit(1.3)})
    m = O.void_metrics(groups, empty, fr, ["wall_id"])
    return m.select("wall_id", "void", *[r6(c).alias(c) for c in ("sill", "head", "width", "center", "ratio")])


# Opening candidates with varied measures, one per part.
_VD = """SELECT concat('P', CAST(p_partkey % 50 AS STRING)) AS plan_id, 'L1' AS level_id, concat('w', CAST(p_partkey % 7 AS STRING)) AS wall_id, p_partkey AS void, CASE WHEN p_partkey % 3 = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS sill,
    CASE p_partkey % 5 WHEN 0 THEN CAST(2.7 AS DOUBLE) WHEN 1 THEN CAST(2.1 AS DOUBLE) WHEN 2 THEN CAST(1.7 AS DOUBLE) ELSE CAST(2.3 AS DOUBLE) END AS head, p_size / CAST(20 AS DOUBLE) AS width, p_size / CAST(10 AS DOUBLE) AS center,
    p_partkey % 4 = 0 AS low_confidence, CAST(5 AS DOUBLE) AS length, CAST(2.7 AS DOUBLE) AS ceiling_height FROM {part}"""
VD = _VD.format(part="part")
_KIND = """CASE WHEN sill <= 0.15 AND abs(ceiling_height - head) <= 0.20 AND width >= 0.90 THEN 'passage' WHEN sill <= 0.15 AND head BETWEEN 1.90 AND 2.40 AND ceiling_height - head >= 0.20 AND width BETWEEN 0.60 AND 1.80 THEN 'door'
    WHEN sill >= 0.40 AND head <= ceiling_height - 0.05 AND head - sill >= 0.40 AND width BETWEEN 0.40 AND 3.00 THEN 'window' END"""


@query("classify_openings", f"SELECT void, kind FROM (SELECT *, {_KIND} AS kind FROM ({VD}) v) q WHERE kind IS NOT NULL")
def classify_openings(spark, sf):
    return O.classify_openings(sql(spark, sf, _VD)).select("void", "kind")


@query("finish_openings", f"""SELECT plan_id, concat('o', CAST(row_number() OVER (PARTITION BY plan_id ORDER BY wall_id, void) AS STRING)) AS opening_id, wall_id, kind, {r('least(1.0, greatest(0.0, center / length))', 'off')}, {r('least(width, length - 0.01)', 'width')},
    CASE WHEN kind <> 'door' THEN 'none' WHEN least(width, length - 0.01) > 1.20 THEN 'double' ELSE 'left' END AS swing, CASE WHEN low_confidence THEN 0.45 ELSE 0.9 END AS confidence FROM (SELECT *, {_KIND} AS kind FROM ({VD}) v) q WHERE kind IS NOT NULL AND least(width, length - 0.01) > 0.05 AND least(head, ceiling_height) > sill""")
def finish_openings(spark, sf):
    o = O.finish_openings(sql(spark, sf, _VD), PLAN)
    return o.select("plan_id", "opening_id", "wall_id", "kind", r6("offset").alias("off"), r6("width").alias("width"), "swing", "confidence")


def gap_faces(spark, sf):
    """Per plan a wall of two faces with a gap that grows with the plan number."""
    b = lay(spark, sf, "base")
    gap = 0.75 + (F.col("s") % 20) / 10.0
    face = lambda n, x1, x2: F.struct(F.lit(n).alias("face"), x1.alias("x1"), x2.alias("x2"))
    f = b.select(*PLAN, "t", F.explode(F.array(face(1, F.lit(0.0), F.lit(2.0)), face(2, 2.0 + gap, 5.0 + gap))).alias("f"))
    return f.select(*PLAN, F.col("f.face").cast("bigint").alias("face"), F.col("f.x1").alias("x1"), F.lit(1.0).alias("y1"), F.col("f.x2").alias("x2"), F.lit(1.0).alias("y2"), F.col("t").cast("double").alias("thickness"), F.lit(False).alias("assumed"), F.lit("exterior").alias("kind"))


_GAP = "SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, 0.75 + (s_suppkey % 20) / 10.0 AS w FROM supplier"


@query("gap_passages", f"SELECT plan_id, {r('w', 'width')}, {r('2.0 + w / 2.0', 'x')}, 1.0::DOUBLE AS y, 0.0::DOUBLE AS x1, {r('5.0 + w', 'x2')} FROM ({_GAP}) q WHERE round(w, 9) BETWEEN 0.9 AND 2.5")
def gap_passages(spark, sf):
    p = O.gap_passages(gap_faces(spark, sf), PLAN)
    return p.select("plan_id", *[r6(c).alias(c) for c in ("width", "x", "y", "x1", "x2")])


@query("anti_near", f"SELECT p.plan_id, count(*) AS n FROM ({LI}) p WHERE NOT EXISTS (SELECT 1 FROM ({D['fixtures']}) f WHERE f.plan_id = p.plan_id AND sqrt((f.x - p.x) * (f.x - p.x) + (f.y - p.y) * (f.y - p.y)) < 0.4) GROUP BY 1")
def anti_near(spark, sf):
    return O.anti_near(line_points(spark, sf), lay(spark, sf, "fixtures"), 0.4, PLAN).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))


@query("point_on_wall", f"""SELECT o.plan_id, o.opening_id, {r('w.x1 + (w.x2 - w.x1) * o."offset"', 'x')}, {r('w.y1 + (w.y2 - w.y1) * o."offset"', 'y')} FROM ({D['openings']}) o JOIN ({WALLS}) w USING (plan_id, wall_id)""")
def point_on_wall(spark, sf):
    return O.point_on_wall(lay(spark, sf, "openings"), wall_segments(spark, sf), PLAN).select("plan_id", "opening_id", r6("x").alias("x"), r6("y").alias("y"))


@query("host_wall", f"SELECT plan_id, CASE WHEN CAST(substring(plan_id, 2) AS INT) % 2 = 0 THEN 'old' ELSE 'new' END AS host, {r('(2.0 + w / 2.0) / (5.0 + w)', 'off')} FROM ({_GAP}) q WHERE round(w, 9) BETWEEN 0.9 AND 2.5")
def host_wall(spark, sf):
    gaps = O.gap_passages(gap_faces(spark, sf), PLAN)
    # Even plans have a wall over the whole span already.
    even = F.substring("plan_id", 2, 9).cast("int") % 2 == 0
    gaps = settle(gaps)
    walls = gaps.filter(even).select(*PLAN, F.lit("w1").alias("wall_id"), "x1", "y1", "x2", "y2", "thickness", "kind").withColumns({"a": F.lit("v1"), "b": F.lit("v2"), "confidence": F.lit(1.0)})
    verts = gaps.filter(even).select(*PLAN, F.lit("v1").alias("vertex_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    hosted, new_walls, _ = O.host_wall(gaps, walls, verts, PLAN)
    made = new_walls.select(*PLAN, "wall_id", F.lit("new").alias("host"))
    return hosted.join(made, [*PLAN, "wall_id"], "left").select("plan_id", F.coalesce("host", F.lit("old")).alias("host"), r6("offset").alias("off"))


def _near_wall_sql(pad, along):
    n = "sqrt((w.x2 - w.x1) * (w.x2 - w.x1) + (w.y2 - w.y1) * (w.y2 - w.y1))"
    return f"""EXISTS (SELECT 1 FROM ({WALLS}) w WHERE w.plan_id = p.plan_id AND ((p.x - w.x1) * (w.x2 - w.x1) + (p.y - w.y1) * (w.y2 - w.y1)) / {n} BETWEEN -{along} AND {n} + {along}
        AND abs((w.x2 - w.x1) * (p.y - w.y1) - (w.y2 - w.y1) * (p.x - w.x1)) / {n} <= w.thickness / 2.0 + {pad})"""


@query("away_from_walls", f"SELECT p.plan_id, count(*) AS n FROM ({LI}) p WHERE NOT {_near_wall_sql('0.08', '0.08')} GROUP BY 1")
def away_from_walls(spark, sf):
    return O.away_from_walls(line_points(spark, sf), wall_segments(spark, sf), 0.08, keys=PLAN).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))


_COLS = D["columns"]


@query("residual_points", f"""SELECT p.plan_id, count(*) AS n FROM ({LI}) p WHERE NOT {_near_wall_sql('0.12', '0.1')} AND NOT EXISTS (SELECT 1 FROM ({_COLS}) c WHERE c.plan_id = p.plan_id AND
    sqrt(greatest(abs(p.x - c.x) - 0.2, 0) * greatest(abs(p.x - c.x) - 0.2, 0) + greatest(abs(p.y - c.y) - 0.2, 0) * greatest(abs(p.y - c.y) - 0.2, 0)) <= 0.08 + 1e-9) GROUP BY 1 HAVING count(*) >= 15""")
def residual_points(spark, sf):
    pts = line_points(spark, sf).withColumn("nz", F.lit(0.0))
    p = X.residual_points(pts, levels_of(spark, sf), wall_segments(spark, sf), lay(spark, sf, "columns"), None, PLAN)
    return p.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))


@query("near_wall", f"SELECT p.plan_id, p.fixture_id FROM ({D['fixtures']}) p WHERE NOT {_near_wall_sql('0.05', '0.05')}")
def near_wall(spark, sf):
    return X.near_wall(lay(spark, sf, "fixtures"), wall_segments(spark, sf), PLAN).select("plan_id", "fixture_id")


_RULES = ", ".join(f"({i}, '{s}', '{ro}', {', '.join(f'{v}::DOUBLE' for v in m)})" for i, (s, ro, *m) in enumerate(X.BOX_RULES))
_BX = """SELECT p_partkey AS box_id, p_size / CAST(20 AS DOUBLE) AS width, p_partkey % 53 / CAST(20 AS DOUBLE) AS depth, p_partkey % 47 / CAST(20 AS DOUBLE) AS height FROM {part}"""
_MID = lambda lo, hi, v: f"CASE WHEN {hi} >= 1e8 THEN greatest({lo}, {v}) ELSE ({lo} + {hi}) / 2.0 END"
_GAPA = lambda w, d: f"abs({w} * {d} - ({_MID('w0', 'w1', w)}) * ({_MID('d0', 'd1', d)}))"
_FIT = lambda v, lo, hi: f"({v} >= {lo} - 1e-6 AND {v} <= {hi} + 1e-6)"


@query("classify_boxes", f"""SELECT b.box_id, coalesce(h.symbol, 'block') AS symbol, coalesce(h.role, 'furniture') AS role, CASE WHEN h.n IS NULL THEN 0.3 WHEN h.n = 1 THEN 0.8 ELSE 0.5 END AS confidence, {r('coalesce(h.w, b.width)', 'width')}, {r('coalesce(h.d, b.depth)', 'depth')} FROM ({_BX.format(part='part')}) b LEFT JOIN (
    SELECT *, count(*) OVER (PARTITION BY box_id) AS n, row_number() OVER (PARTITION BY box_id ORDER BY {_GAPA('w', 'd')}, o) AS k FROM (
        SELECT *, CASE WHEN turn THEN depth ELSE width END AS w, CASE WHEN turn THEN width ELSE depth END AS d FROM (
            SELECT *, sw AND (NOT di OR {_GAPA('depth', 'width')} < {_GAPA('width', 'depth')}) AS turn FROM (
                SELECT *, {_FIT('width', 'w0', 'w1')} AND {_FIT('depth', 'd0', 'd1')} AS di, {_FIT('depth', 'w0', 'w1')} AND {_FIT('width', 'd0', 'd1')} AS sw FROM ({_BX.format(part='part')}) x, (VALUES {_RULES}) r(o, symbol, role, w0, w1, d0, d1, h0, h1)
                WHERE height >= h0 AND height <= h1) y WHERE di OR sw) z) u) h ON h.box_id = b.box_id AND h.k = 1""")
def classify_boxes(spark, sf):
    c = X.classify_boxes(sql(spark, sf, _BX))
    return c.select("box_id", "symbol", "role", "confidence", r6("width").alias("width"), r6("depth").alias("depth"))


@query("column_ring", f"SELECT plan_id, column_id, {r('x - width / 2.0', 'min_x')}, {r('y + depth / 2.0', 'max_y')}, {r('width * depth', 'area')} FROM ({_COLS}) c")
def column_ring(spark, sf):
    c = O.column_ring(lay(spark, sf, "columns"))
    b = g.ring_bounds(F.col("ring"))
    return c.select("plan_id", "column_id", r6(b["min_x"]).alias("min_x"), r6(b["max_y"]).alias("max_y"), r6(F.abs(g.ring_area(F.col("ring")))).alias("area"))


# Points of a box turned by the angle whose sine is 0.6, one box per part.
def turned_points(spark, sf):
    p = load(spark, sf, "part").withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(5))))
    a, b = F.col("u") / 5.0 * (1.0 + F.col("p_size") / 10.0), F.col("v") / 5.0 * 0.7
    return p.select(F.col("p_partkey").alias("id"), (0.8 * a - 0.6 * b + F.col("p_partkey")).alias("x"), (0.6 * a + 0.8 * b).alias("y"))


@query("min_rotated_rect", f"SELECT p_partkey AS id, {r('1.0 + p_size / 10.0', 'long')}, 0.7::DOUBLE AS short, {r('p_partkey + 0.4 * (1.0 + p_size / 10.0) - 0.21', 'x')}, {r('0.3 * (1.0 + p_size / 10.0) + 0.28', 'y')} FROM part")
def min_rotated_rect(spark, sf):
    m = O.min_rotated_rect(turned_points(spark, sf), ["id"])
    return m.select("id", r6(F.greatest("width", "depth")).alias("long"), r6(F.least("width", "depth")).alias("short"), r6("x").alias("x"), r6("y").alias("y"))


@query("convex_hull", f"SELECT p_partkey AS id, {r('(1.0 + p_size / 10.0) * 0.7', 'area')} FROM part")
def convex_hull(spark, sf):
    return hulls.convex_hull(turned_points(spark, sf), ["id"]).select("id", r6(g.ring_area(F.col("hull"))).alias("area"))


# Ramp triangles per plan: footprint 1.2 m by 2.8 m rising 1 to 2.5 m.
def ramps(spark, sf):
    b = lay(spark, sf, "base").withColumn("rise", 1.0 + (F.col("s") % 4) / 2.0)
    at = lambda x, y, z: (F.lit(x), F.lit(y), z)
    zero, rise = F.lit(0.0), F.col("rise")
    tri = lambda *p: F.struct(*[v.alias(f"{c}{n}") for c, q in zip("abc", p) for n, v in zip("xyz", q)])
    t = F.array(tri(at(5.2, 0.4, zero), at(6.4, 0.4, zero), at(6.4, 3.2, rise)), tri(at(5.2, 0.4, zero), at(6.4, 3.2, rise), at(5.2, 3.2, rise)))
    return b.select(*PLAN, F.explode(t).alias("t")).select(*PLAN, "t.*")


_STAIR = "SELECT plan_id, 3.36::DOUBLE AS area, 0.0::DOUBLE AS dir_x, 1.0::DOUBLE AS dir_y, CAST(greatest(1, round_even(rise / 0.18, 0)) AS INT) AS risers, {rise} FROM (SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, 1.0 + (s_suppkey % 4) / 2.0 AS rise FROM supplier) q WHERE degrees(atan2(rise, 2.8)) BETWEEN 20 AND 45"


@query("detect_stairs_mesh", _STAIR.format(rise=r("rise", "rise")))
def detect_stairs_mesh(spark, sf):
    s = O.detect_stairs_mesh(ramps(spark, sf), levels_of(spark, sf), PLAN)
    return s.select("plan_id", r6(g.ring_area(F.col("outline"))).alias("area"), r6("dir_x").alias("dir_x"), r6("dir_y").alias("dir_y"), F.col("riser_count").alias("risers"), r6(F.col("to_elevation") - F.col("from_elevation")).alias("rise"))


@query("detect_stairs_points", _STAIR.format(rise=r("rise", "rise")))
def detect_stairs_points(spark, sf):
    b = lay(spark, sf, "base").withColumn("rise", 1.0 + (F.col("s") % 4) / 2.0)
    p = b.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(14))))
    slope = F.sqrt(F.col("rise") * F.col("rise") + 2.8 * 2.8)
    p = p.select(*PLAN, (5.2 + F.col("u") * 0.2).alias("x"), (0.4 + F.col("v") * 0.2).alias("y"), (F.col("rise") * F.col("v") / 14.0).alias("z"), F.lit(0.0).alias("nx"), (-F.col("rise") / slope).alias("ny"), (2.8 / slope).alias("nz"))
    s = O.detect_stairs_points(p, levels_of(spark, sf), None, PLAN)
    return s.select("plan_id", r6(g.ring_area(F.col("outline"))).alias("area"), r6("dir_x").alias("dir_x"), r6("dir_y").alias("dir_y"), F.col("riser_count").alias("risers"), r6(F.col("to_elevation") - F.col("from_elevation")).alias("rise"))


def solid_items(spark, sf):
    """Points of one column and one toilet-sized box in the first room of every plan."""
    b = lay(spark, sf, "base")

    def shell(x0, y0, w, d, h, n, step):
        ring = [(x0 + w * k / n, y0) for k in range(n)] + [(x0 + w, y0 + d * k / n) for k in range(n)] + [(x0 + w - w * k / n, y0 + d) for k in range(n)] + [(x0, y0 + d - d * k / n) for k in range(n)]
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(h).alias("h"), F.lit(step).alias("step")) for x, y in ring])

    p = b.select(*PLAN, F.explode(F.concat(shell(1.8, 1.8, 0.4, 0.4, 2.6, 6, 0.1), shell(3.0, 2.5, 0.4, 0.7, 0.4, 7, 0.05))).alias("p"))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.round(F.col("p.h") / F.col("p.step")).cast("int"))))
    return settle(p.select(*PLAN, "p.x", "p.y", (F.col("k") * F.col("p.step")).alias("z"), F.lit(0.0).alias("nz")))


@query("detect_columns", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, 2.0::DOUBLE AS x, 2.0::DOUBLE AS y, TRUE AS sized FROM supplier")
def detect_columns(spark, sf):
    c = O.detect_columns(solid_items(spark, sf), wall_segments(spark, sf), levels_of(spark, sf), PLAN)
    near = lambda e: F.abs(F.col(e) - 0.4) < 0.09
    return c.select("plan_id", clean(F.col("x"), 1).alias("x"), clean(F.col("y"), 1).alias("y"), (near("width") & near("depth")).alias("sized"))


@query("cluster_points", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, 2 AS clusters FROM supplier")
def cluster_points(spark, sf):
    p = X.cluster_points(X.thin(solid_items(spark, sf), 0.05, keys=PLAN), keys=PLAN)
    return p.groupBy("plan_id").agg(F.countDistinct("cluster").cast("int").alias("clusters"))


@query("cluster_height", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, h AS height FROM supplier, (VALUES (0.35::DOUBLE), (2.4::DOUBLE)) v(h)")
def cluster_height(spark, sf):
    pts = solid_items(spark, sf)
    p = settle(X.cluster_points(X.thin(pts, 0.05, keys=PLAN), keys=PLAN))
    return X.cluster_height(p, pts, levels_of(spark, sf), PLAN).select("plan_id", r6("height").alias("height"))


@query("detect_fixtures", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, 'toilet' AS symbol, 3.2::DOUBLE AS x, 2.85::DOUBLE AS y, 0.4::DOUBLE AS width, 0.7::DOUBLE AS depth FROM supplier")
def detect_fixtures(spark, sf):
    pts = solid_items(spark, sf)
    walls, levels = wall_segments(spark, sf), levels_of(spark, sf)
    cols = settle(O.detect_columns(pts, walls, levels, PLAN))
    f = X.detect_fixtures(pts, levels, walls, cols, None, PLAN)
    return f.select("plan_id", "symbol", *[clean(F.col(c), 2).alias(c) for c in ("x", "y", "width", "depth")])


@query("detect_openings", """SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, k AS kind, CAST(count(*) AS BIGINT) AS n, round(w, 2) AS width FROM supplier, LATERAL (SELECT unnest(generate_series(1, 1 + s_suppkey % 3)) AS i) x, (VALUES ('door', 0.9::DOUBLE), ('window', 1.2::DOUBLE)) v(k, w) GROUP BY ALL""")
def detect_openings(spark, sf):
    """Openings of every lattice wall, seen in the mesh of its face with the holes cut out."""
    from levelgrid.queries.inputs import plan_tables

    w = wall_segments(spark, sf)
    o = lay(spark, sf, "openings").select(*PLAN, "wall_id", "offset", "width", "sill", "head")
    m = w.join(o, [*PLAN, "wall_id"], "left")
    length = g.dist(g.xy("x1", "y1"), g.xy("x2", "y2"))
    d = g.unit(g.sub(g.xy("x2", "y2"), g.xy("x1", "y1")))
    c = F.col("offset") * length
    u0, u1 = c - F.col("width") / 2.0, c + F.col("width") / 2.0
    z, top = F.lit(0.0), F.lit(2.7)
    rect = lambda a, b, lo, hi: F.struct(a.alias("a"), b.alias("b"), lo.alias("lo"), hi.alias("hi"))
    whole = F.array(rect(z, length, z, top))
    holed = F.array(rect(z, u0, z, top), rect(u1, length, z, top), rect(u0, u1, z, F.col("sill")), rect(u0, u1, F.col("head"), top))
    m = m.withColumn("q", F.explode(F.when(F.col("offset").isNull(), whole).otherwise(holed))).filter("q.b - q.a > 1e-6 and q.hi - q.lo > 0.02")
    at = lambda e, h: (F.col("x1") + d.x * F.col(f"q.{e}"), F.col("y1") + d.y * F.col(f"q.{e}"), F.col(f"q.{h}"))
    tri = lambda *p: F.struct(*[v.alias(f"{k}{n}") for k, s in zip("abc", p) for n, v in zip("xyz", s)])
    t = m.select(*PLAN, F.explode(F.array(tri(at("a", "lo"), at("b", "lo"), at("b", "hi")), tri(at("a", "lo"), at("b", "hi"), at("a", "hi")))).alias("t")).select(*PLAN, "t.*")
    found = O.detect_openings(None, w, levels_of(spark, sf), settle(t), PLAN)
    # Measured widths are one or two raster cells short.
    near = F.when(F.abs(F.col("width") - 0.9) <= 0.06, 0.9).when(F.abs(F.col("width") - 1.2) <= 0.06, 1.2).otherwise(F.col("width"))
    return found.groupBy("plan_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(near), 2).alias("width"))
