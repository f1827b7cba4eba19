"""Queries on surfaces, wall graphs, openings and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from levelgrid.functions import arrangement as arr
from levelgrid.functions import geometry as g
from levelgrid.functions import graph, hulls, splits, tiles
from levelgrid.functions.geometry import clean
from levelgrid.operators import fixtures as X, normalize as N, openings as O, surfaces as S, wallgraph as G
from levelgrid.queries.inputs import DUCK, SPARK, load, plan_sql, points_m, sql, wall_segments
from levelgrid.queries.registry import query
from levelgrid.queries.scans import OP, order_points, r
from levelgrid.session import settle

PM = points_m()
PLAN = ["plan_id", "level_id"]
D = plan_sql(DUCK)
WALLS = D["walls"].replace('"offset"', '"offset"')
r6 = lambda c: clean(F.col(c) if isinstance(c, str) else c)
lay = lambda spark, sf, name: sql(spark, sf, plan_sql(SPARK, "{supplier}")[name].replace('"offset"', "`offset`"))

# Points with their storey: two storeys, told apart by height.
_SP = f"SELECT p.*, CASE WHEN z >= 2.95 THEN 1 ELSE 0 END AS level_index FROM ({PM}) p"


def storey_points(spark, sf):
    from levelgrid.queries.inputs import scan_points

    p = scan_points(spark, sf).withColumn("level_index", F.when(F.col("z") >= 2.95, 1).otherwise(0))
    return p


@query("vertical_points", f"SELECT scan_id, level_index, count(*) AS n FROM ({_SP}) p WHERE abs(nz) <= 0.25 GROUP BY 1, 2 HAVING count(*) >= 200")
def vertical_points(spark, sf):
    return S.vertical_points(storey_points(spark, sf)).groupBy("scan_id", "level_index").agg(F.count(F.lit(1)).alias("n"))


# Customer points on three flat sheets, one per scan.
_CP = """SELECT concat('C', CAST(c_custkey % 3 AS STRING)) AS scan_id, c_custkey AS id, CAST(CASE WHEN c_custkey % 3 = 1 THEN 0 ELSE (c_custkey * 37) % 199 END AS DOUBLE) / CAST(10 AS DOUBLE) AS x,
    CAST(CASE WHEN c_custkey % 3 = 2 THEN 0 ELSE (c_custkey * 53) % 211 END AS DOUBLE) / CAST(10 AS DOUBLE) AS y, CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE (c_custkey * 71) % 223 END AS DOUBLE) / CAST(10 AS DOUBLE) AS z FROM {customer}"""
CP = _CP.format(customer="customer")
_KNN = f"""SELECT scan_id, id, nid, nx, ny, nz, k AS rank, gap FROM (SELECT a.scan_id, a.id, b.id AS nid, b.x AS nx, b.y AS ny, b.z AS nz, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS gap,
    row_number() OVER (PARTITION BY a.scan_id, a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), b.id) AS k FROM ({CP}) a JOIN ({CP}) b USING (scan_id)) q WHERE k <= 8"""


@query("knn", f"SELECT scan_id, id, nid, CAST(rank AS INT) AS rank, {r('gap', 'gap')} FROM ({_KNN}) q")
def knn(spark, sf):
    return tiles.knn(sql(spark, sf, _CP), 8, ["scan_id"], 2.0).select("scan_id", "id", "nid", "rank", r6("gap").alias("gap"))


# One scan with nine tenths of its points in one corner, a thousandth of its side wide.
_CORNER = """SELECT 'D' AS scan_id, c_custkey AS id, x * s AS x, y * s AS y, z * s AS z FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END AS s,
    CAST((c_custkey * 37) % 1999 AS DOUBLE) / CAST(100 AS DOUBLE) AS x, CAST((c_custkey * 53) % 2111 AS DOUBLE) / CAST(100 AS DOUBLE) AS y, CAST((c_custkey * 71) % 2239 AS DOUBLE) / CAST(100 AS DOUBLE) AS z FROM {customer}) c"""


@query("knn_dense_corner", f"SELECT scan_id, id, nid, CAST(rank AS INT) AS rank, {r('gap', 'gap', 9)} FROM ({_KNN.replace(CP, _CORNER.format(customer='customer'))}) q")
def knn_dense_corner(spark, sf):
    return splits.knn(sql(spark, sf, _CORNER), 8, ["scan_id"]).select("scan_id", "id", "nid", "rank", clean(F.col("gap"), 9).alias("gap"))


# The sheets crumpled by up to 2 m. The least eigenvalue of a neighbourhood's scatter in closed form.
_CRUMPLED = f"SELECT scan_id, id, x + (id * 29) % 17 / 10.0 AS x, y + (id * 31) % 19 / 10.0 AS y, z + (id * 23) % 13 / 10.0 AS z FROM ({_CP}) c"
_NEAR = _KNN.replace(CP, _CRUMPLED.format(customer="customer"))
_SCATTER = "SELECT scan_id, id, " + ", ".join(f"sum(n{a} * n{b}) - sum(n{a}) * sum(n{b}) / count(*) AS c{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + f" FROM ({_NEAR}) k GROUP BY 1, 2"
_EIGEN = f"""SELECT scan_id, id, q + 2 * p * cos(acos(least(1.0, greatest(-1.0, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p)))) / 3 + 2 * pi() / 3) AS eig FROM (
    SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM (SELECT *, (cxx + cyy + czz) / 3 AS q FROM ({_SCATTER}) s) t) u"""


@query("curvature", f"SELECT scan_id, id, {r('eig', 'curvature', 5)} FROM ({_EIGEN}) e")
def curvature(spark, sf):
    k = settle(tiles.knn(sql(spark, sf, _CRUMPLED), 8, ["scan_id"], 2.0))
    return S.curvature(k, ["scan_id"]).select("scan_id", "id", clean(F.col("curvature"), 5).alias("curvature"))


@query("estimate_normals", f"SELECT scan_id, id, CASE scan_id WHEN 'C1' THEN 1.0::DOUBLE ELSE 0.0 END AS ax, CASE scan_id WHEN 'C2' THEN 1.0::DOUBLE ELSE 0.0 END AS ay, CASE scan_id WHEN 'C0' THEN 1.0::DOUBLE ELSE 0.0 END AS az FROM ({CP}) p")
def estimate_normals(spark, sf):
    n = N.estimate_normals(sql(spark, sf, _CP), 12, ["scan_id"], 2.0)
    return n.select("scan_id", "id", *[clean(F.abs(f"n{c}"), 4).alias(f"a{c}") for c in "xyz"])


_CLASS = "CASE WHEN nx > 0.5 THEN 3 WHEN nx < -0.5 THEN 5 WHEN ny > 0.5 THEN 4 ELSE 2 END"


@query("plane_segments", f"SELECT scan_id, level_index, n FROM (SELECT scan_id, level_index, {_CLASS} AS c, count(*) AS n FROM ({_SP}) p WHERE abs(nz) <= 0.25 GROUP BY 1, 2, 3) q WHERE n >= 200")
def plane_segments(spark, sf):
    """Every scan turned by another angle, so that its walls are slanted, and standing far from the origin."""
    p = S.vertical_points(storey_points(spark, sf))
    a = F.radians(F.substring("scan_id", 2, 9).cast("int") * 17.0)
    turn = lambda x, y: (F.col(x) * F.cos(a) - F.col(y) * F.sin(a), F.col(x) * F.sin(a) + F.col(y) * F.cos(a))
    (x, y), (nx, ny) = turn("x", "y"), turn("nx", "ny")
    p = S.plane_segments(p.withColumns({"x": x + 1000.0, "y": y - 2000.0, "nx": nx, "ny": ny}))
    return p.groupBy("scan_id", "level_index", "plane").agg(F.count(F.lit(1)).alias("n")).drop("plane")


# No SQL: where a plane ends depends on those before it. tests/test_planes.py holds the rules.
@query("curved_planes")
def curved_planes(spark, sf):
    """The long walls bent to arcs of a radius of 4 to 11 m: planes of an arc, their points and lengths."""
    p = S.vertical_points(storey_points(spark, sf)).filter("ny <> 0")
    r = 4.0 + F.substring("scan_id", 2, 9).cast("int")
    a, far = F.col("x") / r, r + F.col("y") * F.signum("ny")
    bent = {"x": far * F.cos(a), "y": far * F.sin(a), "nx": F.cos(a), "ny": F.sin(a)}
    p = settle(S.plane_segments(p.withColumns(bent), min_points=40))
    f = S.fit_planes(p, snap=False, min_area=0.0)
    return f.select("scan_id", "level_index", "n", clean(F.col("along1") - F.col("along0"), 2).alias("length"))


def cut_planes(spark, sf):
    """Wall points of the scans cut into strips of 2 m: planes that belong together."""
    p = S.vertical_points(storey_points(spark, sf))
    c = F.expr(_CLASS)
    u = F.when(c.isin(2, 4), F.col("x")).otherwise(F.col("y"))
    return settle(p.withColumn("plane", (c * 100 + F.floor(u / 2.0)).cast("bigint")))


_CUT = f"SELECT *, {_CLASS} AS c, CAST({_CLASS} * 100 + floor((CASE WHEN {_CLASS} IN (2, 4) THEN x ELSE y END) / 2.0) AS BIGINT) AS plane FROM ({_SP}) p WHERE abs(nz) <= 0.25"
_FIT = f"""SELECT scan_id, level_index, {{g}}, count(*) AS n, CASE max(c) WHEN 3 THEN avg(x) WHEN 5 THEN -avg(x) WHEN 4 THEN avg(y) ELSE -avg(y) END AS ofs,
    CASE WHEN max(c) IN (2, 4) THEN max(x) - min(x) ELSE max(y) - min(y) END AS length, min(z) AS z0, max(z) AS z1, avg(x) AS ax, avg(y) AS ay, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(c) AS c
    FROM ({_CUT}) q GROUP BY 1, 2, 3"""


@query("fit_planes", f"SELECT scan_id, level_index, plane, n, {r('ofs', 'pos', 3)}, {r('length', 'length', 3)}, {r('z0', 'z0')}, {r('z1', 'z1')} FROM ({_FIT.format(g='plane')}) q WHERE length * (z1 - z0) >= 0.5")
def fit_planes(spark, sf):
    f = S.fit_planes(cut_planes(spark, sf))
    return f.select("scan_id", "level_index", "plane", "n", clean(F.col("offset"), 3).alias("pos"), clean(F.col("along1") - F.col("along0"), 3).alias("length"), r6("z0").alias("z0"), r6("z1").alias("z1"))


@query("snap_planes", f"SELECT scan_id, level_index, plane, {r('ofs', 'pos')}, {r('length', 'length')} FROM ({_FIT.format(g='plane')}) q WHERE length * (z1 - z0) >= 0.5")
def snap_planes(spark, sf):
    p = cut_planes(spark, sf)
    s = S.snap_planes(settle(S.fit_planes(p, snap=False, min_area=0.5)), p)
    return s.select("scan_id", "level_index", "plane", r6("offset").alias("pos"), r6(F.col("along1") - F.col("along0")).alias("length"))


@query("merge_planes", f"SELECT scan_id, level_index, n, {r('ofs', 'pos', 3)}, {r('length', 'length', 3)} FROM ({_FIT.format(g='c + 0 AS wall')}) q WHERE z1 - z0 >= 1.2")
def merge_planes(spark, sf):
    p = cut_planes(spark, sf)
    m, _ = S.merge_planes(S.fit_planes(p, min_area=0.0), p)
    return m.select("scan_id", "level_index", "n", clean(F.col("offset"), 3).alias("pos"), clean(F.col("along1") - F.col("along0"), 3).alias("length"))


def _whole_planes(spark, sf):
    p = S.vertical_points(storey_points(spark, sf))
    p = settle(p.withColumn("plane", F.expr(_CLASS).cast("bigint")))
    return settle(S.fit_planes(p)), p


_WHOLE = _FIT.format(g="c + 0 AS wall")


# Planes moved inwards by 0, 50, 100 mm, ...: those within 80 mm are on the hull.
@query("on_hull", f"SELECT scan_id, level_index, CAST(wall AS BIGINT) AS plane, (CAST(substring(scan_id, 2) AS INT) + wall) % 4 <= 1 AS on_hull FROM ({_WHOLE}) q")
def on_hull(spark, sf):
    planes, p = _whole_planes(spark, sf)
    deep = (F.substring("scan_id", 2, 9).cast("int") + F.col("plane")) % 4 * 0.05
    inward = g.dot(g.xy("nx", "ny"), g.sub(g.P(F.lit(4.0), F.lit(3.0)), g.xy("mx", "my")))
    planes = planes.withColumn("offset", F.col("offset") + F.when(inward > 0, deep).otherwise(-deep))
    return S.on_hull(planes, p).select("scan_id", "level_index", "plane", "on_hull")


@query("assumed_walls", f"""SELECT scan_id, level_index, 0.3::DOUBLE AS thickness, 'exterior' AS kind, 0.4::DOUBLE AS confidence,
    round_even(CASE c WHEN 3 THEN ax + 0.15 WHEN 5 THEN ax - 0.15 WHEN 2 THEN x0 ELSE x1 END, 3) + 0.0 AS x1, round_even(CASE c WHEN 2 THEN ay - 0.15 WHEN 4 THEN ay + 0.15 WHEN 3 THEN y0 ELSE y1 END, 3) + 0.0 AS y1 FROM ({_WHOLE}) q""")
def assumed_walls(spark, sf):
    planes, p = _whole_planes(spark, sf)
    planes = settle(S.on_hull(planes, p))
    pairs = S.pair_planes(planes)
    return S.assumed_walls(planes, pairs).select("scan_id", "level_index", "thickness", "kind", "confidence", (F.col("x1") + F.lit(0.0)).alias("x1"), (F.col("y1") + F.lit(0.0)).alias("y1"))


def wall_planes(spark, sf):
    """Both faces of every lattice wall as planes."""
    w = wall_segments(spark, sf)
    d = g.unit(g.sub(g.xy("x2", "y2"), g.xy("x1", "y1")))
    n = g.left(d)
    side = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("s")
    w = w.select(*PLAN, "wall_id", "thickness", "x1", "y1", "x2", "y2", side, d.x.alias("dx"), d.y.alias("dy"))
    nx, ny = -F.col("dy") * F.col("s"), F.col("dx") * F.col("s")
    mx = (F.col("x1") + F.col("x2")) / 2.0 + nx * F.col("thickness") / 2.0
    my = (F.col("y1") + F.col("y2")) / 2.0 + ny * F.col("thickness") / 2.0
    half = g.dist(g.xy("x1", "y1"), g.xy("x2", "y2")) / 2.0
    w = w.withColumns({"nx": nx, "ny": ny, "mx": mx, "my": my, "along1": half, "along0": -half, "z0": F.lit(0.0), "z1": F.lit(2.7), "n": F.lit(100).cast("bigint"), "on_hull": F.lit(False)})
    w = w.withColumn("offset", F.col("nx") * F.col("mx") + F.col("ny") * F.col("my"))
    return w.withColumn("plane", F.xxhash64(*PLAN, "wall_id", "s"))


@query("pair_planes", f"SELECT plan_id, level_id, count(*) AS pairs, {r('sum(thickness)', 'thickness')} FROM ({WALLS}) w GROUP BY 1, 2")
def pair_planes(spark, sf):
    p = S.pair_planes(settle(wall_planes(spark, sf)), PLAN)
    return p.groupBy(*PLAN).agg(F.count(F.lit(1)).alias("pairs"), r6(F.sum("distance")).alias("thickness"))


_UND = "least(x1, x2) AS xa, least(y1, y2) AS ya, greatest(x1, x2) AS xb, greatest(y1, y2) AS yb"
und = lambda: [(F.least("x1", "x2") + F.lit(0.0)).alias("xa"), (F.least("y1", "y2") + F.lit(0.0)).alias("ya"), (F.greatest("x1", "x2") + F.lit(0.0)).alias("xb"), (F.greatest("y1", "y2") + F.lit(0.0)).alias("yb")]


@query("paired_walls", f"SELECT plan_id, level_id, {_UND}, {r('thickness', 'thickness')} FROM ({WALLS}) w")
def paired_walls(spark, sf):
    planes = settle(wall_planes(spark, sf))
    return S.paired_walls(planes, S.pair_planes(planes, PLAN), PLAN).select(*PLAN, *und(), r6("thickness").alias("thickness"))


@query("wall_face_ring", f"SELECT plan_id, level_id, wall_id, {r('CASE WHEN y1 = y2 THEN (x2 - x1) * thickness ELSE (y2 - y1) * thickness END', 'area')}, {r('CASE WHEN y1 = y2 THEN x1 ELSE x1 - thickness / 2.0 END', 'min_x')} FROM ({WALLS}) w")
def wall_face_ring(spark, sf):
    w = wall_segments(spark, sf)
    n = g.left(g.unit(g.sub(g.xy("x2", "y2"), g.xy("x1", "y1"))))
    f = S.wall_face_ring(w.withColumns({"nx": n.x, "ny": n.y}))
    return f.select(*PLAN, "wall_id", r6(F.abs(g.ring_area(F.col("polygon")))).alias("area"), r6(g.ring_bounds(F.col("polygon"))["min_x"]).alias("min_x"))


def room_points(spark, sf):
    """Floor and ceiling points near the four walls of every room."""
    rooms = lay(spark, sf, "grid_r")
    at = lambda x, y, nz: F.struct((5 * F.col("i") + x).cast("double").alias("x"), (4 * F.col("j") + y).cast("double").alias("y"), F.lit(nz).alias("nz"))
    pts = F.explode(F.array(*[at(x, y, z) for x, y in ((2.5, 0.3), (2.5, 3.7), (0.3, 2.0), (4.7, 2.0)) for z in (1.0, -1.0)])).alias("p")
    return rooms.select(*PLAN, pts).select(*PLAN, "p.*")


@query("wall_kind", f"SELECT plan_id, level_id, wall_id, kind FROM ({WALLS}) w")
def wall_kind(spark, sf):
    w = wall_segments(spark, sf).drop("kind").withColumn("face", F.col("wall_id"))
    return S.wall_kind(w, room_points(spark, sf).filter("nz > 0"), PLAN).select(*PLAN, "wall_id", "kind")


_SEG = """SELECT concat('G', CAST(c_nationkey AS STRING)) AS plan_id, 'L1' AS level_id, CAST(c_custkey AS STRING) AS seg, CAST(c_custkey % 50 AS DOUBLE) AS x1, CAST(c_custkey % 40 AS DOUBLE) AS y1,
    CAST(c_custkey % 50 AS DOUBLE) + c_custkey % 7 AS x2, CAST(c_custkey % 40 AS DOUBLE) + c_custkey % 5 / CAST(20 AS DOUBLE) + (c_custkey % 2) * (c_custkey % 11) AS y2 FROM {customer}"""
SEG = _SEG.format(customer="customer")
_ANG = "(abs(degrees(atan2(y2 - y1, x2 - x1))) % 90.0)"


@query("off_axis", f"SELECT seg FROM ({SEG}) s WHERE least({_ANG}, 90.0 - {_ANG}) > 8.000001")
def off_axis(spark, sf):
    return S.off_axis(sql(spark, sf, _SEG)).select("seg")


_A1 = "(CASE WHEN a > 90 THEN 180 - a ELSE a END)"


@query("axis_align", f"""SELECT seg, {r(f'CASE WHEN {_A1} > 1 AND abs({_A1} - 90) <= 1 THEN round_even((x1 + x2) / 2.0, 4) ELSE x1 END', 'x1')}, {r(f'CASE WHEN {_A1} <= 1 THEN round_even((y1 + y2) / 2.0, 4) ELSE y2 END', 'y2')}
    FROM (SELECT *, abs(degrees(atan2(y2 - y1, x2 - x1))) % 180.0 AS a FROM ({SEG}) s WHERE sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 0.4) q""")
def axis_align(spark, sf):
    return G.axis_align(sql(spark, sf, _SEG)).select("seg", r6("x1").alias("x1"), r6("y2").alias("y2"))


@query("drop_assumed_islands", f"SELECT plan_id, count(*) AS n FROM ({WALLS}) w WHERE CAST(substring(plan_id, 2) AS INT) % 4 <> 2 GROUP BY 1")
def drop_assumed_islands(spark, sf):
    # Where the plan number leaves 2 all walls are assumed and inner; elsewhere one measured wall saves its whole group.
    k = F.substring("plan_id", 2, 9).cast("int") % 4
    w = wall_segments(spark, sf).withColumnRenamed("wall_id", "seg").withColumns({"kind": F.lit("interior"), "assumed": (k == 2) | (F.col("seg") != "w1")})
    return G.drop_assumed_islands(w, PLAN).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))


@query("snap_ends", f"SELECT plan_id, level_id, wall_id AS seg, x1, y1, x2, y2 FROM ({WALLS}) w")
def snap_ends(spark, sf):
    w = wall_segments(spark, sf)
    d = g.unit(g.sub(g.xy("x2", "y2"), g.xy("x1", "y1")))
    short = w.select(*PLAN, F.col("wall_id").alias("seg"), (F.col("x1") + d.x * 0.03).alias("x1"), (F.col("y1") + d.y * 0.03).alias("y1"), (F.col("x2") - d.x * 0.03).alias("x2"), (F.col("y2") - d.y * 0.03).alias("y2"))
    s, _ = G.snap_ends(short, PLAN)
    return s.select(*PLAN, "seg", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2")])


def long_lines(spark, sf):
    """The lattice as full-length lines."""
    b = lay(spark, sf, "base")
    h = b.select(*PLAN, F.explode(F.sequence(F.lit(0), F.col("ny").cast("int"))).alias("j"), "nx", "ny", "t").select(
        *PLAN, F.concat(F.lit("h"), "j").alias("seg"), F.lit(0.0).alias("x1"), (4.0 * F.col("j")).alias("y1"), (5.0 * F.col("nx")).alias("x2"), (4.0 * F.col("j")).alias("y2"), F.col("t").cast("double").alias("thickness"))
    v = b.select(*PLAN, F.explode(F.sequence(F.lit(0), F.col("nx").cast("int"))).alias("i"), "nx", "ny", "t").select(
        *PLAN, F.concat(F.lit("v"), "i").alias("seg"), (5.0 * F.col("i")).alias("x1"), F.lit(0.0).alias("y1"), (5.0 * F.col("i")).alias("x2"), (4.0 * F.col("ny")).alias("y2"), F.col("t").cast("double").alias("thickness"))
    return settle(h.unionByName(v))


@query("split_segments", f"SELECT plan_id, level_id, {_UND} FROM ({WALLS}) w WHERE y1 = y2")
def split_segments(spark, sf):
    lines = long_lines(spark, sf).filter("seg like 'h%'")
    cuts = lines.select(*PLAN, "seg", F.explode(F.sequence(F.lit(0), (F.col("x2") / 5).cast("int"))).alias("k"), "y1").select(*PLAN, "seg", (5.0 * F.col("k")).alias("x"), F.col("y1").alias("y"))
    return G.split_segments(lines, cuts, PLAN).select(*PLAN, *und())


def lattice_pieces(spark, sf):
    return settle(arr.node_segments(long_lines(spark, sf).drop("thickness"), PLAN))


@query("node_segments", f"SELECT plan_id, level_id, {_UND} FROM ({WALLS}) w")
def node_segments(spark, sf):
    return lattice_pieces(spark, sf).select(*PLAN, *und())


@query("piece_parent", f"SELECT plan_id, level_id, wall_id AS piece, CASE WHEN y1 = y2 THEN concat('h', CAST(CAST(y1 / 4 AS BIGINT) AS STRING)) ELSE concat('v', CAST(CAST(x1 / 5 AS BIGINT) AS STRING)) END AS parent FROM ({WALLS}) w")
def piece_parent(spark, sf):
    pieces = wall_segments(spark, sf).withColumnRenamed("wall_id", "piece")
    return G.piece_parent(pieces, long_lines(spark, sf), PLAN).select(*PLAN, "piece", "parent")


GRID = D["grid_r"]


@query("polygonize", f"SELECT plan_id, level_id, 20.0::DOUBLE AS area, CAST(5 * i AS DOUBLE) AS min_x, CAST(4 * j AS DOUBLE) AS min_y FROM ({GRID}) r")
def polygonize(spark, sf):
    c = arr.polygonize(lattice_pieces(spark, sf), PLAN)
    b = g.ring_bounds(F.col("ring"))
    return c.select(*PLAN, r6("area").alias("area"), r6(b["min_x"]).alias("min_x"), r6(b["min_y"]).alias("min_y"))


@query("polygonize_holes", "SELECT concat('P', CAST(s_suppkey AS STRING)) AS plan_id, a AS area FROM supplier, (VALUES (96.0::DOUBLE), (4.0::DOUBLE)) v(a)")
def polygonize_holes(spark, sf):
    base = lay(spark, sf, "base")
    sides = lambda x0, x1: [(x0, x0, x1, x0), (x1, x0, x1, x1), (x1, x1, x0, x1), (x0, x1, x0, x0)]
    rows = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(s, arr.ENDS)]) for s in sides(0, 10) + sides(4, 6)])).alias("e")
    c = arr.polygonize(settle(base.select(*PLAN, rows).select(*PLAN, "e.*")), PLAN, holes=True)
    return c.select("plan_id", r6("area").alias("area"))


def lattice_cells(spark, sf):
    lab = arr.half_edge_faces(lattice_pieces(spark, sf), PLAN)
    cells = settle(arr.faces(lab, PLAN))
    return lab, cells


@query("cell_evidence", f"SELECT plan_id, level_id, CAST(5 * i AS DOUBLE) AS min_x, CAST(4 * j AS DOUBLE) AS min_y, 0.2::DOUBLE AS floor_score, 0.2::DOUBLE AS ceiling_score, TRUE AS sure FROM ({GRID}) r")
def cell_evidence(spark, sf):
    _, cells = lattice_cells(spark, sf)
    e = G.cell_evidence(cells, room_points(spark, sf), PLAN)
    b = g.ring_bounds(F.col("ring"))
    return e.select(*PLAN, r6(b["min_x"]).alias("min_x"), r6(b["min_y"]).alias("min_y"), r6("floor_score").alias("floor_score"), r6("ceiling_score").alias("ceiling_score"), "sure")


@query("cell_adjacency", f"""SELECT plan_id, level_id, CAST(5 * i AS DOUBLE) AS min_x, CAST(4 * j AS DOUBLE) AS min_y, CAST((CASE WHEN i > 0 THEN 1 ELSE 0 END) + (CASE WHEN i < nx - 1 THEN 1 ELSE 0 END) + (CASE WHEN j > 0 THEN 1 ELSE 0 END) + (CASE WHEN j < ny - 1 THEN 1 ELSE 0 END) AS BIGINT) AS neighbours,
    CAST((CASE WHEN i = 0 THEN 4 ELSE 0 END) + (CASE WHEN i = nx - 1 THEN 4 ELSE 0 END) + (CASE WHEN j = 0 THEN 5 ELSE 0 END) + (CASE WHEN j = ny - 1 THEN 5 ELSE 0 END) AS DOUBLE) AS outer_length FROM ({GRID}) r""")
def cell_adjacency(spark, sf):
    lab, cells = lattice_cells(spark, sf)
    a = G.cell_adjacency(lab, cells, PLAN).groupBy(*PLAN, "cell").agg(F.count("other").alias("neighbours"), F.coalesce(F.sum(F.when(F.col("other").isNull(), F.col("shared"))), F.lit(0.0)).alias("outer_length"))
    b = g.ring_bounds(F.col("ring"))
    return a.join(cells, [*PLAN, "cell"]).select(*PLAN, r6(b["min_x"]).alias("min_x"), r6(b["min_y"]).alias("min_y"), "neighbours", r6("outer_length").alias("outer_length"))


# Only the first cell of each plan is sure. Two rooms stay together (a tie goes
# inside); in longer rows and in blocks the first room is cut off alone.
@query("label_inside", f"SELECT plan_id, level_id, CAST(5 * i AS DOUBLE) AS min_x, CAST(4 * j AS DOUBLE) AS min_y, (i = 0 AND j = 0) OR nx * ny = 2 AS inside FROM ({GRID}) r")
def label_inside(spark, sf):
    lab, cells = lattice_cells(spark, sf)
    b = g.ring_bounds(F.col("ring"))
    cells = settle(cells.withColumn("sure", (b["min_x"] == 0) & (b["min_y"] == 0)))
    out = G.label_inside(cells, G.cell_adjacency(lab, cells, PLAN), PLAN)
    return out.select(*PLAN, r6(b["min_x"]).alias("min_x"), r6(b["min_y"]).alias("min_y"), "inside")


@query("separating", f"SELECT plan_id, level_id, {_UND} FROM ({WALLS}) w WHERE least(x1, x2) < 5 AND greatest(x1, x2) <= 5 AND greatest(y1, y2) <= 4 OR (x1 = 5 AND x2 = 5 AND greatest(y1, y2) <= 4)")
def separating(spark, sf):
    pieces = lattice_pieces(spark, sf)
    lab = arr.half_edge_faces(pieces, PLAN)
    b = g.ring_bounds(F.col("ring"))
    cells = arr.faces(lab, PLAN).withColumn("inside", (b["min_x"] == 0) & (b["min_y"] == 0))
    return G.separating(pieces, lab, settle(cells), PLAN).select(*PLAN, *und())


@query("open_ends", f"SELECT plan_id, level_id, x, CAST(4 * j AS DOUBLE) AS y FROM (SELECT DISTINCT plan_id, level_id, nx, j FROM ({D['grid_v']}) g) q, LATERAL (SELECT 0.0::DOUBLE AS x UNION ALL SELECT CAST(5 * nx AS DOUBLE)) e")
def open_ends(spark, sf):
    w = wall_segments(spark, sf).filter("y1 = y2")
    return G.open_ends(w, PLAN).select(*PLAN, "x", "y")


# Points of line items over the plan of their supplier.
_LI = """SELECT concat('P', CAST(l_suppkey AS STRING)) AS plan_id, 'L1' AS level_id, ((l_partkey * 131 + l_orderkey * 17) % 16000) / CAST(1000 AS DOUBLE) AS x, ((l_partkey * 7919 + l_orderkey * 13) % 9000) / CAST(1000 AS DOUBLE) AS y,
    ((l_orderkey * 31) % 2700) / CAST(1000 AS DOUBLE) AS z, CAST(1 AS DOUBLE) AS nz, l_orderkey, l_linenumber, l_partkey FROM {lineitem}"""
LI = _LI.format(lineitem="lineitem")
line_points = lambda spark, sf: sql(spark, sf, _LI)


@query("points_in_rings", f"SELECT p.plan_id, CAST(5 * i AS DOUBLE) AS min_x, CAST(4 * j AS DOUBLE) AS min_y, count(*) AS n FROM ({LI}) p JOIN ({GRID}) r ON p.plan_id = r.plan_id AND x >= 5 * i AND x < 5 * i + 5 AND y >= 4 * j AND y < 4 * j + 4 GROUP BY 1, 2, 3")
def points_in_rings(spark, sf):
    rooms = lay(spark, sf, "grid_r")
    at = lambda dx, dy: F.struct((5.0 * F.col("i") + dx).alias("x"), (4.0 * F.col("j") + dy).alias("y"))
    rings = rooms.select(*PLAN, "i", "j", F.array(at(0, 0), at(5, 0), at(5, 4), at(0, 4)).alias("ring"))
    return tiles.points_in_rings(line_points(spark, sf), rings, PLAN).groupBy("plan_id", (5.0 * F.col("i")).alias("min_x"), (4.0 * F.col("j")).alias("min_y")).agg(F.count(F.lit(1)).alias("n"))


@query("floor_outside_ratio", f"SELECT p.plan_id, count(*) AS floor_points, {r('1.0 - count_if(x < 5 * nx AND y < 4 * ny) / count(*)', 'outside')}, count(*) >= 50 AND 1.0 - count_if(x < 5 * nx AND y < 4 * ny) / count(*) > 0.15 AS open_gap FROM ({LI}) p JOIN ({D['base']}) b USING (plan_id) GROUP BY 1")
def floor_outside_ratio(spark, sf):
    _, cells = lattice_cells(spark, sf)
    return G.floor_outside_ratio(line_points(spark, sf), cells, PLAN).select("plan_id", "floor_points", r6("outside").alias("outside"), "open_gap")


_LONG = f"""SELECT plan_id, level_id, 0.0::DOUBLE AS xa, CAST(4 * j AS DOUBLE) AS ya, CAST(5 * nx AS DOUBLE) AS xb, CAST(4 * j AS DOUBLE) AS yb FROM (SELECT DISTINCT plan_id, level_id, nx, j FROM ({D['grid_v']}) g) q
    UNION ALL SELECT plan_id, level_id, CAST(5 * i AS DOUBLE), 0.0, CAST(5 * i AS DOUBLE), CAST(4 * ny AS DOUBLE) FROM (SELECT DISTINCT plan_id, level_id, ny, i FROM ({D['grid_v']}) g) q"""


@query("merge_collinear", _LONG)
def merge_collinear(spark, sf):
    w = wall_segments(spark, sf).withColumnRenamed("wall_id", "seg")
    return G.merge_collinear(w, PLAN).select(*PLAN, *und())


@query("dedupe_segments", f"SELECT plan_id, level_id, {_UND} FROM ({WALLS}) w")
def dedupe_segments(spark, sf):
    w = wall_segments(spark, sf).withColumnRenamed("wall_id", "seg")
    flip = w.select(*PLAN, F.concat("seg", F.lit("f")).alias("seg"), F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), "thickness")
    return G.dedupe_segments(w.select(*flip.columns).unionByName(flip), PLAN).select(*PLAN, *und())


@query("to_graph", f"""SELECT w.plan_id, w.level_id, a.vid AS a, b.vid AS b, {r('w.thickness', 'thickness')} FROM ({WALLS}) w JOIN (SELECT plan_id, x, y, concat('v', CAST(row_number() OVER (PARTITION BY plan_id ORDER BY x, y) AS STRING)) AS vid FROM (SELECT plan_id, CAST(5 * i AS DOUBLE) AS x, CAST(4 * j AS DOUBLE) AS y FROM ({D['grid_v']}) g) u) a
    ON a.plan_id = w.plan_id AND a.x = w.x1 AND a.y = w.y1 JOIN (SELECT plan_id, x, y, concat('v', CAST(row_number() OVER (PARTITION BY plan_id ORDER BY x, y) AS STRING)) AS vid FROM (SELECT plan_id, CAST(5 * i AS DOUBLE) AS x, CAST(4 * j AS DOUBLE) AS y FROM ({D['grid_v']}) g) u) b ON b.plan_id = w.plan_id AND b.x = w.x2 AND b.y = w.y2""")
def to_graph(spark, sf):
    _, w = G.to_graph(wall_segments(spark, sf).withColumnRenamed("wall_id", "seg"), PLAN)
    return w.select(*PLAN, "a", "b", r6("thickness").alias("thickness"))


@query("room_seeds", f"SELECT plan_id, level_id, CAST(5 * i + 2.5 AS DOUBLE) AS x, CAST(4 * j + 2 AS DOUBLE) AS y FROM ({GRID}) r")
def room_seeds(spark, sf):
    _, cells = lattice_cells(spark, sf)
    return G.room_seeds(cells, PLAN).select(*PLAN, r6("x").alias("x"), r6("y").alias("y"))


@query("reseat_seeds", f"SELECT plan_id, level_id, concat('r', CAST(j * nx + i + 1 AS STRING)) AS room_id, CAST(5 * i + 2.5 AS DOUBLE) AS x, CAST(4 * j + 2 AS DOUBLE) AS y FROM ({GRID}) r")
def reseat_seeds(spark, sf):
    rooms = lay(spark, sf, "grid_r").withColumn("h", F.col("t").cast("double") / 2.0)
    at = lambda dx, dy, sx, sy: F.struct((5.0 * F.col("i") + dx + sx * F.col("h")).alias("x"), (4.0 * F.col("j") + dy + sy * F.col("h")).alias("y"))
    name = F.concat(F.lit("r"), (F.col("j") * F.col("nx") + F.col("i") + 1).cast("string"))
    faces = rooms.select(*PLAN, name.alias("face"), F.array(at(0, 0, 1, 1), at(5, 0, -1, 1), at(5, 4, -1, -1), at(0, 4, 1, -1)).alias("ring"))
    seeds = rooms.select(*PLAN, name.alias("room_id"), (5.0 * F.col("i") + 0.03).alias("x"), (4.0 * F.col("j") + 2.0).alias("y"), F.lit("Room").alias("name"), F.lit("1").alias("number"))
    return G.reseat_seeds(seeds, faces, PLAN).select(*PLAN, "room_id", r6("x").alias("x"), r6("y").alias("y"))


@query("draft_levels", _LONG)
def draft_levels(spark, sf):
    w = wall_segments(spark, sf).withColumns({"face": F.col("wall_id"), "assumed": F.lit(False)})
    levels = lay(spark, sf, "levels").select(*PLAN, "elevation", "ceiling_height")
    d = G.draft_levels(w, settle(room_points(spark, sf)), levels, PLAN)
    return d.walls.select(*PLAN, *und())


# Links between an order and the customer's previous one within 30 days: components are runs.
_RUNS = """SELECT o_custkey, o_orderkey, sum(b) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS run FROM (
    SELECT *, CASE WHEN date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) <= 90 THEN 0 ELSE 1 END AS b FROM orders) q"""


@query("connected_components", f"SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey, run) AS component FROM ({_RUNS}) r")
def connected_components(spark, sf):
    from pyspark.sql import Window as W

    o = load(spark, sf, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    near = F.datediff("o_orderdate", F.lag("o_orderdate").over(w)) <= 90
    edges = o.select(F.col("o_orderkey").alias("u"), F.when(near, F.lag("o_orderkey").over(w)).alias("v")).filter("v is not null")
    return graph.connected_components(edges, o.select(F.col("o_orderkey").alias("id")))


@query("rank_cycles", "SELECT CAST(o_orderkey AS BIGINT) AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS cycle, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE count(*) OVER (PARTITION BY o_custkey) - row_number() OVER w + 1 END AS behind FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def rank_cycles(spark, sf):
    from pyspark.sql import Window as W

    o = load(spark, sf, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = F.coalesce(F.lead("o_orderkey").over(w), F.first("o_orderkey").over(whole))
    return graph.rank_cycles(o.select(F.col("o_orderkey").alias("id"), nxt.alias("nxt"))).select("id", "cycle", "behind")


# Matrices with one coupled pair of axes, whose least eigenvalue has a short closed form.
_EIG = """SELECT p_partkey AS id, CAST(5 + p_size AS DOUBLE) AS a, CAST(3 + p_partkey % 17 AS DOUBLE) AS b, CAST(1 + p_partkey % 23 AS DOUBLE) AS c, CAST(p_partkey % 7 AS DOUBLE) / CAST(4 AS DOUBLE) AS d FROM {part}"""


@query("smallest_eigen", f"SELECT id, {r('least(c, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + d * d))', 'eig', 5)}, 1.0::DOUBLE AS length FROM ({_EIG.format(part='part')}) m")
def smallest_eigen(spark, sf):
    from levelgrid.functions.eigen import with_smallest_eigen

    zero = F.lit(0.0)
    m = sql(spark, sf, _EIG).withColumns({"cxx": F.col("a"), "cyy": F.col("b"), "czz": F.col("c"), "cxy": F.col("d"), "cxz": zero, "cyz": zero})
    e = with_smallest_eigen(m)
    return e.select("id", clean(F.col("eig"), 5).alias("eig"), clean(F.sqrt(g.sq(F.col("ex")) + g.sq(F.col("ey")) + g.sq(F.col("ez"))), 5).alias("length"))
