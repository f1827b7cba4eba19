"""Spatial lookups on plan tables: pick, snap, box selection, clear distances, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import arrangement as arr
from levelgrid.functions import geometry as g
from levelgrid.functions import tiles
from levelgrid.functions.numbering import nearest
from levelgrid.plans.documents import PLAN, PlanTables
from levelgrid.plans.rooms import wall_lines, wall_polygons
from levelgrid.session import settle

# Lookup order and snap order of the kinds.
RANK = {"vertex": 0, "opening": 1, "column": 2, "fixture": 3, "wall": 4, "separator": 5, "text": 6, "room": 7}
PRIORITY = {"vertex": 1, "midpoint": 2, "intersection": 3, "foot": 4, "extension": 5, "alignment": 6, "angle": 7, "grid": 8}
SNAP_PX = 8.0
EXTENSION = 2.0
GRID = 0.01
ORTHO_COS_DEG = 1.0


def lines_of(t: PlanTables, table: str = "walls") -> DataFrame:
    df = getattr(t, table)
    return wall_lines(t.vertices, df if table == "walls" else df.withColumn("wall_id", F.col("separator_id")))


def opening_ends(t: PlanTables) -> DataFrame:
    """Openings with their end points (ox1..oy2) and centre (cx, cy)."""
    lines = lines_of(t).select(*PLAN, "wall_id", F.col("thickness"), "x1", "y1", "x2", "y2")
    o = t.openings.select(*PLAN, "opening_id", "wall_id", "kind", "offset", "width", "sill", "head").join(lines, [*PLAN, "wall_id"])
    a, b = g.xy("x1", "y1"), g.xy("x2", "y2")
    d = g.unit(g.sub(b, a))
    c = g.lerp(a, b, F.col("offset"))
    o = o.withColumns({"_ux": d.x, "_uy": d.y, "cx": c.x, "cy": c.y})
    half = F.col("width") / 2.0
    ends = {"ox1": F.col("cx") - F.col("_ux") * half, "oy1": F.col("cy") - F.col("_uy") * half, "ox2": F.col("cx") + F.col("_ux") * half, "oy2": F.col("cy") + F.col("_uy") * half}
    return o.withColumns(ends)


def opening_rect(t: PlanTables) -> DataFrame:
    """Openings with `ring`: the wall's full thickness over the opening's width."""
    o = opening_ends(t)
    s, e = g.xy("ox1", "oy1"), g.xy("ox2", "oy2")
    n = g.P(-F.col("_uy") * F.col("thickness") / 2.0, F.col("_ux") * F.col("thickness") / 2.0)
    ring = F.array(*[g.point_struct(p) for p in (g.sub(s, n), g.sub(e, n), g.add(e, n), g.add(s, n))])
    return o.withColumn("ring", ring)


def offset_along_wall(points: DataFrame, width: str = "width") -> DataFrame:
    """Adds `offset` of a point on a wall (x1..y2), kept half a width from the ends."""
    t = g.foot_param(g.xy("x", "y"), g.xy("x1", "y1"), g.xy("x2", "y2"))
    length = g.dist(g.xy("x1", "y1"), g.xy("x2", "y2"))
    half = F.least(F.lit(0.49), F.col(width) / 2.0 / length)
    return points.withColumn("offset", F.when(t.isNull(), 0.5).otherwise(F.least(1.0 - half, F.greatest(half, t))))


def resolve_refs(refs: DataFrame, t: PlanTables) -> DataFrame:
    """Adds the plan point (x, y) of references (type, ref, edge)."""
    v = t.vertices.select(*PLAN, F.col("vertex_id").alias("ref"), F.lit("vertex").alias("type"), F.struct("x", "y").alias("_v"))
    ends = opening_ends(t).select(
        *PLAN, F.col("opening_id").alias("ref"), F.lit("opening").alias("type"),
        F.struct(F.col("ox1").alias("x"), F.col("oy1").alias("y")).alias("_s"), F.struct(F.col("ox2").alias("x"), F.col("oy2").alias("y")).alias("_e"),
    )
    out = refs.join(v, [*PLAN, "type", "ref"], "left").join(ends, [*PLAN, "type", "ref"], "left")
    p = F.coalesce("_v", F.when(F.col("edge") == "start", F.col("_s")).otherwise(F.col("_e")))
    return out.withColumns({"x": p["x"], "y": p["y"]}).drop("_v", "_s", "_e")


def pick_features(t: PlanTables, rooms: DataFrame | None = None) -> DataFrame:
    """Every element as one row: kind, id, segment or point, ring, half thickness, reach."""
    none = F.lit(None).cast(g.RING_TYPE)
    zero = F.lit(0.0)

    def rows(df, kind, id_col, x1, y1, x2, y2, half=zero, box=zero, ring=none):
        return df.select(
            *PLAN, F.lit(kind).alias("kind"), F.col(id_col).alias("item"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
            half.alias("half"), box.alias("box"), ring.alias("ring"),
        )

    col = F.col
    spot = lambda df, kind, id_col, box=zero: rows(df, kind, id_col, col("x"), col("y"), col("x"), col("y"), zero, box)
    lines = lines_of(t)
    parts = [
        spot(t.vertices, "vertex", "vertex_id"),
        rows(lines, "wall", "wall_id", col("x1"), col("y1"), col("x2"), col("y2"), col("thickness") / 2.0),
        rows(opening_ends(t), "opening", "opening_id", col("ox1"), col("oy1"), col("ox2"), col("oy2"), col("thickness") / 2.0),
        spot(t.columns, "column", "column_id", F.greatest("width", "depth") / 2.0),
        spot(t.fixtures, "fixture", "fixture_id", F.greatest("width", "depth") / 2.0),
        spot(t.texts, "text", "text_id", col("height_m")),
        rows(lines_of(t, "separators"), "separator", "separator_id", col("x1"), col("y1"), col("x2"), col("y2")),
    ]
    if rooms is not None:
        b = g.ring_bounds(col("ring"))
        parts.append(rows(rooms, "room", "room_id", b["min_x"], b["min_y"], b["max_x"], b["max_y"], zero, zero, col("ring")))
    return reduce(DataFrame.unionByName, parts)


def lookup(points: DataFrame, features: DataFrame, tolerance: float, size: float = 2.0) -> DataFrame:
    """Features near each point (point_id, x, y), ranked by kind and distance.

    Features go to the tiles of their box; a query point has one tile.
    """
    f = features.withColumn("_k", F.xxhash64("kind", "item"))
    # Only a stroke's own half thickness widens what counts as a hit.
    pad = F.col("half") + tolerance
    lo = lambda c: F.least(f"{c}1", f"{c}2") - pad
    hi = lambda c: F.greatest(f"{c}1", f"{c}2") + pad
    seg = tiles.tile_segment(f.filter("ring is null"), g.xy("x1", "y1"), g.xy("x2", "y2"), pad, size)
    box = tiles.tile_box(f.filter("ring is not null"), lo("x"), lo("y"), hi("x"), hi("y"), size)
    m = tiles.tile_points(points.select(*PLAN, "point_id", "x", "y"), "x", "y", size).join(seg.unionByName(box), [*PLAN, *tiles.TILE])
    p = g.xy("x", "y")
    near = g.distance_to_segment(p, g.xy("x1", "y1"), g.xy("x2", "y2"))
    in_room = F.when(g.point_in_ring(p, F.col("ring")), 0.0).otherwise(g.distance_to_ring(p, F.col("ring")))
    m = m.withColumn("distance", F.when(F.col("ring").isNull(), near).otherwise(in_room)).filter(F.col("distance") <= pad)
    rank = F.element_at(F.create_map(*[x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    order = W.partitionBy(*PLAN, "point_id").orderBy("_r", "distance", "item")
    return m.withColumn("_r", rank).withColumn("rank", F.row_number().over(order)).select(*PLAN, "point_id", "rank", "kind", "item", "distance")


def snap(points: DataFrame, t: PlanTables, pixels_per_meter: float, grid: float = GRID) -> DataFrame:
    """Best snap of each cursor (point_id, x, y and optionally px, py, dir_x, dir_y).

    Every kind of candidate is one bounded join; the least (priority, distance)
    wins by one aggregate.
    """
    tol = SNAP_PX / pixels_per_meter
    cur = settle(points.withColumn("id", F.struct(*PLAN, "point_id")))
    v = t.vertices
    p = g.xy("x", "y")

    def take(df, kind, q: g.P, item, distance=None):
        d = g.dist(p, q) if distance is None else distance
        return df.withColumn("_d", d).filter(F.col("_d") <= tol).select(
            *PLAN, "point_id", F.lit(PRIORITY[kind]).alias("priority"), "_d", F.lit(kind).alias("kind"), q.x.alias("sx"), q.y.alias("sy"), item.alias("item")
        )

    lines = settle(lines_of(t).select(*PLAN, "wall_id", "x1", "y1", "x2", "y2"))
    mids = lines.select(*PLAN, F.col("wall_id").alias("item"), ((F.col("x1") + F.col("x2")) / 2.0).alias("qx"), ((F.col("y1") + F.col("y2")) / 2.0).alias("qy"))
    crosses = arr.crossings(lines.withColumn("seg", F.col("wall_id")), PLAN).select(*PLAN, F.col("seg").alias("item"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    crosses = crosses.groupBy(*PLAN, "qx", "qy").agg(F.min("item").alias("item"))
    spots = v.select(*PLAN, F.col("vertex_id").alias("item"), F.col("x").alias("qx"), F.col("y").alias("qy"))

    def near_points(df, kind):
        size = max(tol, 1e-6)
        cells = df.withColumn("_tx", F.explode(F.sequence(tiles.cell("qx", size) - 1, tiles.cell("qx", size) + 1)))
        cells = cells.withColumn("_ty", F.explode(F.sequence(tiles.cell("qy", size) - 1, tiles.cell("qy", size) + 1)))
        m = tiles.tile_points(cur, "x", "y", size).join(cells, [*PLAN, *tiles.TILE])
        return take(m, kind, g.xy("qx", "qy"), F.col("item"))

    a, b = g.xy("x1", "y1"), g.xy("x2", "y2")
    # Walls with the stretch of two metres past each end, where an extension may be met.
    d = g.unit(g.sub(b, a))
    long = lines.withColumns({"ex1": F.col("x1") - d.x * EXTENSION, "ey1": F.col("y1") - d.y * EXTENSION, "ex2": F.col("x2") + d.x * EXTENSION, "ey2": F.col("y2") + d.y * EXTENSION})
    tiled = tiles.tile_segment(long, g.xy("ex1", "ey1"), g.xy("ex2", "ey2"), tol, 1.0)
    m = tiles.tile_points(cur, "x", "y", 1.0).join(tiled, [*PLAN, *tiles.TILE]).withColumn("_t", g.foot_param(p, a, b)).filter("_t is not null")
    foot = g.lerp(a, b, F.col("_t"))
    length = g.dist(a, b)
    past = F.when(F.col("_t") < 0, -F.col("_t") * length).otherwise((F.col("_t") - 1) * length)
    feet = take(m.filter("_t > 0 and _t < 1"), "foot", foot, F.col("wall_id"))
    ext = take(m.filter("_t <= 0 or _t >= 1").filter((past > 0) & (past <= EXTENSION)), "extension", foot, F.col("wall_id"))

    def guide(axis):
        hit = nearest(cur, v, PLAN, axis, axis, "vertex_id", "id").filter(F.col("gap") <= tol)
        return hit.select("id", F.struct(F.col("gap").alias("_g"), "item", F.col("value").alias("q")).alias(f"_{axis}"))

    al = cur.join(guide("x"), "id", "left").join(guide("y"), "id", "left").filter("_x is not null or _y is not null")
    aq = g.P(F.coalesce(F.col("_x.q"), F.col("x")), F.coalesce(F.col("_y.q"), F.col("y")))
    align = al.select(
        *PLAN, "point_id", F.lit(PRIORITY["alignment"]).alias("priority"), g.dist(p, aq).alias("_d"), F.lit("alignment").alias("kind"), aq.x.alias("sx"), aq.y.alias("sy"),
        F.coalesce(F.col("_x.item"), F.col("_y.item")).alias("item"),
    )
    none = F.lit(None).cast("string")
    parts = [near_points(spots, "vertex"), near_points(mids, "midpoint"), near_points(crosses, "intersection"), feet, ext, align]
    if "dir_x" in points.columns:
        turned = cur.filter("dir_x is not null and (dir_x <> 0 or dir_y <> 0)").withColumn("_deg", F.explode(F.array(*[F.lit(x) for x in (0.0, 45.0, -45.0, 90.0, -90.0)])))
        ray = g.rotate(g.unit(g.xy("dir_x", "dir_y")), F.col("_deg"))
        anchor = g.xy("px", "py")
        travel = g.dot(g.sub(p, anchor), ray)
        parts.append(take(turned.filter(travel >= 0), "angle", g.add(anchor, g.mul(ray, travel)), none))
    if grid > 0:
        parts.append(take(cur, "grid", g.P(g.js_round(F.col("x") / grid) * grid, g.js_round(F.col("y") / grid) * grid), none))
    best = reduce(DataFrame.unionByName, parts).groupBy(*PLAN, "point_id").agg(
        F.min_by(F.struct("kind", "sx", "sy", "item", F.col("_d").alias("distance")), F.struct("priority", "_d", "item")).alias("b")
    )
    return best.select(*PLAN, "point_id", "b.kind", F.col("b.sx").alias("x"), F.col("b.sy").alias("y"), "b.item", "b.distance")


def selection_shapes(t: PlanTables, rooms: DataFrame | None = None) -> DataFrame:
    """(plan, kind, item, ring, closed): the outline of every selectable element."""
    from levelgrid.operators.openings import column_ring

    one = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    rows = lambda df, kind, id_col, ring, closed=True: df.select(*PLAN, F.lit(kind).alias("kind"), F.col(id_col).alias("item"), ring.alias("ring"), F.lit(closed).alias("closed"))
    fix = g.rotated_box(g.xy("x", "y"), F.col("width"), F.col("depth"), F.col("rotation_deg"))
    parts = [
        rows(t.vertices, "vertex", "vertex_id", one("x", "y"), False),
        rows(wall_polygons(t.vertices, t.walls), "wall", "wall_id", F.col("ring")),
        rows(opening_rect(t), "opening", "opening_id", F.col("ring")),
        rows(column_ring(t.columns), "column", "column_id", F.col("ring")),
        rows(t.fixtures, "fixture", "fixture_id", fix),
        rows(lines_of(t, "separators"), "separator", "separator_id", F.concat(one("x1", "y1"), one("x2", "y2")), False),
        rows(t.texts, "text", "text_id", one("x", "y"), False),
        rows(t.stairs, "stair", "stair_id", F.col("outline")),
    ]
    if rooms is not None:
        parts.append(rows(rooms, "room", "room_id", F.col("ring")))
    return reduce(DataFrame.unionByName, parts)


def items_in_box(boxes: DataFrame, shapes: DataFrame, size: float = 8.0) -> DataFrame:
    """Shapes inside (window) or touching (crossing) boxes (box_id, mode, min_x..max_y)."""
    bt = tiles.tile_box(boxes, F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), size)
    bb = g.ring_bounds(F.col("ring"))
    st = tiles.tile_box(shapes.filter(F.size("ring") > 0), bb["min_x"], bb["min_y"], bb["max_x"], bb["max_y"], size)
    m = st.join(bt, [*PLAN, *tiles.TILE])
    x0, y0, x1, y1 = (F.col(c) for c in ("min_x", "min_y", "max_x", "max_y"))
    inside = lambda p: (p["x"] >= x0) & (p["x"] <= x1) & (p["y"] >= y0) & (p["y"] <= y1)
    whole = F.forall("ring", inside)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]

    def orient(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    def crosses(e, c, d):
        ax, ay, bx, by = e["x1"], e["y1"], e["x2"], e["y2"]
        o1, o2 = orient(ax, ay, bx, by, *c), orient(ax, ay, bx, by, *d)
        o3, o4 = orient(*c, *d, ax, ay), orient(*c, *d, bx, by)
        box = (F.least(ax, bx) <= F.greatest(c[0], d[0])) & (F.least(c[0], d[0]) <= F.greatest(ax, bx)) & (F.least(ay, by) <= F.greatest(c[1], d[1])) & (F.least(c[1], d[1]) <= F.greatest(ay, by))
        return (o1 * o2 <= 0) & (o3 * o4 <= 0) & box

    edge = lambda e: reduce(lambda a, b: a | b, [crosses(e, corners[i], corners[(i + 1) % 4]) for i in range(4)])
    edges = g.ring_edges(F.col("ring"))
    edges = F.when(F.col("closed"), edges).otherwise(F.slice(edges, F.lit(1), F.greatest(F.size(edges) - 1, F.lit(0))))
    around = reduce(lambda a, b: a | b, [g.point_in_ring(g.P(*c), F.col("ring")) for c in corners])
    touch = F.exists("ring", inside) | F.exists(edges, edge) | (F.col("closed") & around)
    hit = F.when(F.col("mode") == "window", whole).otherwise(touch)
    return m.filter(hit).select(*PLAN, "box_id", "kind", "item").distinct()


def _frames(t: PlanTables) -> DataFrame:
    d = g.sub(g.xy("x2", "y2"), g.xy("x1", "y1"))
    lines = lines_of(t).withColumn("length", g.norm(d)).filter("length > 0")
    return lines.select(*PLAN, "wall_id", "thickness", "x1", "y1", "x2", "y2", "length", (d.x / F.col("length")).alias("dx"), (d.y / F.col("length")).alias("dy"))


def _measured(pairs: DataFrame) -> DataFrame:
    """Clear distance and side of pairs of wall frames (suffixes _l and _r)."""
    c = lambda n: F.col(n)
    lean = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(c("dx_l") * c("dx_r") + c("dy_l") * c("dy_r")))))
    d = (c("x1_r") - c("x1_l")) * -c("dy_l") + (c("y1_r") - c("y1_l")) * c("dx_l")
    out = pairs.withColumns({"_lean": lean, "_d": d}).filter(F.col("_lean") <= ORTHO_COS_DEG)
    return out.withColumns({"clear": F.abs("_d") - c("thickness_l") / 2.0 - c("thickness_r") / 2.0, "side": F.signum("_d")}).drop("_lean", "_d")


def _sides(frames: DataFrame, tag: str) -> DataFrame:
    return frames.select(*PLAN, *[F.col(c).alias(f"{c}_{tag}") for c in frames.columns if c not in PLAN])


def clear_distance(pairs: DataFrame, t: PlanTables) -> DataFrame:
    """Clear distance and side of named pairs (wall_id, other_id); pairs not parallel give no row."""
    fr = settle(_frames(t))
    m = pairs.join(_sides(fr, "l").withColumnRenamed("wall_id_l", "wall_id"), [*PLAN, "wall_id"]).join(_sides(fr, "r").withColumnRenamed("wall_id_r", "other_id"), [*PLAN, "other_id"])
    return _measured(m).select(*PLAN, "wall_id", "other_id", "clear", "side")


def parallel_neighbors(t: PlanTables, strip: float = 1.0) -> DataFrame:
    """Nearest parallel wall on each side of every wall whose span overlaps it.

    Walls are cut into strips of their axis, at the angle class of the wall:
    only walls of one class that share a strip of one storey meet. All walls
    of a strip are measured against each other, so the work of a strip grows
    with the square of the walls along it.
    """
    fr = _frames(t)
    turn = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    # Classes two degrees wide; a wall joins its own class and both neighbours look at it.
    fr = settle(fr.withColumn("_c", F.floor(turn / 2.0)))
    facing = F.radians(F.col("_c") * 2.0 + 1.0)
    s1 = F.col("x1") * F.cos(facing) + F.col("y1") * F.sin(facing)
    s2 = F.col("x2") * F.cos(facing) + F.col("y2") * F.sin(facing)
    mine = fr.withColumn("_s", F.explode(F.sequence(F.floor(F.least(s1, s2) / strip), F.floor(F.greatest(s1, s2) / strip))))
    others = fr.withColumn("_c", F.explode(F.array(*[F.pmod(F.col("_c") + k, F.lit(90)) for k in (-1, 0, 1)])))
    others = others.withColumn("_s", F.explode(F.sequence(F.floor(F.least(s1, s2) / strip), F.floor(F.greatest(s1, s2) / strip))))
    keep = ["wall_id", "thickness", "x1", "y1", "x2", "y2", "length", "dx", "dy"]
    left = mine.select(*PLAN, "_c", "_s", *[F.col(c).alias(f"{c}_l") for c in keep])
    right = others.select(*PLAN, "_c", "_s", *[F.col(c).alias(f"{c}_r") for c in keep])
    m = _measured(left.join(right, [*PLAN, "_c", "_s"]).filter("wall_id_l <> wall_id_r"))
    u = lambda e: (F.col(f"x{e}_r") - F.col("x1_l")) * F.col("dx_l") + (F.col(f"y{e}_r") - F.col("y1_l")) * F.col("dy_l")
    m = m.filter((F.col("side") != 0) & (F.col("clear") > 0) & (F.greatest(u(1), u(2)) > 0) & (F.least(u(1), u(2)) < F.col("length_l")))
    best = m.groupBy(*PLAN, F.col("wall_id_l").alias("wall_id"), F.when(F.col("side") > 0, "left").otherwise("right").alias("side")).agg(
        F.min(F.struct(F.round("clear", 9).alias("r"), F.col("wall_id_r").alias("w"), F.col("clear").alias("c"))).alias("b")
    )
    return best.select(*PLAN, "wall_id", "side", F.col("b.w").alias("other_id"), F.col("b.c").alias("clear"))


def outside_items(items: DataFrame, rooms: DataFrame, slack: float = 0.05) -> DataFrame:
    """Items (x, y, width, depth, rotation_deg, symbol) with a corner more than 0.05 m outside
    the storey's room ring, with a message each."""
    box = g.rotated_box(g.xy("x", "y"), F.col("width"), F.col("depth"), F.col("rotation_deg"))
    corners = items.withColumn("_ring", box).withColumn("_c", F.explode("_ring"))
    named = corners.join(rooms.select(*PLAN, F.col("ring").alias("_room")), PLAN)
    p = g.pt("_c")
    ok = g.point_in_ring(p, F.col("_room")) | (g.distance_to_ring(p, F.col("_room")) <= slack)
    verdict = named.groupBy(*PLAN, "fixture_id", "symbol", "x", "y", "width", "depth").agg(F.bool_and(ok).alias("_ok")).filter("not _ok")
    text = F.format_string("The %s at x=%.2f m, y=%.2f m, %.2f m by %.2f m, is outside the room.", "symbol", "x", "y", "width", "depth")
    return verdict.select(*PLAN, "fixture_id", text.alias("message"))
