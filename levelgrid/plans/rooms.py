"""Wall polygons, free faces and net rooms of plan storeys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import arrangement as arr
from levelgrid.functions import geometry as g
from levelgrid.functions import tiles
from levelgrid.functions.graph import connected_components
from levelgrid.functions.numbering import number_rows
from levelgrid.session import settle

# Editor tolerances in metres and square metres.
JOIN = 0.05
MITER = 3.0
MIN_ROOM = 0.5
SEED_REACH = 0.3

PLAN = ["plan_id", "level_id"]


def wall_lines(vertices: DataFrame, walls: DataFrame, keys=PLAN) -> DataFrame:
    """Walls with the coordinates of both ends."""
    keys = list(keys)
    at = lambda name, x, y: vertices.select(*keys, F.col("vertex_id").alias(name), F.col("x").alias(x), F.col("y").alias(y))
    plain = walls.drop("x1", "y1", "x2", "y2")
    return plain.join(at("a", "x1", "y1"), [*keys, "a"]).join(at("b", "x2", "y2"), [*keys, "b"])


def wall_ends(lines: DataFrame, keys=PLAN) -> DataFrame:
    keys = list(keys)
    ends = F.explode(
        F.array(
            F.struct(F.lit("a").alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")),
            F.struct(F.lit("b").alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")),
        )
    )
    return lines.select(*keys, "wall_id", "thickness", ends.alias("_e")).select(*keys, "wall_id", "thickness", "_e.*")


def joints(lines: DataFrame, keys=PLAN) -> DataFrame:
    """Every wall end with its joint: mean point, number of ends, and host of a T-butt.

    Ends of different walls within 0.05 m are one joint (closed transitively).
    A lone end within 0.05 m of the inside of another wall butts against it.
    """
    keys = list(keys)
    ends = settle(wall_ends(lines, keys).withColumn("id", F.struct(*keys, "wall_id", "end")))
    pairs = tiles.eps_pairs(ends, keys, ["x", "y"], JOIN).filter("u.wall_id <> v.wall_id")
    label = connected_components(pairs.select("u", "v"), ends.select("id")).withColumnRenamed("component", "joint")
    named = settle(ends.join(label, "id"))
    middle = named.groupBy("joint").agg(F.count(F.lit(1)).alias("ends"), F.avg("x").alias("jx"), F.avg("y").alias("jy"))
    named = settle(named.join(middle, "joint"))
    lone = named.filter("ends = 1").select(*keys, "id", "wall_id", "x", "y")
    hosts = lines.select(*keys, F.col("wall_id").alias("host"), "x1", "y1", "x2", "y2")
    p, a, b = g.xy("x", "y"), g.xy("x1", "y1"), g.xy("x2", "y2")
    t = g.foot_param(p, a, b)
    foot = g.lerp(a, b, t)
    ok = (F.col("host") != F.col("wall_id")) & (t > 0) & (t < 1) & (g.dist(p, foot) <= JOIN) & (g.dist(foot, a) > JOIN) & (g.dist(foot, b) > JOIN)
    butts = tiles.near_segments(lone, hosts, keys, JOIN, ok)
    butts = butts.withColumns({"_gap": g.dist(p, foot), "_fx": foot.x, "_fy": foot.y})
    best = butts.groupBy("id").agg(F.min_by(F.struct("host", F.col("_fx").alias("fx"), F.col("_fy").alias("fy")), F.struct("_gap", "host")).alias("_h"))
    out = named.join(best, "id", "left")
    return out.select(
        *keys, "wall_id", "end", "thickness", "joint", "ends", F.col("_h.host").alias("host"),
        F.coalesce(F.col("_h.fx"), F.col("jx")).alias("gx"), F.coalesce(F.col("_h.fy"), F.col("jy")).alias("gy"),
    )


def wall_polygons(vertices: DataFrame, walls: DataFrame, keys=PLAN) -> DataFrame:
    """(keys, wall_id, ring): mitred at joints, bevelled past the limit, butted at T-junctions."""
    keys = list(keys)
    lines = settle(wall_lines(vertices, walls, keys))
    js = settle(joints(lines, keys))
    here = js.select(*keys, "wall_id", "end", "thickness", "joint", "ends", "host", "gx", "gy")
    far = js.select(*keys, "wall_id", F.when(F.col("end") == "a", "b").otherwise("a").alias("end"), F.col("gx").alias("ox"), F.col("gy").alias("oy"))
    e = here.join(far, [*keys, "wall_id", "end"])
    d = g.unit(g.sub(g.xy("ox", "oy"), g.xy("gx", "gy")))
    e = e.withColumns({"dx": d.x, "dy": d.y}).filter("dx <> 0 or dy <> 0")
    e = settle(e.withColumn("angle", F.atan2("dy", "dx")))
    many = e.filter("ends >= 2 and host is null")
    # Each joint is walked once around: the next edge in turning order, wrapping.
    w = W.partitionBy("joint").orderBy("angle", "wall_id", "end")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = F.struct("wall_id", "end", "thickness", "dx", "dy")
    ring = many.withColumns({"_n": F.coalesce(F.lead(nxt).over(w), F.first(nxt).over(whole)), "_k": F.count(F.lit(1)).over(whole)}).filter("_k >= 2")
    joint, d1, d2 = g.xy("gx", "gy"), g.xy("dx", "dy"), g.P(F.col("_n.dx"), F.col("_n.dy"))
    p1 = g.add(joint, g.mul(g.left(d1), F.col("thickness") / 2.0))
    p2 = g.add(joint, g.mul(g.right(d2), F.col("_n.thickness") / 2.0))
    # Staged columns: each corner is worked out once.
    ring = ring.withColumns({"p1x": p1.x, "p1y": p1.y, "p2x": p2.x, "p2y": p2.y})
    p1, p2 = g.xy("p1x", "p1y"), g.xy("p2x", "p2y")
    ring = ring.withColumn("_t", g.line_param(p1, d1, p2, d2))
    hit = g.add(p1, g.mul(d1, F.col("_t")))
    ring = ring.withColumns({"hx": hit.x, "hy": hit.y})
    hit = g.xy("hx", "hy")
    limit = MITER * F.least(F.col("thickness"), F.col("_n.thickness"))
    ring = ring.withColumn("_miter", F.coalesce(g.dist(hit, joint) <= limit, F.lit(False)))
    miter = F.col("_miter")
    corner = lambda wall, end, side, p: F.struct(
        wall.alias("wall_id"), end.alias("end"), side.alias("side"),
        F.when(miter, hit.x).otherwise(p.x).alias("x"), F.when(miter, hit.y).otherwise(p.y).alias("y"),
    )
    # Seen from the wall (a to b), the left of an edge leaving b is the wall's right.
    flip = lambda end, at_a, at_b: F.when(end == "a", at_a).otherwise(at_b)
    both = F.array(
        corner(F.col("wall_id"), F.col("end"), flip(F.col("end"), "left", "right"), p1),
        corner(F.col("_n.wall_id"), F.col("_n.end"), flip(F.col("_n.end"), "right", "left"), p2),
    )
    found = ring.select(*keys, F.explode(both).alias("c")).select(*keys, "c.*")
    pick = lambda end, side: F.max(F.when((F.col("end") == end) & (F.col("side") == side), F.struct("x", "y"))).alias(f"{end}_{side}")
    found = found.groupBy(*keys, "wall_id").agg(*[pick(x, s) for x in "ab" for s in ("left", "right")])
    at = lambda x: js.filter(F.col("end") == x).select(
        *keys, "wall_id", F.col("gx").alias(f"{x}x"), F.col("gy").alias(f"{x}y"), ((F.col("ends") >= 3) & F.col("host").isNull()).alias(f"{x}hub")
    )
    body = lines.select(*keys, "wall_id", "thickness").join(at("a"), [*keys, "wall_id"]).join(at("b"), [*keys, "wall_id"]).join(found, [*keys, "wall_id"], "left")
    a, b = g.xy("ax", "ay"), g.xy("bx", "by")
    dirn = g.unit(g.sub(b, a))
    body = settle(body.withColumns({"_ux": dirn.x, "_uy": dirn.y}))
    dirn = g.xy("_ux", "_uy")
    half = F.col("thickness") / 2.0

    def cap(end, side):
        origin = a if end == "a" else b
        p = g.add(origin, g.mul(g.left(dirn), half * (1.0 if side == "left" else -1.0)))
        return F.array(F.coalesce(F.col(f"{end}_{side}"), g.point_struct(p)))

    none = F.array().cast(g.RING_TYPE)
    hub = lambda end, p: F.when(F.col(f"{end}hub"), F.array(g.point_struct(p))).otherwise(none)
    raw = F.concat(cap("a", "right"), cap("b", "right"), hub("b", b), cap("b", "left"), cap("a", "left"), hub("a", a))
    out = body.filter((dirn.x != 0) | (dirn.y != 0)).select(*keys, "wall_id", g.dedupe_ring(raw).alias("ring"))
    out = settle(out.filter(F.size("ring") >= 3))
    # T-butts end at the host's near face: a half-plane clip on the butt's own side.
    butt = js.filter("host is not null").join(
        lines.select(*keys, F.col("wall_id").alias("host"), "x1", "y1", "x2", "y2", F.col("thickness").alias("ht")), [*keys, "host"]
    ).join(far, [*keys, "wall_id", "end"])
    ha, hb = g.xy("x1", "y1"), g.xy("x2", "y2")
    side = g.left(g.unit(g.sub(hb, ha)))
    sign = F.when(g.dot(g.sub(g.xy("ox", "oy"), ha), side) >= 0, 1.0).otherwise(F.lit(-1.0))
    n = g.mul(side, sign)
    o = g.add(g.xy("gx", "gy"), g.mul(n, F.col("ht") / 2.0))
    plane = F.struct(o.x.alias("ox"), o.y.alias("oy"), n.x.alias("nx"), n.y.alias("ny"))
    butt = butt.withColumn("_plane", plane)
    plane = F.col("_plane")
    cuts = butt.groupBy(*keys, "wall_id").agg(F.array_sort(F.collect_list(plane)).alias("_cuts"))
    out = out.join(cuts, [*keys, "wall_id"], "left")
    cut = F.aggregate(
        F.col("_cuts"), F.col("ring"),
        lambda r, c: g.clip_half_plane(r, g.P(c["ox"], c["oy"]), g.P(c["nx"], c["ny"])),
    )
    clipped = F.when(F.col("_cuts").isNull(), F.col("ring")).otherwise(g.dedupe_ring(cut))
    ring = F.when(F.size(clipped) >= 3, clipped).otherwise(F.col("ring"))
    return out.select(*keys, "wall_id", ring.alias("ring"))


def max_join_spike(vertices: DataFrame, walls: DataFrame, polygons: DataFrame, keys=PLAN) -> DataFrame:
    """Farthest ring point from the joint it is nearer to, per storey."""
    keys = list(keys)
    lines = wall_lines(vertices, walls, keys)
    js = joints(lines, keys).select(*keys, "wall_id", "end", "joint")
    spots = wall_ends(lines, keys).select(*keys, "wall_id", "end", F.col("x").alias("px"), F.col("y").alias("py"))
    js = js.join(spots, [*keys, "wall_id", "end"])
    middle = js.groupBy("joint").agg(F.avg("px").alias("jx"), F.avg("py").alias("jy"))
    js = js.join(middle, "joint")
    far = spots.select(*keys, "wall_id", F.when(F.col("end") == "a", "b").otherwise("a").alias("end"), F.col("px").alias("ox"), F.col("py").alias("oy"))
    pts = polygons.select(*keys, "wall_id", F.explode("ring").alias("p"))
    near = g.dist(g.pt("p"), g.xy("jx", "jy"))
    rows = js.join(far, [*keys, "wall_id", "end"]).join(pts, [*keys, "wall_id"]).filter(near <= g.dist(g.pt("p"), g.xy("ox", "oy")))
    return rows.groupBy(*keys).agg(F.max(near).alias("spike"))


def ring_segments(rings: DataFrame, keys: list[str], id: str, tag: str) -> DataFrame:
    """Ring edges as segments (keys, seg, x1..y2)."""
    e = rings.select(*keys, F.col(id).alias("_i"), F.posexplode(g.ring_edges(F.col("ring"))).alias("_n", "_e"))
    return e.select(*keys, F.concat_ws(":", F.lit(tag), "_i", F.col("_n").cast("string")).alias("seg"), "_e.x1", "_e.y1", "_e.x2", "_e.y2")


def free_faces(polygons: DataFrame, separators: DataFrame | None = None, keys=PLAN, min_area: float = 1e-4) -> DataFrame:
    """(keys, face, ring, area): bounded faces of the wall arrangement in no wall.

    Without separators these are the hole rings of the wall union; what lies
    inside a hole without touching it is not subtracted. Separators
    (separator_id, x1..y2) cut the faces they cross from side to side.
    """
    keys = list(keys)
    polygons = settle(polygons)
    segs = ring_segments(polygons, keys, "wall_id", "w")
    if separators is not None:
        segs = segs.unionByName(separators.select(*keys, F.concat(F.lit("s:"), "separator_id").alias("seg"), "x1", "y1", "x2", "y2"))
    cells = settle(arr.polygonize(arr.node_segments(segs, keys), keys, min_area=min_area))
    # Written first: the join asks for tiles that are not null, and that test would repeat the steps of a point in each other.
    probes = settle(g.with_interior_point(cells).select(*keys, "cell", "x", "y"))
    solid = tiles.points_in_rings(probes, polygons.select(*keys, "ring"), keys).select(*keys, "cell").distinct()
    free = cells.join(solid, [*keys, "cell"], "left_anti")
    return number_rows(free, keys, ["cell"], "face").select(*keys, "face", "ring", "area")


def cut_faces(vertices, walls, separators, keys=PLAN) -> DataFrame:
    """Free faces with the storeys' separators (separator_id, a, b) taken as cuts."""
    keys = list(keys)
    lines = wall_lines(vertices, separators.withColumn("wall_id", F.col("separator_id")), keys)
    return free_faces(wall_polygons(vertices, walls, keys), lines, keys)


def _seat(best: DataFrame) -> DataFrame:
    """Adds _sx, _sy: the seed, or the nearest boundary point moved a little towards the middle."""
    ring, seed = F.col("m.ring"), g.P(F.col("m.x"), F.col("m.y"))
    edge, middle = g.closest_on_ring(seed, ring), g.ring_centroid(ring)
    out = best.withColumns({"_ex": edge.x, "_ey": edge.y, "_mx": middle.x, "_my": middle.y, "_in": g.point_in_ring(seed, ring)})
    edge, middle = g.xy("_ex", "_ey"), g.xy("_mx", "_my")
    toward = g.sub(middle, edge)
    length = g.norm(toward)
    moved = g.add(edge, g.mul(g.unit(toward), F.least(length * 0.5, F.lit(JOIN))))
    out = out.withColumns({"_vx": moved.x, "_vy": moved.y, "_min": g.point_in_ring(middle, ring), "_far": length > 0})
    moved = g.xy("_vx", "_vy")
    out = out.withColumn("_use", F.col("_far") & (g.point_in_ring(moved, ring) | ~F.col("_min")))
    pick = lambda a, m, c, e: F.when(F.col("_in"), a).when(F.col("_use"), m).when(F.col("_min"), c).otherwise(e)
    return out.withColumns({"_sx": pick(seed.x, moved.x, middle.x, edge.x), "_sy": pick(seed.y, moved.y, middle.y, edge.y)})


def match_rooms(faces: DataFrame, seeds: DataFrame, keys=PLAN) -> tuple[DataFrame, DataFrame]:
    """(rooms, issues) from free faces and room seeds (room_id, name, number, x, y)."""
    keys = list(keys)
    faces = settle(faces.filter(F.col("area") >= MIN_ROOM))
    box = g.ring_bounds(F.col("ring"))
    tiled = tiles.tile_box(
        faces.select(*keys, "face", "ring", "area"),
        box["min_x"] - SEED_REACH, box["min_y"] - SEED_REACH, box["max_x"] + SEED_REACH, box["max_y"] + SEED_REACH, 4.0,
    )
    near = tiles.tile_points(seeds.select(*keys, "room_id", "name", "number", "x", "y"), "x", "y", 4.0).join(tiled, [*keys, *tiles.TILE]).drop(*tiles.TILE)
    p = g.xy("x", "y")
    near = near.withColumn("_in", g.point_in_ring(p, F.col("ring")))
    near = near.withColumn("_gap", F.when(F.col("_in"), 0.0).otherwise(g.distance_to_ring(p, F.col("ring"))))
    near = near.filter(F.col("_in") | (F.col("_gap") <= SEED_REACH))
    best = near.groupBy(*keys, "room_id").agg(
        F.min_by(F.struct("face", "ring", "area", "name", "number", "x", "y"), F.struct((~F.col("_in")).alias("o"), F.col("_gap").alias("g"), F.col("face").alias("f"))).alias("m")
    )
    best = _seat(best)
    spot = g.xy("_sx", "_sy")
    rooms = settle(
        best.select(
            *keys, "room_id", "m.name", "m.number", F.col("m.face").alias("face"), spot.x.alias("x"), spot.y.alias("y"),
            F.col("m.ring").alias("ring"), F.col("m.area").alias("area"),
        )
    )
    lost = seeds.join(rooms.select(*keys, "room_id"), [*keys, "room_id"], "left_anti")
    shared = rooms.groupBy(*keys, "face").agg(F.count(F.lit(1)).alias("_n"), F.min("room_id").alias("room_id")).filter("_n > 1")
    # An id has at most 32 characters; a longer one ends in a digest of the whole, so that long room ids stay apart.
    full = lambda code: F.concat(F.lit(f"i-{code}-"), "room_id")
    short = lambda name: F.when(F.length(name) <= 32, name).otherwise(F.concat(F.substring(name, 1, 15), F.lit("-"), F.substring(F.sha2(name, 256), 1, 16)))
    issue = lambda df, code, message: df.select(
        *keys, F.col("room_id").alias("element_id"), short(full(code)).alias("issue_id"),
        F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"),
    )
    issues = issue(lost, "room_seed_lost", "The room seed is not inside a free face.").unionByName(
        issue(shared, "room_not_split", "Two room seeds are in the same face.")
    )
    return rooms, issues


def rooms(vertices, walls, seeds, separators=None, keys=PLAN) -> tuple[DataFrame, DataFrame]:
    """Net rooms and issues of every storey."""
    keys = list(keys)
    polygons = wall_polygons(vertices, walls, keys)
    lines = None
    if separators is not None:
        lines = wall_lines(vertices, separators.withColumn("wall_id", F.col("separator_id")), keys)
    return match_rooms(free_faces(polygons, lines, keys), seeds, keys)


def room_bounds(faces: DataFrame, storeys: DataFrame, scan_box: DataFrame | None = None, keys=PLAN) -> DataFrame:
    """Largest free face of every storey with its width, depth and area.

    A storey without one takes the rectangle of its scan (min_x..max_y in
    `scan_box`, walls 0.30 m thick, confidence 0.4), else an error row.
    """
    keys = list(keys)
    best = faces.groupBy(*keys).agg(F.max_by(F.struct("ring", "area"), F.struct("area", -F.col("face"))).alias("_b"))
    out = storeys.select(*keys).join(best, keys, "left")
    box = g.ring_bounds(F.col("_b.ring"))
    cols = {k: v for k, v in box.items()}
    out = out.withColumns({**cols, "area": F.col("_b.area"), "source": F.when(F.col("_b").isNotNull(), "plan")})
    if scan_box is not None:
        names = ["min_x", "min_y", "max_x", "max_y"]
        side = scan_box.select(*keys, *[F.col(c).alias(f"_{c}") for c in names])
        out = out.join(side, keys, "left").withColumn("source", F.coalesce("source", F.when(F.col("_min_x").isNotNull(), "scan")))
        out = out.withColumns({c: F.coalesce(c, f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])
        out = out.withColumn("area", F.coalesce("area", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))))
    return out.select(
        *keys, F.coalesce("source", F.lit("none")).alias("source"), "min_x", "min_y", "max_x", "max_y",
        (F.col("max_x") - F.col("min_x")).alias("width"), (F.col("max_y") - F.col("min_y")).alias("depth"), "area",
        F.when(F.col("source") == "scan", 0.30).alias("wall_thickness"),
        F.when(F.col("source") == "scan", 0.4).when(F.col("source") == "plan", 1.0).alias("confidence"),
        F.when(F.col("source").isNull(), "The level has no closed room.").alias("error"),
        F.col("_b.ring").alias("ring"),
    )
