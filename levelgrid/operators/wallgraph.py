"""From wall faces to a planar wall graph, cells, and room seeds, keyed by storey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.functions import arrangement as arr
from levelgrid.functions import geometry as g
from levelgrid.functions import tiles
from levelgrid.functions.graph import connected_components
from levelgrid.functions.numbering import number_rows
from levelgrid.operators.surfaces import LEVEL, MIN_WALL
from levelgrid.session import attach, settle
from levelgrid.functions.geometry import sq

# Join tolerances in metres and the least room in square metres.
END_SNAP = 0.05
MIN_ROOM = 0.50
SHARED = 0.05
FLOOR_OUTSIDE = 0.15
FLOOR_MIN = 50
UP = 0.7

ENDS = arr.ENDS


def _length() -> Column:
    return F.sqrt(sq(F.col("x2") - F.col("x1")) + sq(F.col("y2") - F.col("y1")))


def end_points(segments: DataFrame, keys: list[str], seg: str = "seg") -> DataFrame:
    """Two rows per segment: (keys, seg, end, x, y)."""
    ends = F.array(
        F.struct(F.lit("a").alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.lit("b").alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")),
    )
    return segments.select(*keys, seg, F.explode(ends).alias("_e")).select(*keys, seg, "_e.end", "_e.x", "_e.y")


def end_components(segments: DataFrame, keys: list[str], radius: float = END_SNAP) -> DataFrame:
    """(id, component) of segments linked through ends within `radius`; ids are structs."""
    ends = end_points(segments, keys).withColumn("id", F.struct(*keys, "seg", "end"))
    pairs = tiles.eps_pairs(ends, keys, ["x", "y"], radius)
    whole = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in (*keys, "seg")])
    nodes = segments.select(F.struct(*keys, "seg").alias("id"))
    return connected_components(pairs.select(whole("u").alias("u"), whole("v").alias("v")).filter("u <> v"), nodes)


def drop_assumed_islands(faces: DataFrame, keys=LEVEL) -> DataFrame:
    """Drop groups of linked walls with no measured and no exterior member."""
    keys = list(keys)
    faces = settle(faces)
    label = end_components(faces, keys).select(
        *[F.col(f"id.{k}").alias(k) for k in (*keys, "seg")], F.col("component").alias("_g")
    )
    named = settle(faces.join(label, [*keys, "seg"]))
    good = named.groupBy("_g").agg(F.bool_or(~F.col("assumed") | (F.col("kind") == "exterior")).alias("_ok")).filter("_ok")
    return named.join(good.select("_g"), "_g", "left_semi").drop("_g")


def axis_align(segments: DataFrame) -> DataFrame:
    """Segments of at least 0.40 m; within 1 degree of an axis they are put on it."""
    s = segments.filter(_length() >= MIN_WALL)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    angle = F.pmod(F.abs(F.degrees(F.atan2(dy, dx))), F.lit(180.0))
    angle = F.when(angle > 90.0, 180.0 - angle).otherwise(angle)
    my = F.bround((F.col("y1") + F.col("y2")) / 2.0, 4)
    mx = F.bround((F.col("x1") + F.col("x2")) / 2.0, 4)
    flat, tall = angle <= 1.0, F.abs(angle - 90.0) <= 1.0
    return s.withColumns({"_flat": flat, "_tall": tall & ~flat, "_mx": mx, "_my": my}).withColumns(
        {
            "y1": F.when(F.col("_flat"), F.col("_my")).otherwise(F.col("y1")),
            "y2": F.when(F.col("_flat"), F.col("_my")).otherwise(F.col("y2")),
            "x1": F.when(F.col("_tall"), F.col("_mx")).otherwise(F.col("x1")),
            "x2": F.when(F.col("_tall"), F.col("_mx")).otherwise(F.col("x2")),
        }
    ).drop("_flat", "_tall", "_mx", "_my")


def snap_ends(segments: DataFrame, keys=LEVEL) -> tuple[DataFrame, DataFrame]:
    """(segments with snapped ends, cuts on hosts).

    An end moves to the nearest crossing with another segment's line that is
    within 0.05 m of the end and on that segment (0.05 m either side). All
    snaps are computed from the original segments, so order does not matter.
    """
    keys = list(keys)
    segments = settle(segments)
    ends = end_points(segments, keys).join(segments.select(*keys, "seg", *[F.col(c).alias(f"o{c}") for c in ENDS]), [*keys, "seg"])
    hosts = segments.select(*keys, F.col("seg").alias("host"), *ENDS)
    hosts = tiles.tile_segment(hosts, g.xy("x1", "y1"), g.xy("x2", "y2"), 2 * END_SNAP, 1.0)
    near = tiles.tile_points(ends, "x", "y", 1.0).join(hosts, [*keys, *tiles.TILE]).filter("host <> seg")
    a, b = g.xy("ox1", "oy1"), g.xy("ox2", "oy2")
    c, d = g.xy("x1", "y1"), g.xy("x2", "y2")
    hit = g.line_intersect(a, g.sub(b, a), c, g.sub(d, c))
    near = near.withColumns({"hx": hit.x, "hy": hit.y}).filter("hx is not null")
    h = g.xy("hx", "hy")
    length = g.dist(c, d)
    t = g.foot_param(h, c, d)
    near = near.withColumn("gap", g.dist(g.xy("x", "y"), h)).filter((F.col("gap") < END_SNAP) & t.between(-END_SNAP / length, 1 + END_SNAP / length))
    hx, hy = F.bround("hx", 4), F.bround("hy", 4)
    inside = g.foot_param(g.P(hx, hy), c, d).between(0.02, 0.98)
    best = near.groupBy(*keys, "seg", "end").agg(
        F.min(F.struct("gap", "host", hx.alias("x"), hy.alias("y"), inside.alias("inside"))).alias("b")
    )
    best = settle(best.select(*keys, "seg", "end", "b.host", "b.x", "b.y", "b.inside"))
    pick = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    moves = best.groupBy(*keys, "seg").agg(pick("a", "x").alias("_ax"), pick("a", "y").alias("_ay"), pick("b", "x").alias("_bx"), pick("b", "y").alias("_by"))
    out = segments.join(moves, [*keys, "seg"], "left").withColumns(
        {"x1": F.coalesce("_ax", "x1"), "y1": F.coalesce("_ay", "y1"), "x2": F.coalesce("_bx", "x2"), "y2": F.coalesce("_by", "y2")}
    ).drop("_ax", "_ay", "_bx", "_by")
    cuts = best.filter("inside").select(*keys, F.col("host").alias("seg"), "x", "y").distinct()
    return settle(out), settle(cuts)


def split_segments(segments: DataFrame, cuts: DataFrame, keys=LEVEL) -> DataFrame:
    """Hosts split at their cuts; pieces shorter than 0.40 m are dropped."""
    return arr.split_at(segments, cuts, list(keys), 1e-4).filter(_length() >= MIN_WALL)


def piece_parent(pieces: DataFrame, segments: DataFrame, keys=LEVEL, near: float = 0.03, shortest: float = 0.05) -> DataFrame:
    """Pieces of at least 0.05 m with `parent`, the nearest segment to their middle.

    `pieces` has piece, x1..y2; `segments` has seg and its attributes.
    """
    keys = list(keys)
    mids = pieces.filter(_length() >= shortest).select(
        *keys, "piece", ((F.col("x1") + F.col("x2")) / 2.0).alias("x"), ((F.col("y1") + F.col("y2")) / 2.0).alias("y")
    )
    lines = segments.select(*keys, "seg", *ENDS)
    gap = g.distance_to_segment(g.xy("x", "y"), g.xy("x1", "y1"), g.xy("x2", "y2"))
    hits = tiles.near_segments(mids, lines, keys, near, gap < near)
    hits = hits.withColumn("_gap", gap)
    best = hits.groupBy(*keys, "piece").agg(F.min_by("seg", F.struct(F.round("_gap", 9), "seg")).alias("parent"))
    return pieces.join(best, [*keys, "piece"])


def cell_evidence(cells: DataFrame, points: DataFrame, keys=LEVEL) -> DataFrame:
    """Floor and ceiling points per square metre of each cell, and whether it is surely inside."""
    keys = list(keys)
    flat = points.filter(F.abs(F.col("nz")) > UP).select(*keys, "x", "y", (F.col("nz") > 0).alias("_up"))
    hits = tiles.points_in_rings(flat, cells.select(*keys, "cell", "ring"), keys)
    count = hits.groupBy(*keys, "cell").agg(F.count_if("_up").alias("floor"), F.count_if(~F.col("_up")).alias("ceiling"))
    area = F.greatest("area", F.lit(1e-6))
    out = cells.join(count, [*keys, "cell"], "left").withColumns(
        {"floor_score": F.coalesce("floor", F.lit(0)) / area, "ceiling_score": F.coalesce("ceiling", F.lit(0)) / area}
    )
    out = settle(out.withColumn("score", F.greatest("floor_score", "ceiling_score")).drop("floor", "ceiling"))
    middle = out.filter("score > 0").groupBy(*keys).agg(F.percentile("score", F.lit(0.5)).alias("_m"))
    return out.join(middle, keys, "left").withColumn("sure", F.coalesce((F.col("score") > 0) & (F.col("score") >= F.col("_m")), F.lit(False))).drop("_m")


def cell_adjacency(labelled: DataFrame, cells: DataFrame, keys=LEVEL) -> DataFrame:
    """(keys, cell, other, shared): common boundary of at least 0.05 m; other NULL is outside."""
    keys = list(keys)
    length = F.sqrt(sq(F.col("id.x2") - F.col("id.x1")) + sq(F.col("id.y2") - F.col("id.y1")))
    sides = labelled.select(F.col("cycle").alias("cell"), F.col("other"), length.alias("len"))
    known = cells.select(*keys, "cell")
    far = cells.select(F.col("cell").alias("other"), F.lit(1).alias("_in"))
    sides = sides.join(known, "cell").join(far, "other", "left")
    sides = sides.withColumn("other", F.when(F.col("_in").isNotNull(), F.col("other")))
    return sides.groupBy(*keys, "cell", "other").agg(F.sum("len").alias("shared")).filter(F.col("shared") >= SHARED - 1e-9)


def label_inside(cells: DataFrame, adjacency: DataFrame, keys=LEVEL) -> DataFrame:
    """Cells (with `sure`) plus `inside`.

    Starting from the sure cells, a cell joins when its neighbours inside are
    at least as many as its outside contact and its other neighbours, which
    never raises the number of cut boundaries. Pairs of neighbours join on the
    same test taken together. Scans with no sure cell have no inside.
    """
    keys = list(keys)
    edges = settle(adjacency.filter("other is not null").select("cell", "other"))
    out_contact = settle(adjacency.filter("other is null").select("cell", F.lit(1).alias("_out")))
    state = settle(cells.select("cell", F.col("sure").alias("inside"), F.xxhash64(*keys).alias("_k")))
    alive = cells.filter("sure").select(*keys).distinct()
    if state.filter("inside").isEmpty():
        return cells.withColumn("inside", F.lit(False))
    # Every round takes in a cell at least, so this ends.
    while True:
        lab = state.select(F.col("cell").alias("other"), F.col("inside").alias("_oin"))
        tally = edges.join(lab, "other").groupBy("cell").agg(F.count_if("_oin").alias("_i"), F.count_if(~F.col("_oin")).alias("_o"))
        score = state.join(tally, "cell", "left").join(out_contact, "cell", "left")
        zero = F.lit(0)
        # Boundaries gained minus boundaries lost by taking the cell in.
        balance = F.coalesce("_i", zero) - F.coalesce("_o", zero) - F.coalesce("_out", zero)
        score = settle(score.select("cell", "inside", (balance).alias("bal"), F.coalesce("_i", zero).alias("_i")))
        alone = score.filter(~F.col("inside") & (F.col("bal") >= 0) & (F.col("_i") > 0)).select("cell")
        if alone.isEmpty():
            free = score.filter(~F.col("inside"))
            left = free.select("cell", F.col("bal").alias("ba"), F.col("_i").alias("ia"))
            right = free.select(F.col("cell").alias("other"), F.col("bal").alias("bb"), F.col("_i").alias("ib"))
            both = edges.filter("cell < other").join(left, "cell").join(right, "other")
            # The boundary between the two was counted against each of them.
            both = both.filter((F.col("ba") + F.col("bb") + 2 >= 0) & (F.col("ia") + F.col("ib") > 0))
            alone = settle(both.select(F.explode(F.array("cell", "other")).alias("cell")).distinct())
            if alone.isEmpty():
                break
        state = settle(state.join(alone.withColumn("_new", F.lit(True)), "cell", "left").select("cell", (F.col("inside") | F.coalesce("_new", F.lit(False))).alias("inside"), "_k"))
    out = cells.join(state.select("cell", "inside"), "cell")
    # Where nothing is sure the whole storey stays outside.
    known = alive.withColumn("_alive", F.lit(True))
    return out.join(known, keys, "left").withColumn("inside", F.col("inside") & F.coalesce("_alive", F.lit(False))).drop("_alive")


def separating(pieces: DataFrame, labelled: DataFrame, cells: DataFrame, keys=LEVEL) -> DataFrame:
    """Pieces that bound at least one inside cell. `cells` carries `inside`."""
    keys = list(keys)
    inside = cells.filter("inside").select(F.col("cell").alias("cycle"))
    edges = labelled.join(inside, "cycle", "left_semi").select(*[F.col(f"id.{k}").alias(k) for k in [*keys, *ENDS]])
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    undirected = lambda df: df.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)})
    keep = undirected(edges).select(*keys, "_lo", "_hi").distinct()
    return undirected(pieces).join(keep, [*keys, "_lo", "_hi"], "left_semi").drop("_lo", "_hi")


def open_ends(walls: DataFrame, keys=LEVEL) -> DataFrame:
    """Points, to a millimetre, where exactly one wall ends."""
    keys = list(keys)
    ends = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    p = walls.select(*keys, ends.alias("p"))
    p = p.groupBy(*keys, F.bround("p.x", 3).alias("x"), F.bround("p.y", 3).alias("y")).agg(F.count(F.lit(1)).alias("degree"))
    return p.filter("degree = 1").drop("degree")


def floor_outside_ratio(points: DataFrame, cells: DataFrame, keys=LEVEL) -> DataFrame:
    """Share of floor points in no inside cell, and the open-gap flag."""
    keys = list(keys)
    floor = settle(points.filter(F.col("nz") > UP).select(*keys, "x", "y"))
    total = floor.groupBy(*keys).agg(F.count(F.lit(1)).alias("floor_points"))
    # Cells do not overlap, so a point is counted once.
    inside = cells.filter("inside").select(*keys, "cell", "ring") if "inside" in cells.columns else cells.select(*keys, "cell", "ring")
    covered = tiles.points_in_rings(floor, inside, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    out = total.join(covered, keys, "left")
    out = out.withColumn("outside", 1.0 - F.coalesce("_c", F.lit(0)) / F.col("floor_points")).drop("_c")
    return out.withColumn("open_gap", (F.col("floor_points") >= FLOOR_MIN) & (F.col("outside") > FLOOR_OUTSIDE))


def merge_collinear(walls: DataFrame, keys=LEVEL) -> DataFrame:
    """Walls in one line that share an end, a kind and a thickness become one wall.

    Chains are components of the sharing graph; a chain's wall runs between
    its extreme ends and takes the least confidence.
    """
    keys = list(keys)
    walls = settle(walls.filter(_length() >= MIN_WALL))
    ends = end_points(walls, keys).join(walls.select(*keys, "seg", "kind", "thickness", *[F.col(c).alias(f"o{c}") for c in ENDS]), [*keys, "seg"])
    ends = settle(ends.withColumns({"_fx": F.when(F.col("end") == "a", F.col("ox2")).otherwise(F.col("ox1")), "_fy": F.when(F.col("end") == "a", F.col("oy2")).otherwise(F.col("oy1"))}))
    named = ends.withColumn("id", F.struct(*keys, "seg", "end"))
    pairs = tiles.eps_pairs(named, keys, ["x", "y"], 0.001)
    side = lambda t: ends.select(F.struct(*keys, "seg", "end").alias(t), *[F.col(c).alias(f"{c}_{t}") for c in ("x", "y", "_fx", "_fy", "kind", "thickness")])
    p = pairs.join(side("u"), "u").join(side("v"), "v")
    angle = g.joint_angle_deg(g.xy("x_u", "y_u"), g.xy("_fx_u", "_fy_u"), g.xy("_fx_v", "_fy_v"))
    p = p.filter((F.col("kind_u") == F.col("kind_v")) & (F.abs(F.col("thickness_u") - F.col("thickness_v")) <= 0.001 + 1e-12) & (F.abs(angle - 180.0) <= 1.0))
    whole = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in (*keys, "seg")])
    label = connected_components(p.select(whole("u").alias("u"), whole("v").alias("v")).filter("u <> v"), walls.select(F.struct(*keys, "seg").alias("id")))
    label = label.select(*[F.col(f"id.{k}").alias(k) for k in (*keys, "seg")], F.col("component.seg").alias("_g"))
    joined = settle(walls.join(label, [*keys, "seg"]))
    # Ends are compared along the direction of the longest member.
    frame = joined.groupBy(*keys, "_g").agg(
        F.max_by(F.struct((F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy")), F.struct(_length(), "seg")).alias("_d"),
        F.min_by(F.struct("thickness", "kind"), "seg").alias("_w"),
        F.min("confidence").alias("confidence"),
    )
    pts = end_points(joined.select(*keys, "seg", *ENDS), keys).join(label, [*keys, "seg"]).join(frame, [*keys, "_g"])
    along = F.col("x") * F.col("_d.dx") + F.col("y") * F.col("_d.dy")
    out = pts.groupBy(*keys, F.col("_g").alias("seg")).agg(
        F.min(F.struct(along.alias("t"), "x", "y")).alias("_lo"), F.max(F.struct(along.alias("t"), "x", "y")).alias("_hi"),
        F.first("_w").alias("_w"), F.first("confidence").alias("confidence"),
    )
    return out.select(
        *keys, "seg", F.col("_lo.x").alias("x1"), F.col("_lo.y").alias("y1"), F.col("_hi.x").alias("x2"), F.col("_hi.y").alias("y2"),
        "_w.thickness", "_w.kind", "confidence",
    )


def dedupe_segments(walls: DataFrame, keys=LEVEL) -> DataFrame:
    """One wall per undirected pair of millimetre end points; the least seg stays."""
    keys = list(keys)
    mm = lambda c: F.bround(c, 3) + F.lit(0.0)
    a = F.struct(mm("x1").alias("x"), mm("y1").alias("y"))
    b = F.struct(mm("x2").alias("x"), mm("y2").alias("y"))
    rest = [c for c in walls.columns if c not in keys]
    out = walls.filter(a != b).groupBy(*keys, F.least(a, b).alias("_lo"), F.greatest(a, b).alias("_hi"))
    return out.agg(F.min_by(F.struct(*rest), F.col("seg")).alias("_w")).select(*keys, *[F.col(f"_w.{c}").alias(c) for c in rest])


def to_graph(segments: DataFrame, keys=LEVEL) -> tuple[DataFrame, DataFrame]:
    """(vertices, walls): millimetre vertices numbered by (x, y), walls by their ends."""
    keys = list(keys)
    mm = lambda c: F.bround(c, 3) + F.lit(0.0)
    s = segments.select(*keys, "seg", "thickness", "kind", "confidence", *[mm(c).alias(c) for c in ENDS])
    s = settle(s.filter("x1 <> x2 or y1 <> y2"))
    points = end_points(s, keys).select(*keys, "x", "y").distinct()
    points = number_rows(points, keys, ["x", "y"], "_n")
    vertices = settle(points.select(*keys, "x", "y", F.concat(F.lit("v"), "_n").alias("vertex_id")))
    at = lambda x, y, name: vertices.select(*keys, F.col("x").alias(x), F.col("y").alias(y), F.col("vertex_id").alias(name))
    walls = s.join(at("x1", "y1", "a"), [*keys, "x1", "y1"]).join(at("x2", "y2", "b"), [*keys, "x2", "y2"])
    kinds = ("exterior", "interior", "partition", "assumed")
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("interior")
    walls = number_rows(walls.withColumn("kind", kind), keys, [*ENDS, "seg"], "_n")
    walls = walls.withColumn("wall_id", F.concat(F.lit("w"), "_n"))
    return vertices, walls.select(*keys, "wall_id", "a", "b", "thickness", "kind", "confidence", *ENDS)


def room_seeds(cells: DataFrame, keys=LEVEL) -> DataFrame:
    """A seed inside every inside cell of at least half a square metre."""
    keys = list(keys)
    big = cells.filter(F.col("area") >= MIN_ROOM)
    if "inside" in cells.columns:
        big = big.filter("inside")
    big = g.with_interior_point(big.select(*keys, "cell", "ring")).select(*keys, "cell", "x", "y")
    big = number_rows(big, keys, ["cell"], "_n")
    return big.select(*keys, F.concat(F.lit("r"), "_n").alias("room_id"), "x", "y", F.lit("Room").alias("name"), F.col("_n").cast("string").alias("number"))


def reseat_seeds(seeds: DataFrame, faces: DataFrame, keys=LEVEL) -> DataFrame:
    """Seeds that lie in a wall move into the face they belong to.

    The host is the face that holds the seed or has its boundary within
    0.02 m, else the nearest one within 0.3 m.
    """
    keys = list(keys)
    seeds = settle(seeds)
    box = g.ring_bounds(F.col("ring"))
    reach = 0.3
    tiled = tiles.tile_box(faces.select(*keys, "face", "ring"), box["min_x"] - reach, box["min_y"] - reach, box["max_x"] + reach, box["max_y"] + reach, 2.0)
    near = tiles.tile_points(seeds, "x", "y", 2.0).join(tiled, [*keys, *tiles.TILE])
    p = g.xy("x", "y")
    near = near.withColumns({"_in": g.point_in_ring(p, F.col("ring")), "_gap": g.distance_to_ring(p, F.col("ring"))})
    near = near.filter(F.col("_in") | (F.col("_gap") <= reach))
    rank = F.struct((~F.col("_in")).alias("o"), F.col("_gap").alias("g"), F.col("face").alias("f"))
    best = near.groupBy(*keys, "room_id").agg(F.min_by(F.struct("_in", "ring"), rank).alias("_b"))
    away = best.filter("not _b._in").select(*keys, "room_id", F.col("_b.ring").alias("ring"))
    inner = g.with_interior_point(away, "ring", "_x", "_y").drop("ring")
    out = seeds.join(inner, [*keys, "room_id"], "left")
    return out.select(*keys, "room_id", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"), "name", "number")


class Draft:
    def __init__(self, vertices, walls, rooms, cells, issues, levels):
        self.vertices, self.walls, self.rooms, self.cells, self.issues, self.levels = vertices, walls, rooms, cells, issues, levels


def draft_levels(faces: DataFrame, level_points: DataFrame, levels: DataFrame, keys=LEVEL) -> Draft:
    """Wall graph, cells and seeds of every storey from its wall faces and points."""
    keys = list(keys)
    kept = drop_assumed_islands(faces.withColumn("seg", F.col("face")).select(*keys, "seg", *ENDS, "thickness", "assumed", "kind", "confidence"), keys)
    kept = kept.withColumn("kind", F.when(F.col("assumed"), "assumed").otherwise(F.col("kind")))
    snapped, cuts = snap_ends(axis_align(kept), keys)
    whole = split_segments(snapped, cuts, keys)
    whole = settle(whole.withColumn("seg", F.xxhash64("seg", *ENDS)))
    pieces = arr.node_segments(whole.select(*keys, "seg", *ENDS), keys).drop("seg").distinct()
    pieces = settle(pieces.withColumn("piece", F.xxhash64(*ENDS)))
    pieces = settle(piece_parent(pieces, whole, keys))
    labelled = arr.half_edge_faces(pieces, keys)
    cells = settle(arr.faces(labelled, keys, holes=True))
    cells = settle(cell_evidence(cells, level_points, keys))
    cells = settle(label_inside(cells, cell_adjacency(labelled, cells, keys), keys))
    chosen = separating(pieces, labelled, cells, keys)
    parents = whole.select(*keys, F.col("seg").alias("parent"), "thickness", "kind", "confidence")
    chosen = settle(chosen.join(parents, [*keys, "parent"]).withColumn("seg", F.col("piece")).drop("piece", "parent"))
    loose = open_ends(chosen, keys).select(*keys).distinct()
    gaps = floor_outside_ratio(level_points, cells, keys).filter("open_gap").select(*keys)
    merged = dedupe_segments(merge_collinear(chosen, keys), keys)
    vertices, walls = to_graph(merged, keys)
    walls = settle(walls)
    seeds = room_seeds(cells, keys)
    issues = loose.unionByName(gaps).distinct().select(
        *keys, F.lit("open_gap").alias("code"), F.lit("warning").alias("severity"), F.lit("A room is open where a wall is missing.").alias("message")
    )
    height = F.when(F.col("ceiling_height") > 1.5, F.col("ceiling_height")).otherwise(F.lit(2.7))
    return Draft(vertices, walls, seeds, cells, issues, levels.withColumn("ceiling_height", height))
