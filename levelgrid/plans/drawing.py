"""Dimension chains, schedules, bounds and sheet tiles of plan tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import geometry as g
from levelgrid.functions.numbering import number_rows
from levelgrid.plans.documents import PLAN, PlanTables
from levelgrid.plans.lookup import lines_of, opening_ends, opening_rect, resolve_refs
from levelgrid.plans.rooms import wall_polygons
from levelgrid.plans.validate import dimension_refs
from levelgrid.session import settle

# Chain distances from the outline and paper sizes in millimetres (portrait).
SIDES = {"south": -1, "east": -1, "north": 1, "west": 1}
CHAIN = {"overall": 0.4, "segments": 0.8, "openings": 1.2}
PAPER = {"A4": (210, 297), "A3": (297, 420), "A2": (420, 594), "A1": (594, 841)}
FRAME_LEFT, FRAME_EDGE, TITLE_H, PAD, OVERLAP = 20, 10, 50, 8, 20


def _sides(df: DataFrame, x: Column, y: Column, tol: float = 0.02) -> DataFrame:
    """One row per outline side a point lies on; df carries the storey's bounds."""
    near = lambda c, b: F.abs(c - F.col(b)) <= tol
    on = [("south", near(y, "y0")), ("east", near(x, "x1b")), ("north", near(y, "y1b")), ("west", near(x, "x0"))]
    side = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in on]))
    return df.withColumn("side", F.explode(side))


def dimension_chains(t: PlanTables, rooms: DataFrame | None = None) -> DataFrame:
    """Automatic chains (plan, dimension_id, offset, segment, a, b) without the suppressed ones."""
    box = t.vertices.groupBy(*PLAN).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1b"), F.max("y").alias("y1b"))
    box = settle(box)
    along = F.when(F.col("side").isin("east", "west"), F.col("y")).otherwise(F.col("x"))
    v = _sides(t.vertices.join(box, PLAN), F.col("x"), F.col("y")).withColumn("_u", along)
    v = settle(number_rows(v.select(*PLAN, "side", "vertex_id", "_u"), [*PLAN, "side"], ["_u", "vertex_id"], "_k"))
    ends = v.groupBy(*PLAN, "side").agg(F.count(F.lit(1)).alias("_n"), F.min_by("vertex_id", "_k").alias("_first"), F.max_by("vertex_id", "_k").alias("_last")).filter("_n >= 2")
    after = v.select(*PLAN, "side", (F.col("_k") - 1).alias("_k"), F.col("vertex_id").alias("_next"))
    v = v.join(ends, [*PLAN, "side"]).join(after, [*PLAN, "side", "_k"], "left").withColumn("_i", F.col("_k") - 1)
    v = settle(v)
    sign = lambda d: F.when(F.col("side").isin("south", "east"), -d).otherwise(F.lit(d))
    name = lambda kind: F.concat(F.lit("exterior-"), "side", F.lit(f"-{kind}"))
    overall = v.filter("_i = 0").select(*PLAN, name("overall").alias("dimension_id"), sign(CHAIN["overall"]).alias("offset"), F.lit(0).alias("segment"), F.col("_first").alias("a"), F.col("_last").alias("b"))
    segments = v.filter("_next is not null").select(*PLAN, name("segments").alias("dimension_id"), sign(CHAIN["segments"]).alias("offset"), F.col("_i").cast("int").alias("segment"), F.col("vertex_id").alias("a"), F.col("_next").alias("b"))
    o = t.openings.select(*PLAN, "opening_id", "wall_id").join(lines_of(t).select(*PLAN, "wall_id", "a", "b", "x1", "y1", "x2", "y2"), [*PLAN, "wall_id"]).join(box.withColumnRenamed("x1b", "_x1b"), PLAN).withColumnRenamed("_x1b", "x1b")
    o = _sides(o, (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0)
    live = v.select(*PLAN, "side").distinct()
    o = o.join(live, [*PLAN, "side"], "left_semi")
    o = number_rows(o.select(*PLAN, "side", "opening_id", "a", "b"), [*PLAN, "side"], ["opening_id"], "_k")
    openings = o.select(*PLAN, name("openings").alias("dimension_id"), sign(CHAIN["openings"]).alias("offset"), (F.col("_k") - 1).alias("segment"), "a", "b")
    parts = [overall, segments, openings]
    if rooms is not None:
        lean = lambda e: g.axis_delta_deg(e["x2"] - e["x1"], e["y2"] - e["y1"]) <= 5.0
        r = rooms.filter((F.size("ring") >= 4) & F.forall(g.ring_edges(F.col("ring")), lean))
        b = g.ring_bounds(F.col("ring"))
        r = settle(r.select(*PLAN, "room_id", b["min_x"].alias("rx"), b["min_y"].alias("ry")))
        for kind, low, on, sort in (("width", "ry", "y", "x"), ("depth", "rx", "x", "y")):
            hit = r.join(t.vertices, PLAN).filter(F.abs(F.col(on) - F.col(low)) <= 0.05)
            ends = hit.groupBy(*PLAN, "room_id").agg(F.min(F.struct(sort, "vertex_id")).alias("_a"), F.max(F.struct(F.col(sort), F.col("vertex_id"))).alias("_b"))
            ends = ends.filter(F.col("_a.vertex_id") != F.col("_b.vertex_id"))
            parts.append(ends.select(*PLAN, F.concat(F.lit("room-"), "room_id", F.lit(f"-{kind}")).alias("dimension_id"), F.lit(0.3).alias("offset"), F.lit(0).alias("segment"), F.col("_a.vertex_id").alias("a"), F.col("_b.vertex_id").alias("b")))
    out = reduce(DataFrame.unionByName, parts)
    hidden = t.levels.select(*PLAN, F.explode("suppressed").alias("dimension_id"))
    return out.join(hidden, [*PLAN, "dimension_id"], "left_anti")


def sync_dimensions(t: PlanTables, rooms: DataFrame | None = None) -> PlanTables:
    """Plan tables whose dimensions are the manual ones and the fresh automatic chains."""
    chains = dimension_chains(t, rooms)
    ref = lambda c: F.struct(F.lit("vertex").alias("type"), F.col(c).alias("id"), F.lit(None).cast("string").alias("edge"))
    made = chains.groupBy(*PLAN, "dimension_id").agg(
        F.first("offset").alias("offset"),
        F.transform(F.array_sort(F.collect_list(F.struct("segment", ref("a").alias("a"), ref("b").alias("b")))), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias("segments"),
    )
    manual = t.dimensions.filter("not auto")
    return t.with_(dimensions=manual.unionByName(made.select(*PLAN, "dimension_id", F.lit(True).alias("auto"), "offset", "segments")))


def display_length(metres: Column, unit: str = "cm") -> Column:
    return g.js_round(metres * (1000.0 if unit == "mm" else 100.0)).cast("long").cast("string")


def dimension_report(t: PlanTables, unit: str = "cm") -> DataFrame:
    """Length, text and label point of every dimension segment."""
    refs = resolve_refs(dimension_refs(t.dimensions), t)
    pick = lambda e: F.max(F.when(F.col("end") == e, F.struct("x", "y")))
    s = refs.groupBy(*PLAN, "element_id", "segment").agg(pick("a").alias("pa"), pick("b").alias("pb"))
    s = s.join(t.dimensions.select(*PLAN, F.col("dimension_id").alias("element_id"), "offset"), [*PLAN, "element_id"])
    a, b = g.pt("pa"), g.pt("pb")
    s = s.withColumn("length", g.dist(a, b)).filter("length > 0")
    n = g.left(g.unit(g.sub(b, a)))
    mid = g.add(g.mul(g.add(a, b), 0.5), g.mul(n, F.col("offset")))
    return s.select(*PLAN, F.col("element_id").alias("dimension_id"), "segment", "length", display_length(F.col("length"), unit).alias("text"), mid.x.alias("label_x"), mid.y.alias("label_y"))


def room_schedule(rooms: DataFrame) -> DataFrame:
    """Name, number, area text and label point of every room."""
    c = g.ring_centroid(F.col("ring"))
    inside = g.point_in_ring(c, F.col("ring"))
    first = F.element_at("ring", 1)
    name = F.when(F.length(F.trim("name")) > 0, F.col("name")).otherwise("Room")
    return rooms.select(
        *PLAN, "room_id", name.alias("name"), F.trim("number").alias("number"), "area", F.format_string("%.1f m²", "area").alias("area_text"),
        F.when(inside, c.x).otherwise(first["x"]).alias("label_x"), F.when(inside, c.y).otherwise(first["y"]).alias("label_y"),
    )


def content_bounds(t: PlanTables, hide_furniture: bool = False) -> DataFrame:
    """Bounding box of everything drawn on each storey; an empty one is a unit square."""
    from levelgrid.operators.openings import column_ring

    spread = lambda df, ring: df.select(*PLAN, F.explode(ring).alias("p")).select(*PLAN, "p.x", "p.y")
    two = lambda df, *names: df.select(*PLAN, F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in names])).alias("p")).select(*PLAN, "p.x", "p.y")
    fixtures = t.fixtures.filter("role <> 'furniture'") if hide_furniture else t.fixtures
    fix = g.rotated_box(g.xy("x", "y"), F.col("width"), F.col("depth"), F.col("rotation_deg"))
    refs = resolve_refs(dimension_refs(t.dimensions), t)
    pick = lambda e: F.max(F.when(F.col("end") == e, F.struct("x", "y")))
    dims = refs.groupBy(*PLAN, "element_id", "segment").agg(pick("a").alias("pa"), pick("b").alias("pb")).join(t.dimensions.select(*PLAN, F.col("dimension_id").alias("element_id"), "offset"), [*PLAN, "element_id"])
    a, b = g.pt("pa"), g.pt("pb")
    n = g.left(g.unit(g.sub(b, a)))
    dims = settle(dims.withColumns({"_nx": n.x * F.col("offset"), "_ny": n.y * F.col("offset")}))
    n = g.xy("_nx", "_ny")
    dims = dims.filter(g.dist(a, b) > 0).select(*PLAN, F.explode(F.array(g.point_struct(g.add(a, n)), g.point_struct(g.add(b, n)))).alias("p")).select(*PLAN, "p.x", "p.y")
    parts = [
        spread(wall_polygons(t.vertices, t.walls), "ring"), spread(opening_rect(t), "ring"), spread(column_ring(t.columns), "ring"), spread(t.stairs, "outline"),
        spread(fixtures.withColumn("ring", fix), "ring"), two(lines_of(t, "separators"), ("x1", "y1"), ("x2", "y2")), dims, t.texts.select(*PLAN, "x", "y"),
    ]
    box = reduce(DataFrame.unionByName, parts).groupBy(*PLAN).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    out = t.levels.select(*PLAN).join(box, PLAN, "left")
    return out.select(*PLAN, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("min_x", 0.0), ("min_y", 0.0), ("max_x", 1.0), ("max_y", 1.0))])


def sheet_suffix(index: Column) -> Column:
    """a..z, then aa, ab and so on, up to three letters."""
    letter = lambda n: F.char(n + 97)
    one, two, three = index < 26, index < 26 + 676, index - 702
    k = index - 26
    return F.when(one, letter(index % 26)).when(two, F.concat(letter(F.floor(k / 26)), letter(k % 26))).otherwise(
        F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26))
    )


def sheet_tiles(bounds: DataFrame) -> DataFrame:
    """Sheet windows of storeys (min_x..max_y, paper, orientation, scale, sheet_number).

    `fits` tells whether one sheet is enough; otherwise windows overlap by 20 mm.
    """
    sizes = F.create_map(*[x for k, (w, h) in PAPER.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))])
    p = F.element_at(sizes, F.col("paper"))
    wide = F.col("orientation") == "landscape"
    w, h = F.when(wide, p["h"]).otherwise(p["w"]), F.when(wide, p["w"]).otherwise(p["h"])
    b = bounds.withColumns({"dw": w - FRAME_LEFT - FRAME_EDGE - 2 * PAD, "dh": h - 2 * FRAME_EDGE - TITLE_H - 2 * PAD, "mm": 1000.0 / F.col("scale")})
    b = b.withColumns({"cw": (F.col("max_x") - F.col("min_x")) * F.col("mm"), "ch": (F.col("max_y") - F.col("min_y")) * F.col("mm")})
    step = lambda d: F.greatest(F.lit(1), F.col(d) - OVERLAP)
    count = lambda c, d: F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0.0), F.round(F.col(c) - OVERLAP, 9)) / step(d))).cast("int")
    b = b.withColumns({"sx": step("dw"), "sy": step("dh"), "cols": count("cw", "dw"), "rows": count("ch", "dh")})
    b = b.withColumn("fits", (F.col("cw") <= F.col("dw") + 0.5) & (F.col("ch") <= F.col("dh") + 0.5))
    b = b.withColumn("next_scale", F.when(F.col("scale") == 50, 100).when(F.col("scale") == 100, 200))
    b = b.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    index = F.col("row") * F.col("cols") + F.col("col")
    many = F.col("rows") * F.col("cols") > 1
    x0 = F.col("min_x") + F.col("col") * F.col("sx") / F.col("mm")
    y0 = F.col("min_y") + F.col("row") * F.col("sy") / F.col("mm")
    return b.select(
        *PLAN, "fits", "next_scale", index.alias("tile"), F.concat("sheet_number", F.when(many, sheet_suffix(index)).otherwise("")).alias("sheet"),
        x0.alias("win_x0"), y0.alias("win_y0"), (x0 + F.col("dw") / F.col("mm")).alias("win_x1"), (y0 + F.col("dh") / F.col("mm")).alias("win_y1"),
    )


def net_wall_area(t: PlanTables) -> DataFrame:
    """Drawn wall area net of openings.

    Openings of one wall share its direction, so along the wall each takes an
    interval; overlapping intervals are joined before they are clipped out.
    """
    polygons = settle(wall_polygons(t.vertices, t.walls))
    o = opening_rect(t).withColumns({"u0": F.col("offset") * g.dist(g.xy("x1", "y1"), g.xy("x2", "y2")) - F.col("width") / 2.0})
    o = o.withColumn("u1", F.col("u0") + F.col("width"))
    w = W.partitionBy(*PLAN, "wall_id").orderBy("u0", "opening_id")
    reach = F.max("u1").over(w.rowsBetween(W.unboundedPreceding, -1))
    o = o.withColumn("_b", F.coalesce(F.col("u0") > reach, F.lit(True)).cast("int"))
    o = o.withColumn("_g", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = g.unit(g.sub(g.xy("x2", "y2"), g.xy("x1", "y1")))
    spans = o.groupBy(*PLAN, "wall_id", "_g").agg(
        F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.first("thickness").alias("t"), F.first("x1").alias("x"), F.first("y1").alias("y"), F.first(d.x).alias("dx"), F.first(d.y).alias("dy")
    )
    a, dd = g.xy("x", "y"), g.xy("dx", "dy")
    n = g.mul(g.left(dd), F.col("t") / 2.0)
    s, e = g.add(a, g.mul(dd, F.col("u0"))), g.add(a, g.mul(dd, F.col("u1")))
    rect = F.array(*[g.point_struct(q) for q in (g.sub(s, n), g.sub(e, n), g.add(e, n), g.add(s, n))])
    cut = spans.withColumn("cut", rect).join(polygons, [*PLAN, "wall_id"])
    part = F.abs(g.ring_area(g.clip_convex(F.col("ring"), g.counter_clockwise(F.col("cut")))))
    lost = cut.groupBy(*PLAN, "wall_id").agg(F.sum(part).alias("_cut"))
    out = polygons.join(lost, [*PLAN, "wall_id"], "left")
    gross = F.abs(g.ring_area(F.col("ring")))
    return out.select(*PLAN, "wall_id", gross.alias("gross"), (gross - F.coalesce("_cut", F.lit(0.0))).alias("net"))


def stair_treads(stairs: DataFrame) -> DataFrame:
    """Tread lines across each stair: riser count minus one."""
    d = g.unit(g.pt("direction"))
    s = stairs.withColumns({"dx": d.x, "dy": d.y}).filter("(dx <> 0 or dy <> 0)").filter(F.size("outline") > 0)
    us = F.transform("outline", lambda p: p["x"] * F.col("dx") + p["y"] * F.col("dy"))
    vs = F.transform("outline", lambda p: p["y"] * F.col("dx") - p["x"] * F.col("dy"))
    s = s.withColumns({"u0": F.array_min(us), "u1": F.array_max(us), "v0": F.array_min(vs), "v1": F.array_max(vs), "_n": F.greatest(F.lit(1), F.col("riser_count"))})
    s = s.filter("_n > 1").withColumn("tread", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    u = F.col("u0") + (F.col("u1") - F.col("u0")) * F.col("tread") / F.col("_n")
    at = lambda v: (F.col("dx") * u - F.col("dy") * F.col(v), F.col("dy") * u + F.col("dx") * F.col(v))
    (x1, y1), (x2, y2) = at("v0"), at("v1")
    return s.select(*PLAN, "stair_id", "tread", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
