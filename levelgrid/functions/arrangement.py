"""Noding, half-edges, faces: the planar arrangement of segments as joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import geometry as g
from levelgrid.functions import tiles
from levelgrid.functions.graph import rank_cycles
from levelgrid.session import settle
from levelgrid.functions.geometry import sq

ENDS = ["x1", "y1", "x2", "y2"]
GRID = 6  # decimals of a metre: every node lies on a micrometre
TOUCH = 2e-6


def _fix(c: Column) -> Column:
    return F.round(c, GRID) + F.lit(0.0)


def crossings(segments: DataFrame, keys: list[str], size: float = 2.0) -> DataFrame:
    """(keys, seg, x, y): the points where segments are to be cut.

    Crossing points, and end points that touch another segment (which also
    covers collinear overlaps). Candidate pairs share a tile.
    """
    keys = list(keys)
    s = segments.select(*keys, "seg", *[_fix(F.col(c)).alias(c) for c in ENDS])
    tiled = settle(tiles.tile_segment(s, g.xy("x1", "y1"), g.xy("x2", "y2"), 1e-5, size))
    left = tiled.select(*keys, *tiles.TILE, F.col("seg").alias("sa"), *[F.col(c).alias(f"a{c}") for c in ENDS])
    right = tiled.select(*keys, *tiles.TILE, F.col("seg").alias("sb"), *[F.col(c).alias(f"b{c}") for c in ENDS])
    # Segments that meet have boxes that meet, which is quickly seen; a centimetre is far more than TOUCH and rounding ask for.
    low, high = lambda s, c: F.least(f"{s}{c}1", f"{s}{c}2"), lambda s, c: F.greatest(f"{s}{c}1", f"{s}{c}2")
    boxes = reduce(lambda p, q: p & q, [low(s, c) <= high(o, c) + 0.01 for s, o in ("ab", "ba") for c in "xy"])
    pairs = left.join(right, [*keys, *tiles.TILE]).filter("sa < sb").filter(boxes).drop(*tiles.TILE)
    a, b, c, d = g.xy("ax1", "ay1"), g.xy("ax2", "ay2"), g.xy("bx1", "by1"), g.xy("bx2", "by2")
    t, _u = g.segment_params(a, b, c, d)
    pairs = pairs.withColumn("_t", t)
    hit = g.lerp(a, b, F.col("_t"))
    pairs = pairs.withColumns({"_hx": hit.x, "_hy": hit.y})
    hit = g.xy("_hx", "_hy")
    # A crossing at an end point is that end point, for both segments alike.
    best = g.point_struct(g.P(_fix(hit.x), _fix(hit.y)))
    for end in (d, c, b, a):
        best = F.when(g.dist(hit, end) <= TOUCH, g.point_struct(end)).otherwise(best)
    pairs = pairs.withColumn("_at", best)
    x, y = F.col("_at.x"), F.col("_at.y")

    def cut(seg, px, py, when):
        return F.struct(F.col(seg).alias("seg"), px.alias("x"), py.alias("y"), when.alias("ok"))

    rows = F.array(
        cut("sa", x, y, F.col("_t").isNotNull()),
        cut("sb", x, y, F.col("_t").isNotNull()),
        *[cut("sb", e.x, e.y, g.distance_to_segment(e, c, d) <= TOUCH) for e in (a, b)],
        *[cut("sa", e.x, e.y, g.distance_to_segment(e, a, b) <= TOUCH) for e in (c, d)],
    )
    cuts = pairs.select(*keys, F.explode(rows).alias("c")).filter("c.ok")
    return cuts.select(*keys, "c.seg", "c.x", "c.y").distinct()


def split_at(segments: DataFrame, cuts: DataFrame, keys: list[str], shortest: float = 0.0) -> DataFrame:
    """Pieces of segments between their ends and cut points, in order along each."""
    keys = list(keys)
    extra = [c for c in segments.columns if c not in (*keys, "seg", *ENDS)]
    base = segments.select(*keys, "seg", *extra, *[_fix(F.col(c)).alias(c) for c in ENDS])
    a, b = g.xy("x1", "y1"), g.xy("x2", "y2")
    ends = base.select(*keys, "seg", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    marks = ends.select(*keys, "seg", "p.x", "p.y").unionByName(cuts.select(*keys, "seg", "x", "y")).distinct()
    marks = marks.join(base, [*keys, "seg"]).withColumn("_t", g.foot_param(g.xy("x", "y"), a, b))
    w = W.partitionBy(*keys, "seg").orderBy("_t", "x", "y")
    chain = marks.withColumns({"_nx": F.lead("x").over(w), "_ny": F.lead("y").over(w)}).filter("_nx is not null")
    gap = F.sqrt(sq(F.col("_nx") - F.col("x")) + sq(F.col("_ny") - F.col("y")))
    return chain.filter(gap > shortest).select(
        *keys, "seg", *extra, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("_nx").alias("x2"), F.col("_ny").alias("y2")
    )


def node_segments(segments: DataFrame, keys: list[str], size: float = 2.0) -> DataFrame:
    """Segments (keys, seg, x1..y2) split wherever they meet."""
    segments = settle(segments)
    return split_at(segments, crossings(segments, keys, size), keys)


def _half_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions of each edge with the half-edge that follows on its left."""
    flip = edges.select(*keys, F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    out = edges.select(*keys, *ENDS).unionByName(flip)
    out = out.withColumn("_a", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    w = W.partitionBy(*keys, "x1", "y1").orderBy("_a", "x2", "y2")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    target = F.struct("x2", "y2")
    before = F.coalesce(F.lag(target).over(w), F.last(target).over(whole))
    # Arriving along the reverse of an edge, the walk leaves by the edge before it.
    return out.select(
        *keys,
        F.struct(*keys, F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2")).alias("id"),
        F.struct(*keys, "x1", "y1", before["x2"].alias("x2"), before["y2"].alias("y2")).alias("nxt"),
    )


def _labelled(edges: DataFrame, keys: list[str]) -> DataFrame:
    ranked = rank_cycles(settle(_half_edges(edges, keys)))
    flip = F.struct(
        *[F.col(f"id.{k}").alias(k) for k in keys],
        F.col("id.x2").alias("x1"), F.col("id.y2").alias("y1"), F.col("id.x1").alias("x2"), F.col("id.y1").alias("y2"),
    )
    other = ranked.select(flip.alias("id"), F.col("cycle").alias("other"))
    return settle(ranked.join(other, "id"))


def half_edge_faces(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Half-edges (id, cycle, behind, other) of the arrangement without bridges.

    `cycle` names the face on the left, `other` the face on the right. An edge
    with one face on both sides (a dangling piece, or a link between two
    parts) bounds nothing and is dropped before the faces are walked again.
    """
    keys = list(keys)
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges = pieces.select(*keys, lo["x"].alias("x1"), lo["y"].alias("y1"), hi["x"].alias("x2"), hi["y"].alias("y2"))
    edges = settle(edges.filter("x1 <> x2 or y1 <> y2").distinct())
    found = _labelled(edges, keys)
    if found.filter("cycle = other").isEmpty():
        return found
    back = [F.col(f"id.{k}").alias(k) for k in [*keys, *ENDS]]
    proper = found.filter("cycle <> other").select(*back).filter(
        F.struct(F.col("x1"), F.col("y1")) < F.struct(F.col("x2"), F.col("y2"))
    )
    return _labelled(settle(proper), keys)


def faces(labelled: DataFrame, keys: list[str], holes: bool = False, min_area: float = 1e-4) -> DataFrame:
    """Bounded faces (keys, cell, ring, area), the ring counter-clockwise.

    With `holes`, `area` is net of the parts lying inside a face without
    touching its boundary, and `ring` stays the outer ring.
    """
    keys = list(keys)
    order = F.when(F.col("behind") == 0, F.lit(-(1 << 62))).otherwise(-F.col("behind"))
    cross = F.col("id.x1") * F.col("id.y2") - F.col("id.x2") * F.col("id.y1")
    rings = labelled.groupBy("cycle").agg(
        (F.sum(cross) / 2.0).alias("area"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("id.x1").alias("x"), F.col("id.y1").alias("y")))),
            lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")),
        ).alias("ring"),
    )
    rings = rings.select(*[F.col(f"cycle.{k}").alias(k) for k in keys], F.col("cycle").alias("cell"), "ring", "area")
    if not holes:
        return rings.filter(F.col("area") > min_area)
    rings = settle(rings)
    outer = rings.filter("area > 0")
    islands = rings.filter("area < 0").select(
        *keys, F.col("cell").alias("island"), F.col("area").alias("_a"), F.array_min("ring").alias("_p")
    ).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")
    held = tiles.points_in_rings(islands, outer, keys)
    held = held.filter(~F.exists("ring", lambda p: (p["x"] == F.col("x")) & (p["y"] == F.col("y"))))
    host = held.groupBy(*keys, "island").agg(F.min_by("cell", "area").alias("cell"), F.first("_a").alias("_a"))
    lost = host.groupBy(*keys, "cell").agg(F.sum("_a").alias("_hole"))
    out = outer.join(lost, [*keys, "cell"], "left").withColumn("area", F.col("area") + F.coalesce("_hole", F.lit(0.0)))
    return out.select(*keys, "cell", "ring", "area").filter(F.col("area") > min_area)


def polygonize(pieces: DataFrame, keys: list[str], holes: bool = False, min_area: float = 1e-4) -> DataFrame:
    """Bounded faces of noded pieces."""
    return faces(half_edge_faces(pieces, keys), keys, holes, min_area)
