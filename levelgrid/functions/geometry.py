"""Plan geometry as column expressions. Y is up; nothing here runs in Python per row."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
RING_TYPE = "array<struct<x:double,y:double>>"


class P(NamedTuple):
    """A 2-D point made of two columns."""

    x: Column
    y: Column


def num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def sq(c: Column) -> Column:
    """A product: cheaper in generated code than a power."""
    return c * c


def xy(x, y) -> P:
    """A point from two column names or columns."""
    return P(F.col(x) if isinstance(x, str) else num(x), F.col(y) if isinstance(y, str) else num(y))


def pt(column) -> P:
    column = F.col(column) if isinstance(column, str) else column
    return P(column["x"], column["y"])


def point_struct(p: P) -> Column:
    return F.struct(p.x.alias("x"), p.y.alias("y"))


def add(a: P, b: P) -> P:
    return P(a.x + b.x, a.y + b.y)


def sub(a: P, b: P) -> P:
    return P(a.x - b.x, a.y - b.y)


def mul(a: P, scale) -> P:
    return P(a.x * scale, a.y * scale)


def dot(a: P, b: P) -> Column:
    return a.x * b.x + a.y * b.y


def cross(a: P, b: P) -> Column:
    return a.x * b.y - a.y * b.x


def norm(a: P) -> Column:
    return F.sqrt(a.x * a.x + a.y * a.y)


def dist(a: P, b: P) -> Column:
    return norm(sub(a, b))


def unit(a: P) -> P:
    length = norm(a)
    return P(
        F.when(length == 0, 0.0).otherwise(a.x / length),
        F.when(length == 0, 0.0).otherwise(a.y / length),
    )


def left(d: P) -> P:
    return P(-d.y, d.x)


def right(d: P) -> P:
    return P(d.y, -d.x)


def rotate(d: P, degrees) -> P:
    angle = num(degrees) * F.lit(math.pi) / F.lit(180.0)
    c, s = F.cos(angle), F.sin(angle)
    return P(d.x * c - d.y * s, d.x * s + d.y * c)


def same_point(a: P, b: P, eps: float = EPS) -> Column:
    return (F.abs(a.x - b.x) <= eps) & (F.abs(a.y - b.y) <= eps)


def lerp(a: P, b: P, t) -> P:
    return add(a, mul(sub(b, a), t))


def line_param(origin: P, direction: P, other: P, other_direction: P) -> Column:
    """Parameter along the first line where the two lines meet; NULL when parallel."""
    denominator = cross(direction, other_direction)
    return F.when(
        F.abs(denominator) >= EPS, cross(sub(other, origin), other_direction) / denominator
    )


def line_intersect(origin: P, direction: P, other: P, other_direction: P) -> P:
    t = line_param(origin, direction, other, other_direction)
    return add(origin, mul(direction, t))


def segment_params(a: P, b: P, c: P, d: P) -> tuple[Column, Column]:
    """Parameters (t, u) where two segments meet; both NULL when they do not."""
    ab, cd = sub(b, a), sub(d, c)
    t = line_param(a, ab, c, cd)
    u = F.when(F.abs(cross(ab, cd)) >= EPS, cross(sub(c, a), ab) / cross(ab, cd))
    meets = (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS)
    return F.when(meets, t), F.when(meets, u)


def foot_param(p: P, a: P, b: P) -> Column:
    delta = sub(b, a)
    length2 = dot(delta, delta)
    return F.when(length2 != 0, dot(sub(p, a), delta) / length2)


def distance_to_segment(p: P, a: P, b: P) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(foot_param(p, a, b), F.lit(0.0))))
    return dist(p, lerp(a, b, t))


def joint_angle_deg(vertex: P, left_point: P, right_point: P) -> Column:
    cosine = dot(unit(sub(left_point, vertex)), unit(sub(right_point, vertex)))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def js_round(value: Column) -> Column:
    """Half toward plus infinity."""
    return F.floor(value + 0.5)


def axis_delta_deg(dx: Column, dy: Column) -> Column:
    """Angle to the nearest axis, 0 to 45 degrees."""
    angle = F.pmod(F.abs(F.degrees(F.atan2(dy, dx))), F.lit(90.0))
    return F.least(angle, 90.0 - angle)


# Rings: arrays of {x, y}, not closed.


def ring_next(ring: Column) -> Column:
    """The ring shifted by one, so that zipping gives its edges."""
    return F.concat(
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1))
    )


def ring_edges(ring: Column) -> Column:
    return F.zip_with(
        ring,
        ring_next(ring),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def ring_area(ring: Column) -> Column:
    crosses = F.zip_with(ring, ring_next(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(crosses, F.lit(0.0), lambda total, c: total + c) / 2.0


def ring_centroid(ring: Column) -> P:
    """Mean of the vertices."""
    count = F.size(ring)
    x = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["x"])
    y = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["y"])
    return P(F.when(count > 0, x / count).otherwise(0.0), F.when(count > 0, y / count).otherwise(0.0))


def dedupe_ring(ring: Column) -> Column:
    """Drop points equal to the one before them, and a last one equal to the first."""

    def keep(out, p):
        last = F.element_at(out, -1)
        repeated = (F.size(out) > 0) & same_point(pt(last), pt(p))
        return F.when(repeated, out).otherwise(F.concat(out, F.array(p)))

    empty = F.slice(ring, F.lit(1), F.lit(0))
    out = F.aggregate(ring, empty, keep)
    closed = (F.size(out) > 1) & same_point(pt(F.element_at(out, 1)), pt(F.element_at(out, -1)))
    return F.when(closed, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)


def point_in_ring(p: P, ring: Column) -> Column:
    """Even-odd rule, half-open in y."""

    def hit(inside, e):
        crosses = (e["y1"] > p.y) != (e["y2"] > p.y)
        x = (e["x2"] - e["x1"]) * (p.y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return inside != F.coalesce(crosses & (p.x < x), F.lit(False))

    return F.aggregate(ring_edges(ring), F.lit(False), hit)


def distance_to_ring(p: P, ring: Column) -> Column:
    gaps = F.transform(
        ring_edges(ring), lambda e: distance_to_segment(p, P(e["x1"], e["y1"]), P(e["x2"], e["y2"]))
    )
    return F.array_min(gaps)


def closest_on_ring(p: P, ring: Column) -> P:
    """Nearest boundary point; the first edge wins a tie."""

    def candidate(e, i):
        a, b = P(e["x1"], e["y1"]), P(e["x2"], e["y2"])
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(foot_param(p, a, b), F.lit(0.0))))
        q = lerp(a, b, t)
        return F.struct(dist(p, q).alias("gap"), i.alias("i"), q.x.alias("x"), q.y.alias("y"))

    best = F.array_min(F.transform(ring_edges(ring), candidate))
    return P(best["x"], best["y"])


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return {
        "min_x": F.array_min(xs),
        "min_y": F.array_min(ys),
        "max_x": F.array_max(xs),
        "max_y": F.array_max(ys),
    }


def clip_half_plane(ring: Column, origin: P, normal: P) -> Column:
    """The part of a convex ring with (p - origin) . normal >= 0."""

    def side(x, y):
        return (x - origin.x) * normal.x + (y - origin.y) * normal.y

    def part(e):
        sa, sb = side(e["x1"], e["y1"]), side(e["x2"], e["y2"])
        t = sa / F.nullif(sa - sb, F.lit(0.0))
        start = F.struct(e["x1"].alias("x"), e["y1"].alias("y"))
        cut = F.struct(
            (e["x1"] + (e["x2"] - e["x1"]) * t).alias("x"), (e["y1"] + (e["y2"] - e["y1"]) * t).alias("y")
        )
        none = F.slice(F.array(start), F.lit(1), F.lit(0))
        crossing = ((sa >= 0) & (sb < 0)) | ((sa < 0) & (sb >= 0))
        return F.concat(F.when(sa >= 0, F.array(start)).otherwise(none), F.when(crossing, F.array(cut)).otherwise(none))

    return F.flatten(F.transform(ring_edges(ring), part))


def clip_convex(subject: Column, clipper: Column) -> Column:
    """A convex subject ring cut by a convex counter-clockwise clipper ring."""

    def cut(ring, e):
        a, b = P(e["x1"], e["y1"]), P(e["x2"], e["y2"])
        return clip_half_plane(ring, a, left(sub(b, a)))

    return F.aggregate(ring_edges(clipper), subject, cut)


def counter_clockwise(ring: Column) -> Column:
    return F.when(ring_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def rotated_box(center: P, width, depth, degrees) -> Column:
    """Ring of a box turned about its centre, counter-clockwise."""
    hx, hy = num(width) / 2.0, num(depth) / 2.0
    corners = [(1, 1), (-1, 1), (-1, -1), (1, -1)]
    u = rotate(P(F.lit(1.0), F.lit(0.0)), degrees)
    v = left(u)
    return F.array(*[point_struct(add(center, add(mul(u, hx * sx), mul(v, hy * sy)))) for sx, sy in corners])


def with_interior_point(df: DataFrame, ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """Adds a point inside the ring: the middle of the widest stretch of a scanline halfway up.

    The steps are columns of their own, so that none is repeated inside another.
    """
    ys = F.array_sort(F.array_distinct(F.transform(F.col(ring), lambda p: p["y"])))
    out = df.withColumn("_ys", ys).withColumn("_mid", (F.element_at("_ys", 1) + F.element_at("_ys", -1)) / 2.0)
    # A scanline through a vertex would be counted twice: move it off to the next gap.
    below = F.array_max(F.filter("_ys", lambda v: v <= F.col("_mid")))
    above = F.array_min(F.filter("_ys", lambda v: v > F.col("_mid")))
    out = out.withColumn("_line", (below + above) / 2.0)
    line = F.col("_line")
    crossing = lambda e: e["x1"] + (e["x2"] - e["x1"]) * (line - e["y1"]) / (e["y2"] - e["y1"])
    cut = F.filter(ring_edges(F.col(ring)), lambda e: (e["y1"] > line) != (e["y2"] > line))
    out = out.withColumn("_hits", F.array_sort(F.transform(cut, crossing)))
    hits = F.col("_hits")
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(hits) / 2, F.lit(1)).cast("int")),
        lambda i: F.struct(
            (F.get(hits, 2 * i - 1) - F.get(hits, 2 * i - 2)).alias("w"),
            ((F.get(hits, 2 * i - 1) + F.get(hits, 2 * i - 2)) / 2.0).alias("x"),
        ),
    )
    return out.withColumns({x: F.array_max(pairs)["x"], y: line}).drop("_ys", "_mid", "_line", "_hits")


def clean(value: Column, digits: int = 6) -> Column:
    """Round a result and turn minus zero into zero."""
    return F.round(value, digits) + F.lit(0.0)
