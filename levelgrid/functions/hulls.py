"""Convex hulls and least rotated rectangles of point groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.functions import geometry as g
from levelgrid.session import attach, settle


def _half(points):
    """One half of the monotone chain over points sorted by (x, y)."""

    def turn(a, b, c):
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def push(chain, p):
        # Points that no longer make a left turn leave the end of the chain: keep
        # the longest prefix whose last edge turns left into p.
        n = F.size(chain)
        keep = F.filter(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: (i == 1) | (turn(F.get(chain, i - 2), F.get(chain, i - 1), p) > 0),
        )
        return F.concat(F.slice(chain, F.lit(1), F.array_max(keep)), F.array(p))

    first = F.slice(points, F.lit(1), F.lit(1))
    rest = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    return F.aggregate(rest, first, push)


def convex_hull(points: DataFrame, keys: list[str], chunk: int = 2048) -> DataFrame:
    """(keys, hull): counter-clockwise convex hull ring of each group.

    A group is never gathered whole. A point inside the polygon of the
    extreme points in sixteen directions cannot be on the hull, so one
    aggregate finds these extremes and a filter drops everything inside them.
    What is left is cut into chunks by hash and each chunk is replaced by its
    own hull, again and again, until a group fits in one chunk or no longer
    shrinks because it is the hull.
    """
    keys = list(keys)
    dirs = 16
    p = points.select(*keys, "x", "y")
    far = [
        F.max_by(F.struct("x", "y"), F.col("x") * math.cos(2 * math.pi * i / dirs) + F.col("y") * math.sin(2 * math.pi * i / dirs)).alias(f"d{i}")
        for i in range(dirs)
    ]
    outer = p.groupBy(*keys).agg(*far)
    # Extremes in turning order form a convex ring; equal neighbours are dropped.
    outer = settle(outer.select(*keys, g.dedupe_ring(F.array(*[F.col(f"d{i}") for i in range(dirs)])).alias("_ring")))
    q = attach(p, outer, keys)
    inside = F.forall(
        g.ring_edges(F.col("_ring")),
        lambda e: (e["x2"] - e["x1"]) * (F.col("y") - e["y1"]) - (e["y2"] - e["y1"]) * (F.col("x") - e["x1"]) > 1e-12,
    ) & (F.size("_ring") >= 3)
    # Of the points with one x only the lowest and the highest can be corners.
    q = q.filter(~inside).groupBy(*keys, "x").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    ends = F.array_distinct(F.array(F.struct("x", F.col("y0").alias("y")), F.struct("x", F.col("y1").alias("y"))))
    left = settle(q.select(*keys, F.explode(ends).alias("p")))
    last = None
    for _ in range(12):
        sizes = settle(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
        biggest = sizes.agg(F.max("_n")).first()[0] or 0
        if biggest <= chunk or (last is not None and biggest > 0.9 * last):
            break
        last = biggest
        mark = F.pmod(F.xxhash64("p"), F.ceil(F.col("_n") / chunk))
        part = attach(left, sizes, keys).groupBy(*keys, mark.alias("_s")).agg(F.array_sort(F.collect_set("p")).alias("_p"))
        left = settle(part.select(*keys, F.explode(_ring("_p")).alias("p")))
    whole = left.groupBy(*keys).agg(F.array_sort(F.collect_set("p")).alias("_p"))
    return whole.select(*keys, _ring("_p").alias("hull"))


def _ring(column: str):
    points = F.col(column)
    lower = _half(points)
    upper = _half(F.reverse(points))
    joined = F.concat(
        F.slice(lower, F.lit(1), F.greatest(F.size(lower) - 1, F.lit(0))), F.slice(upper, F.lit(1), F.greatest(F.size(upper) - 1, F.lit(0)))
    )
    return F.when(F.size(points) < 3, points).otherwise(joined)


def rotated_rectangle(hulls: DataFrame, keys: list[str], hull: str = "hull") -> DataFrame:
    """Least-area rectangle on a hull edge: width along the edge, depth, angle, centre.

    Groups whose hull has no area give no row.
    """
    keys = list(keys)
    h = hulls.withColumn("_e", F.explode(g.ring_edges(F.col(hull))))
    dx, dy = F.col("_e.x2") - F.col("_e.x1"), F.col("_e.y2") - F.col("_e.y1")
    length = F.sqrt(dx * dx + dy * dy)
    size = F.nullif(length, F.lit(0.0))
    h = h.filter(length > 0).withColumns({"_ux": dx / size, "_uy": dy / size})
    us = F.transform(F.col(hull), lambda p: p["x"] * F.col("_ux") + p["y"] * F.col("_uy"))
    vs = F.transform(F.col(hull), lambda p: p["y"] * F.col("_ux") - p["x"] * F.col("_uy"))
    h = h.withColumns({"_u0": F.array_min(us), "_u1": F.array_max(us), "_v0": F.array_min(vs), "_v1": F.array_max(vs)})
    w, d = F.col("_u1") - F.col("_u0"), F.col("_v1") - F.col("_v0")
    mu, mv = (F.col("_u0") + F.col("_u1")) / 2.0, (F.col("_v0") + F.col("_v1")) / 2.0
    angle = F.degrees(F.atan2("_uy", "_ux"))
    box = F.struct(
        F.round(w * d, 12).alias("area"), F.abs(angle).alias("turn"), angle.alias("angle"), w.alias("width"), d.alias("depth"),
        (mu * F.col("_ux") - mv * F.col("_uy")).alias("x"), (mu * F.col("_uy") + mv * F.col("_ux")).alias("y"),
    )
    best = h.groupBy(*keys).agg(F.min(box).alias("_b")).filter("_b.width >= 1e-3 and _b.depth >= 1e-3")
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in ("width", "depth", "angle", "x", "y")])
