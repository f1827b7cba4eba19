"""Fixtures and furniture from the points no structure explains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelgrid.functions import geometry as g
from levelgrid.functions import hulls, tiles
from levelgrid.functions.numbering import number_rows
from levelgrid.operators.openings import away_from_walls, column_ring
from levelgrid.operators.surfaces import LEVEL
from levelgrid.session import attach, settle

# Symbol, role, then the least and greatest width, depth and height in metres.
BOX_RULES = [
    ("toilet", "fixture", 0.35, 0.45, 0.60, 0.80, 0.35, 0.55),
    ("sink", "fixture", 0.40, 0.80, 0.35, 0.55, 0.10, 0.25),
    ("bathtub", "fixture", 0.70, 0.90, 1.40, 1.90, 0.40, 0.60),
    ("shower", "fixture", 0.70, 1.20, 0.70, 1.20, 0.05, 0.30),
    ("kitchen-counter", "fixture", 1.20, 1.0e9, 0.50, 0.70, 0.80, 1.00),
    ("stove", "fixture", 0.55, 0.65, 0.55, 0.65, 0.85, 1.00),
    ("bed-double", "furniture", 1.30, 2.00, 1.90, 2.20, 0.40, 0.70),
    ("sofa", "furniture", 0.80, 1.10, 1.40, 2.80, 0.70, 1.00),
    ("table", "furniture", 0.60, 1.40, 0.60, 2.20, 0.65, 0.80),
    ("wardrobe", "furniture", 0.80, 1.0e9, 0.50, 0.70, 1.80, 2.40),
]
RULE_SCHEMA = "symbol string, role string, w_min double, w_max double, d_min double, d_max double, h_min double, h_max double"


def box_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOX_RULES, RULE_SCHEMA)


def clear_of_rings(points: DataFrame, rings: DataFrame, pad: float, keys: list[str]) -> DataFrame:
    """Points neither in a ring nor within `pad` of it."""
    box = g.ring_bounds(F.col("ring"))
    tiled = tiles.tile_box(rings.select(*keys, "ring"), box["min_x"] - pad, box["min_y"] - pad, box["max_x"] + pad, box["max_y"] + pad, 1.0).alias("s")
    left = tiles.tile_points(points, "x", "y", 1.0).alias("p")
    p = g.xy("p.x", "p.y")
    on = g.point_in_ring(p, F.col("s.ring")) | (g.distance_to_ring(p, F.col("s.ring")) <= pad + 1e-9)
    for k in [*keys, *tiles.TILE]:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    return left.join(tiled, on, "left_anti").drop(*tiles.TILE)


def residual_points(level_points: DataFrame, levels: DataFrame, walls: DataFrame, columns: DataFrame | None = None, stairs: DataFrame | None = None, keys=LEVEL, least: int = 15) -> DataFrame:
    """Upright points of a storey clear of walls, columns and stairs."""
    keys = list(keys)
    p = attach(level_points.select(*keys, "x", "y", "z", "nz"), levels.select(*keys, F.col("elevation").alias("_e"), F.col("ceiling_height").alias("_c")), keys)
    p = p.filter(
        (F.col("z") >= F.col("_e") - 0.05) & (F.col("z") <= F.col("_e") + F.col("_c") + 0.05) & (F.abs(F.col("nz")) <= math.sin(math.radians(20.0)))
    ).select(*keys, "x", "y", "z")
    p = away_from_walls(p, walls, 0.12, 0.1, keys)
    if columns is not None:
        p = clear_of_rings(p, column_ring(columns), 0.08, keys)
    if stairs is not None:
        p = clear_of_rings(p, stairs.select(*keys, F.col("outline").alias("ring")), 0.08, keys)
    p = settle(p)
    enough = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)
    return p.join(enough, keys, "left_semi")


def thin(points: DataFrame, size: float = 0.05, id: str | None = None, keys=LEVEL) -> DataFrame:
    """The first point (by id, else by position) of every voxel."""
    keys = list(keys)
    rest = [c for c in points.columns if c not in keys]
    order = F.struct(*([id] if id else ["x", "y", "z"]))
    cells = points.groupBy(*keys, *[tiles.cell(c, size).alias(f"v{c}") for c in "xyz"])
    return cells.agg(F.min_by(F.struct(*rest), order).alias("_p")).select(*keys, "vx", "vy", "vz", *[F.col(f"_p.{c}").alias(c) for c in rest])


def cluster_points(points: DataFrame, eps: float = 0.15, keys=LEVEL, least: int = 12, span: float = 0.30) -> DataFrame:
    """Thinned points with their single-linkage cluster; small clusters are dropped."""
    keys = list(keys)
    at = ["x", "y", "z"]
    part, names = tiles.eps_parts(points, keys, at, eps)
    # A part that is linked over no border is a cluster; the others are put together by their sizes and boxes.
    box = [f(c).alias(n) for c in "xy" for f, n in ((F.min, f"_0{c}"), (F.max, f"_1{c}"))]
    shared = tiles.with_names(part.select("_part", "_open", "x", "y"), names).filter(F.col("component").isNotNull())
    parts = settle(shared.groupBy("_part").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("_m"), *box))
    whole = parts.groupBy("component").agg(F.sum("_m").alias("_m"), *[(F.max(f"_1{c}") - F.min(f"_0{c}")).alias(f"_s{c}") for c in "xy"])
    rows = tiles.with_names(part, settle(parts.select("_part", "component").join(whole, "component")))
    named = F.col("component").isNotNull()
    wide = lambda i, c: F.when(named, F.col(f"_s{c}")).otherwise(F.col("_high")[i] - F.col("_low")[i])
    good = (F.coalesce("_m", "_n") >= least) & ((wide(0, "x") >= span) | (wide(1, "y") >= span))
    return rows.filter(good).select(F.coalesce("component", tiles.closed_name(keys, at)).alias("cluster"), *points.columns)


def cluster_height(clusters: DataFrame, level_points: DataFrame, levels: DataFrame, keys=LEVEL) -> DataFrame:
    """(keys, cluster, height): extent in z of all the points over a cluster's box."""
    keys = list(keys)
    box = clusters.groupBy(*keys, "cluster").agg(
        (F.min("x") - 0.02).alias("x0"), (F.max("x") + 0.02).alias("x1"), (F.min("y") - 0.02).alias("y0"), (F.max("y") + 0.02).alias("y1"),
        F.min("z").alias("low"), F.max("z").alias("high"),
    )
    box = settle(box.join(levels.select(*keys, (F.col("elevation") + F.col("ceiling_height") - 0.20).alias("_top")), keys))
    tiled = tiles.tile_box(box, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 1.0)
    hits = tiles.tile_points(level_points.select(*keys, "x", "y", "z"), "x", "y", 1.0).join(tiled, [*keys, *tiles.TILE])
    hits = hits.filter(
        F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
        & (F.col("z") >= F.col("low") - 0.08) & (F.col("z") <= F.least("_top", F.col("high") + 0.12))
    )
    tall = hits.groupBy(*keys, "cluster").agg((F.max("z") - F.min("z")).alias("_h"))
    return box.join(tall, [*keys, "cluster"], "left").select(*keys, "cluster", F.coalesce("_h", F.col("high") - F.col("low")).alias("height"))


def _fits(v: Column, low: str, high: str) -> Column:
    return (v >= F.col(low) - 1e-6) & (v <= F.col(high) + 1e-6)


def _middle(low: str, high: str, measured: Column) -> Column:
    return F.when(F.col(high) >= 1.0e8, F.greatest(F.col(low), measured)).otherwise((F.col(low) + F.col(high)) / 2.0)


def _area_gap(w: Column, d: Column) -> Column:
    return F.abs(w * d - _middle("w_min", "w_max", w) * _middle("d_min", "d_max", d))


def classify_boxes(boxes: DataFrame, rules: DataFrame | None = None, keys=("box_id",)) -> DataFrame:
    """Symbol, role, confidence and the width and depth that matched.

    `boxes` has keys, width, depth, height. The rule table is ten fixed rows,
    so it is broadcast and each box takes its least area distance by one
    aggregate.
    """
    keys = list(keys)
    rules = box_rules(boxes.sparkSession) if rules is None else rules
    rules = rules.withColumn("_o", F.monotonically_increasing_id())
    w, d = F.col("width"), F.col("depth")
    height = (F.col("height") >= F.col("h_min")) & (F.col("height") <= F.col("h_max"))
    direct = _fits(w, "w_min", "w_max") & _fits(d, "d_min", "d_max")
    swapped = _fits(d, "w_min", "w_max") & _fits(w, "d_min", "d_max")
    hits = boxes.join(F.broadcast(rules), height & (direct | swapped))
    turn = swapped & (~direct | (_area_gap(d, w) < _area_gap(w, d)))
    hits = hits.withColumns({"_w": F.when(turn, d).otherwise(w), "_d": F.when(turn, w).otherwise(d)})
    best = hits.groupBy(*keys).agg(
        F.min_by(F.struct("symbol", "role", "_w", "_d"), F.struct(_area_gap(F.col("_w"), F.col("_d")).alias("g"), F.col("_o"))).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
    )
    out = boxes.join(best, keys, "left")
    return out.select(
        *[c for c in boxes.columns if c not in ("width", "depth")],
        F.coalesce(F.col("_b.symbol"), F.lit("block")).alias("symbol"), F.coalesce(F.col("_b.role"), F.lit("furniture")).alias("role"),
        F.when(F.col("_n").isNull(), 0.3).when(F.col("_n") == 1, 0.8).otherwise(F.lit(0.5)).alias("confidence"),
        F.coalesce(F.col("_b._w"), w).alias("width"), F.coalesce(F.col("_b._d"), d).alias("depth"),
    )


def near_wall(boxes: DataFrame, walls: DataFrame, keys=LEVEL) -> DataFrame:
    """Boxes (x, y) whose centre lies on no wall."""
    return away_from_walls(boxes, walls, 0.05, 0.05, keys)


def detect_fixtures(level_points: DataFrame, levels: DataFrame, walls: DataFrame, columns=None, stairs=None, keys=LEVEL) -> DataFrame:
    """Fixture rows of every storey."""
    keys = list(keys)
    rest = thin(residual_points(level_points, levels, walls, columns, stairs, keys), 0.05, keys=keys)
    clusters = settle(cluster_points(rest, keys=keys))
    rect = hulls.rotated_rectangle(hulls.convex_hull(clusters, [*keys, "cluster"]), [*keys, "cluster"])
    tall = cluster_height(clusters, level_points, levels, keys)
    boxes = settle(rect.join(tall, [*keys, "cluster"]).withColumns({"edge_w": F.col("width"), "edge_d": F.col("depth")}))
    named = near_wall(classify_boxes(boxes, keys=[*keys, "cluster"]), walls, keys).filter("width > 0 and depth > 0")
    straight = F.abs(F.col("width") - F.col("edge_w")) <= F.abs(F.col("width") - F.col("edge_d"))
    named = number_rows(named, keys, ["cluster"], "_n")
    return named.select(
        *keys, F.concat(F.lit("f"), "_n").alias("fixture_id"), "symbol", "x", "y",
        F.when(straight, F.col("angle")).otherwise(F.col("angle") + 90.0).alias("rotation_deg"), "width", "depth", "confidence", "role",
    )
