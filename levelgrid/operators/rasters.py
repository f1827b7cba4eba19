"""Rasters as sparse cell tables, and preview samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.operators.normalize import SCAN
from levelgrid.session import attach, settle

# Raster pixel, margin, section height and half band, least image side.
PIXEL = 0.02
MARGIN = 1.0
SECTION = 1.20
SECTION_BAND = 0.15
SIDE_MIN = 32

LEVEL = ["scan_id", "level_index"]


def raster_frames(level_points: DataFrame, levels: DataFrame, keys=LEVEL) -> DataFrame:
    """Bounds plus a margin and the image size of every storey; an empty one is +-1 m."""
    keys = list(keys)
    box = level_points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    out = levels.join(box, keys, "left")
    zero = F.lit(0.0)
    out = out.withColumns(
        {
            "min_x": F.coalesce("x0", zero) - MARGIN,
            "min_y": F.coalesce("y0", zero) - MARGIN,
            "max_x": F.coalesce("x1", zero) + MARGIN,
            "max_y": F.coalesce("y1", zero) + MARGIN,
        }
    ).drop("x0", "y0", "x1", "y1")
    side = lambda a, b: F.greatest(F.lit(SIDE_MIN), F.ceil((F.col(b) - F.col(a)) / PIXEL)).cast("int")
    return out.withColumns({"width": side("min_x", "max_x"), "height": side("min_y", "max_y")})


def _raster(points: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    side = frames.select(*keys, "min_x", "max_y", "width", "height")
    out = attach(points.select(*keys, "x", "y"), side, keys)
    out = out.withColumns(
        {
            "col": F.floor((F.col("x") - F.col("min_x")) / PIXEL),
            "row": F.floor((F.col("max_y") - F.col("y")) / PIXEL),
        }
    )
    out = out.filter("col >= 0 and col < width and row >= 0 and row < height")
    return out.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("points"))


def density_raster(level_points: DataFrame, frames: DataFrame, keys=LEVEL) -> DataFrame:
    """Points per pixel seen from above."""
    return _raster(level_points, frames, list(keys))


def section_raster(level_points: DataFrame, frames: DataFrame, keys=LEVEL) -> DataFrame:
    """Points per pixel in a thin slice 1.20 m above the floor. Points carry `elevation`."""
    cut = level_points.filter(F.abs(F.col("z") - (F.col("elevation") + SECTION)) <= SECTION_BAND)
    return _raster(cut, frames, list(keys))


def stride_sample(points: DataFrame, cap: int = 500_000, id: str = "point_id", keys=SCAN) -> DataFrame:
    """Every ceil(n / cap)-th point of a scan in order of id, at most `cap` of them.

    Points are numbered within buckets of the id, so no task holds a whole scan.
    """
    keys = list(keys)
    count = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    count = count.withColumn("_step", F.greatest(F.lit(1), F.ceil(F.col("_n") / cap)).cast("long"))
    # Number within buckets of the id, then add the rows of the buckets before.
    bucketed = points.withColumn("_b", F.floor(F.col(id) / F.lit(1 << 16)))
    sizes = bucketed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = settle(sizes.withColumn("_before", F.coalesce(before, F.lit(0))).select(*keys, "_b", "_before"))
    order = W.partitionBy(*keys, "_b").orderBy(id)
    ranked = attach(bucketed.withColumn("_r", F.row_number().over(order) - 1), offsets, [*keys, "_b"])
    ranked = attach(ranked, count.select(*keys, "_step"), keys)
    place = F.col("_r") + F.col("_before")
    chosen = ranked.filter((place % F.col("_step") == 0) & (place / F.col("_step") < cap))
    return chosen.select(*points.columns)


def top_view(points: DataFrame, size: int, id: str = "point_id", keys=SCAN) -> DataFrame:
    """Coloured square view: 8 % pad, 3x3 splats, the last point wins a pixel."""
    keys = list(keys)
    box = points.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0))
    box = box.select(
        *keys, (span * 1.16).alias("_span"), ((F.col("x0") + F.col("x1")) / 2.0).alias("_mx"), ((F.col("y0") + F.col("y1")) / 2.0).alias("_my")
    )
    p = attach(points, box, keys)
    inside = lambda v: F.least(F.lit(size - 1), F.greatest(F.lit(0), v)).cast("int")
    px = inside(F.floor((F.col("x") - (F.col("_mx") - F.col("_span") / 2.0)) / F.col("_span") * (size - 1)))
    py = inside(F.floor(((F.col("_my") + F.col("_span") / 2.0) - F.col("y")) / F.col("_span") * (size - 1)))
    p = p.select(*keys, F.col(id).alias("_id"), px.alias("_px"), py.alias("_py"), F.struct("r", "g", "b").alias("_rgb"))
    # Splats are drawn offset by offset, so a later offset covers an earlier one.
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dy, dx) in enumerate((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))])
    p = p.withColumn("_o", F.explode(offsets))
    p = p.withColumns({"col": inside(F.col("_px") + F.col("_o.dx")), "row": inside(F.col("_py") + F.col("_o.dy"))})
    top = p.groupBy(*keys, "row", "col").agg(F.max_by("_rgb", F.struct(F.col("_o.k"), F.col("_id"))).alias("_c"))
    return top.select(*keys, "row", "col", "_c.r", "_c.g", "_c.b")
