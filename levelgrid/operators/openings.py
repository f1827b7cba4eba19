"""Openings, columns and stairs of drafted storeys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import geometry as g
from levelgrid.functions import hulls, tiles, words
from levelgrid.functions.numbering import number_rows
from levelgrid.operators.normalize import SIN15
from levelgrid.operators.surfaces import LEVEL, face_issues
from levelgrid.session import attach, dealt, settle
from levelgrid.functions.geometry import sq

# Raster cell and thresholds in metres, cells and degrees.
CELL = 0.02
EDGE = 0.05
MIN_CELLS = 18
GROUP_JUMP = 4
LOW_RATIO = 0.70
STAIR_LOW = 20.0
STAIR_HIGH = 45.0
RISER = 0.18


def wall_frames(walls: DataFrame, levels: DataFrame, keys=LEVEL, shortest: float = 0.5) -> DataFrame:
    """Walls long enough to hold openings, with raster size and storey heights."""
    keys = list(keys)
    w = walls.join(levels.select(*keys, "elevation", "ceiling_height"), keys)
    length = F.sqrt(sq(F.col("x2") - F.col("x1")) + sq(F.col("y2") - F.col("y1")))
    w = w.withColumns({"length": length, "z0": F.col("elevation") + EDGE, "z1": F.col("elevation") + F.col("ceiling_height") - EDGE})
    w = w.filter((F.col("length") >= shortest) & (F.col("z1") > F.col("z0")))
    size = lambda v: F.greatest(F.lit(1), F.ceil(v / CELL)).cast("int")
    return w.select(
        *keys, "wall_id", "x1", "y1", "x2", "y2", "thickness", "length", "elevation", "ceiling_height", "z0", "z1",
        size(F.col("length")).alias("cols"), size(F.col("z1") - F.col("z0")).alias("rows"),
    )


def project_to_walls(points: DataFrame, frames: DataFrame, keys=LEVEL) -> DataFrame:
    """(keys, wall_id, u, z) of the points in each wall's band."""
    keys = list(keys)
    a, b, p = g.xy("x1", "y1"), g.xy("x2", "y2"), g.xy("x", "y")
    d = g.sub(b, a)
    u = g.dot(g.sub(p, a), d) / F.col("length")
    off = F.abs(g.cross(d, g.sub(p, a))) / F.col("length")
    keep = (off <= F.col("thickness") / 2.0 + EDGE) & (u >= -0.02) & (u <= F.col("length") + 0.02) & (F.col("z") >= F.col("z0")) & (F.col("z") <= F.col("z1"))
    side = frames.select(*keys, "wall_id", "x1", "y1", "x2", "y2", "thickness", "length", "z0", "z1", "cols", "rows")
    hits = tiles.near_segments(points.select(*keys, "x", "y", "z"), side, keys, F.col("thickness") / 2.0 + 0.1, keep)
    return hits.select(*keys, "wall_id", u.alias("u"), "z", "z0", "cols", "rows")


def elevation_raster(projected: DataFrame, keys=LEVEL, least: int = 2, every: bool = False) -> DataFrame:
    """Solid cells: at least two points, rows and columns clipped to the wall.

    With `every`, all cells that hold a point, and whether they are `solid`.
    """
    keys = list(keys)
    clip = lambda v, n: F.least(F.col(n) - 1, F.greatest(F.lit(0), F.floor(v / CELL))).cast("int")
    cells = projected.select(
        *keys, "wall_id", clip(F.col("z") - F.col("z0"), "rows").alias("row"), clip(F.col("u"), "cols").alias("col")
    )
    cells = cells.groupBy(*keys, "wall_id", "row", "col").agg(F.count(F.lit(1)).alias("points"))
    solid = F.col("points") >= least
    return cells.withColumn("solid", solid) if every else cells.filter(solid)


def elevation_runs_mesh(triangles: DataFrame, frames: DataFrame, keys=LEVEL, by=None) -> DataFrame:
    """Solid runs (row, c0, c1) of the triangles that lie wholly inside a wall's band.

    `triangles` has keys, ax..cz. Each triangle is filled row by row as one run. Triangles, not runs, are shuffled: they
    are dealt by wall (columns `by`), and the runs of a wall stay in one task.
    """
    keys = list(keys)
    by = list(by or [*keys, "wall_id"])
    a, b = g.xy("x1", "y1"), g.xy("x2", "y2")
    d = g.sub(b, a)
    corners = {c: g.xy(f"{c}x", f"{c}y") for c in "abc"}
    u = {c: g.dot(g.sub(p, a), d) / F.col("length") for c, p in corners.items()}
    off = {c: F.abs(g.cross(d, g.sub(p, a))) / F.col("length") for c, p in corners.items()}
    side = frames.select(*keys, "wall_id", "x1", "y1", "x2", "y2", "thickness", "length", "z0", "z1", "cols", "rows")
    band = F.col("thickness") / 2.0 + EDGE
    # Each triangle is sent to the tiles of its own box; a pair met twice is dropped below.
    lo = lambda n: F.least(*[F.col(f"{c}{n}") for c in "abc"])
    hi = lambda n: F.greatest(*[F.col(f"{c}{n}") for c in "abc"])
    tri = triangles.withColumn("_t", F.xxhash64(*[f"{c}{n}" for c in "abc" for n in "xyz"]))
    tri = tiles.tile_box(tri, lo("x"), lo("y"), hi("x"), hi("y"), 2.0)
    walls = tiles.tile_segment(side, a, b, F.col("thickness") / 2.0 + 0.1, 2.0)
    m = tri.join(walls, [*keys, *tiles.TILE])
    m = m.filter(
        (F.greatest(*off.values()) <= band) & (F.greatest(*u.values()) >= -0.05) & (F.least(*u.values()) <= F.col("length") + 0.05)
        & (hi("z") >= F.col("z0")) & (lo("z") <= F.col("z1"))
    ).repartition(dealt(triangles.sparkSession), *by).dropDuplicates([*keys, "wall_id", "_t"])
    # Corners from the lowest to the highest: a row meets the long side and one of the short ones. They are sorted before the
    # rows are laid out, as what is done for each row must stay small enough for the JVM to compile.
    at = lambda c: F.struct(F.rint((F.col(f"{c}z") - F.col("z0")) / CELL).cast("int").alias("v"), F.rint(u[c] / CELL).cast("int").alias("u"))
    m = m.select(*keys, "wall_id", "cols", "rows", F.array_sort(F.array(*[at(c) for c in "abc"])).alias("_p"))
    m = m.select(*keys, "wall_id", "cols", "rows", *[F.col("_p")[i][n].alias(f"{n}{i}") for i in range(3) for n in "vu"])
    low, high = F.greatest(F.lit(0), F.col("v0")), F.least(F.col("rows") - 1, F.col("v2"))
    m = m.filter(low <= high).withColumn("row", F.explode(F.sequence(low, high)))
    side = lambda i, j: F.col(f"u{i}") + (F.col(f"u{j}") - F.col(f"u{i}")) * (F.col("row") - F.col(f"v{i}")) / (F.col(f"v{j}") - F.col(f"v{i}"))
    flat = F.col("v0") == F.col("v2")
    m = m.withColumns(
        {
            "_l": F.when(flat, F.col("u0")).otherwise(side(0, 2)),
            "_s": F.when(flat, F.col("u2")).when(F.col("row") < F.col("v1"), side(0, 1)).when(F.col("row") > F.col("v1"), side(1, 2)).otherwise(F.col("u1")),
        }
    )
    c0 = F.greatest(F.lit(0), F.floor(F.least("_l", "_s") + 0.5)).cast("int")
    c1 = F.least(F.col("cols") - 1, F.floor(F.greatest("_l", "_s") + 0.5)).cast("int")
    return m.select(*keys, "wall_id", "row", c0.alias("c0"), c1.alias("c1")).filter("c0 <= c1")


def elevation_raster_mesh(triangles: DataFrame, frames: DataFrame, keys=LEVEL) -> DataFrame:
    """Solid cells of the triangles in each wall's band.

    Runs that overlap are cut where the ones before them end, so runs are shuffled and each cell is laid out once.
    """
    keys = list(keys)
    runs = elevation_runs_mesh(triangles, frames, keys)
    w = W.partitionBy(*keys, "wall_id", "row").orderBy("c0", "c1").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest("c0", F.coalesce(F.max("c1").over(w) + 1, F.col("c0")))
    runs = runs.withColumn("c0", fresh).filter("c0 <= c1")
    return runs.select(*keys, "wall_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def empty_runs(runs: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    """Empty runs (keys, row, c0, c1): the gaps between the solid runs (row, c0, c1) of every row."""
    keys = list(keys)
    marks = dims.select(*keys, "rows", "cols").repartition(dealt(dims.sparkSession), *keys)
    rows = marks.select(*keys, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.col("cols").alias("c0"), F.col("cols").alias("c1"))
    w = W.partitionBy(*keys, "row").orderBy("c0", "c1")
    seen = F.coalesce(F.max("c1").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))
    gaps = runs.select(*keys, "row", "c0", "c1").unionByName(rows).withColumn("_s", seen + 1).filter(F.col("c0") > F.col("_s"))
    return gaps.select(*keys, "row", F.col("_s").alias("c0"), (F.col("c0") - 1).alias("c1"))


def empty_cells(runs: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    """Empty cells (keys, row, col).

    Walls are mostly solid, so the holes are laid out and the solid cells are not.
    """
    return empty_runs(runs, dims, keys).select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def cell_runs(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(*keys, "row", F.col("col").alias("c0"), F.col("col").alias("c1"))


def dilate(cells: DataFrame, keys: list[str], offsets) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dr).alias("r"), F.lit(dc).alias("c")) for dr, dc in offsets])
    out = cells.select(*keys, "row", "col", F.explode(steps).alias("_s"))
    return out.select(*keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col")).distinct()


CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))
SQUARE = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1))


def morph_close(cells: DataFrame, dims: DataFrame, keys: list[str], offsets=CROSS) -> DataFrame:
    """Dilation then erosion on sparse cells; beyond the border counts as solid.

    `dims` has keys, rows, cols. Cells are packed 64 to a word before they are shuffled, and a block of rows is closed in
    one task. Rasters with several rows of `dims` are closed cell by cell.
    """
    keys = list(keys)
    once, again = words.by_dims(dims, keys)
    out = words.to_cells(words.close(cells, once, keys, offsets), keys, cells.schema["col"].dataType)
    if again is None:
        return out
    part = cells.join(F.broadcast(again.select(*keys).distinct()), keys, "left_semi")
    return out.unionByName(_close_cells(part, again, keys, offsets))


def _close_cells(cells: DataFrame, dims: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Closing cell by cell: each dilated cell votes for the cells it supports, once for each row of `dims`."""
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("cols"))
    side = dims.select(*keys, "rows", "cols")
    grown = attach(dilate(cells, keys, offsets), side, keys).filter(inside).drop("rows", "cols")
    steps = F.array(*[F.struct(F.lit(-dr).alias("r"), F.lit(-dc).alias("c")) for dr, dc in offsets])
    votes = grown.select(*keys, "row", "col", F.explode(steps).alias("_s"))
    votes = votes.select(*keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"))
    votes = votes.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_v"))
    votes = attach(votes, side, keys).filter(inside)
    need = F.lit(0)
    for dr, dc in offsets:
        r, c = F.col("row") + dr, F.col("col") + dc
        need = need + ((r >= 0) & (r < F.col("rows")) & (c >= 0) & (c < F.col("cols"))).cast("int")
    return votes.filter(F.col("_v") == need).select(*keys, "row", "col")


def open_words(empty: DataFrame, dims: DataFrame, keys: list[str], offsets=CROSS) -> DataFrame:
    """What closing leaves empty, as words (row, w, bits), of empty runs (row, c0, c1)."""
    keys = list(keys)
    once, again = words.by_dims(dims, keys)
    out = words.open(words.of_runs(empty, keys), once, keys, offsets)
    if again is None:
        return out
    part = empty.join(again.select(*keys).distinct(), keys, "left_semi").select(*keys, "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    return out.unionByName(words.of_cells(_open_cells(part, again, keys, offsets), keys))


def morph_open(empty: DataFrame, dims: DataFrame, keys: list[str], offsets=CROSS) -> DataFrame:
    """What closing the solid cells leaves empty: erosion, then dilation, of the empty ones."""
    runs = cell_runs(empty, keys).withColumn("row", F.col("row").cast("int"))
    return words.to_cells(open_words(runs, dims, keys, offsets), keys)


def _open_cells(empty: DataFrame, dims: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Opening cell by cell; a cell comes once for each row of `dims`."""
    side = dims.select(*keys, "rows", "cols")
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("cols"))
    steps = F.array(*[F.struct(F.lit(-dr).alias("r"), F.lit(-dc).alias("c")) for dr, dc in offsets])
    votes = empty.select(*keys, F.explode(steps).alias("_s"), "row", "col")
    votes = votes.select(*keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"))
    votes = attach(votes.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_v")), side, keys).filter(inside)
    need = F.lit(0)
    for dr, dc in offsets:
        r, c = F.col("row") + dr, F.col("col") + dc
        need = need + ((r >= 0) & (r < F.col("rows")) & (c >= 0) & (c < F.col("cols"))).cast("int")
    core = votes.filter(F.col("_v") == need).select(*keys, "row", "col")
    return attach(dilate(core, keys, offsets), side, keys).filter(inside).select(*keys, "row", "col")


def column_voids(empty: DataFrame, keys: list[str], least: int = MIN_CELLS) -> DataFrame:
    """(keys, col, z0, z1): first and last empty row of the columns with enough empty rows, of cells or words."""
    keys = list(keys)
    empty = words.to_cells(empty, keys) if "bits" in empty.columns else empty
    out = empty.groupBy(*keys, "col").agg(F.min("row").alias("z0"), F.max("row").alias("z1"), F.count(F.lit(1)).alias("_n"))
    return out.filter((F.col("_n") >= least) & (F.col("z1") - F.col("z0") + 1 >= least)).select(*keys, "col", "z0", "z1")


def group_voids(columns: DataFrame, keys: list[str], least: int = MIN_CELLS) -> DataFrame:
    """Runs of neighbouring void columns with steady ends: gaps and islands."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("col")
    jump = (
        (F.col("col") > F.lag("col").over(w) + 1)
        | (F.abs(F.col("z0") - F.lag("z0").over(w)) > GROUP_JUMP)
        | (F.abs(F.col("z1") - F.lag("z1").over(w)) > GROUP_JUMP)
    )
    c = columns.withColumn("_b", F.coalesce(jump, F.lit(False)).cast("int"))
    c = c.withColumn("void", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = c.groupBy(*keys, "void").agg(
        F.count(F.lit(1)).alias("columns"),
        F.min("col").alias("c0"), F.max("col").alias("c1"),
        F.floor(F.percentile("z0", F.lit(0.5))).cast("int").alias("z0"), F.floor(F.percentile("z1", F.lit(0.5))).cast("int").alias("z1"),
    )
    return out.filter((F.col("columns") >= least) & (F.col("z1") > F.col("z0")))


def void_metrics(groups: DataFrame, empty: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Sill, head, width, centre and fill of every void narrower than its wall."""
    keys = list(keys)
    side = groups.select(*keys, "void", "c0", "c1", F.col("z0").alias("r0"), F.col("z1").alias("r1"))
    # A void belongs to one wall, and a wall has few: the words of empty cells meet them by wall and word.
    at = empty if "bits" in empty.columns else words.of_cells(empty, keys)
    reach = side.withColumn("w", F.explode(F.sequence(F.shiftright("c0", 6), F.shiftright("c1", 6))))
    hit = at.join(reach, [*keys, "w"]).filter(F.col("row").between(F.col("r0"), F.col("r1")))
    filled = hit.groupBy(*keys, "void").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(words.span(F.col("c0"), F.col("c1"))))).alias("_f"))
    v = groups.join(filled, [*keys, "void"], "left").join(frames.select(*keys, "rows", "length", "ceiling_height"), keys)
    area = (F.col("c1") - F.col("c0") + 1) * (F.col("z1") - F.col("z0") + 1)
    ceiling = F.col("ceiling_height")
    head = F.when(F.col("z1") >= F.col("rows") - 2, ceiling).otherwise(EDGE + (F.col("z1") + 1) * CELL)
    v = v.withColumns(
        {
            "ratio": F.coalesce("_f", F.lit(0)) / area,
            "width": (F.col("c1") - F.col("c0") + 1) * CELL,
            "center": F.least((F.col("c0") + F.col("c1") + 1) * CELL / 2.0, F.col("length")),
            "sill": F.when(F.col("z0") <= 1, 0.0).otherwise(EDGE + F.col("z0") * CELL),
            "head": F.least(head, ceiling),
        }
    )
    v = v.filter(F.col("width") < F.col("length")).withColumn("low_confidence", F.col("ratio") < LOW_RATIO)
    return v.select(*keys, "void", "sill", "head", "width", "center", "ratio", "low_confidence", "length", "ceiling_height")


def opening_kind(sill: Column, head: Column, width: Column, ceiling: Column) -> Column:
    """Passage, then door, then window, else NULL."""
    below, height = ceiling - head, head - sill
    passage = (sill <= 0.15) & (F.abs(below) <= 0.20) & (width >= 0.90)
    door = (sill <= 0.15) & head.between(1.90, 2.40) & (below >= 0.20) & width.between(0.60, 1.80)
    window = (sill >= 0.40) & (head <= ceiling - 0.05) & (height >= 0.40) & width.between(0.40, 3.00)
    return F.when(passage, "passage").when(door, "door").when(window, "window")


def classify_openings(voids: DataFrame) -> DataFrame:
    kind = opening_kind(F.col("sill"), F.col("head"), F.col("width"), F.col("ceiling_height"))
    return voids.withColumn("kind", kind).filter("kind is not null")


def finish_openings(voids: DataFrame, keys=LEVEL) -> DataFrame:
    """Opening rows with clamped width and offset, swing, confidence and ids."""
    keys = list(keys)
    v = classify_openings(voids).withColumn("width", F.least(F.col("width"), F.col("length") - 0.01)).filter("width > 0.05")
    v = v.withColumns(
        {
            "offset": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("center") / F.col("length"))),
            "swing": F.when(F.col("kind") != "door", "none").when(F.col("width") > 1.20, "double").otherwise("left"),
            "swing_side": F.lit("positive"),
            "head": F.least("head", "ceiling_height"),
            "confidence": F.when(F.col("low_confidence"), 0.45).otherwise(F.lit(0.9)),
        }
    ).filter("head > sill")
    v = number_rows(v, keys, ["wall_id", "void"], "_n")
    return v.select(
        *keys, F.concat(F.lit("o"), "_n").alias("opening_id"), "wall_id", "kind", "offset", "width", "sill", "head",
        "swing", "swing_side", "confidence", "low_confidence",
    )


def opening_issues(openings: DataFrame, keys=LEVEL) -> DataFrame:
    return openings.filter("low_confidence").select(
        *keys, F.lit("low_confidence_opening").alias("code"), F.lit("warning").alias("severity"),
        F.lit("An opening is only partly empty and was kept.").alias("message"), F.col("opening_id").alias("element_id"),
    )


def structure_issues(faces: DataFrame, openings: DataFrame, keys=LEVEL) -> DataFrame:
    """What wall and opening detection doubt, for `plans.validate.consolidate_issues`.

    plan_id is the first key; walls come before openings, lower storeys before upper ones.
    """
    keys = list(keys)
    walls = face_issues(faces, keys).withColumns({"element_id": F.lit(None).cast("string"), "stage": F.lit(0)})
    rows = walls.unionByName(opening_issues(openings, keys).withColumn("stage", F.lit(1)))
    arrival = F.struct("stage", *keys[1:], "element_id").alias("arrival")
    return rows.select(F.col(keys[0]).alias("plan_id"), arrival, "code", "severity", "message", "element_id")


def detect_openings(level_points: DataFrame, walls: DataFrame, levels: DataFrame, triangles: DataFrame | None = None, keys=LEVEL) -> DataFrame:
    """Openings of every wall, from points or, where given, from the mesh."""
    keys = list(keys)
    wall = [*keys, "wall_id"]
    frames = settle(wall_frames(walls, levels, keys))
    # Walls get whole numbers, which are given once and written, so that rasters need not carry their names.
    named = settle(frames.select(*wall).distinct().withColumn("_w", F.monotonically_increasing_id()))
    frames = settle(frames.join(named, wall).withColumnRenamed("wall_id", "_name").withColumnRenamed("_w", "wall_id"))
    number = ["wall_id"]
    if triangles is not None:
        runs = elevation_runs_mesh(triangles, frames, keys, number)
    else:
        runs = cell_runs(elevation_raster(project_to_walls(level_points, frames, keys), keys), number)
    empty = settle(open_words(empty_runs(runs, frames, number), frames, number))
    groups = settle(group_voids(column_voids(empty, number), number))
    voids = void_metrics(groups, empty, frames, number).withColumnRenamed("wall_id", "_w")
    return finish_openings(voids.join(named, "_w").drop("_w"), keys)


def gap_passages(faces: DataFrame, keys=LEVEL) -> DataFrame:
    """Collinear measured faces with a passage-wide gap between them.

    Candidate pairs share a line bucket and a tile: each face is padded by the
    widest gap.
    """
    keys = list(keys)
    f = faces.filter("not assumed")
    f = f.withColumn("_len", F.sqrt(sq(F.col("x2") - F.col("x1")) + sq(F.col("y2") - F.col("y1")))).filter("_len >= 0.4")
    f = f.select(*keys, "face", "x1", "y1", "x2", "y2", "thickness", "kind", "_len")
    # Only what lies along the line can be across the gap: pad the ends, not the sides.
    dx, dy = (F.col("x2") - F.col("x1")) / F.col("_len"), (F.col("y2") - F.col("y1")) / F.col("_len")
    a = g.P(F.col("x1") - dx * 1.3, F.col("y1") - dy * 1.3)
    b = g.P(F.col("x2") + dx * 1.3, F.col("y2") + dy * 1.3)
    tiled = settle(tiles.tile_segment(f, a, b, 0.2, 1.0))
    one = lambda t: tiled.select(*keys, *tiles.TILE, *[F.col(c).alias(f"{c}_{t}") for c in ("face", "x1", "y1", "x2", "y2", "thickness", "kind", "_len")])
    p = one("l").join(one("r"), [*keys, *tiles.TILE]).filter("face_l < face_r").drop(*tiles.TILE).distinct()
    a1, a2, b1, b2 = g.xy("x1_l", "y1_l"), g.xy("x2_l", "y2_l"), g.xy("x1_r", "y1_r"), g.xy("x2_r", "y2_r")
    axis = g.unit(g.sub(a2, a1))
    parallel = F.abs(g.cross(g.sub(a2, a1), g.sub(b2, b1))) / (F.col("_len_l") * F.col("_len_r")) <= 0.05
    aside = F.abs(g.cross(axis, g.sub(b1, a1))) <= 0.08
    along = lambda q: g.dot(g.sub(q, a1), axis)
    p = p.filter((F.abs(F.col("thickness_l") - F.col("thickness_r")) <= 0.05) & parallel & aside)
    p = p.withColumns({"_r0": F.least(along(b1), along(b2)), "_r1": F.greatest(along(b1), along(b2)), "_ax": axis.x, "_ay": axis.y})
    first = (F.col("_r0") > 0) | ((F.col("_r0") == 0) & (F.col("_r1") > F.col("_len_l")))
    g0 = F.when(first, F.col("_len_l")).otherwise(F.col("_r1"))
    g1 = F.when(first, F.col("_r0")).otherwise(F.lit(0.0))
    p = p.withColumns({"g0": g0, "g1": g1, "s": F.least(F.lit(0.0), F.col("_r0")), "e": F.greatest(F.col("_len_l"), F.col("_r1"))})
    p = p.withColumn("width", F.col("g1") - F.col("g0")).filter(F.col("width").between(0.90, 2.50))
    at = lambda t: ((F.col("x1_l") + F.col("_ax") * t), (F.col("y1_l") + F.col("_ay") * t))
    mid = (F.col("g0") + F.col("g1")) / 2.0
    s, e, m = at(F.col("s")), at(F.col("e")), at(mid)
    return p.select(
        *keys, F.concat_ws("-", F.col("face_l").cast("string"), F.col("face_r").cast("string")).alias("gap"),
        s[0].alias("x1"), s[1].alias("y1"), e[0].alias("x2"), e[1].alias("y2"), F.col("thickness_l").alias("thickness"), F.col("kind_l").alias("kind"),
        m[0].alias("x"), m[1].alias("y"), "width",
    )


def anti_near(candidates: DataFrame, others: DataFrame, radius: float = 0.4, keys=LEVEL) -> DataFrame:
    """Candidates (x, y) with no other row (x, y) nearer than `radius`."""
    keys = list(keys)
    near = others.select(*keys, F.col("x").alias("_ox"), F.col("y").alias("_oy"))
    near = near.withColumn("_tx", F.explode(F.sequence(tiles.cell("_ox", radius) - 1, tiles.cell("_ox", radius) + 1)))
    near = near.withColumn("_ty", F.explode(F.sequence(tiles.cell("_oy", radius) - 1, tiles.cell("_oy", radius) + 1)))
    left = tiles.tile_points(candidates, "x", "y", radius).alias("p")
    right = near.alias("s")
    on = g.dist(g.xy("p.x", "p.y"), g.xy("s._ox", "s._oy")) < radius
    for k in [*keys, *tiles.TILE]:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    return left.join(right, on, "left_anti").drop(*tiles.TILE)


def point_on_wall(openings: DataFrame, walls: DataFrame, keys=LEVEL) -> DataFrame:
    """Openings with the plan point (x, y) of their centre."""
    keys = list(keys)
    side = walls.select(*keys, "wall_id", "x1", "y1", "x2", "y2")
    p = g.lerp(g.xy("x1", "y1"), g.xy("x2", "y2"), F.col("offset"))
    return openings.join(side, [*keys, "wall_id"]).withColumns({"x": p.x, "y": p.y}).drop("x1", "y1", "x2", "y2")


def host_wall(gaps: DataFrame, walls: DataFrame, vertices: DataFrame, keys=LEVEL):
    """(gaps with wall_id and offset, new walls, new vertices).

    A gap is hosted by a wall with both ends within 0.08 m of the gap's span,
    either way round. Otherwise a wall is made, on vertices within 0.03 m
    where there are any.
    """
    keys = list(keys)
    gaps = settle(gaps)
    ends = walls.select(*keys, "wall_id", F.col("x1").alias("wx1"), F.col("y1").alias("wy1"), F.col("x2").alias("wx2"), F.col("y2").alias("wy2"))
    # Both ends must be close, so meeting in the cells of one gap end is enough.
    size = 0.16
    both = ends.select("*", F.explode(F.array(F.struct(F.col("wx1").alias("x"), F.col("wy1").alias("y")), F.struct(F.col("wx2").alias("x"), F.col("wy2").alias("y")))).alias("_p"))
    both = both.withColumns({"_tx": tiles.cell("_p.x", size), "_ty": tiles.cell("_p.y", size)}).drop("_p")
    near = gaps.withColumn("_tx", F.explode(F.sequence(tiles.cell("x1", size) - 1, tiles.cell("x1", size) + 1)))
    near = near.withColumn("_ty", F.explode(F.sequence(tiles.cell("y1", size) - 1, tiles.cell("y1", size) + 1)))
    m = near.join(both, [*keys, *tiles.TILE])
    s, e, a, b = g.xy("x1", "y1"), g.xy("x2", "y2"), g.xy("wx1", "wy1"), g.xy("wx2", "wy2")
    ok = ((g.dist(a, s) < 0.08) & (g.dist(b, e) < 0.08)) | ((g.dist(a, e) < 0.08) & (g.dist(b, s) < 0.08))
    host = m.filter(ok).groupBy(*keys, "gap").agg(F.min(F.struct(F.length("wall_id"), "wall_id", "wx1", "wy1", "wx2", "wy2")).alias("h"))
    found = settle(gaps.join(host, [*keys, "gap"], "left"))
    new = found.filter(F.col("h").isNull() & (g.dist(s, e) >= 0.5))
    spots = new.select(*keys, F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit("b").alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"), "gap")
    spots = spots.select(*keys, F.struct("gap", "p.end").alias("id"), "p.x", "p.y")
    welded = tiles.nearest_within(spots, vertices, keys, ["x", "y"], 0.03, "vertex_id")
    spots = spots.join(welded, [*keys, "id"], "left").drop("gap")
    most = vertices.groupBy(*keys).agg(F.max(F.expr("try_cast(substring(vertex_id, 2) as int)")).alias("_m"))
    fresh = spots.filter("vertex_id is null").select(*keys, F.bround("x", 3).alias("x"), F.bround("y", 3).alias("y")).distinct()
    fresh = number_rows(fresh, keys, ["x", "y"], "_n").join(most, keys, "left")
    fresh = settle(fresh.select(*keys, F.concat(F.lit("v"), F.coalesce("_m", F.lit(0)) + F.col("_n")).alias("vertex_id"), "x", "y"))
    all_v = vertices.select(*keys, "vertex_id", "x", "y").unionByName(fresh)
    named = spots.select(*keys, "id", F.bround("x", 3).alias("x"), F.bround("y", 3).alias("y"), "vertex_id").join(
        fresh.withColumnRenamed("vertex_id", "_v"), [*keys, "x", "y"], "left").select(*keys, "id", F.coalesce("vertex_id", "_v").alias("vertex_id"))
    named = named.join(all_v, [*keys, "vertex_id"])
    pick = lambda end, c: F.max(F.when(F.col("id.end") == end, F.col(c)))
    pairs = named.groupBy(*keys, F.col("id.gap").alias("gap")).agg(*[pick(e, c).alias(n) for e, c, n in (("a", "vertex_id", "a"), ("b", "vertex_id", "b"), ("a", "x", "ax"), ("a", "y", "ay"), ("b", "x", "bx"), ("b", "y", "by"))])
    top = walls.groupBy(*keys).agg(F.max(F.expr("try_cast(substring(wall_id, 2) as int)")).alias("_m"))
    made = number_rows(new.join(pairs.filter("a <> b"), [*keys, "gap"]), keys, ["x1", "y1", "x2", "y2", "gap"], "_n").join(top, keys, "left")
    made = settle(made.withColumn("wall_id", F.concat(F.lit("w"), F.coalesce("_m", F.lit(0)) + F.col("_n"))))
    kind = F.when(F.col("kind").isin("exterior", "interior", "partition", "assumed"), F.col("kind")).otherwise("exterior")
    new_walls = made.select(*keys, "wall_id", "a", "b", "thickness", kind.alias("kind"), F.lit(0.8).alias("confidence"), F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("bx").alias("x2"), F.col("by").alias("y2"))
    old = found.filter("h is not null").select(*keys, "gap", "x1", "y1", "x2", "y2", "thickness", "kind", "x", "y", "width", F.col("h.wall_id").alias("wall_id"), F.col("h.wx1").alias("ax"), F.col("h.wy1").alias("ay"), F.col("h.wx2").alias("bx"), F.col("h.wy2").alias("by"))
    hosted = old.unionByName(made.select(*old.columns))
    t = g.foot_param(g.xy("x", "y"), g.xy("ax", "ay"), g.xy("bx", "by"))
    hosted = hosted.filter(F.col("width") < g.dist(s, e)).withColumn("offset", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(t, F.lit(0.5)))))
    return hosted.select(*keys, "gap", "wall_id", "offset", "width", "x", "y"), new_walls, fresh


def away_from_walls(points: DataFrame, walls: DataFrame, pad: float = 0.08, along: float | None = None, keys=LEVEL) -> DataFrame:
    """Points outside every wall's padded band (an anti join on tiles)."""
    keys = list(keys)
    lines = walls.filter("x1 <> x2 or y1 <> y2").select(*keys, "x1", "y1", "x2", "y2", "thickness")
    along = pad if along is None else along
    across = F.col("s.thickness") / 2.0 + pad
    a, b, p = g.xy("s.x1", "s.y1"), g.xy("s.x2", "s.y2"), g.xy("p.x", "p.y")
    d = g.sub(b, a)
    length = g.norm(d)
    t = g.dot(g.sub(p, a), d) / length
    near = (t >= -along) & (t <= length + along) & (F.abs(g.cross(d, g.sub(p, a))) / length <= across)
    return tiles.near_segments(points, lines, keys, F.col("thickness") / 2.0 + max(pad, along), near, "left_anti")


def plan_cells(points: DataFrame, size: float = 0.08, keys=LEVEL) -> DataFrame:
    """One plan sample per cell: mean x and y, least and greatest z."""
    keys = list(keys)
    c = points.groupBy(*keys, tiles.cell("x", size).alias("cx"), tiles.cell("y", size).alias("cy"))
    micro = lambda n: (F.sum(F.rint(F.col(n) * 1e6).cast("long")) / F.count(F.lit(1)) / 1e6).alias(n)
    return c.agg(micro("x"), micro("y"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.count(F.lit(1)).alias("n"))


def min_rotated_rect(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least rotated rectangle of each group of points."""
    return hulls.rotated_rectangle(hulls.convex_hull(points, keys), keys)


def detect_columns(level_points: DataFrame, walls: DataFrame, levels: DataFrame, keys=LEVEL) -> DataFrame:
    """Free-standing columns: cell clusters of column size away from walls."""
    keys = list(keys)
    p = attach(level_points.select(*keys, "x", "y", "z", "nz"), levels.select(*keys, F.col("elevation").alias("_e"), F.col("ceiling_height").alias("_c")), keys)
    p = p.filter((F.abs(F.col("nz")) <= SIN15) & (F.col("z") >= F.col("_e") + EDGE) & (F.col("z") <= F.col("_e") + F.col("_c") - EDGE)).select(*keys, "x", "y", "z")
    cells = settle(plan_cells(away_from_walls(p, walls, 0.08, keys=keys), 0.08, keys).withColumn("id", F.struct(*keys, "cx", "cy")))
    enough = cells.groupBy(*keys).agg(F.sum("n").alias("_p"), F.count(F.lit(1)).alias("_k")).filter("_p >= 20 and _k >= 8").select(*keys)
    cells = settle(cells.join(enough, keys, "left_semi"))
    # Points of a cell are at most 0.11 m apart, so a cell's mean stands for it.
    label = tiles.eps_components(cells, keys, ["x", "y"], 0.18)
    named = settle(cells.join(label, "id"))
    good = named.groupBy("component").agg(F.count(F.lit(1)).alias("_k"), (F.max("z1") - F.min("z0")).alias("_h")).filter("_k >= 6 and _h >= 1.2")
    named = named.join(good.select("component"), "component", "left_semi")
    rects = min_rotated_rect(named, [*keys, "component"])
    rects = settle(rects.filter((F.least("width", "depth") >= 0.15) & (F.greatest("width", "depth") <= 0.80)))
    spots = rects.withColumn("id", F.col("component"))
    group = tiles.eps_components(spots, keys, ["x", "y"], 0.55).withColumnRenamed("component", "_g")
    merged = spots.join(group, "id").groupBy(*keys, "_g").agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("width").alias("width"), F.max("depth").alias("depth"), F.min_by("angle", "id").alias("rotation_deg")
    )
    merged = number_rows(merged, keys, ["_g"], "_n")
    return merged.select(*keys, F.concat(F.lit("c"), "_n").alias("column_id"), "x", "y", "width", "depth", "rotation_deg")


def column_ring(columns: DataFrame) -> DataFrame:
    return columns.withColumn("ring", g.rotated_box(g.xy("x", "y"), F.col("width"), F.col("depth"), F.col("rotation_deg")))


def _stair_rows(sums: DataFrame, ring: DataFrame, keys: list[str], least_area: float, clamp: bool) -> DataFrame:
    out = sums.join(ring, keys).filter((F.size("hull") >= 3) & (g.ring_area(F.col("hull")) >= least_area))
    length = F.greatest(F.sqrt(sq(F.col("_dx")) + sq(F.col("_dy"))), F.lit(1e-8))
    rise = F.greatest(F.col("_z1") - F.col("_z0"), F.lit(0.0))
    low = F.col("_z0") - F.col("_e")
    out = out.select(
        *keys, F.col("hull").alias("outline"), (F.col("_dx") / length).alias("dir_x"), (F.col("_dy") / length).alias("dir_y"),
        F.greatest(F.lit(1), F.rint(rise / RISER)).cast("int").alias("riser_count"),
        (F.greatest(F.lit(0.0), low) if clamp else low).alias("from_elevation"), (F.col("_z1") - F.col("_e")).alias("to_elevation"),
    )
    return out.filter("to_elevation > from_elevation").withColumn("stair_id", F.lit("s1"))


def detect_stairs_mesh(triangles: DataFrame, levels: DataFrame, keys=LEVEL) -> DataFrame:
    """Stairs from sloped triangles: 20 to 45 degrees, at least one square metre.

    `triangles` has keys and ax..cz; each storey is weighed by triangle area.
    """
    keys = list(keys)
    t = attach(triangles, levels.select(*keys, F.col("elevation").alias("_e"), F.col("ceiling_height").alias("_c")), keys)
    e = lambda p, c: F.col(f"{p}{c}") - F.col(f"a{c}")
    nx = e("b", "y") * e("c", "z") - e("b", "z") * e("c", "y")
    ny = e("b", "z") * e("c", "x") - e("b", "x") * e("c", "z")
    nz = e("b", "x") * e("c", "y") - e("b", "y") * e("c", "x")
    t = t.withColumns({"_nx": nx, "_ny": ny, "_nz": nz}).withColumn("_len", F.sqrt(sq(F.col("_nx")) + sq(F.col("_ny")) + sq(F.col("_nz")))).filter("_len > 1e-8")
    sign = F.when(F.col("_nz") < 0, -1.0).otherwise(F.lit(1.0))
    t = t.withColumns({f"_{n}": F.col(f"_{n}") * sign / F.col("_len") for n in ("nx", "ny", "nz")})
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.col("_nz"))))
    mid = (F.col("az") + F.col("bz") + F.col("cz")) / 3.0
    t = t.filter(angle.between(STAIR_LOW, STAIR_HIGH) & (mid >= F.col("_e") - 0.05) & (mid <= F.col("_e") + F.col("_c") + 0.05))
    flat = F.sqrt(sq(F.col("_nx")) + sq(F.col("_ny")))
    w = F.col("_len") / 2.0
    sums = t.groupBy(*keys).agg(
        F.sum(w).alias("_a"), F.sum(-F.col("_nx") / flat * w).alias("_dx"), F.sum(-F.col("_ny") / flat * w).alias("_dy"),
        F.min(F.least("az", "bz", "cz")).alias("_z0"), F.max(F.greatest("az", "bz", "cz")).alias("_z1"), F.first("_e").alias("_e"),
    ).filter("_a >= 1.0")
    pts = t.select(*keys, F.explode(F.array(*[F.struct(F.col(f"{c}x").alias("x"), F.col(f"{c}y").alias("y")) for c in "abc"])).alias("p")).select(*keys, "p.x", "p.y")
    return _stair_rows(sums, hulls.convex_hull(pts, keys), keys, 0.5, True)


def detect_stairs_points(level_points: DataFrame, levels: DataFrame, mesh_stairs: DataFrame | None = None, keys=LEVEL) -> DataFrame:
    """Stairs from sloped points, for storeys whose mesh gave none."""
    keys = list(keys)
    p = attach(level_points.select(*keys, "x", "y", "z", "nx", "ny", "nz"), levels.select(*keys, F.col("elevation").alias("_e"), F.col("ceiling_height").alias("_c")), keys)
    if mesh_stairs is not None:
        p = attach(p, mesh_stairs.select(*keys), keys, "left_anti")
    sign = F.when(F.col("nz") < 0, -1.0).otherwise(F.lit(1.0))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs("nz"))))
    p = p.filter(angle.between(STAIR_LOW, STAIR_HIGH) & (F.col("z") >= F.col("_e")) & (F.col("z") <= F.col("_e") + F.col("_c")))
    flat = F.sqrt(sq(F.col("nx")) + sq(F.col("ny")))
    sums = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"), F.avg(-F.col("nx") * sign / flat).alias("_dx"), F.avg(-F.col("ny") * sign / flat).alias("_dy"),
        F.min("z").alias("_z0"), F.max("z").alias("_z1"), F.first("_e").alias("_e"),
    ).filter("_k >= 30")
    return _stair_rows(sums, hulls.convex_hull(p, keys), keys, 1.0, False)


def attach_structure(draft, level_points: DataFrame, faces: DataFrame, level_triangles: DataFrame | None = None, keys=LEVEL):
    """(vertices, walls, openings, columns, stairs) of drafted storeys."""
    keys = list(keys)
    openings = settle(detect_openings(level_points, draft.walls, draft.levels, level_triangles, keys))
    gaps = anti_near(gap_passages(faces, keys), point_on_wall(openings, draft.walls, keys), 0.4, keys)
    hosted, new_walls, new_vertices = host_wall(gaps, draft.walls, draft.vertices, keys)
    walls = settle(draft.walls.unionByName(new_walls))
    vertices = settle(draft.vertices.select(*keys, "vertex_id", "x", "y").unionByName(new_vertices))
    count = openings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hosted = number_rows(hosted, keys, ["gap"], "_k")
    more = hosted.join(count, keys, "left").join(draft.levels.select(*keys, "ceiling_height"), keys)
    number = F.coalesce("_n", F.lit(0)) + F.col("_k")
    more = more.select(
        *keys, F.concat(F.lit("o"), number).alias("opening_id"), "wall_id", F.lit("passage").alias("kind"), "offset", "width",
        F.lit(0.0).alias("sill"), F.col("ceiling_height").alias("head"), F.lit("none").alias("swing"), F.lit("positive").alias("swing_side"),
        F.lit(0.85).alias("confidence"), F.lit(False).alias("low_confidence"),
    )
    openings = settle(openings.unionByName(more))
    columns = settle(detect_columns(level_points, walls, draft.levels, keys))
    mesh = settle(detect_stairs_mesh(level_triangles, draft.levels, keys)) if level_triangles is not None else None
    stairs = detect_stairs_points(level_points, draft.levels, mesh, keys)
    stairs = settle(stairs if mesh is None else mesh.unionByName(stairs))
    return vertices, walls, openings, columns, stairs
