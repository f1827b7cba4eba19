"""Vertical planes of a storey and the wall faces they pair up to."""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import eigen, hulls, tiles
from levelgrid.functions import geometry as g
from levelgrid.functions.graph import connected_components
from levelgrid.operators.normalize import COS15, PLANE_ANGLE, PLANE_DIST, SIN15
from levelgrid.session import attach, settle
from levelgrid.functions.geometry import sq

# Detection tolerances in metres, square metres, degrees and counts.
SNAP_DEG = 8.0
MIN_POINTS = 200
MIN_AREA = 0.5
MIN_HEIGHT = 1.2
MIN_WALL = 0.40
THICKNESS_MIN = 0.08
THICKNESS_MAX = 0.60
ASSUMED_INTERIOR = 0.15
ASSUMED_EXTERIOR = 0.30
MERGE_COS = 0.99
MERGE_OFFSET = 0.03
MERGE_GAP = 0.15
HULL_NEAR = 0.08
GROW_COS = math.cos(math.radians(PLANE_ANGLE))
# Where a fit faces farther than this from the normals of its points, the points do not determine it.
FIT_COS = math.cos(math.radians(45.0))
# Least patch, and how many mean gaps it spans: so many points lie as close as the 31 nearest of one.
PATCH = 0.12
PATCH_GAPS = math.sqrt(31 / math.pi)
PATCH_CELL = 0.5

LEVEL = ["scan_id", "level_index"]


def vertical_points(points: DataFrame, keys=LEVEL, min_points: int = MIN_POINTS) -> DataFrame:
    """Points with level normals, of storeys that have enough of them."""
    keys = list(keys)
    upright = points.filter(F.abs(F.col("nz")) <= SIN15)
    enough = upright.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    return attach(upright, enough, keys).drop("_n")


def curvature(neighbours: DataFrame, keys=LEVEL) -> DataFrame:
    """Smallest eigenvalue of each row's neighbourhood scatter, from a kNN table."""
    keys = list(keys)
    # Moments about the nearest row (the row itself) keep their digits.
    first = neighbours.filter("rank = 1").select(*keys, "id", *[F.col(f"n{c}").alias(f"_{c}") for c in "xyz"])
    near = neighbours.join(first, [*keys, "id"]).withColumns({f"d{c}": F.col(f"n{c}") - F.col(f"_{c}") for c in "xyz"})
    fit = eigen.with_smallest_eigen(near.groupBy(*keys, "id").agg(*eigen.moment_sums("dx", "dy", "dz")))
    return fit.select(*keys, "id", F.col("eig").alias("curvature"))


def _patch_size(points: DataFrame, keys: list[str], patch: float | None) -> DataFrame:
    """Adds _patch: the given size, or as many mean gaps between a storey's points as its neighbours reach."""
    if patch is not None:
        return points.withColumn("_patch", F.lit(float(patch)))
    cells = points.groupBy(*keys, *[F.floor(F.col(c) / PATCH_CELL).alias(f"_{c}") for c in "xyz"]).agg(F.count(F.lit(1)).alias("_n"))
    gap = PATCH_CELL / F.sqrt(F.avg("_n"))
    return attach(points, cells.groupBy(*keys).agg(F.greatest(F.lit(PATCH), PATCH_GAPS * gap).alias("_patch")), keys)


def _with_patches(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the patch of every point on two grids of direction, offset and place that are shifted by half a bin."""
    angle = F.pmod(F.degrees(F.atan2("ny", "nx")), F.lit(360.0))
    turns = int(360 / PLANE_ANGLE)
    for grid, shift in ((0, 0.0), (1, 0.5)):
        a = F.pmod(F.rint(angle / PLANE_ANGLE + shift), F.lit(turns)).cast("int")
        facing = F.radians((a - shift) * PLANE_ANGLE)
        offset = F.col("x") * F.cos(facing) + F.col("y") * F.sin(facing)
        along = F.col("y") * F.cos(facing) - F.col("x") * F.sin(facing)
        bins = {
            "a": a,
            "o": F.rint(offset / (2 * PLANE_DIST) + shift).cast("int"),
            "t": F.floor(along / F.col("_patch")).cast("int"),
            "v": F.floor(F.col("z") / F.col("_patch")).cast("int"),
        }
        points = points.withColumn(f"_bin{grid}", F.struct(*[c.alias(n) for n, c in bins.items()]))
        points = points.withColumn(f"_u{grid}", F.xxhash64(*keys, F.lit(grid), f"_bin{grid}"))
    return points


def _patch_components(points: DataFrame, keys: list[str]) -> DataFrame:
    """id, component of the patches that touch and face alike, or share a point across the grids."""
    side = lambda grid: points.select(*keys, F.lit(grid).alias("_g"), F.col(f"_bin{grid}").alias("_bin"), F.col(f"_u{grid}").alias("id"))
    nodes = settle(side(0).unionByName(side(1)).dropDuplicates(["id"]))
    shared = points.select(F.col("_u0").alias("u"), F.col("_u1").alias("v")).distinct()
    # A wall that is slanted against its bin crosses offsets, so touching patches of the next offset belong together
    # too; what does not lie in one plane is parted later. Half of the 26 neighbours reach every pair once.
    ahead = [s for s in itertools.product((-1, 0, 1), repeat=3) if s > (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("otv", s)]) for s in ahead])
    near = nodes.withColumn("_s", F.explode(steps))
    moved = F.struct(F.col("_bin.a"), *[(F.col(f"_bin.{c}") + F.col(f"_s.{c}")).alias(c) for c in "otv"])
    near = near.select(F.col("id").alias("u"), F.xxhash64(*keys, "_g", moved).alias("v"))
    touching = near.join(nodes.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")
    return connected_components(touching.unionByName(shared), nodes.select("id"))


def _on_seed_plane(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _in: within reach of the plane that is fitted to what lies on the seed of the point's component `_c`.

    The seed is the patch with most points: its centre and mean normal are the first hypothesis.
    """
    of = [*keys, "_c"]
    patches = points.groupBy(*of, "_u0").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"s{c}") for c in ("x", "y", "z", "nx", "ny")])
    seed = patches.groupBy(*of).agg(F.max(F.struct("n", F.xxhash64("_u0").alias("mix"), F.col("_u0").alias("seed"), "sx", "sy", "sz", "snx", "sny")).alias("s"))
    x, y = _horizontal(F.col("s.snx"), F.col("s.sny"))
    seed = settle(seed.select(*of, F.col("s.seed").alias("_seed"), F.col("s.sx").alias("_sx"), F.col("s.sy").alias("_sy"), F.col("s.sz").alias("_sz"), x.alias("_fx"), y.alias("_fy")))
    near = attach(points, seed, of)
    # Measured from the seed, so that planes far from the origin keep their digits.
    near = near.withColumns({f"d{c}": F.col(c) - F.col(f"_s{c}") for c in "xyz"})
    close = lambda x, y, offset: (F.col("nx") * x + F.col("ny") * y >= GROW_COS) & (F.abs(F.col("dx") * x + F.col("dy") * y - offset) <= PLANE_DIST)
    first = near.filter(close(F.col("_fx"), F.col("_fy"), F.lit(0.0)))
    moments = first.groupBy(*of).agg(*eigen.moment_sums("dx", "dy", "dz"), F.sum("nx").alias("hx"), F.sum("ny").alias("hy"))
    fit = fit_normals(moments, snap=False).select(*of, F.col("nx").alias("_px"), F.col("ny").alias("_py"), F.col("offset").alias("_po"))
    near = attach(near, seed.select(*of).join(fit, of, "left"), of)
    inside = F.coalesce(close(F.col("_px"), F.col("_py"), F.col("_po")), F.lit(False))
    return near.withColumns({"_in": inside, "_first": F.col("_u0") == F.col("_seed")}).select(*points.columns, "_in", "_first")


def plane_segments(points: DataFrame, keys=LEVEL, min_points: int = MIN_POINTS, patch: float | None = None) -> DataFrame:
    """Points of vertical planes with a `plane` id.

    Patches of points that touch and face alike are joined to components. Each component then grows one plane a
    round: a hypothesis from its fullest patch is fitted anew to the points within PLANE_DIST and PLANE_ANGLE of it,
    and the largest connected part of those within reach of the fit is the plane. What is left is joined anew and
    goes on, in all components at once, until fewer than `min_points` hang together. A flat wall is done in
    the first round, a curved one falls apart into planes that each fit.

    Left out, as by growth from single seeds: parts under `min_points`. Without `patch`, patches follow the gaps
    between the points of a storey.
    """
    keys = list(keys)
    names = points.columns
    opened = settle(_with_patches(_patch_size(points, keys, patch), keys))
    planes, round_ = [], 0
    while True:
        label = _patch_components(opened, keys).select(F.col("id").alias("_u0"), F.col("component").alias("_c"))
        named = settle(opened.join(label, "_u0"))
        of = [*keys, "_c"]
        large = named.groupBy(*of).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
        named = settle(_on_seed_plane(settle(attach(named, large.select(*of), of)), keys))
        counts = named.groupBy(*of).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_in").alias("_m"))
        # Where nothing is in reach, the seed goes, so that every round ends smaller.
        named = attach(named, counts, of).withColumn("_in", F.col("_in") | ((F.col("_m") == 0) & F.col("_first")))
        planes.append(named.filter("_n = _m").select(*names, F.xxhash64("_c", F.lit(round_)).alias("plane")))
        split = settle(named.filter("_n <> _m").drop("_n", "_m", "_first"))
        if split.isEmpty():
            break
        parts = _patch_components(split.filter("_in"), keys).select(F.col("id").alias("_u0"), F.col("component").alias("_p"))
        split = settle(split.join(parts, "_u0", "left").withColumn("_p", F.when(F.col("_in"), F.col("_p"))))
        sizes = split.filter("_in").groupBy(*of, "_p").agg(F.count(F.lit(1)).alias("_n"))
        best = sizes.groupBy(*of).agg(F.max(F.struct("_n", "_p")).alias("_best"))
        split = settle(attach(split, best, of).withColumn("_taken", F.col("_in") & (F.col("_p") == F.col("_best._p"))))
        grown = split.filter(F.col("_taken") & (F.col("_best._n") >= min_points))
        planes.append(grown.select(*names, F.xxhash64("_p", F.lit(round_ + 1)).alias("plane")))
        opened = settle(split.filter("not _taken").drop("_c", "_p", "_best", "_taken", "_in"))
        round_ += 2
    return reduce(DataFrame.unionByName, planes)


def _horizontal(x: Column, y: Column) -> tuple[Column, Column]:
    length = F.sqrt(x * x + y * y)
    return (
        F.when(length < 1e-8, 1.0).otherwise(x / length),
        F.when(length < 1e-8, 0.0).otherwise(y / length),
    )


def snapped_normal(x: Column, y: Column) -> tuple[Column, Column]:
    """A level normal within 8 degrees of an axis becomes that axis."""
    near = g.axis_delta_deg(x, y) <= SNAP_DEG
    wide = F.abs(x) >= F.abs(y)
    sx = F.when(wide, F.signum(x)).otherwise(F.lit(0.0))
    sy = F.when(wide, F.lit(0.0)).otherwise(F.signum(y))
    return F.when(near, sx).otherwise(x), F.when(near, sy).otherwise(y)


def fit_normals(moments: DataFrame, snap: bool = True) -> DataFrame:
    """Level normal and offset from moment sums and the summed point normals (hx, hy).

    Points above each other, such as the last millimetres of a wall, lie on planes of any direction. Where the
    fit faces more than FIT_COS away from the points' own normals, these are taken.
    """
    fit = eigen.with_smallest_eigen(moments)
    x, y = _horizontal(F.col("ex"), F.col("ey"))
    hx, hy = _horizontal(F.col("hx"), F.col("hy"))
    known = F.sqrt(F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy")) >= 1e-8
    fit = fit.withColumns({"_x": x, "_y": y, "_across": F.coalesce(known & (F.abs(x * hx + y * hy) < FIT_COS), F.lit(False))})
    x, y = (F.when(F.col("_across"), h).otherwise(F.col(c)) for h, c in ((hx, "_x"), (hy, "_y")))
    fit = fit.withColumns({"_x": x, "_y": y}).drop("_across")
    x, y = F.col("_x"), F.col("_y")
    sign = F.when(x * hx + y * hy < 0, -1.0).otherwise(F.lit(1.0))
    fit = fit.withColumns({"_x": x * sign, "_y": y * sign})
    sx, sy = snapped_normal(F.col("_x"), F.col("_y")) if snap else (F.col("_x"), F.col("_y"))
    fit = fit.withColumns({"nx": sx, "ny": sy})
    return fit.withColumn("offset", F.col("nx") * F.col("mx") + F.col("ny") * F.col("my")).drop("_x", "_y", "ex", "ey", "ez", "eig")


def _measure(points: DataFrame, normals: DataFrame, keys: list[str]) -> DataFrame:
    """Extents of each plane along its tangent and in z, by one aggregate."""
    side = normals.select(*keys, "plane", F.col("nx").alias("_nx"), F.col("ny").alias("_ny"), F.col("mx").alias("_mx"), F.col("my").alias("_my"))
    p = attach(points.select(*keys, "plane", "x", "y", "z"), side, [*keys, "plane"])
    along = (F.col("y") - F.col("_my")) * F.col("_nx") - (F.col("x") - F.col("_mx")) * F.col("_ny")
    return p.groupBy(*keys, "plane").agg(
        F.min(along).alias("along0"), F.max(along).alias("along1"), F.min("z").alias("z0"), F.max("z").alias("z1")
    )


def fit_planes(points: DataFrame, keys=LEVEL, snap: bool = True, min_area: float = MIN_AREA) -> DataFrame:
    """One row per plane: level normal, offset, extents and the moment sums."""
    keys = list(keys)
    moments = eigen.with_origin(points, keys).groupBy(*keys, "plane").agg(*eigen.local_moments(), F.sum("nx").alias("hx"), F.sum("ny").alias("hy"))
    normals = settle(fit_normals(moments, snap))
    out = normals.join(_measure(points, normals, keys), [*keys, "plane"])
    return out.filter((F.col("along1") - F.col("along0")) * (F.col("z1") - F.col("z0")) >= min_area)


def snap_planes(planes: DataFrame, points: DataFrame, keys=LEVEL) -> DataFrame:
    """Planes re-measured on their snapped normals."""
    keys = list(keys)
    sx, sy = snapped_normal(F.col("nx"), F.col("ny"))
    turned = planes.withColumns({"_sx": sx, "_sy": sy}).drop("along0", "along1", "z0", "z1", "offset")
    turned = turned.withColumns({"nx": F.col("_sx"), "ny": F.col("_sy")}).drop("_sx", "_sy")
    turned = settle(turned.withColumn("offset", F.col("nx") * F.col("mx") + F.col("ny") * F.col("my")))
    return turned.join(_measure(points, turned, keys), [*keys, "plane"])


def plan_segments(planes: DataFrame) -> DataFrame:
    """Adds x1, y1, x2, y2: the plane seen from above."""
    px = F.col("mx") + F.col("nx") * (F.col("offset") - (F.col("nx") * F.col("mx") + F.col("ny") * F.col("my")))
    py = F.col("my") + F.col("ny") * (F.col("offset") - (F.col("nx") * F.col("mx") + F.col("ny") * F.col("my")))
    return planes.withColumns(
        {
            "x1": px - F.col("ny") * F.col("along0"),
            "y1": py + F.col("nx") * F.col("along0"),
            "x2": px - F.col("ny") * F.col("along1"),
            "y2": py + F.col("nx") * F.col("along1"),
        }
    )


def _plane_pairs(planes: DataFrame, keys: list[str], reach: float, ordered: bool) -> DataFrame:
    """Pairs of planes whose plan segments share a tile when padded by `reach`.

    Planes of one direction class only meet planes of the same (or the
    opposite) class, which keeps crossing walls out of the candidate set.
    """
    cols = ["plane", "nx", "ny", "offset", "along0", "along1", "z0", "z1", "mx", "my", "n", "x1", "y1", "x2", "y2"]
    lines = plan_segments(planes).select(*keys, *cols)
    # Undirected direction class of 15 degrees, each plane in its own and the next one.
    turn = F.pmod(F.degrees(F.atan2("ny", "nx")), F.lit(180.0)) / 15.0
    lines = lines.withColumn("_d0", F.floor(turn))
    tiled = settle(tiles.tile_segment(lines, g.xy("x1", "y1"), g.xy("x2", "y2"), reach, max(1.0, reach)))
    a = tiled.select(*keys, *tiles.TILE, *[F.col(c).alias(f"{c}_l") for c in cols], F.explode(F.array(*[F.pmod(F.col("_d0") + d, F.lit(12)) for d in (-1, 0, 1)])).alias("_d"))
    b = tiled.select(*keys, *tiles.TILE, *[F.col(c).alias(f"{c}_r") for c in cols], F.pmod("_d0", F.lit(12)).alias("_d"))
    pairs = a.join(b, [*keys, *tiles.TILE, "_d"])
    pairs = pairs.filter(F.col("plane_l") < F.col("plane_r")) if ordered else pairs.filter(F.col("plane_l") != F.col("plane_r"))
    b0 = _project("along0")
    b1 = _project("along1")
    return pairs.withColumns({"b0": F.least(b0, b1), "b1": F.greatest(b0, b1)})


def _project(end: str) -> Column:
    """The right plane's end measured along the left plane's tangent."""
    px = F.col("mx_r") - F.col("ny_r") * F.col(f"{end}_r")
    py = F.col("my_r") + F.col("nx_r") * F.col(f"{end}_r")
    return (py - F.col("my_l")) * F.col("nx_l") - (px - F.col("mx_l")) * F.col("ny_l")


def merge_edges(planes: DataFrame, keys=LEVEL) -> DataFrame:
    """Pairs of planes that are one wall surface."""
    keys = list(keys)
    p = _plane_pairs(planes, keys, MERGE_GAP, ordered=True)
    same = F.col("nx_l") * F.col("nx_r") + F.col("ny_l") * F.col("ny_r") >= MERGE_COS
    flush = F.abs(F.col("offset_l") - F.col("offset_r")) <= MERGE_OFFSET
    tall = F.least("z1_l", "z1_r") - F.greatest("z0_l", "z0_r") >= -MERGE_GAP
    gap = F.greatest(F.col("b0") - F.col("along1_l"), F.col("along0_l") - F.col("b1"), F.lit(0.0))
    return p.filter(same & flush & tall & (gap <= MERGE_GAP)).select(*keys, F.col("plane_l").alias("u"), F.col("plane_r").alias("v")).distinct()


def merge_planes(planes: DataFrame, points: DataFrame, keys=LEVEL, min_height: float = MIN_HEIGHT):
    """(planes, points) with mergeable planes closed to one, to a fixpoint."""
    keys = list(keys)
    planes = settle(planes)
    # Every round leaves fewer planes, so this ends.
    while True:
        edges = settle(merge_edges(planes, keys))
        if edges.isEmpty():
            break
        label = connected_components(
            edges.select(F.struct(*keys, "u").alias("u"), F.struct(*keys, F.col("v").alias("u")).alias("v")),
            planes.select(F.struct(*keys, F.col("plane").alias("u")).alias("id")),
        )
        names = settle(label.select(*[F.col(f"id.{k}").alias(k) for k in keys], F.col("id.u").alias("plane"), F.col("component.u").alias("_to")))
        points = settle(attach(points, names, [*keys, "plane"]).withColumn("plane", F.col("_to")).drop("_to"))
        joined = planes.join(names, [*keys, "plane"]).withColumn("plane", F.col("_to"))
        # All planes of a storey are measured from one origin, so their sums add up.
        origin = [F.first(c).alias(c) for c in ("ox", "oy", "oz") if c in planes.columns]
        moments = joined.groupBy(*keys, "plane").agg(*eigen.add_moments(), *origin, F.sum("hx").alias("hx"), F.sum("hy").alias("hy"))
        normals = settle(fit_normals(moments))
        planes = settle(normals.join(_measure(points, normals, keys), [*keys, "plane"]))
    return planes.filter(F.col("z1") - F.col("z0") >= min_height), points


def on_hull(planes: DataFrame, points: DataFrame, keys=LEVEL) -> DataFrame:
    """Adds `on_hull`: the middle of the plane lies near the hull of all wall points."""
    keys = list(keys)
    ring = settle(hulls.convex_hull(points.select(*keys, "x", "y"), keys))
    lines = plan_segments(planes)
    mid = g.P((F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0)
    out = lines.join(ring, keys, "left")
    near = F.coalesce(g.distance_to_ring(mid, F.col("hull")) <= HULL_NEAR, F.lit(False))
    return out.withColumn("on_hull", near).drop("hull")


def pair_planes(planes: DataFrame, keys=LEVEL) -> DataFrame:
    """Mutual best partners: opposite faces of one wall, each pair once."""
    keys = list(keys)
    p = _plane_pairs(planes, keys, THICKNESS_MAX, ordered=False)
    facing = F.col("nx_l") * F.col("nx_r") + F.col("ny_l") * F.col("ny_r")
    distance = F.abs(F.col("offset_l") - F.col("offset_r") * facing)
    overlap = F.least("along1_l", "b1") - F.greatest("along0_l", "b0")
    shorter = F.least(F.col("along1_l") - F.col("along0_l"), F.col("b1") - F.col("b0"))
    p = p.withColumns({"overlap": overlap, "distance": distance})
    p = p.filter((facing <= -0.95) & distance.between(THICKNESS_MIN, THICKNESS_MAX) & (shorter > 0) & (overlap >= 0.5 * shorter))
    # Overlaps that differ by a micrometre or less are a tie; the nearer plane wins it.
    score = F.struct((-F.rint(F.col("overlap") * 1e6)).alias("o"), F.col("distance").alias("d"), F.col("plane_r").alias("r"))
    best = settle(p.groupBy(*keys, F.col("plane_l").alias("u")).agg(F.min(score).alias("_b")).select(*keys, "u", F.col("_b.r").alias("v"), F.col("_b.d").alias("distance")))
    back = best.select(*keys, F.col("u").alias("v"), F.col("v").alias("u"))
    return best.join(back, [*keys, "u", "v"]).filter("u < v")


def _line(prefix: str, offset: Column, along0: Column, along1: Column) -> dict[str, Column]:
    """Endpoints to a millimetre on a plane shifted to `offset`."""
    c = lambda n: F.col(f"{n}{prefix}")
    shift = offset - (c("nx") * c("mx") + c("ny") * c("my"))
    ox, oy = c("mx") + c("nx") * shift, c("my") + c("ny") * shift
    return {
        "x1": F.bround(ox - c("ny") * along0, 3),
        "y1": F.bround(oy + c("nx") * along0, 3),
        "x2": F.bround(ox - c("ny") * along1, 3),
        "y2": F.bround(oy + c("nx") * along1, 3),
    }


def paired_walls(planes: DataFrame, pairs: DataFrame, keys=LEVEL) -> DataFrame:
    """Walls seen from both sides: midline, thickness, common extent."""
    keys = list(keys)
    cols = ["plane", "nx", "ny", "offset", "along0", "along1", "mx", "my"]
    one = lambda tag, name: planes.select(*keys, *[F.col(c).alias(f"{c}_{tag}") for c in cols]).withColumnRenamed(f"plane_{tag}", name)
    p = pairs.join(one("l", "u"), [*keys, "u"]).join(one("r", "v"), [*keys, "v"])
    facing = F.col("nx_l") * F.col("nx_r") + F.col("ny_l") * F.col("ny_r")
    other = F.col("offset_r") * facing
    b0, b1 = _project("along0"), _project("along1")
    along0 = F.greatest(F.col("along0_l"), F.least(b0, b1))
    along1 = F.least(F.col("along1_l"), F.greatest(b0, b1))
    mid = (F.col("offset_l") + other) / 2.0
    p = p.filter(along1 - along0 >= MIN_WALL)
    ends = _line("_l", mid, along0, along1)
    return p.select(
        *keys, *[v.alias(k) for k, v in ends.items()], F.abs(F.col("offset_l") - other).alias("thickness"),
        F.lit(False).alias("assumed"), F.lit("interior").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(2).alias("sides"),
        F.col("nx_l").alias("nx"), F.col("ny_l").alias("ny"), mid.alias("offset"),
    )


def assumed_walls(planes: DataFrame, pairs: DataFrame, keys=LEVEL) -> DataFrame:
    """Walls seen from one side; `planes` carries on_hull. Thickness is assumed."""
    keys = list(keys)
    taken = pairs.select(*keys, F.col("u").alias("plane")).unionByName(pairs.select(*keys, F.col("v").alias("plane")))
    p = planes.join(taken, [*keys, "plane"], "left_anti")
    p = p.filter((F.col("along1") - F.col("along0") >= MIN_WALL) & (F.col("z1") - F.col("z0") >= MIN_HEIGHT))
    t = F.when(F.col("on_hull"), ASSUMED_EXTERIOR).otherwise(F.lit(ASSUMED_INTERIOR))
    p = p.withColumn("thickness", t)
    ends = _line("", F.col("offset") + F.col("thickness") / 2.0, F.col("along0"), F.col("along1"))
    return p.select(
        *keys, *[v.alias(k) for k, v in ends.items()], "thickness", F.lit(True).alias("assumed"),
        F.when(F.col("on_hull"), "exterior").otherwise("interior").alias("kind"), F.lit(0.4).alias("confidence"),
        F.lit(1).alias("sides"), "nx", "ny", "offset",
    )


def wall_face_ring(df: DataFrame) -> DataFrame:
    """Adds `polygon`: the rectangle half a thickness to both sides of the centreline."""
    hx, hy = F.col("nx") * F.col("thickness") / 2.0, F.col("ny") * F.col("thickness") / 2.0
    corner = lambda i, s: F.struct((F.col(f"x{i}") + s * hx).alias("x"), (F.col(f"y{i}") + s * hy).alias("y"))
    return df.withColumn("polygon", F.array(corner(1, 1), corner(2, 1), corner(2, -1), corner(1, -1)))


def wall_kind(walls: DataFrame, floor: DataFrame, keys=LEVEL, id: str = "face") -> DataFrame:
    """Kind by floor seen beside the wall: both sides partition, one exterior, none interior."""
    keys = list(keys)
    a, b, p = g.xy("x1", "y1"), g.xy("x2", "y2"), g.xy("x", "y")
    d = g.sub(b, a)
    length = g.norm(d)
    signed = g.cross(d, g.sub(p, a)) / length
    along = g.dot(g.sub(p, a), d) / (length * length)
    margin = F.col("thickness") / 2.0 + 0.05
    lines = walls.select(*keys, id, "x1", "y1", "x2", "y2", "thickness").filter("x1 <> x2 or y1 <> y2")
    pad = F.greatest(F.lit(0.5), 0.05 * F.sqrt(sq(F.col("x2") - F.col("x1")) + sq(F.col("y2") - F.col("y1"))))
    tiled = tiles.tile_segment(lines, a, b, pad, 1.0)
    near = tiles.tile_points(floor.select(*keys, "x", "y"), "x", "y", 1.0).join(tiled, [*keys, *tiles.TILE])
    near = near.filter(along.between(-0.05, 1.05) & (F.abs(signed) > margin) & (F.abs(signed) < 0.5))
    seen = near.groupBy(*keys, id).agg(F.bool_or(signed > 0).alias("_pos"), F.bool_or(signed < 0).alias("_neg"))
    out = walls.join(seen, [*keys, id], "left")
    pos, neg = F.coalesce("_pos", F.lit(False)), F.coalesce("_neg", F.lit(False))
    kind = F.when(pos & neg, "partition").when(pos | neg, "exterior").otherwise("interior")
    return out.withColumn("kind", kind).drop("_pos", "_neg")


def off_axis(walls: DataFrame) -> DataFrame:
    """Walls more than 8 degrees off both axes."""
    return walls.filter(g.axis_delta_deg(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) > SNAP_DEG + 1e-6)


def face_issues(faces: DataFrame, keys=LEVEL) -> DataFrame:
    keys = list(keys)
    row = lambda df, code, severity, message: df.select(*keys, F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    return row(faces.filter("assumed"), "assumed_thickness", "warning", "A wall was seen from one side, so its thickness is assumed.").unionByName(
        row(off_axis(faces), "non_manhattan", "info", "A wall is diagonal and was not snapped to the Manhattan frame.")
    )


def detect_faces(level_points: DataFrame, keys=LEVEL, min_points: int = MIN_POINTS) -> DataFrame:
    """Wall faces of every storey, from points that carry level_index and normals."""
    keys = list(keys)
    points = settle(plane_segments(vertical_points(level_points, keys, min_points), keys, min_points))
    planes, points = merge_planes(fit_planes(points, keys), points, keys)
    planes = settle(on_hull(planes, points, keys))
    pairs = settle(pair_planes(planes, keys))
    paired = settle(paired_walls(planes, pairs, keys).withColumn("face", F.xxhash64("x1", "y1", "x2", "y2", "nx", "ny")))
    floor = voxel_floor(level_points, keys)
    both = wall_kind(paired, floor, keys).unionByName(assumed_walls(planes, pairs, keys).withColumn("face", F.xxhash64("x1", "y1", "x2", "y2", "nx", "ny")))
    return wall_face_ring(both)


def voxel_floor(level_points: DataFrame, keys=LEVEL) -> DataFrame:
    return level_points.filter(F.col("nz") > COS15).select(*keys, "x", "y")
