"""Units, downsampling, gravity, Manhattan frame and storeys, keyed by scan.

Points are never gathered per scan: they move through expressions, hash
aggregates and equi-joins. What is known once per scan (the frame) is a small
settled table attached to the points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import eigen
from levelgrid.functions import tiles
from levelgrid.functions.graph import connected_components
from levelgrid.session import attach, settle
from levelgrid.functions.geometry import sq

# Detection tolerances in metres and degrees.
VOXEL_MIN = 0.02
VOXEL_MAX = 0.10
TARGET_POINTS = 2_000_000
PLANE_DIST = 0.02
PLANE_ANGLE = 8.0
COARSE = 0.05
COARSE_MIN = 500
BIN = 0.05

SIN15 = math.sin(math.radians(15.0))
COS15 = math.cos(math.radians(15.0))

# Sums run over whole micrometres, so a centroid does not depend on row order.
MICRO = 1_000_000.0

SCAN = ["scan_id"]


def micro(c: Column) -> Column:
    return F.rint(c * MICRO).cast("long")


def extents(points: DataFrame, keys=SCAN) -> DataFrame:
    out = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )
    out = out.withColumns({f"size_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"})
    return out.withColumn("span", F.greatest("size_x", "size_y"))


def unit_scale(ext: DataFrame, units: str = "auto", hint: str | None = None) -> DataFrame:
    """Adds `scale` to metres and `guessed`. Forced mm counts as guessed."""
    h = F.col(hint) if hint else F.lit(None).cast("double")
    span = F.col("span")
    if units == "mm":
        scale, guessed = F.lit(0.001), F.lit(True)
    elif units == "m":
        scale, guessed = F.lit(1.0), F.lit(False)
    else:
        scale = (
            F.when(h.isNotNull(), h).when(span > 200, 0.001).when(span > 50, 0.01).otherwise(F.lit(1.0))
        )
        guessed = F.when(h.isNotNull(), h != 1.0).otherwise(span > 50)
    return ext.withColumns({"scale": scale, "guessed": guessed})


def guess_units(ext: DataFrame, hint: str | None = None) -> DataFrame:
    h = F.col(hint) if hint else F.lit(None).cast("double")
    named = F.when(F.abs(h - 0.001) < 1e-9, "mm").when(F.abs(h - 0.01) < 1e-9, "cm").otherwise("m")
    by_span = F.when(F.col("span") > 200, "mm").when(F.col("span") > 50, "cm").otherwise("m")
    return ext.withColumn("units", F.when(h.isNotNull() & (h != 1.0), named).otherwise(by_span))


def guess_up_axis(ext: DataFrame, point_only: str | None = None) -> DataFrame:
    """Point-only scans are Y-up; else the shortest side, x before y before z."""
    x, y, z = F.col("size_x"), F.col("size_y"), F.col("size_z")
    shortest = F.when((x <= y) & (x <= z), "x").when(y <= z, "y").otherwise("z")
    axis = F.when(F.col(point_only), "y").otherwise(shortest) if point_only else shortest
    return ext.withColumn("up_axis", axis)


def choose_voxel(ext: DataFrame) -> DataFrame:
    scale = F.col("scale") if "scale" in ext.columns else F.lit(1.0)
    volume = F.lit(1.0)
    for c in "xyz":
        volume = volume * F.greatest(F.col(f"size_{c}") * scale, F.lit(VOXEL_MIN))
    wide = F.least(F.lit(VOXEL_MAX), F.greatest(F.lit(VOXEL_MIN), F.cbrt(volume / TARGET_POINTS)))
    return ext.withColumn(
        "voxel", F.when(volume / VOXEL_MIN**3 > TARGET_POINTS, wide).otherwise(F.lit(VOXEL_MIN))
    )


def _cell_sums(points: DataFrame) -> list[Column]:
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(micro(F.col(c))).alias(f"_s{c}") for c in "xyz"]]
    if "nx" in points.columns:
        sums += [F.sum(micro(F.col(f"n{c}"))).alias(f"_n{c}") for c in "xyz"]
    if "r" in points.columns:
        sums += [F.sum(F.col(c).cast("long")).alias(f"_c{c}") for c in "rgb"]
    return sums


def _cell_means(cells: DataFrame, keys: list[str], unit_normals: bool) -> DataFrame:
    n = F.col("n")
    cols = [*keys, "vx", "vy", "vz", "n", *[(F.col(f"_s{c}") / n / MICRO).alias(c) for c in "xyz"]]
    if "_nx" in cells.columns:
        raw = [F.col(f"_n{c}") / MICRO for c in "xyz"]
        length = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
        for c, v, empty in zip("xyz", raw, (0.0, 0.0, 1.0)):
            unit = F.when(length > 0, v / length).otherwise(F.lit(empty))
            cols.append((unit if unit_normals else v / n).alias(f"n{c}"))
    if "_cr" in cells.columns:
        for c in "rgb":
            mean = F.rint(F.col(f"_c{c}") / n)
            cols.append(F.least(F.lit(255.0), F.greatest(F.lit(0.0), mean)).cast("int").alias(c))
    return cells.select(*cols)


def voxel_downsample(points: DataFrame, frame: DataFrame | float = VOXEL_MIN, keys=SCAN) -> DataFrame:
    """One centroid, unit normal and mean colour per voxel, in metres.

    `frame` holds `scale` and `voxel` per key, or is one voxel size for points
    already in metres. The shuffle key contains the voxel, so one huge scan
    spreads over the cluster, and partial sums shrink it before the shuffle.
    """
    keys = list(keys)
    if isinstance(frame, DataFrame):
        points = attach(points, frame.select(*keys, "scale", "voxel"), keys)
        scale, voxel = F.col("scale"), F.col("voxel")
    else:
        scale, voxel = F.lit(1.0), F.lit(float(frame))
    points = points.withColumns({c: F.col(c) * scale for c in "xyz"})
    points = points.withColumns({f"v{c}": F.floor(F.col(c) / voxel) for c in "xyz"})
    cells = points.groupBy(*keys, "vx", "vy", "vz").agg(*_cell_sums(points))
    return _cell_means(cells, keys, unit_normals=True)


def voxel_mean(points: DataFrame, voxel: float = COARSE, keys=SCAN) -> DataFrame:
    """Voxel centroids with mean (not unit) normals."""
    keys = list(keys)
    points = points.withColumns({f"v{c}": F.floor(F.col(c) / voxel) for c in "xyz"})
    cells = points.groupBy(*keys, "vx", "vy", "vz").agg(*_cell_sums(points))
    return _cell_means(cells, keys, unit_normals=False)


def estimate_normals(points: DataFrame, k: int = 30, keys=SCAN, radius: float = 0.1) -> DataFrame:
    """Normals by neighbourhood PCA, turned away from the middle of the scan's box.

    `points` has keys, id, x, y, z. Fewer than three points give +Z.
    """
    keys = list(keys)
    ext = extents(points, keys).select(
        *keys, "n", *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2.0).alias(f"m_{c}") for c in "xyz"]
    )
    ext = settle(ext.withColumnRenamed("n", "_count"))
    hood = tiles.knn(points, k, keys, radius)
    # Moments about the point itself keep their digits far from the origin.
    own = points.select(*keys, "id", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    hood = hood.join(own, [*keys, "id"]).withColumns({f"d{c}": F.col(f"n{c}") - F.col(f"_{c}") for c in "xyz"})
    fitted = eigen.with_smallest_eigen(hood.groupBy(*keys, "id").agg(*eigen.moment_sums("dx", "dy", "dz")))
    fitted = fitted.select(*keys, "id", "ex", "ey", "ez", "eig")
    out = attach(points.join(fitted, [*keys, "id"]), ext, keys)
    facing = sum((F.col(f"e{c}") * (F.col(c) - F.col(f"m_{c}")) for c in "xyz"), F.lit(0.0))
    sign = F.when(facing < 0, -1.0).otherwise(F.lit(1.0))
    few = F.col("_count") < 3
    for c, up in zip("xyz", (0.0, 0.0, 1.0)):
        out = out.withColumn(f"n{c}", F.when(few, up).otherwise(F.col(f"e{c}") * sign))
    return out.drop("ex", "ey", "ez", "_count", "m_x", "m_y", "m_z").withColumnRenamed("eig", "curvature")


def coarse_planes(points: DataFrame, keys=SCAN, min_points: int = COARSE_MIN, axis_share: float | None = None) -> DataFrame:
    """Planes of the 0.05 m cloud: bins of unit normal and offset, refitted by PCA.

    With `axis_share`, planes along the axes alone: voxels whose unit normal has no component above it, as those
    on edges, where the normals of two faces are averaged, belong to none.
    """
    keys = list(keys)
    coarse = voxel_mean(points, COARSE, keys)
    length = F.sqrt(sq(F.col("nx")) + sq(F.col("ny")) + sq(F.col("nz")))
    coarse = coarse.withColumn("_len", length).filter("_len > 1e-8")
    coarse = coarse.withColumns({f"n{c}": F.col(f"n{c}") / F.col("_len") for c in "xyz"})
    if axis_share is not None:
        coarse = coarse.filter(F.greatest(*[F.abs(f"n{c}") for c in "xyz"]) > axis_share)
    step = math.sin(math.radians(PLANE_ANGLE))
    offset = F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz")
    coarse = coarse.withColumns(
        {
            **{f"b{c}": F.rint(F.col(f"n{c}") / step).cast("int") for c in "xyz"},
            "bo": F.rint(offset / PLANE_DIST).cast("int"),
        }
    )
    bins = eigen.with_origin(coarse, keys).groupBy(*keys, "bx", "by", "bz", "bo").agg(
        *eigen.local_moments(), *[F.avg(f"n{c}").alias(f"h{c}") for c in "xyz"]
    )
    bins = bins.filter(F.col("n") >= min_points)
    order = W.partitionBy(*keys).orderBy("bx", "by", "bz", "bo")
    bins = bins.withColumn("plane", F.row_number().over(order))
    fit = eigen.with_smallest_eigen(bins)
    agree = F.col("ex") * F.col("hx") + F.col("ey") * F.col("hy") + F.col("ez") * F.col("hz")
    sign = F.when(agree < 0, -1.0).otherwise(F.lit(1.0))
    return fit.select(
        *keys,
        "plane",
        "n",
        *[(F.col(f"e{c}") * sign).alias(f"n{c}") for c in "xyz"],
        *[F.col(f"m{c}").alias(f"c{c}") for c in "xyz"],
        (F.col("n") * (COARSE * COARSE)).alias("area"),
    )


def cluster_normals(planes: DataFrame, keys=SCAN) -> DataFrame:
    """Planes whose normals lie within 10 degrees, closed transitively.

    The normal of a cluster is that of its largest plane. Order-free: the
    closure replaces a first-fit pass over the planes.
    """
    keys = list(keys)
    named = planes.withColumn("id", F.struct(*keys, "plane"))
    chord = 2.0 * math.sin(math.radians(5.0))
    pairs = tiles.eps_pairs(named, keys, ["nx", "ny", "nz"], chord, strict=True)
    label = connected_components(pairs.select("u", "v"), named.select("id"))
    labelled = named.join(label, "id")
    biggest = F.max_by(F.struct("nx", "ny", "nz"), F.struct("area", -F.col("plane")))
    out = labelled.groupBy(*keys, "component").agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("planes"), biggest.alias("_n"))
    return out.select(
        *keys, F.col("component.plane").alias("cluster"), "planes", "area", *[F.col(f"_n.n{c}").alias(f"n{c}") for c in "xyz"]
    )


def gravity(clusters: DataFrame, ext: DataFrame, up_axis: str = "auto", keys=SCAN) -> DataFrame:
    """Up direction (unsigned) per scan, and whether it is uncertain."""
    keys = list(keys)
    base = guess_up_axis(ext).select(*keys, "up_axis")
    axis = {c: F.when(F.col("up_axis") == c, 1.0).otherwise(F.lit(0.0)).alias(f"a{c}") for c in "xyz"}
    if up_axis in ("x", "y", "z"):
        fixed = base.withColumn("up_axis", F.lit(up_axis)).select(*keys, *axis.values())
        return fixed.select(*keys, *[F.col(f"a{c}").alias(f"u{c}") for c in "xyz"], "ax", "ay", "az", F.lit(False).alias("uncertain"), F.lit(True).alias("forced"))
    base = base.select(*keys, *axis.values())
    near = clusters.join(base, keys)
    lean = F.abs(sum((F.col(f"n{c}") * F.col(f"a{c}") for c in "xyz"), F.lit(0.0)))
    near = near.filter(lean >= math.cos(math.radians(25.0)))
    best = near.groupBy(*keys).agg(F.max_by(F.struct("nx", "ny", "nz"), F.struct("area", -F.col("cluster"))).alias("_n"))
    out = base.join(best, keys, "left")
    return out.select(
        *keys,
        *[F.coalesce(F.col(f"_n.n{c}"), F.col(f"a{c}")).alias(f"u{c}") for c in "xyz"],
        "ax", "ay", "az",
        F.col("_n").isNull().alias("uncertain"),
        F.lit(False).alias("forced"),
    )


def orient_up(up: DataFrame, planes: DataFrame, keys=SCAN) -> DataFrame:
    """Sign of up: from the lower to the upper of the two largest level planes."""
    keys = list(keys)
    length = F.greatest(F.sqrt(sq(F.col("ux")) + sq(F.col("uy")) + sq(F.col("uz"))), F.lit(1e-12))
    up = up.withColumns({f"u{c}": F.col(f"u{c}") / length for c in "xyz"})
    level = planes.join(up, keys).filter(
        F.abs(sum((F.col(f"n{c}") * F.col(f"u{c}") for c in "xyz"), F.lit(0.0))) >= COS15
    )
    order = W.partitionBy(*keys).orderBy(F.col("area").desc(), "plane")
    top = level.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    top = top.withColumn("_h", sum((F.col(f"c{c}") * F.col(f"a{c}") for c in "xyz"), F.lit(0.0)))
    pair = top.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"),
        F.min(F.struct("_h", "_r", "cx", "cy", "cz")).alias("_lo"),
        F.max(F.struct("_h", "_r", "cx", "cy", "cz")).alias("_hi"),
    )
    out = up.join(pair, keys, "left")
    by_axis = sum((F.col(f"u{c}") * F.col(f"a{c}") for c in "xyz"), F.lit(0.0))
    by_planes = sum((F.col(f"u{c}") * (F.col(f"_hi.c{c}") - F.col(f"_lo.c{c}")) for c in "xyz"), F.lit(0.0))
    turn = F.when(F.coalesce(F.col("_k"), F.lit(0)) < 2, by_axis).otherwise(by_planes)
    sign = F.when(F.col("forced") | (turn >= 0), 1.0).otherwise(F.lit(-1.0))
    return out.select(*keys, *[(F.col(f"u{c}") * sign).alias(f"u{c}") for c in "xyz"], "uncertain")


ROT = [f"r{i}{j}" for i in range(3) for j in range(3)]


def rotation_to_z(up: DataFrame) -> DataFrame:
    """Adds r00..r22, the least rotation that turns (ux, uy, uz) to +Z."""
    length = F.greatest(F.sqrt(sq(F.col("ux")) + sq(F.col("uy")) + sq(F.col("uz"))), F.lit(1e-12))
    # Staged columns keep the expressions of the nine entries short.
    out = up.withColumns({"_x": F.col("ux") / length, "_y": F.col("uy") / length, "_c": F.col("uz") / length})
    x, y, c = F.col("_x"), F.col("_y"), F.col("_c")
    use_x = F.abs(x) < 0.9
    # Upside down: half a turn about a level axis.
    out = out.withColumns(
        {
            "_k": 1.0 / F.nullif(1.0 + c, F.lit(0.0)),
            "_a0": F.when(use_x, 0.0).otherwise(-c),
            "_a1": F.when(use_x, c).otherwise(F.lit(0.0)),
            "_a2": F.when(use_x, -y).otherwise(x),
        }
    )
    k = F.col("_k")
    free = [
        [1.0 - k * x * x, -k * x * y, -x],
        [-k * x * y, 1.0 - k * y * y, -y],
        [x, y, 1.0 - k * (x * x + y * y)],
    ]
    out = out.withColumn("_l2", sq(F.col("_a0")) + sq(F.col("_a1")) + sq(F.col("_a2")))
    eye = [[1.0 if i == j else 0.0 for j in range(3)] for i in range(3)]
    half = [[2.0 * F.col(f"_a{i}") * F.col(f"_a{j}") / F.nullif(F.col("_l2"), F.lit(0.0)) - eye[i][j] for j in range(3)] for i in range(3)]
    out = out.withColumns(
        {
            f"r{i}{j}": F.when(c > 0.999999, F.lit(eye[i][j])).when(c < -0.999999, half[i][j]).otherwise(free[i][j])
            for i in range(3)
            for j in range(3)
        }
    )
    return out.drop("_x", "_y", "_c", "_k", "_a0", "_a1", "_a2", "_l2")


def rotate_columns(names: tuple[str, str, str], shift: str | None = None) -> dict[str, Column]:
    v = [F.col(n) for n in names]
    out = {n: F.col(f"r{i}0") * v[0] + F.col(f"r{i}1") * v[1] + F.col(f"r{i}2") * v[2] for i, n in enumerate(names)}
    if shift:
        out[names[2]] = out[names[2]] - F.col(shift)
    return out


def apply_frame(rows: DataFrame, frame: DataFrame, keys=SCAN) -> DataFrame:
    """Rigid transform of points (with normals) or triangles by r00..r22 and z_shift."""
    keys = list(keys)
    shift = "z_shift" if "z_shift" in frame.columns else None
    out = attach(rows, frame.select(*keys, *ROT, *([shift] if shift else [])), keys)
    if "ax" in rows.columns:
        for corner in "abc":
            out = out.withColumns(rotate_columns((f"{corner}x", f"{corner}y", f"{corner}z"), shift))
    else:
        out = out.withColumns(rotate_columns(("x", "y", "z"), shift))
        if "nx" in rows.columns:
            out = out.withColumns(rotate_columns(("nx", "ny", "nz")))
    return out.select(*rows.columns)


def manhattan_angle(points: DataFrame, keys=SCAN, min_points: int = 50) -> DataFrame:
    """Mean direction inside the fullest 1 degree bin of level normals, in (-90, 90]."""
    keys = list(keys)
    level = points.filter(F.abs(F.col("nz")) < SIN15)
    angle = F.pmod(F.degrees(F.atan2("ny", "nx")), F.lit(180.0))
    hist = level.select(*keys, angle.alias("_a")).groupBy(*keys, F.floor("_a").alias("bin"))
    hist = hist.agg(F.count(F.lit(1)).alias("n"), F.avg("_a").alias("mean"))
    best = hist.groupBy(*keys).agg(
        F.sum("n").alias("level_points"), F.max_by("mean", F.struct("n", -F.col("bin"))).alias("mean")
    )
    best = best.filter(F.col("level_points") >= min_points)
    return best.select(*keys, "level_points", (-(F.pmod(F.col("mean") + 90.0, F.lit(180.0)) - 90.0)).alias("manhattan_deg"))


def turn_about_z(degrees: str = "manhattan_deg") -> dict[str, Column]:
    a = F.radians(F.col(degrees))
    c, s = F.cos(a), F.sin(a)
    one, zero = F.lit(1.0), F.lit(0.0)
    return dict(zip(ROT, (c, -s, zero, s, c, zero, zero, zero, one)))


def height_peaks(points: DataFrame, column: str = "z", keys=SCAN) -> DataFrame:
    """Peaks of the 0.05 m height histogram: (keys, height, weight)."""
    keys = list(keys)
    values = points.select(*keys, F.col(column).alias("_v"))
    lim = values.groupBy(*keys).agg(
        (F.min("_v") - BIN).alias("low"), (F.max("_v") + 0.1).alias("high"), F.count(F.lit(1)).alias("total")
    )
    lim = settle(
        lim.withColumn("step", F.col("low") + BIN - F.col("low")).withColumn(
            "bins", F.ceil((F.col("high") - F.col("low")) / BIN) - 1
        )
    )
    binned = attach(values, lim.select(*keys, "low", "step"), keys)
    i = F.floor((F.col("_v") - F.col("low")) / BIN)
    # The edges are low + i * step: settle values that division put one bin off.
    i = (
        F.when(F.col("_v") >= F.col("low") + (i + 1) * F.col("step"), i + 1)
        .when(F.col("_v") < F.col("low") + i * F.col("step"), i - 1)
        .otherwise(i)
    )
    hist = binned.groupBy(*keys, i.alias("bin")).agg(F.count(F.lit(1)).alias("h"))
    # Only occupied bins can peak. Their neighbours' counts come from windows over bin numbers, so an outlier
    # far up or down adds one bin and not all those between.
    full = hist.join(lim.filter("bins > 0"), keys).filter("bin >= 0 and bin < bins")
    zero = F.lit(0).cast("long")
    near = lambda a, b: F.sum("h").over(W.partitionBy(*keys).orderBy("bin").rangeBetween(a, b))
    full = full.withColumns({"hl": F.coalesce(near(-1, -1), zero), "hr": F.coalesce(near(1, 1), zero), "s": near(-1, 1), "sl": near(-2, 0), "sr": near(0, 2)})
    full = full.withColumns({"sl": F.when(F.col("bin") > 0, F.col("sl")), "sr": F.when(F.col("bin") < F.col("bins") - 1, F.col("sr"))})
    heavy = F.col("h") >= 0.02 * F.col("total")
    smooth_peak = (
        (F.col("s") >= F.coalesce("sl", F.lit(-1))) & (F.col("s") >= F.coalesce("sr", F.lit(-1)))
        & ~((F.col("sl").isNotNull()) & (F.col("s") == F.col("sl")) & (F.col("h") <= F.col("hl")))
        & heavy & (F.col("s") > 0)
    )
    raw_peak = heavy & (F.col("h") >= F.coalesce("hl", zero)) & (F.col("h") >= F.coalesce("hr", zero)) & (F.col("h") > 0)
    short = F.col("bins") < 3

    def centre(k):
        return F.col("low") + (F.col("bin") + k) * F.col("step") + F.col("step") / 2.0

    weighted = (
        F.coalesce("hl", zero) * centre(-1) + F.col("h") * centre(0) + F.coalesce("hr", zero) * centre(1)
    ) / F.col("s")
    peaks = full.filter(F.when(short, raw_peak).otherwise(smooth_peak))
    return peaks.select(*keys, F.when(short, centre(0)).otherwise(weighted).alias("height"), F.col("h").alias("weight"))


def floor_points(points: DataFrame) -> DataFrame:
    return points.filter(F.col("nz") > COS15)


def ceiling_points(points: DataFrame) -> DataFrame:
    return points.filter(F.col("nz") < -COS15)


def seat_shift(points: DataFrame, keys=SCAN) -> DataFrame:
    """z_shift per scan: the lowest floor peak, or the lowest floor point."""
    keys = list(keys)
    floor = floor_points(points)
    low = floor.groupBy(*keys).agg(F.min("z").alias("_low"))
    peak = height_peaks(floor, "z", keys).groupBy(*keys).agg(F.min("height").alias("_peak"))
    return low.join(peak, keys, "left").select(*keys, F.coalesce("_peak", "_low").alias("z_shift"))


def seat_floors(points: DataFrame, keys=SCAN) -> DataFrame:
    keys = list(keys)
    out = attach(points, seat_shift(points, keys), keys, "left")
    return out.withColumn("z", F.col("z") - F.coalesce("z_shift", F.lit(0.0))).select(*points.columns)


def band_area(points: DataFrame, heights: DataFrame, keys=SCAN, approximate: bool = False) -> DataFrame:
    """Area of distinct 0.05 m cells within 0.05 m of each height.

    The range join is an equi-join on the height bucket: each height is sent
    to the buckets its band touches.
    """
    keys = list(keys)
    near = heights.select(*keys, "height").withColumn(
        "_b", F.explode(F.sequence(F.floor((F.col("height") - 0.05) / 0.1) - 1, F.floor((F.col("height") + 0.05) / 0.1) + 1))
    )
    cells = points.select(*keys, "z", tiles.cell("x", BIN).alias("_cx"), tiles.cell("y", BIN).alias("_cy"), F.floor(F.col("z") / 0.1).alias("_b"))
    hits = attach(cells, near, [*keys, "_b"]).filter(F.abs(F.col("z") - F.col("height")) <= 0.05)
    if approximate:
        count = hits.groupBy(*keys, "height").agg(F.approx_count_distinct(F.xxhash64("_cx", "_cy"), 0.02).alias("cells"))
    else:
        count = hits.groupBy(*keys, "height", "_cx", "_cy").agg(F.lit(1).alias("one"))
        count = count.groupBy(*keys, "height").agg(F.count(F.lit(1)).alias("cells"))
    out = heights.join(count, [*keys, "height"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    return out.withColumn("area", F.col("cells") * (BIN * BIN))


def storeys(floor_areas: DataFrame, ceiling_peaks: DataFrame, lowest: DataFrame, keys=SCAN) -> tuple[DataFrame, DataFrame]:
    """(levels, hints) from floor peaks with areas, ceiling peaks and min z per scan."""
    keys = list(keys)
    widest = F.max("area").over(W.partitionBy(*keys))
    floors = settle(
        floor_areas.withColumn("_w", widest).withColumn("small", (F.col("_w") > 0) & (F.col("area") < 0.3 * F.col("_w")))
    )
    kept = floors.filter(~F.col("small"))
    ceilings = ceiling_peaks.select(*keys, F.col("height").alias("top"))
    # Peaks per scan are bounded by the 2 % rule (at most fifty of each kind).
    paired = kept.join(ceilings, keys).filter((F.col("top") - F.col("height")).between(1.8, 8.0))
    found = settle(
        paired.groupBy(*keys, F.col("height").alias("elevation"), "weight").agg(F.min("top").alias("top"))
        .select(*keys, "elevation", (F.col("top") - F.col("elevation")).alias("ceiling_height"))
    )
    strongest = kept.groupBy(*keys).agg(F.max_by("height", F.struct("weight", -F.col("height"))).alias("_f"))
    missing = lowest.join(found.select(*keys).distinct(), keys, "left_anti").join(strongest, keys, "left")
    missing = settle(missing.select(*keys, F.coalesce("_f", "min_z").alias("elevation"), F.lit(2.7).alias("ceiling_height")))
    both = found.unionByName(missing)
    order = W.partitionBy(*keys).orderBy("elevation")
    levels = both.withColumn("level_index", (F.row_number().over(order) - 1).cast("int"))
    hints = floors.filter("small").select(
        *keys, F.lit("mezzanine").alias("code"), F.lit("info").alias("severity"),
        F.lit("A small floor peak was ignored as a mezzanine hint.").alias("message"),
    ).unionByName(
        missing.select(
            *keys, F.lit("ceiling_missing").alias("code"), F.lit("warning").alias("severity"),
            F.lit("No ceiling was found, so the storey height is assumed.").alias("message"),
        )
    )
    return levels.select(*keys, "level_index", "elevation", "ceiling_height"), hints


def find_storeys(points: DataFrame, keys=SCAN) -> tuple[DataFrame, DataFrame]:
    keys = list(keys)
    floor = floor_points(points)
    peaks = settle(height_peaks(floor, "z", keys))
    areas = band_area(floor, peaks, keys)
    ceilings = height_peaks(ceiling_points(points), "z", keys)
    lowest = points.groupBy(*keys).agg(F.min("z").alias("min_z"))
    return storeys(areas, ceilings, lowest, keys)


def assign_levels(points: DataFrame, levels: DataFrame, keys=SCAN) -> DataFrame:
    """Points with the storeys that hold them (a point may belong to two)."""
    keys = list(keys)
    side = levels.select(*keys, "level_index", "elevation", "ceiling_height").withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("elevation") - 0.3) - 1, F.floor(F.col("elevation") + F.col("ceiling_height") + 0.3) + 1))
    )
    out = attach(points.withColumn("_b", F.floor("z")), side, [*keys, "_b"])
    inside = (F.col("z") >= F.col("elevation") - 0.3) & (F.col("z") <= F.col("elevation") + F.col("ceiling_height") + 0.3)
    return out.filter(inside).drop("_b")


def scan_issues(frame: DataFrame, hints: DataFrame | None = None, keys=SCAN) -> DataFrame:
    """Issue rows for guessed units, uncertain gravity, and the storey hints."""
    keys = list(keys)

    def rows(flag, code, message):
        return frame.filter(F.col(flag)).select(
            *keys, F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.lit(message).alias("message")
        )

    out = rows("guessed", "units_guessed", "The file units were guessed and converted to metres.").unionByName(
        rows("uncertain", "gravity_uncertain", "Gravity was taken from the shortest bounding-box axis.")
    )
    return out if hints is None else out.unionByName(hints.select(*keys, "code", "severity", "message"))


def shell_level(levels: DataFrame, lowest: DataFrame, keys=SCAN) -> DataFrame:
    """One empty storey per scan at the lowest storey, else at min z."""
    keys = list(keys)
    low = levels.groupBy(*keys).agg(F.min(F.struct("elevation", "ceiling_height")).alias("_l"))
    ceiling = F.coalesce(F.col("_l.ceiling_height"), F.lit(2.7))
    return lowest.join(low, keys, "left").select(
        *keys, F.lit("L1").alias("level_id"), F.lit("Level 1").alias("name"),
        F.coalesce(F.col("_l.elevation"), F.col("min_z"), F.lit(0.0)).alias("elevation"),
        F.when(ceiling > 1.5, ceiling).otherwise(F.lit(2.7)).alias("ceiling_height"),
    )


class Normalized:
    """Settled outputs of `normalize`."""

    def __init__(self, points, frame, levels, issues, triangles=None):
        self.points = points
        self.frame = frame
        self.levels = levels
        self.issues = issues
        self.triangles = triangles


def normalize(points: DataFrame, triangles: DataFrame | None = None, units: str = "auto", up_axis: str = "auto",
              hint: DataFrame | None = None, plane_min: int = COARSE_MIN) -> Normalized:
    """Units, voxels, normals, gravity, rotation, Manhattan turn, floors, storeys.

    `points` has scan_id, x, y, z and optionally nx, ny, nz and r, g, b;
    `hint` has scan_id, unit_scale. Each stage that needs a whole-scan figure
    ends in a small settled table; the points pass through twice settled: once
    after the voxels, once in the final frame.
    """
    ext = extents(points)
    if hint is not None:
        ext = ext.join(hint.select("scan_id", "unit_scale"), "scan_id", "left")
    frame = settle(choose_voxel(unit_scale(ext, units, "unit_scale" if hint is not None else None)))
    cloud = voxel_downsample(points, frame).withColumn("id", F.struct("vx", "vy", "vz"))
    cloud = settle(cloud)
    if "nx" not in points.columns:
        cloud = settle(estimate_normals(cloud))
    planes = settle(coarse_planes(cloud, min_points=plane_min))
    box = settle(extents(cloud))
    up = settle(orient_up(settle(gravity(cluster_normals(planes), box, up_axis)), planes))
    up = settle(rotation_to_z(up))
    cloud = apply_frame(cloud, up)
    turn = manhattan_angle(cloud).select("scan_id", "manhattan_deg")
    turn = up.select("scan_id").join(turn, "scan_id", "left").withColumn("manhattan_deg", F.coalesce("manhattan_deg", F.lit(0.0)))
    turn = settle(turn.withColumns(turn_about_z()))
    cloud = apply_frame(cloud, turn)
    shift = settle(seat_shift(cloud))
    cloud = attach(cloud, shift, SCAN, "left").withColumn("z", F.col("z") - F.coalesce("z_shift", F.lit(0.0))).drop("z_shift")
    cloud = settle(cloud)
    levels, hints = find_storeys(cloud)
    levels = settle(levels)
    whole = (
        frame.select("scan_id", "scale", "voxel", "guessed")
        .join(up.select("scan_id", "ux", "uy", "uz", "uncertain", *[F.col(r).alias(f"_{r}") for r in ROT]), "scan_id", "left")
        .join(turn.select("scan_id", "manhattan_deg", *[F.col(r).alias(f"t{r}") for r in ROT]), "scan_id", "left")
        .join(shift, "scan_id", "left")
        .withColumn("z_shift", F.coalesce("z_shift", F.lit(0.0)))
        .withColumn("uncertain", F.coalesce("uncertain", F.lit(False)))
    )
    # One rotation for meshes: the Manhattan turn after the turn to Z.
    whole = whole.withColumns(
        {f"r{i}{j}": sum((F.col(f"tr{i}{k}") * F.col(f"_r{k}{j}") for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)}
    )
    whole = settle(whole.select("scan_id", "scale", "voxel", "guessed", "ux", "uy", "uz", "uncertain", "manhattan_deg", *ROT, "z_shift"))
    mesh = None
    if triangles is not None:
        scaled = attach(triangles, whole.select("scan_id", "scale"), SCAN)
        corners = [f"{c}{d}" for c in "abc" for d in "xyz"]
        scaled = scaled.withColumns({c: F.col(c) * F.col("scale") for c in corners}).drop("scale")
        mesh = apply_frame(scaled, whole)
    return Normalized(cloud, whole, levels, scan_issues(whole, hints), mesh)
