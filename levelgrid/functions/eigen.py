"""Closed-form eigen solution of symmetric 3x3 matrices (Smith, CACM 1961) on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.session import attach

MOMENTS = ["n", "sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]


def moment_sums(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    """Nine sums and a count; they add up, so partial aggregation and merges are free."""
    x, y, z = F.col(x), F.col(y), F.col(z)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(z).alias("sz"),
        F.sum(x * x).alias("sxx"),
        F.sum(x * y).alias("sxy"),
        F.sum(x * z).alias("sxz"),
        F.sum(y * y).alias("syy"),
        F.sum(y * z).alias("syz"),
        F.sum(z * z).alias("szz"),
    ]


def add_moments() -> list[Column]:
    return [F.sum(m).alias(m) for m in MOMENTS]


def with_origin(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ox, oy, oz, a whole-metre point near the middle of each key's rows, and x_, y_, z_ measured from it.

    Squares of map coordinates leave no digits for the millimetres of a plane; squares of these do. They are
    whole nanometres, so that their sums are exact.
    """
    middle = points.groupBy(*keys).agg(*[F.floor(F.avg(c)).cast("double").alias(f"o{c}") for c in "xyz"])
    out = attach(points, middle, list(keys))
    return out.withColumns({f"{c}_": F.rint((F.col(c) - F.col(f"o{c}")) * 1e9) / 1e9 for c in "xyz"})


def local_moments() -> list[Column]:
    """Moment sums measured from the rows' origin, with the origin itself (one per group).

    The first sums are added up as whole nanometres, so that a centre is the nearest number to its exact value.
    """
    whole = [(F.sum(F.rint(F.col(f"{c}_") * 1e9).cast("long")) / 1e9).alias(f"s{c}") for c in "xyz"]
    count, _, _, _, *second = moment_sums("x_", "y_", "z_")
    return [count, *whole, *second, *[F.first(f"o{c}").alias(f"o{c}") for c in "xyz"]]


def with_scatter(df: DataFrame) -> DataFrame:
    """Centre and centred scatter (cxx..czz) from the moment sums, which may have an origin (ox, oy, oz)."""
    mean = {c: F.col(f"s{c}") / F.col("n") for c in "xyz"}
    out = df.withColumns({f"c{a}{b}": F.col(f"s{a}{b}") - F.col("n") * mean[a] * mean[b] for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")})
    return out.withColumns({f"m{c}": mean[c] + F.col(f"o{c}") if f"o{c}" in df.columns else mean[c] for c in "xyz"})


def with_smallest_eigen(df: DataFrame) -> DataFrame:
    """Adds `eig` (smallest eigenvalue of the scatter) and its unit vector ex, ey, ez."""
    df = with_scatter(df) if "cxx" not in df.columns else df
    a, b, c = F.col("cxx"), F.col("cyy"), F.col("czz")
    d, e, f = F.col("cxy"), F.col("cxz"), F.col("cyz")
    df = df.withColumns({"_q": (a + b + c) / 3.0, "_p1": d * d + e * e + f * f})
    q = F.col("_q")
    df = df.withColumn(
        "_p", F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2.0 * F.col("_p1")) / 6.0)
    )
    p = F.col("_p")
    det = (
        (a - q) * ((b - q) * (c - q) - f * f)
        - d * (d * (c - q) - f * e)
        + e * (d * f - (b - q) * e)
    )
    df = df.withColumn("_r", F.when(p > 0, det / (2.0 * p * p * p)).otherwise(F.lit(1.0)))
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_r")))
    df = df.withColumn("eig", q + 2.0 * p * F.cos(F.acos(r) / 3.0 + F.lit(2.0 * math.pi / 3.0)))
    lam = F.col("eig")
    rows = [(a - lam, d, e), (d, b - lam, f), (e, f, c - lam)]

    def crossed(u, v):
        return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])

    candidates = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        x, y, z = crossed(rows[i], rows[j])
        candidates.append(F.struct((x * x + y * y + z * z).alias("len2"), x.alias("x"), y.alias("y"), z.alias("z")))
    df = df.withColumn("_best", F.greatest(*candidates))
    length = F.sqrt(F.col("_best.len2"))
    # A zero cross product means a repeated smallest eigenvalue: any vector
    # orthogonal to the longest row belongs to it.
    longest = F.greatest(
        *[F.struct((u[0] * u[0] + u[1] * u[1] + u[2] * u[2]).alias("len2"), u[0].alias("x"), u[1].alias("y"), u[2].alias("z")) for u in rows]
    )
    df = df.withColumn("_long", longest)
    lx, ly, lz = F.col("_long.x"), F.col("_long.y"), F.col("_long.z")
    flat = F.abs(lx) >= F.abs(lz)
    ox = F.when(F.col("_long.len2") <= 0, 0.0).when(flat, -ly).otherwise(F.lit(0.0))
    oy = F.when(F.col("_long.len2") <= 0, 0.0).when(flat, lx).otherwise(-lz)
    oz = F.when(F.col("_long.len2") <= 0, 1.0).when(flat, 0.0).otherwise(ly)
    olen = F.sqrt(ox * ox + oy * oy + oz * oz)
    tiny = length <= F.lit(1e-12) * F.greatest(F.col("_long.len2"), F.lit(1e-300))
    df = df.withColumns(
        {
            "ex": F.when(tiny, ox / olen).otherwise(F.col("_best.x") / length),
            "ey": F.when(tiny, oy / olen).otherwise(F.col("_best.y") / length),
            "ez": F.when(tiny, oz / olen).otherwise(F.col("_best.z") / length),
        }
    )
    return df.drop("_q", "_p1", "_p", "_r", "_best", "_long")
