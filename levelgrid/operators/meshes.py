"""Scene inputs: node transforms, colours, and area sampling of triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.operators.normalize import SCAN
from levelgrid.session import attach
from levelgrid.functions.geometry import sq


def bake_transforms(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points of each node moved by its row-major 4x4; colours only if every block has them."""
    m = [F.element_at("m", i + 1).alias(f"_m{i}") for i in range(12)]
    side = nodes.select("scan_id", "node_id", *m)
    out = attach(points, side, ["scan_id", "node_id"])
    moved = {
        c: F.col(f"_m{4 * i}") * F.col("x") + F.col(f"_m{4 * i + 1}") * F.col("y") + F.col(f"_m{4 * i + 2}") * F.col("z") + F.col(f"_m{4 * i + 3}")
        for i, c in enumerate("xyz")
    }
    out = out.withColumns(moved).drop(*[f"_m{i}" for i in range(12)])
    if "r" not in points.columns:
        return out
    # A block without colours has none at all: one flag per scan is enough.
    painted = points.groupBy("scan_id").agg(F.min(F.col("r").isNotNull().cast("int")).alias("_all"))
    out = attach(out, painted, SCAN)
    return out.withColumns({c: F.when(F.col("_all") == 1, F.col(c)) for c in "rgb"}).drop("_all")


def normalize_colors(points: DataFrame, keys=SCAN) -> DataFrame:
    """Float colours in 0..1 become 0..255; all are rounded half-even and clipped."""
    keys = list(keys)
    top = points.groupBy(*keys).agg(F.max(F.greatest("r", "g", "b")).alias("_top"))
    out = attach(points, top, keys)
    floats = dict(points.dtypes)["r"] in ("double", "float")
    factor = F.when(F.col("_top") <= 1.0, 255.0).otherwise(F.lit(1.0)) if floats else F.lit(1.0)
    shade = lambda c: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.col(c) * factor))).cast("int")
    return out.withColumns({c: shade(c) for c in "rgb"}).drop("_top")


def mesh_step(triangles: DataFrame, keys=SCAN) -> DataFrame:
    """Sample spacing in file units from the mesh's larger plan side."""
    keys = list(keys)
    lows = [F.min(F.least(f"a{c}", f"b{c}", f"c{c}")).alias(f"lo{c}") for c in "xy"]
    highs = [F.max(F.greatest(f"a{c}", f"b{c}", f"c{c}")).alias(f"hi{c}") for c in "xy"]
    box = triangles.groupBy(*keys).agg(*lows, *highs)
    span = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xy"])
    return box.select(*keys, span.alias("span"), F.when(span > 200, 50.0).when(span > 50, 5.0).otherwise(F.lit(0.05)).alias("step"))


def sample_triangles(triangles: DataFrame, steps: DataFrame | None = None, keys=SCAN) -> DataFrame:
    """Barycentric grid samples of every triangle, each with the face normal.

    Two generators make the samples where the triangle lies; nothing shuffles.
    """
    keys = list(keys)
    steps = mesh_step(triangles, keys) if steps is None else steps
    t = attach(triangles, steps.select(*keys, "step"), keys)
    e = {f"{n}{c}": F.col(f"{q}{c}") - F.col(f"{p}{c}") for n, p, q in (("e", "a", "b"), ("f", "a", "c"), ("h", "b", "c")) for c in "xyz"}
    t = t.withColumns({f"_{k}": v for k, v in e.items()})
    col = lambda n: F.col(f"_{n}")
    t = t.withColumns(
        {
            "nx": col("ey") * col("fz") - col("ez") * col("fy"),
            "ny": col("ez") * col("fx") - col("ex") * col("fz"),
            "nz": col("ex") * col("fy") - col("ey") * col("fx"),
        }
    )
    size = lambda v: F.sqrt(sq(F.col(f"{v}x")) + sq(F.col(f"{v}y")) + sq(F.col(f"{v}z")))
    t = t.withColumn("_len", size("n")).filter("_len >= 1e-10")
    longest = F.greatest(size("_e"), size("_f"), size("_h"))
    t = t.withColumn("_k", F.greatest(F.lit(1), F.ceil(longest / F.col("step"))).cast("int"))
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    t = t.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_k") - F.col("i"))))
    u, v = F.col("i") / F.col("_k"), F.col("j") / F.col("_k")
    return t.select(
        *keys, "face_id", "i", "j",
        *[(F.col(f"a{c}") + u * col(f"e{c}") + v * col(f"f{c}")).alias(c) for c in "xyz"],
        *[(F.col(f"n{c}") / F.col("_len")).alias(f"n{c}") for c in "xyz"],
    )
