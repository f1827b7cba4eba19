"""Coloured mask pictures as pixel tables: palette, components, metric boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levelgrid.functions import geometry as g
from levelgrid.functions import hulls
from levelgrid.functions.graph import connected_components
from levelgrid.operators.openings import SQUARE, morph_close
from levelgrid.plans.schemas import FIXTURE_SYMBOLS
from levelgrid.session import BROADCAST_BYTES, attach, settle

# Colour of every region name, as red, green, blue.
PALETTE = {
    "outside": (0, 0, 0), "floor": (238, 238, 238), "toilet": (220, 60, 60), "sink": (60, 180, 75), "bathtub": (50, 100, 220),
    "shower": (40, 200, 200), "kitchen-counter": (220, 170, 40), "stove": (240, 120, 30), "bed-double": (150, 70, 200), "sofa": (220, 70, 160),
    "table": (150, 90, 40), "wardrobe": (30, 160, 160), "block": (100, 100, 100), "chair": (200, 120, 200),
}
TOLERANCE = 100.0
WALL_SNAP = 0.15
PARALLEL_DEG = 12.0

IMAGE = ["image_id"]


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, width, height, row, col, r, g, b) of pictures, by Spark's image source."""
    im = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    n = F.col("nChannels")
    # Bytes are stored in blue, green, red order, row by row.
    at = lambda k: F.conv(F.hex(F.substring(F.col("data"), (F.col("_p") * n + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    px = im.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    rgb = [F.when(n == 1, at(0)).otherwise(at(k)).alias(c) for k, c in ((2, "r"), (1, "g"), (0, "b"))]
    return px.select(F.col("origin").alias("image_id"), "width", "height", F.floor(F.col("_p") / F.col("width")).cast("int").alias("row"), (F.col("_p") % F.col("width")).alias("col"), *rgb)


def nearest_palette(pixels: DataFrame, palette: dict[str, tuple] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds `name` and `distance` of the nearest palette colour; too far gives NULL.

    The palette is a fixed list, so the nearest one is a chain of columns and
    no join at all; the first of equal distances wins.
    """
    palette = PALETTE if palette is None else palette
    d2 = lambda c: g.sq(F.col("r") - c[0]) + g.sq(F.col("g") - c[1]) + g.sq(F.col("b") - c[2])
    # Squared distance and position in one integer: the least one is the nearest, first on ties.
    best = F.least(*[d2(c) * len(palette) + i for i, c in enumerate(palette.values())])
    names = F.array(*[F.lit(n) for n in palette])
    out = pixels.withColumn("_b", best)
    out = out.withColumn("distance", F.sqrt(F.floor(F.col("_b") / len(palette))))
    return out.withColumn("name", F.when(F.col("distance") <= tolerance, F.get(names, F.col("_b") % len(palette)))).drop("_b")


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """The same operator on array<float> rows: nearest of the centroids (label, centroid), the least label of equals.

    Centroids are dealt into blocks of bounded bytes. Vectors meet one broadcast block after the other and keep
    the best so far, so they are never shuffled, whatever the number of centroids.
    """
    side = settle(centroids)
    number = max(1, -(-side._bytes // BROADCAST_BYTES))
    block = F.pmod(F.xxhash64("label"), F.lit(number)).alias("_block")
    packed = settle(side.groupBy(block).agg(F.collect_list(F.struct("label", "centroid")).alias("_all")))
    gap = lambda c: F.aggregate(F.zip_with(F.col(vector), c["centroid"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    near = F.array_min(F.transform("_all", lambda c: F.struct(F.round(gap(c), 9).alias("d"), c["label"].alias("label"))))
    out = vectors
    for k in range(number):
        one = F.broadcast(packed.filter(F.col("_block") == k))
        out = out.withColumn("_block", F.lit(k).cast("long")).join(one, "_block", "left")
        best = near if k == 0 else F.least("_n", near)
        out = out.withColumn("_n", best).drop("_all", "_block")
    return out.withColumns({"nearest": F.col("_n.label"), "distance2": F.col("_n.d")}).drop("_n")


def floor_gate(named: DataFrame, keys=IMAGE) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) pictures: enough floor pixels, at least ten and one per cent."""
    keys = list(keys)
    c = settle(named.groupBy(*keys).agg(F.count_if(F.col("name") == "floor").alias("floor_pixels"), F.count(F.lit(1)).alias("pixels")))
    ok = F.col("floor_pixels") >= F.greatest(F.lit(10), F.floor(F.col("pixels") * 0.01))
    return c.filter(ok), c.filter(~ok).withColumn("reason", F.lit("The mask has no recognizable floor region."))


def mask_components(named: DataFrame, dims: DataFrame, keys=IMAGE) -> DataFrame:
    """(keys, symbol, component, row, col) of closed regions, 8-connected, large enough.

    `dims` has keys, width, height. Pixels of a row that touch are one run,
    and only runs are nodes of the graph, so a large region has one node per
    row and not one per pixel.
    """
    keys = list(keys)
    from pyspark.sql import Window as W

    cells = settle(named.select(*keys, F.col("name").alias("symbol"), "row", "col")).filter(~F.col("symbol").isin("outside", "floor"))
    size = dims.select(*keys, F.col("height").alias("rows"), F.col("width").alias("cols"))
    per = cells.select(*keys, "symbol").distinct().join(size, keys)
    closed = morph_close(cells, per, [*keys, "symbol"], SQUARE)
    w = W.partitionBy(*keys, "symbol", "row").orderBy("col")
    runs = closed.withColumn("_s", F.coalesce(F.col("col") > F.lag("col").over(w) + 1, F.lit(True)).cast("int"))
    runs = settle(runs.withColumn("run", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))))
    r = runs.groupBy(*keys, "symbol", "row", "run").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(F.lit(1)).alias("n"))
    r = settle(r.withColumn("id", F.struct(*keys, "symbol", "row", "run")))
    below = r.select(*keys, "symbol", (F.col("row") - 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("id").alias("v"))
    edges = r.join(below, [*keys, "symbol", "row"]).filter("d0 <= c1 + 1 and d1 >= c0 - 1").select(F.col("id").alias("u"), "v")
    label = connected_components(edges, r.select("id")).select("id", F.struct("component.row", "component.run").alias("component"))
    named_runs = settle(r.join(label, "id"))
    area = named_runs.groupBy(*keys, "symbol", "component").agg(F.sum("n").alias("area")).join(size, keys)
    good = area.filter(F.col("area") >= F.greatest(F.lit(12), F.floor(F.col("rows") * F.col("cols") * 0.00015))).select(*keys, "symbol", "component")
    kept = named_runs.join(good, [*keys, "symbol", "component"])
    return kept.select(*keys, "symbol", "component", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def mask_boxes(components: DataFrame, frames: DataFrame, keys=IMAGE) -> DataFrame:
    """Metric boxes of components; `frames` has keys, width, height and the six numbers ox..yy.

    The width edge is the most level one and rotation lies in [-90, 90).
    """
    keys = list(keys)
    part = [*keys, "symbol", "component"]
    rect = hulls.rotated_rectangle(hulls.convex_hull(components.select(*part, F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y")), part), part)
    box = rect.withColumn("_ring", g.rotated_box(g.xy("x", "y"), F.col("width"), F.col("depth"), F.col("angle")))
    # Not "width": the picture's own size comes with the frame.
    fr = frames.select(*keys, F.col("width").alias("_w"), F.col("height").alias("_h"), "ox", "oy", "xx", "xy", "yx", "yy")
    b = box.drop("width", "depth").join(fr, keys)
    u = lambda p: p["x"] / F.greatest(F.lit(1), F.col("_w") - 1)
    v = lambda p: 1.0 - p["y"] / F.greatest(F.lit(1), F.col("_h") - 1)
    world = F.transform("_ring", lambda p: F.struct((F.col("ox") + u(p) * F.col("xx") + v(p) * F.col("yx")).alias("x"), (F.col("oy") + u(p) * F.col("xy") + v(p) * F.col("yy")).alias("y")))
    b = b.withColumn("_ring", world)
    edges = F.transform(g.ring_edges(F.col("_ring")), lambda e: F.struct((e["x2"] - e["x1"]).alias("dx"), (e["y2"] - e["y1"]).alias("dy")))
    b = b.withColumn("_e", edges)
    size = lambda e: F.sqrt(e["dx"] * e["dx"] + e["dy"] * e["dy"])
    level = F.transform("_e", lambda e, i: F.struct(F.round(F.abs(e["dx"]) + 0.001 * size(e), 9).alias("s"), (-i).alias("i")))
    b = b.withColumn("_k", -F.array_max(level)["i"])
    we, de = F.get("_e", F.col("_k")), F.get("_e", (F.col("_k") + 1) % 4)
    c = g.ring_centroid(F.col("_ring"))
    rot = F.degrees(F.atan2(we["dy"], we["dx"]))
    rot = F.when(rot < -90.0, rot + 180.0).otherwise(rot)
    rot = F.when(rot >= 90.0, rot - 180.0).otherwise(rot)
    role = F.when(F.col("symbol").isin(*FIXTURE_SYMBOLS), "fixture").otherwise("furniture")
    return b.select(*part, c.x.alias("x"), c.y.alias("y"), rot.alias("rotation_deg"), size(we).alias("width"), size(de).alias("depth"), F.lit(0.8).alias("confidence"), role.alias("role"))


def snap_boxes(boxes: DataFrame, rooms: DataFrame, keys=IMAGE, id: str = "box_id") -> DataFrame:
    """Boxes pushed against the nearest parallel room edge when they stay inside the room.

    `rooms` has keys, ring: one room per picture. The best (gap, edge length,
    box edge) wins.
    """
    import math

    keys = list(keys)
    b = boxes.withColumn("_ring", g.rotated_box(g.xy("x", "y"), F.col("width"), F.col("depth"), F.col("rotation_deg")))
    b = b.join(rooms.select(*keys, g.counter_clockwise(F.col("ring")).alias("_room")), keys, "left")
    m = b.filter("_room is not null").withColumn("_w", F.explode(g.ring_edges(F.col("_room")))).select("*", F.posexplode(g.ring_edges(F.col("_ring"))).alias("_i", "_e"))
    wx, wy = F.col("_w.x2") - F.col("_w.x1"), F.col("_w.y2") - F.col("_w.y1")
    wl = F.sqrt(wx * wx + wy * wy)
    ex, ey = F.col("_e.x2") - F.col("_e.x1"), F.col("_e.y2") - F.col("_e.y1")
    el = F.sqrt(ex * ex + ey * ey)
    m = m.withColumns({"_wl": wl, "_el": el}).filter("_wl > 1e-9 and _el > 1e-9")
    m = m.withColumns({"_nx": -wy / F.col("_wl"), "_ny": wx / F.col("_wl")})
    lean = F.abs(wx * ey - wy * ex) / (F.col("_wl") * F.col("_el"))
    mx, my = (F.col("_e.x1") + F.col("_e.x2")) / 2.0, (F.col("_e.y1") + F.col("_e.y2")) / 2.0
    gap = (mx - F.col("_w.x1")) * F.col("_nx") + (my - F.col("_w.y1")) * F.col("_ny")
    m = m.withColumn("_gap", gap).filter((lean <= math.sin(math.radians(PARALLEL_DEG))) & (F.col("_gap") <= WALL_SNAP))
    dx, dy = -F.col("_nx") * F.col("_gap"), -F.col("_ny") * F.col("_gap")
    stays = F.forall("_ring", lambda p: g.point_in_ring(g.P(p["x"] + dx, p["y"] + dy), F.col("_room")) | (g.distance_to_ring(g.P(p["x"] + dx, p["y"] + dy), F.col("_room")) <= 1e-7))
    touches = F.exists("_ring", lambda p: g.point_in_ring(g.P(p["x"], p["y"]), F.col("_room"))) | F.exists("_room", lambda p: g.point_in_ring(g.P(p["x"], p["y"]), F.col("_ring")))
    best = m.filter(stays & touches).groupBy(*keys, id).agg(F.min(F.struct("_gap", "_wl", "_i", dx.alias("dx"), dy.alias("dy"))).alias("_b"))
    out = boxes.join(best, [*keys, id], "left")
    return out.withColumns({"x": F.col("x") + F.coalesce(F.col("_b.dx"), F.lit(0.0)), "y": F.col("y") + F.coalesce(F.col("_b.dy"), F.lit(0.0))}).drop("_b")
