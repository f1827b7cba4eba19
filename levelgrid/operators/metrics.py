"""Detected plans against truth: overlap, precision, thickness, tape lengths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import geometry as g
from levelgrid.functions import tiles
from levelgrid.functions.geometry import sq
from levelgrid.functions.graph import connected_components
from levelgrid.session import attach, settle

LEVEL = ["scan_id", "level_index"]


# Outlines closer than this are one line, in metres.
SAME_LINE = 1e-9


def _capsules(walls: DataFrame, keys: list[str]) -> DataFrame:
    """Walls as buffered centrelines (a, b, unit direction d, half thickness h), each outline once, near a common origin."""
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    slim = walls.filter("thickness > 0").select(*keys, F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (F.col("thickness") / 2.0).alias("h")).distinct()
    origin = slim.groupBy(*keys).agg(F.floor(F.min("a.x")).alias("_ox"), F.floor(F.min("a.y")).alias("_oy"))
    near = attach(slim, origin, keys)
    out = near.select(*keys, "h", *[(F.col(f"{e}.{c}") - F.col(f"_o{c}")).alias(f"{e}{c}") for e in "ab" for c in "xy"])
    out = out.withColumn("len", F.sqrt(sq(F.col("bx") - F.col("ax")) + sq(F.col("by") - F.col("ay"))))
    unit = {f"d{c}": F.when(F.col("len") > 0, (F.col(f"b{c}") - F.col(f"a{c}")) / F.col("len")).otherwise(F.lit(1.0 if c == "x" else 0.0)) for c in "xy"}
    return out.withColumns(unit).withColumn("id", F.struct("ax", "ay", "bx", "by", "h"))


def _outline(w: DataFrame) -> DataFrame:
    """The two sides and the two end arcs of every capsule, counter-clockwise: `e` with place (px, py) and step
    (sx, sy) of a side, or centre and first angle of an arc."""
    h, dx, dy = F.col("h"), F.col("dx"), F.col("dy")
    turn = F.atan2("dy", "dx")
    row = lambda k, arc, x, y, u, v: F.struct(F.lit(k).alias("k"), F.lit(arc).alias("arc"), x.alias("px"), y.alias("py"), u.alias("sx"), v.alias("sy"))
    none = F.lit(0.0)
    parts = F.array(
        row(0, False, F.col("ax") + h * dy, F.col("ay") - h * dx, F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")),
        row(1, True, F.col("bx"), F.col("by"), turn - math.pi / 2, none),
        row(2, False, F.col("bx") - h * dy, F.col("by") + h * dx, F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")),
        row(3, True, F.col("ax"), F.col("ay"), turn + math.pi / 2, none),
    )
    return w.withColumn("e", F.explode(parts)).filter((F.col("len") > 0) | F.col("e.arc"))


def _covered(parts: DataFrame) -> DataFrame:
    """Stretches `_s` (a, b in 0..1) of the outline part `e` that lie inside the other capsule (columns with o_).

    A stretch on the other's outline with the inside on the same side counts once: it is covered by the lesser id.
    Each step is a column of its own, and each stretch a row, as nested functions on arrays would compute every place
    where outlines meet once for each of its uses.
    """
    e, h, r = (lambda c: F.col(f"e.{c}")), F.col("h"), F.col("o_h")
    place = lambda t: (
        F.when(e("arc"), e("px") + h * F.cos(e("sx") + t * math.pi)).otherwise(e("px") + t * e("sx")),
        F.when(e("arc"), e("py") + h * F.sin(e("sx") + t * math.pi)).otherwise(e("py") + t * e("sy")),
    )
    across = lambda x, y: F.col("o_dx") * (y - F.col("o_ay")) - F.col("o_dy") * (x - F.col("o_ax"))
    marks = []
    # Where a side meets the other's two sides and end circles ...
    slope = F.col("o_dx") * e("sy") - F.col("o_dy") * e("sx")
    for sign in (1.0, -1.0):
        flat = (sign * r - across(e("px"), e("py"))) / F.nullif(slope, F.lit(0.0))
        bent = (sign * r - across(e("px"), e("py"))) / h
        turn = F.atan2("o_dy", "o_dx")
        angle = F.when(F.abs(bent) <= 1, F.asin(bent))
        part = lambda v: F.pmod(v - e("sx"), F.lit(2 * math.pi)) / math.pi
        marks += [F.when(e("arc"), part(turn + angle)).otherwise(flat), F.when(e("arc"), part(turn + math.pi - angle))]
    size = sq(e("sx")) + sq(e("sy"))
    for end in "ab":
        fx, fy = e("px") - F.col(f"o_{end}x"), e("py") - F.col(f"o_{end}y")
        half = fx * e("sx") + fy * e("sy")
        root = sq(half) - size * (sq(fx) + sq(fy) - sq(r))
        root = F.when(root >= 0, F.sqrt(root))
        far = F.sqrt(sq(fx) + sq(fy))
        lean = (sq(far) + sq(h) - sq(r)) / F.nullif(2.0 * far * h, F.lit(0.0))
        open_ = F.when(F.abs(lean) <= 1, F.acos(lean))
        toward = F.atan2(-fy, -fx)
        marks += [F.when(e("arc"), part(toward + open_)).otherwise((-half - root) / F.nullif(size, F.lit(0.0))), F.when(e("arc"), part(toward - open_)).otherwise((-half + root) / F.nullif(size, F.lit(0.0)))]
    cut = parts.withColumn("_marks", F.array(*marks))
    inner = F.filter("_marks", lambda t: (t > 0) & (t < 1))
    cut = cut.withColumn("_cuts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), inner, F.array(F.lit(1.0)))))).drop("_marks")
    n = F.size("_cuts") - 1
    spans = F.zip_with(F.slice("_cuts", F.lit(1), n), F.slice("_cuts", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = cut.withColumn("_s", F.explode(spans)).drop("_cuts")
    # ... what lies between two such places is inside or outside as a whole.
    x, y = place((F.col("_s.a") + F.col("_s.b")) / 2.0)
    out = out.withColumns({"_x": x, "_y": y})
    along = (F.col("_x") - F.col("o_ax")) * F.col("o_dx") + (F.col("_y") - F.col("o_ay")) * F.col("o_dy")
    out = out.withColumn("_along", F.greatest(F.lit(0.0), F.least(F.col("o_len"), along)))
    out = out.withColumns({"_ux": F.col("_x") - F.col("o_ax") - F.col("_along") * F.col("o_dx"), "_uy": F.col("_y") - F.col("o_ay") - F.col("_along") * F.col("o_dy")})
    deep = F.sqrt(sq(F.col("_ux")) + sq(F.col("_uy"))) - r
    nx = F.when(e("arc"), F.col("_x") - e("px")).otherwise(e("sy"))
    ny = F.when(e("arc"), F.col("_y") - e("py")).otherwise(-e("sx"))
    return out.filter((deep < -SAME_LINE) | ((deep <= SAME_LINE) & (nx * F.col("_ux") + ny * F.col("_uy") > 0) & (F.col("o_id") < F.col("id"))))


def wall_area(walls: DataFrame, keys=LEVEL) -> DataFrame:
    """(keys, area): exact area of the union of the walls, as centrelines buffered by half their thickness.

    By Green's theorem along the sides and end arcs of all walls, less the stretches that lie inside another wall.
    Rounding is what remains: where outlines only touch, an angle is known to the root of a last digit (1e-8).
    Walls meet by tiles. Keys without a wall of some thickness give no row.
    """
    keys = list(keys)
    w = settle(_capsules(walls, keys))
    cols = ["h", "ax", "ay", "bx", "by", "len", "dx", "dy", "id"]
    tiled = settle(tiles.tile_segment(w.select(*keys, *cols), g.P(F.col("ax"), F.col("ay")), g.P(F.col("bx"), F.col("by")), F.col("h"), 1.0))
    other = tiled.select(*keys, *tiles.TILE, *[F.col(c).alias(f"o_{c}") for c in cols])
    # Walls that touch share a tile; a pair that shares several is looked at once.
    pairs = tiled.join(other, [*keys, *tiles.TILE]).filter("id <> o_id").drop(*tiles.TILE).dropDuplicates([*keys, "id", "o_id"])
    held = _covered(_outline(pairs)).select(*keys, "id", F.col("e.k").alias("k"), "_s.a", "_s.b")
    whole = settle(_outline(w))
    ends = whole.select(*keys, "id", F.col("e.k").alias("k"), F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))
    before = W.partitionBy(*keys, "id", "k").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    gaps = held.unionByName(ends).withColumn("_from", F.coalesce(F.max("b").over(before), F.lit(0.0))).filter("a > _from")
    free = gaps.select(*keys, "id", "k", F.col("_from").alias("t0"), F.col("a").alias("t1")).join(whole.select(*keys, "id", F.col("e.k").alias("k"), "e", "h"), [*keys, "id", "k"])
    e, h = (lambda c: F.col(f"e.{c}")), F.col("h")
    q0, q1 = (e("sx") + F.col(t) * math.pi for t in ("t0", "t1"))
    bent = h * h * (q1 - q0) + e("px") * h * (F.sin(q1) - F.sin(q0)) - e("py") * h * (F.cos(q1) - F.cos(q0))
    flat = (F.col("t1") - F.col("t0")) * (e("px") * e("sy") - e("py") * e("sx"))
    return free.groupBy(*keys).agg((F.sum(F.when(e("arc"), bent).otherwise(flat)) / 2.0).alias("area"))


def wall_iou(pred: DataFrame, truth: DataFrame, keys=LEVEL) -> DataFrame:
    """Intersection over union of buffered centrelines, exact. Keys with no wall on either side score 1."""
    keys = list(keys)
    row = lambda df, *sets: df.select(*keys, "x1", "y1", "x2", "y2", "thickness", F.explode(F.array(*[F.lit(s) for s in sets])).alias("_set"))
    area = wall_area(row(pred, "pred", "both").unionByName(row(truth, "truth", "both")), [*keys, "_set"])
    of = lambda s: F.coalesce(F.sum(F.when(F.col("_set") == s, F.col("area"))), F.lit(0.0)).alias(s)
    found = area.groupBy(*keys).agg(of("pred"), of("truth"), of("both"))
    every = pred.select(*keys).unionByName(truth.select(*keys)).distinct()
    # What both have in common is what their own areas count twice.
    common = F.greatest(F.col("pred") + F.col("truth") - F.col("both"), F.lit(0.0))
    return every.join(found, keys, "left").select(*keys, F.coalesce(common / F.nullif(F.col("both"), F.lit(0.0)), F.lit(1.0)).alias("iou"))


def ring_overlap(a: Column, b: Column) -> Column:
    """Common area of two convex rings."""
    return F.abs(g.ring_area(g.clip_convex(g.counter_clockwise(a), g.counter_clockwise(b))))


def is_convex(ring: Column) -> Column:
    e = g.ring_edges(g.counter_clockwise(ring))
    nxt = F.concat(F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, F.lit(1), F.lit(1)))
    turn = F.zip_with(e, nxt, lambda p, q: (p["x2"] - p["x1"]) * (q["y2"] - q["y1"]) - (p["y2"] - p["y1"]) * (q["x2"] - q["x1"]))
    return F.forall(turn, lambda v: v >= -1e-9)


def ring_cells(rings: DataFrame, cell: float, keys: list[str], id: str) -> DataFrame:
    b = g.ring_bounds(F.col("ring"))
    t = tiles.tile_box(rings.select(*keys, id, "ring"), b["min_x"], b["min_y"], b["max_x"], b["max_y"], cell)
    return t.filter(g.point_in_ring(g.P((F.col("_tx") + 0.5) * cell, (F.col("_ty") + 0.5) * cell), F.col("ring"))).select(*keys, id, *tiles.TILE)


def ring_pairs(pred: DataFrame, truth: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """(keys, t, p, iou) of overlapping rings: exact when both are convex, else by grid cover.

    Rings meet when their boxes share a 4 m tile.
    """
    def tiled(df, name, tag):
        b = g.ring_bounds(F.col("ring"))
        out = df.select(*keys, F.col(name).alias(tag), F.col("ring").alias(f"ring_{tag}"), *[v.alias(f"_{k}") for k, v in b.items()])
        return tiles.tile_box(out, F.col("_min_x"), F.col("_min_y"), F.col("_max_x"), F.col("_max_y"), 4.0).drop("_min_x", "_min_y", "_max_x", "_max_y")

    m = tiled(truth, "truth_id", "t").join(tiled(pred, "pred_id", "p"), [*keys, *tiles.TILE]).drop(*tiles.TILE)
    m = settle(m.dropDuplicates([*keys, "t", "p"]).withColumn("_convex", is_convex(F.col("ring_t")) & is_convex(F.col("ring_p"))))
    area = F.abs(g.ring_area(F.col("ring_t"))) + F.abs(g.ring_area(F.col("ring_p")))
    exact = m.filter("_convex").withColumn("_i", ring_overlap(F.col("ring_t"), F.col("ring_p")))
    exact = exact.select(*keys, "t", "p", F.when(area - F.col("_i") > 0, F.col("_i") / (area - F.col("_i"))).otherwise(F.lit(1.0)).alias("iou"))
    rough = m.filter("not _convex")
    if rough.isEmpty():
        return exact.filter("iou > 0")
    tc = ring_cells(rough.select(*keys, F.col("t"), F.col("ring_t").alias("ring")).dropDuplicates([*keys, "t"]), cell, keys, "t")
    pc = ring_cells(rough.select(*keys, F.col("p"), F.col("ring_p").alias("ring")).dropDuplicates([*keys, "p"]), cell, keys, "p")
    shared = tc.join(pc, [*keys, *tiles.TILE]).groupBy(*keys, "t", "p").agg(F.count(F.lit(1)).alias("_i"))
    size = lambda df, n: df.groupBy(*keys, n).agg(F.count(F.lit(1)).alias(f"_{n}"))
    grid = rough.select(*keys, "t", "p").join(shared, [*keys, "t", "p"]).join(size(tc, "t"), [*keys, "t"]).join(size(pc, "p"), [*keys, "p"])
    grid = grid.select(*keys, "t", "p", (F.col("_i") / (F.col("_t") + F.col("_p") - F.col("_i"))).alias("iou"))
    return exact.unionByName(grid).filter("iou > 0")


def _greedy(pairs: DataFrame, keys: list[str], best: Column) -> DataFrame:
    """One-to-one matches of (keys, t, p): truth in order of id, each taking its best unused row.

    In every round a truth row whose candidates are wanted by no earlier open
    truth row is decided, so rounds follow the longest chain of conflicts and
    not the number of rows.
    """
    open_ = settle(pairs)
    done = None
    while not open_.isEmpty():
        choice = open_.groupBy(*keys, "t").agg(F.min_by("p", best).alias("p"))
        first = open_.groupBy(*keys, "p").agg(F.min("t").alias("_first"))
        # A truth row is decided when it is the earliest open one at every row it could take.
        ready = open_.join(first, [*keys, "p"]).groupBy(*keys, "t").agg(F.bool_and(F.col("t") == F.col("_first")).alias("_ok")).filter("_ok")
        won = settle(choice.join(ready.select(*keys, "t"), [*keys, "t"]))
        done = won if done is None else done.unionByName(won)
        rest = open_.join(won.select(*keys, "t"), [*keys, "t"], "left_anti").join(won.select(*keys, "p"), [*keys, "p"], "left_anti")
        open_ = settle(rest)
    return done if done is not None else pairs.select(*keys, "t", "p").limit(0)


def room_iou(pred: DataFrame, truth: DataFrame, cell: float = 0.02, keys=LEVEL) -> DataFrame:
    """Mean IoU over truth rooms (truth_id, ring) after a one-to-one match with pred_id rings."""
    keys = list(keys)
    pairs = settle(ring_pairs(pred, truth, cell, keys))
    won = _greedy(pairs, keys, F.struct(-F.col("iou"), F.col("p")))
    score = won.join(pairs, [*keys, "t", "p"]).select(*keys, F.col("t").alias("truth_id"), "iou")
    out = truth.select(*keys, "truth_id").join(score, [*keys, "truth_id"], "left")
    return out.groupBy(*keys).agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("room_iou"), F.count(F.lit(1)).alias("rooms"))


def opening_scores(pred: DataFrame, truth: DataFrame, keys=LEVEL) -> DataFrame:
    """Precision and recall of openings (pred_id/truth_id, kind, x, y, width)."""
    keys = list(keys)
    near = pred.select(*keys, "kind", F.col("pred_id").alias("p"), F.col("x").alias("_px"), F.col("y").alias("_py"), F.col("width").alias("_pw"))
    near = near.withColumn("_tx", F.explode(F.sequence(tiles.cell("_px", 0.25) - 1, tiles.cell("_px", 0.25) + 1)))
    near = near.withColumn("_ty", F.explode(F.sequence(tiles.cell("_py", 0.25) - 1, tiles.cell("_py", 0.25) + 1)))
    m = tiles.tile_points(truth.withColumnRenamed("truth_id", "t"), "x", "y", 0.25).join(near, [*keys, "kind", *tiles.TILE])
    m = m.filter((g.dist(g.xy("x", "y"), g.xy("_px", "_py")) <= 0.25) & (F.abs(F.col("width") - F.col("_pw")) <= 0.15)).select(*keys, "t", "p")
    won = _greedy(m, keys, F.col("p")).groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"))
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    out = count(truth, "truth").join(count(pred, "pred"), keys, "full").join(won, keys, "left")
    zero = F.lit(0)
    hits = F.coalesce("matches", zero)
    ratio = lambda c: F.when(F.coalesce(c, zero) == 0, 1.0).otherwise(hits / F.col(c))
    return out.select(*keys, hits.alias("matches"), ratio("pred").alias("precision"), ratio("truth").alias("recall"))


def thickness_mae(pred: DataFrame, truth: DataFrame, keys=LEVEL) -> DataFrame:
    """Mean thickness error of walls on the first truth wall whose centreline they share for 0.2 m."""
    keys = list(keys)
    tag = lambda df, n, s: df.select(*keys, F.col(n).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2", "thickness")])
    p = tiles.tile_segment(tag(pred, "pred_id", "p"), g.xy("x1_p", "y1_p"), g.xy("x2_p", "y2_p"), 1e-6, 2.0)
    t = tiles.tile_segment(tag(truth, "truth_id", "t"), g.xy("x1_t", "y1_t"), g.xy("x2_t", "y2_t"), 1e-6, 2.0)
    m = p.join(t, [*keys, *tiles.TILE]).drop(*tiles.TILE).distinct()
    a, b, c, d = g.xy("x1_p", "y1_p"), g.xy("x2_p", "y2_p"), g.xy("x1_t", "y1_t"), g.xy("x2_t", "y2_t")
    u = g.unit(g.sub(b, a))
    off = lambda q: F.abs(g.cross(u, g.sub(q, a)))
    along = lambda q: g.dot(u, g.sub(q, a))
    shared = F.least(g.dist(a, b), F.greatest(along(c), along(d))) - F.greatest(F.lit(0.0), F.least(along(c), along(d)))
    m = m.filter((off(c) <= 1e-6) & (off(d) <= 1e-6) & (shared >= 0.2 - 1e-9))
    first = m.groupBy(*keys, "p").agg(F.min_by(F.abs(F.col("thickness_p") - F.col("thickness_t")), "t").alias("e"))
    mean = first.groupBy(*keys).agg(F.avg("e").alias("mae"), F.count(F.lit(1)).alias("walls"))
    return pred.select(*keys).distinct().join(mean, keys, "left").select(*keys, F.coalesce("mae", F.lit(0.0)).alias("mae"), F.coalesce("walls", F.lit(0)).alias("walls"))


def frame_angle_error(pred: Column, truth: Column) -> Column:
    delta = F.pmod(F.abs(pred - truth), F.lit(90.0))
    return F.least(delta, 90.0 - delta)


def stair_iou(pairs: DataFrame) -> DataFrame:
    """Adds `iou` of two convex outlines (columns pred_ring, truth_ring)."""
    i = ring_overlap(F.col("pred_ring"), F.col("truth_ring"))
    a = F.abs(g.ring_area(F.col("pred_ring"))) + F.abs(g.ring_area(F.col("truth_ring")))
    out = pairs.withColumn("_i", i)
    return out.withColumn("iou", F.when(a - F.col("_i") > 0, F.col("_i") / (a - F.col("_i"))).otherwise(F.lit(1.0))).drop("_i")


def run_lengths(walls: DataFrame, keys=LEVEL) -> DataFrame:
    """(keys, run, length): collinear chains of walls, measured along the longest member.

    Walls (wall_id, x1..y2) chain when they are within 8 degrees and 0.12 m of
    one line and at most 0.20 m apart.
    """
    import math

    keys = list(keys)
    w = walls.withColumn("_len", g.dist(g.xy("x1", "y1"), g.xy("x2", "y2"))).filter("_len >= 1e-4")
    w = settle(w.select(*keys, "wall_id", "x1", "y1", "x2", "y2", "_len").withColumn("id", F.struct(*keys, "wall_id")))
    tiled = tiles.tile_segment(w, g.xy("x1", "y1"), g.xy("x2", "y2"), 0.21, 1.0)
    one = lambda s: tiled.select(*keys, *tiles.TILE, *[F.col(c).alias(f"{c}_{s}") for c in ("id", "x1", "y1", "x2", "y2", "_len")])
    m = one("l").join(one("r"), [*keys, *tiles.TILE]).filter("id_l < id_r").drop(*tiles.TILE)
    a, b, c, d = g.xy("x1_l", "y1_l"), g.xy("x2_l", "y2_l"), g.xy("x1_r", "y1_r"), g.xy("x2_r", "y2_r")
    u, v = g.unit(g.sub(b, a)), g.unit(g.sub(d, c))
    off = lambda q: F.abs(g.cross(u, g.sub(q, a)))
    along = lambda q: g.dot(u, g.sub(q, a))
    gap = F.greatest(F.lit(0.0), F.least(along(c), along(d))) - F.least(F.col("_len_l"), F.greatest(along(c), along(d)))
    ok = (F.abs(g.dot(u, v)) >= math.cos(math.radians(8.0))) & (off(c) <= 0.12) & (off(d) <= 0.12) & (gap <= 0.20)
    edges = m.filter(ok).select(F.col("id_l").alias("u"), F.col("id_r").alias("v")).distinct()
    label = connected_components(edges, w.select("id"))
    named = w.join(label, "id").select(*keys, F.col("component.wall_id").alias("run"), "wall_id", "x1", "y1", "x2", "y2", "_len")
    named = settle(named)
    lead = named.groupBy(*keys, "run").agg(F.max_by(F.struct("x1", "y1", "x2", "y2"), F.struct("_len", "wall_id")).alias("_d"))
    n = named.join(lead, [*keys, "run"])
    o = g.P(F.col("_d.x1"), F.col("_d.y1"))
    u = g.unit(g.P(F.col("_d.x2") - F.col("_d.x1"), F.col("_d.y2") - F.col("_d.y1")))
    t1, t2 = g.dot(u, g.sub(g.xy("x1", "y1"), o)), g.dot(u, g.sub(g.xy("x2", "y2"), o))
    return n.groupBy(*keys, "run").agg((F.max(F.greatest(t1, t2)) - F.min(F.least(t1, t2))).alias("length"), F.count(F.lit(1)).alias("walls"))


def tape_check(runs: DataFrame, refs: DataFrame, keys=("scan_id",), bucket: float = 0.5) -> DataFrame:
    """References (name, length_m, tolerance_m) with their nearest run and whether they hold.

    Runs are summed up per length bucket. A reference looks into its own
    bucket and at the ends of the nearest filled buckets on both sides, so no
    key's runs are sorted or gathered.
    """
    keys = list(keys)
    runs = runs.select(*keys, "length", F.floor(F.col("length") / bucket).alias("_b"))
    refs = refs.select(*keys, "name", "tolerance_m", F.col("length_m").alias("v"), F.floor(F.col("length_m") / bucket).alias("_b"))
    filled = runs.groupBy(*keys, "_b").agg(F.min("length").alias("_min"), F.max("length").alias("_max"))
    spots = settle(refs.select(*keys, "_b").distinct().join(filled, [*keys, "_b"], "full"))
    up = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*keys).orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    sides = spots.select(*keys, "_b", F.last("_max", True).over(up).alias("_lo"), F.first("_min", True).over(down).alias("_hi"))
    gap = lambda c: F.struct(F.abs(F.col(c) - F.col("v")).alias("g"), F.col(c).alias("l"))
    own = refs.join(runs, [*keys, "_b"]).groupBy(*keys, "name").agg(F.min(gap("length")).alias("_own"))
    m = refs.join(sides, [*keys, "_b"], "left").join(own, [*keys, "name"], "left")
    near = F.array_min(F.array_compact(F.array("_own", *[F.when(F.col(c).isNotNull(), gap(c)) for c in ("_lo", "_hi")])))["l"]
    m = m.select(*keys, "name", F.col("v").alias("length_m"), F.coalesce("tolerance_m", F.lit(0.05)).alias("tolerance_m"), near.alias("closest"))
    m = settle(m.withColumn("error", F.abs(F.col("closest") - F.col("length_m"))))
    # Only the message of a failed reference lists its runs.
    failed = m.filter(F.col("closest").isNull() | (F.col("error") > F.col("tolerance_m"))).select(*keys).distinct()
    listed = runs.join(failed, keys, "left_semi").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("length")), lambda v: F.format_string("%.3f", v)), ", ").alias("runs"))
    m = m.join(listed, keys, "left")
    ok = F.col("closest").isNotNull() & (F.col("error") <= F.col("tolerance_m"))
    text = F.when(F.col("closest").isNull(), F.concat("name", F.lit(": no walls were found"))).otherwise(
        F.format_string("%s: closest wall %.3f m, expected %.3f m ± %.3f m. Runs: %s", "name", "closest", "length_m", "tolerance_m", "runs")
    )
    return m.select(*keys, "name", "length_m", "closest", "error", ok.alias("ok"), F.when(~ok, text).alias("failure"))


def level_count_check(levels: DataFrame, expected: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Scans whose number of storeys is not the expected one (column levels)."""
    keys = list(keys)
    n = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    out = expected.filter("levels is not null").join(n, keys, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.select(*keys, "levels", "found", (F.col("levels") == F.col("found")).alias("ok"))


def opens_check(scans: DataFrame, points: DataFrame, triangles: DataFrame, keys=("scan_id",)) -> DataFrame:
    """Scans with their point and face counts; a scan opens when it has any."""
    keys = list(keys)
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    out = scans.select(*keys).join(count(points, "points"), keys, "left").join(count(triangles, "faces"), keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("points", "faces")})
    return out.withColumn("opens", (F.col("points") > 0) | (F.col("faces") > 0))
