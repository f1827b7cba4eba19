"""Replies about pictures turned into plan rows: labels, fixtures, camera geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.functions import geometry as g
from levelgrid.functions import tiles
from levelgrid.plans import schemas
from levelgrid.plans.documents import PLAN, symbol_dim
from levelgrid.plans.lookup import outside_items
from levelgrid.session import settle

# Picture step and reach of the camera in metres.
SAMPLE = 0.02
REACH = 80.0


def frame_bounds(frames: DataFrame, numbers: str = "numbers") -> DataFrame:
    """Ring and bounds of frames given by six finite numbers; `error` says why not."""
    n = F.col(numbers)
    six = F.size(n) == 6
    ok = six & F.forall(n, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = lambda i: F.when(ok, F.get(n, F.lit(i)))
    ox, oy, xx, xy, yx, yy = (at(i) for i in range(6))
    corners = [g.P(ox, oy), g.P(ox + xx, oy + xy), g.P(ox + xx + yx, oy + xy + yy), g.P(ox + yx, oy + yy)]
    out = frames.withColumn("ring", F.when(ok, F.array(*[g.point_struct(c) for c in corners])))
    area = F.abs(g.ring_area(F.col("ring")))
    error = F.when(~six, "The overhead view has no six-number metric frame.").when(~ok, "The overhead view has an invalid metric frame.").when(
        ~(area > 0), "The overhead view has an invalid floor frame."
    )
    b = g.ring_bounds(F.col("ring"))
    return out.withColumns({**b, "area": area, "error": error})


def visible_only(items: DataFrame, frames: DataFrame, keys=PLAN) -> DataFrame:
    """Items (x, y) inside their storey's frame ring."""
    keys = list(keys)
    good = frames.filter("error is null").select(*keys, "ring")
    return tiles.points_in_rings(items, good, keys).drop("ring")


def json_span(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def apply_labels(fixtures: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixtures, rejects): `block` fixtures take the symbols their reply names.

    `replies` has plan_id, level_id, reply.
    """
    parsed = replies.withColumn("_j", F.from_json(json_span(F.col("reply")), "labels array<struct<id:string,symbol:string>>"))
    bad = parsed.filter("_j is null or _j.labels is null").select(*PLAN, F.lit("The reply holds no fixture labels.").alias("reason"))
    said = parsed.filter("_j.labels is not null").select(*PLAN, F.posexplode("_j.labels").alias("i", "l")).select(*PLAN, "i", F.col("l.id").alias("fixture_id"), F.col("l.symbol").alias("_s"))
    said = said.filter(F.col("_s").isin(*schemas.SYMBOLS)).groupBy(*PLAN, "fixture_id").agg(F.max_by("_s", "i").alias("_s"))
    out = fixtures.join(said, [*PLAN, "fixture_id"], "left")
    use = (F.col("symbol") == "block") & F.col("_s").isNotNull()
    role = F.when(F.col("_s").isin(*schemas.FIXTURE_SYMBOLS), "fixture").otherwise("furniture")
    out = out.withColumns({"role": F.when(use, role).otherwise(F.col("role")), "symbol": F.when(use, F.col("_s")).otherwise(F.col("symbol"))})
    return out.select(*fixtures.columns), bad


def invert4(m: list[Column]) -> list[Column]:
    """Inverse of a 4x4 matrix given as sixteen columns in column-major order."""
    a = lambda r, c: m[c * 4 + r]
    s = [a(0, i) * a(1, j) - a(0, j) * a(1, i) for i, j in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]
    c = [a(2, i) * a(3, j) - a(2, j) * a(3, i) for i, j in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]
    det = s[0] * c[5] - s[1] * c[4] + s[2] * c[3] + s[3] * c[2] - s[4] * c[1] + s[5] * c[0]
    adj = [
        [a(1, 1) * c[5] - a(1, 2) * c[4] + a(1, 3) * c[3], -a(0, 1) * c[5] + a(0, 2) * c[4] - a(0, 3) * c[3], a(3, 1) * s[5] - a(3, 2) * s[4] + a(3, 3) * s[3], -a(2, 1) * s[5] + a(2, 2) * s[4] - a(2, 3) * s[3]],
        [-a(1, 0) * c[5] + a(1, 2) * c[2] - a(1, 3) * c[1], a(0, 0) * c[5] - a(0, 2) * c[2] + a(0, 3) * c[1], -a(3, 0) * s[5] + a(3, 2) * s[2] - a(3, 3) * s[1], a(2, 0) * s[5] - a(2, 2) * s[2] + a(2, 3) * s[1]],
        [a(1, 0) * c[4] - a(1, 1) * c[2] + a(1, 3) * c[0], -a(0, 0) * c[4] + a(0, 1) * c[2] - a(0, 3) * c[0], a(3, 0) * s[4] - a(3, 1) * s[2] + a(3, 3) * s[0], -a(2, 0) * s[4] + a(2, 1) * s[2] - a(2, 3) * s[0]],
        [-a(1, 0) * c[3] + a(1, 1) * c[1] - a(1, 2) * c[0], a(0, 0) * c[3] - a(0, 1) * c[1] + a(0, 2) * c[0], -a(3, 0) * s[3] + a(3, 1) * s[1] - a(3, 2) * s[0], a(2, 0) * s[3] - a(2, 1) * s[1] + a(2, 2) * s[0]],
    ]
    return [adj[r][col] / F.nullif(det, F.lit(0.0)) for col in range(4) for r in range(4)]


def camera_matrices(cameras: DataFrame) -> DataFrame:
    """(shot_id, inv, world, floor_z): the inverse projection is worked out once per shot."""
    proj = [F.get("projection", F.lit(i)) for i in range(16)]
    return cameras.filter((F.size("projection") == 16) & (F.size("matrix_world") == 16)).select(
        "shot_id", F.array(*invert4(proj)).alias("inv"), F.col("matrix_world").alias("world"), "floor_z"
    )


def pixel_to_floor(df: DataFrame, nx: Column, ny: Column, out: str = "") -> DataFrame:
    """Adds px, py (named by `out`): floor point under a picture position in 0..1.

    NULL when the ray is level, points away from the floor, or lands more than
    80 m from the camera. `df` carries inv, world and floor_z.
    """
    m = lambda name, r, c: F.get(name, F.lit(c * 4 + r))
    e = f"_e{out}"

    def point(z, tag):
        v = [nx * 2.0 - 1.0, 1.0 - ny * 2.0, F.lit(z), F.lit(1.0)]
        eye = [sum((m("inv", r, c) * v[c] for c in range(4)), F.lit(0.0)) for r in range(4)]
        return F.struct(*[(eye[i] / F.nullif(eye[3], F.lit(0.0))).alias("xyz"[i]) for i in range(3)]).alias(f"{e}{tag}")

    df = df.withColumns({f"{e}n": point(-1.0, "n"), f"{e}f": point(1.0, "f")})

    def world(tag):
        v = [F.col(f"{e}{tag}.x"), F.col(f"{e}{tag}.y"), F.col(f"{e}{tag}.z"), F.lit(1.0)]
        w = [sum((m("world", r, c) * v[c] for c in range(4)), F.lit(0.0)) for r in range(4)]
        return F.struct(*[(w[i] / F.nullif(w[3], F.lit(0.0))).alias("xyz"[i]) for i in range(3)])

    df = df.withColumns({f"{e}n": world("n"), f"{e}f": world("f")})
    n, f = (lambda a: F.col(f"{e}n.{a}")), (lambda a: F.col(f"{e}f.{a}"))
    dz = f("z") - n("z")
    t = F.when(F.abs(dz) >= 1e-8, (F.col("floor_z") - n("z")) / dz)
    df = df.withColumn(f"{e}t", t)
    t = F.col(f"{e}t")
    x, y = n("x") + t * (f("x") - n("x")), n("y") + t * (f("y") - n("y"))
    far = F.sqrt(g.sq(x - m("world", 0, 3)) + g.sq(y - m("world", 1, 3)))
    ok = (t >= 0) & (far <= REACH)
    return df.withColumns({f"px{out}": F.when(ok, x), f"py{out}": F.when(ok, y)}).drop(f"{e}n", f"{e}f", f"{e}t")


def fixture_pose(df: DataFrame) -> DataFrame:
    """Adds pose_x, pose_y, pose_rot, pose_w, pose_d from nx, ny, span_x, span_y, back.

    `back` names the side of the picture the item's back faces. Rotation is a
    quarter turn. `df` carries inv, world and floor_z.
    """
    back = F.lower("back")
    sx = F.when(back == "left", -1.0).when(back == "right", 1.0).when(back.isin("up", "down"), 0.0)
    sy = F.when(back == "up", -1.0).when(back == "down", 1.0).when(back.isin("left", "right"), 0.0)
    df = df.withColumns({"_sx": sx, "_sy": sy})
    nx, ny = F.col("nx"), F.col("ny")
    df = pixel_to_floor(df, nx, ny, "0")
    df = pixel_to_floor(df, nx + SAMPLE * F.col("_sx"), ny + SAMPLE * F.col("_sy"), "1")
    df = pixel_to_floor(df, nx + SAMPLE * F.col("_sy"), ny + SAMPLE * F.col("_sx"), "2")
    ax, ay = F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0")
    cx, cy = F.col("px2") - F.col("px0"), F.col("py2") - F.col("py0")
    upright = F.col("_sy") != 0
    depth = F.sqrt(ax * ax + ay * ay) / SAMPLE * F.when(upright, F.col("span_y")).otherwise(F.col("span_x"))
    width = F.sqrt(cx * cx + cy * cy) / SAMPLE * F.when(upright, F.col("span_x")).otherwise(F.col("span_y"))
    turn = F.pmod(F.degrees(F.atan2(-ax, ay)), F.lit(360.0))
    quarter = F.pmod(F.floor(turn / 90.0 + 0.5) * 90.0, F.lit(360.0))
    df = df.withColumns({"_w": width, "_d": depth, "_q": quarter})
    ok = (F.col("span_x") > 0) & (F.col("span_y") > 0) & F.col("_sx").isNotNull() & (F.col("_w") > 0) & (F.col("_d") > 0)
    pose = {"pose_x": "px0", "pose_y": "py0", "pose_rot": "_q", "pose_w": "_w", "pose_d": "_d"}
    return df.withColumns({k: F.when(ok, F.col(v)) for k, v in pose.items()}).drop("_sx", "_sy", "_w", "_d", "_q", "px1", "py1", "px2", "py2")


ITEM = "struct<symbol:string,nx:string,ny:string,spanX:string,spanY:string,back:string,confidence:string>"


def parse_fixture_replies(replies: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fixtures, rejects) from replies (plan_id, level_id, shot_id, reply).

    Unknown symbols are skipped; a known one without a position in 0..1, or
    off the floor, rejects its reply. Poses out of 0.15..4 m take default sizes.
    """
    parsed = replies.withColumn("_j", F.from_json(json_span(F.col("reply")), f"fixtures array<{ITEM}>"))
    bad = parsed.filter("_j is null or _j.fixtures is null").select(*PLAN, "shot_id", F.lit("The reply holds no fixture JSON.").alias("reason"))
    share = lambda c: F.when(F.expr(f"try_cast({c} as double)").between(0.0, 1.0), F.expr(f"try_cast({c} as double)"))
    items = parsed.filter("_j.fixtures is not null").select(*PLAN, "shot_id", F.posexplode("_j.fixtures").alias("i", "f"))
    items = items.select(*PLAN, "shot_id", "i", "f.symbol", share("f.nx").alias("nx"), share("f.ny").alias("ny"), share("f.spanX").alias("span_x"), share("f.spanY").alias("span_y"), "f.back", F.expr("try_cast(f.confidence as double)").alias("_c"))
    sizes = F.broadcast(symbol_dim(replies.sparkSession))  # twelve fixed rows
    items = items.join(sizes.select("symbol", "role", "reply_width", "reply_depth"), "symbol")
    posed = settle(fixture_pose(settle(items.join(camera_matrices(cameras), "shot_id"))))
    sane = F.col("pose_w").between(0.15, 4.0) & F.col("pose_d").between(0.15, 4.0)
    posed = posed.withColumns(
        {
            "x": F.col("px0"), "y": F.col("py0"), "rotation_deg": F.coalesce("pose_rot", F.lit(0.0)),
            "width": F.when(sane, F.col("pose_w")).otherwise(F.col("reply_width")), "depth": F.when(sane, F.col("pose_d")).otherwise(F.col("reply_depth")),
            "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("_c", F.lit(0.6)))),
            "_reason": F.when(F.col("nx").isNull() | F.col("ny").isNull(), F.concat(F.lit("The "), "symbol", F.lit(" has no position in the picture."))).when(
                F.col("px0").isNull(), F.concat(F.lit("The "), "symbol", F.lit(" could not be placed on the floor."))),
        }
    )
    fail = posed.filter("_reason is not null").groupBy(*PLAN, "shot_id").agg(F.min_by("_reason", "i").alias("reason"))
    good = posed.filter("_reason is null").join(fail.select(*PLAN, "shot_id"), [*PLAN, "shot_id"], "left_anti")
    good = good.select(*PLAN, "shot_id", F.concat(F.lit("f"), F.col("i") + 1).alias("fixture_id"), "symbol", "x", "y", "rotation_deg", "width", "depth", "confidence", "role")
    return good, bad.unionByName(fail.select(*bad.columns))


def merge_detected_level(current: DataFrame, detected: DataFrame) -> DataFrame:
    """(plan_id, level_id, detected_level): the detected storey nearest in elevation to each
    plan's first storey. Elements of that storey then replace the first storey's, which keeps
    its id and name. `current` has plan_id, level_id, level_order, elevation."""
    first = current.groupBy("plan_id").agg(F.min_by(F.struct("level_id", "name", "elevation"), "level_order").alias("_f"))
    d = detected.select("plan_id", F.col("level_id").alias("_d"), F.col("elevation").alias("_e"), F.col("ceiling_height").alias("_c"))
    near = F.struct(F.abs(F.col("_e") - F.coalesce(F.col("_f.elevation"), F.col("_low"))).alias("g"), F.col("_e"), F.col("_d"))
    low = detected.groupBy("plan_id").agg(F.min_by("elevation", "level_index").alias("_low"))
    m = d.join(low, "plan_id").join(first, "plan_id", "left")
    best = m.groupBy("plan_id").agg(F.min_by(F.struct("_d", "_e", "_c", "_f"), near).alias("b"))
    return best.select(
        "plan_id", F.coalesce(F.col("b._f.level_id"), F.col("b._d")).alias("level_id"), F.coalesce(F.col("b._f.name"), F.lit("Level 1")).alias("name"),
        F.col("b._d").alias("detected_level"), F.col("b._e").alias("elevation"), F.col("b._c").alias("ceiling_height"),
    )


def replace_elements(current: DataFrame, detected: DataFrame, mapping: DataFrame) -> DataFrame:
    """One element table with the mapped storeys' rows taken from the detected ones."""
    kept = current.join(mapping.select(*PLAN), PLAN, "left_anti")
    new = detected.withColumnRenamed("level_id", "detected_level").join(mapping.select("plan_id", "level_id", "detected_level"), ["plan_id", "detected_level"])
    return kept.unionByName(new.select(*current.columns))


def placement_report(items: DataFrame, rooms: DataFrame) -> DataFrame:
    """One text per storey with items outside its room."""
    out = outside_items(items, rooms).groupBy(*PLAN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fixture_id", "message"))), lambda s: s["message"]), " ").alias("listed"))
    b = g.ring_bounds(F.col("ring"))
    out = out.join(rooms.select(*PLAN, *[v.alias(k) for k, v in b.items()]), PLAN)
    text = F.format_string(
        "%s The interior runs from x=%.2f m to x=%.2f m and from y=%.2f m to y=%.2f m.", "listed", "min_x", "max_x", "min_y", "max_y"
    )
    return out.select(*PLAN, text.alias("report"))
