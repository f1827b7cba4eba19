"""Bulk plan corrections: an ops table applied to plan tables by joins.

Every operator takes plan tables and an ops table (plan_id, level_id, seq and
its own columns) and returns (tables, rejects). A rejected op changes nothing.
Operators expect ops of one call to be independent of each other; `apply_ops`
deals longer lists to rounds of such ops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions import geometry as g
from levelgrid.functions import tiles
from levelgrid.functions.graph import connected_components
from levelgrid.functions.numbering import number_rows
from levelgrid.plans.documents import ELEMENTS, PLAN, PlanTables
from levelgrid.plans.lookup import _frames, _measured, _sides, lines_of, resolve_refs
from levelgrid.plans.validate import all_ids, finite
from levelgrid.session import attach, settle

JOIN = 0.05
ORTHO = 1.0

REJECT = ["plan_id", "level_id", "seq", "reason"]


def _reject(df: DataFrame, reason) -> DataFrame:
    return df.select(*PLAN, "seq", (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))


def _no_rejects(ops: DataFrame) -> DataFrame:
    return _reject(ops.limit(0), "")


def patch(df: DataFrame, id_col: str, ops: DataFrame, values: dict[str, Column], checks: list[tuple[Column, str]], what: str) -> tuple[DataFrame, DataFrame]:
    """Rows of `df` whose id an op names take `values`; NULL values keep the old ones.

    `ops` has seq, target and payload columns prefixed by p_. Checks see the
    new values and the payload.
    """
    # The first op on a target is applied; another one at the same time is refused.
    turn = F.row_number().over(W.partitionBy(*PLAN, "target").orderBy("seq"))
    given = settle(ops.withColumn("_turn", turn))
    ops = given.filter("_turn = 1").drop("_turn")
    again = given.filter("_turn > 1")
    extra = [c for c in ops.columns if c not in PLAN and c != "target"]
    m = df.join(ops.withColumnRenamed("target", id_col), [*PLAN, id_col], "left")
    new = {f"_n_{c}": F.when(F.col("seq").isNotNull(), F.coalesce(v, F.col(c))).otherwise(F.col(c)) for c, v in values.items()}
    m = m.withColumns(new)
    reason = F.lit(None).cast("string")
    for ok, text in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)).otherwise(reason)
    m = m.withColumn("_reason", F.when(F.col("seq").isNotNull(), reason))
    m = settle(m)
    rejects = _reject(m.filter("_reason is not null"), F.col("_reason"))
    rejects = rejects.unionByName(_reject(again, F.concat(F.lit(f"Another change of {what} "), "target")))
    unknown = ops.join(df.select(*PLAN, F.col(id_col).alias("target")), [*PLAN, "target"], "left_anti")
    rejects = rejects.unionByName(_reject(unknown, F.concat(F.lit(f"Unknown {what} "), "target")))
    keep = F.col("_reason").isNull()
    out = m.withColumns({c: F.when(keep, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in values})
    return out.drop(*new, *extra, "_reason").select(*df.columns), rejects


def set_thickness(t: PlanTables, ops: DataFrame):
    """ops: target, p_thickness."""
    v = F.col("p_thickness")
    walls, rej = patch(t.walls, "wall_id", ops, {"thickness": v}, [(finite(v) & (v > 0) & (v <= 1.5), "Wall thickness must be greater than 0 and at most 1.5 m")], "wall")
    return t.with_(walls=walls), rej


def rename_rooms(t: PlanTables, ops: DataFrame):
    """ops: target, p_name, p_number (NULL keeps the number)."""
    rooms, rej = patch(t.rooms, "room_id", ops, {"name": F.col("p_name"), "number": F.col("p_number")}, [], "room")
    return t.with_(rooms=rooms), rej


OPENING_FIELDS = ["kind", "offset", "width", "sill", "head", "swing", "swing_side", "confidence"]


def set_openings(t: PlanTables, ops: DataFrame):
    """ops: target and any of p_kind, p_offset, p_width, p_sill, p_head, p_swing, p_swing_side, p_confidence."""
    lines = lines_of(t).select(*PLAN, "wall_id", g.dist(g.xy("x1", "y1"), g.xy("x2", "y2")).alias("_len"))
    df = t.openings.join(lines, [*PLAN, "wall_id"], "left")
    values = {c: F.col(f"p_{c}") for c in OPENING_FIELDS if f"p_{c}" in ops.columns}
    new = lambda c: F.col(f"_n_{c}") if c in values else F.col(c)
    checks = [
        ((new("width") > 0) & (new("width") < F.col("_len")), "Opening width must be shorter than its wall"),
        (new("head") > new("sill"), "Opening head must be above the sill"),
    ]
    out, rej = patch(df, "opening_id", ops, values, checks, "opening")
    return t.with_(openings=out.select(*t.openings.columns)), rej


def set_texts(t: PlanTables, ops: DataFrame):
    out, rej = patch(t.texts, "text_id", ops, {"text": F.col("p_text")}, [], "text")
    return t.with_(texts=out), rej


def set_fixtures(t: PlanTables, ops: DataFrame):
    """ops: target, p_rotation_deg, p_width, p_depth."""
    ok = lambda c: F.col(c).isNull() | finite(F.col(c))
    values = {c: F.col(f"p_{c}") for c in ("rotation_deg", "width", "depth")}
    checks = [
        (ok("p_rotation_deg"), "Rotation must be finite"),
        (ok("p_width") & ok("p_depth") & (F.col("_n_width") > 0) & (F.col("_n_depth") > 0), "The size must be greater than 0"),
    ]
    out, rej = patch(t.fixtures, "fixture_id", ops, values, checks, "fixture")
    return t.with_(fixtures=out), rej


def move_vertices(t: PlanTables, ops: DataFrame):
    """ops: target, p_x, p_y."""
    out, rej = patch(t.vertices, "vertex_id", ops, {"x": F.col("p_x"), "y": F.col("p_y")}, [(finite(F.col("p_x")) & finite(F.col("p_y")), "Vertex coordinates must be finite")], "vertex")
    return t.with_(vertices=out), rej


def remove_selection(t: PlanTables, ids: DataFrame) -> PlanTables:
    """Delete ids (plan_id, level_id, id) and everything that depends on them."""
    drop = settle(ids.select(*PLAN, "id").distinct())
    gone = lambda df, c: df.join(drop.withColumnRenamed("id", c), [*PLAN, c], "left_anti")
    walls = settle(gone(gone(gone(t.walls, "wall_id"), "a"), "b").select(*t.walls.columns))
    openings = gone(t.openings, "opening_id").join(walls.select(*PLAN, "wall_id"), [*PLAN, "wall_id"], "left_semi")
    separators = gone(gone(gone(t.separators, "separator_id"), "a"), "b")
    used = walls.select(*PLAN, F.explode(F.array("a", "b")).alias("vertex_id")).unionByName(separators.select(*PLAN, F.explode(F.array("a", "b")).alias("vertex_id")))
    vertices = gone(t.vertices, "vertex_id").join(used.distinct(), [*PLAN, "vertex_id"], "left_semi")
    vertices, openings = settle(vertices.select(*t.vertices.columns)), settle(openings.select(*t.openings.columns))
    from levelgrid.plans.validate import dimension_refs

    known = vertices.select(*PLAN, F.lit("vertex").alias("type"), F.col("vertex_id").alias("ref")).unionByName(
        openings.select(*PLAN, F.lit("opening").alias("type"), F.col("opening_id").alias("ref"))
    )
    lost = dimension_refs(t.dimensions).join(known, [*PLAN, "type", "ref"], "left_anti").select(*PLAN, F.col("element_id").alias("dimension_id")).distinct()
    plain = {n: gone(getattr(t, n), ELEMENTS[n][0]).select(*getattr(t, n).columns) for n in ("columns", "stairs", "rooms", "fixtures", "texts")}
    return t.with_(
        walls=walls, openings=openings, separators=separators.select(*t.separators.columns), vertices=vertices,
        dimensions=t.dimensions.join(lost, [*PLAN, "dimension_id"], "left_anti").select(*t.dimensions.columns), **plain,
    )


def move_selection(t: PlanTables, ops: DataFrame):
    """ops: items array<struct<kind,id>>, p_dx, p_dy. Walls and separators move their vertices."""
    ops = settle(ops)
    bad = ~(finite(F.col("p_dx")) & finite(F.col("p_dy")))
    items = settle(ops.filter(~bad).select(*PLAN, F.explode("items").alias("i"), "p_dx", "p_dy").select(*PLAN, "i.kind", "i.id", "p_dx", "p_dy"))
    of = lambda kind, c: items.filter(F.col("kind") == kind).select(*PLAN, F.col("id").alias(c), "p_dx", "p_dy").distinct()
    ends = lambda df, c, kind: df.join(of(kind, c), [*PLAN, c]).select(*PLAN, F.explode(F.array("a", "b")).alias("vertex_id"), "p_dx", "p_dy")
    touched = of("vertex", "vertex_id").unionByName(ends(t.walls, "wall_id", "wall")).unionByName(ends(t.separators, "separator_id", "separator")).distinct()
    zero = F.lit(0.0)
    dx, dy = F.coalesce("p_dx", zero), F.coalesce("p_dy", zero)

    def shift(df, side, c):
        return df.join(side, [*PLAN, c], "left").withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}).select(*df.columns)

    stairs = t.stairs.join(of("stair", "stair_id"), [*PLAN, "stair_id"], "left").withColumn(
        "outline", F.transform("outline", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    ).select(*t.stairs.columns)
    rooms = t.rooms.join(of("room", "room_id"), [*PLAN, "room_id"], "left").withColumn(
        "seed", F.struct((F.col("seed.x") + dx).alias("x"), (F.col("seed.y") + dy).alias("y"))
    ).select(*t.rooms.columns)
    return (
        t.with_(
            vertices=shift(t.vertices, touched, "vertex_id"), fixtures=shift(t.fixtures, of("fixture", "fixture_id"), "fixture_id"),
            columns=shift(t.columns, of("column", "column_id"), "column_id"), texts=shift(t.texts, of("text", "text_id"), "text_id"), stairs=stairs, rooms=rooms,
        ),
        _reject(ops.filter(bad), "Move must be finite"),
    )


def collinear_joints(t: PlanTables) -> DataFrame:
    """Pairs of walls that share a vertex, with the angle between them there."""
    lines = lines_of(t)
    ends = settle(
        lines.select(*PLAN, "wall_id", F.explode(F.array(
            F.struct(F.col("a").alias("v"), F.col("x1").alias("hx"), F.col("y1").alias("hy"), F.col("b").alias("far"), F.col("x2").alias("fx"), F.col("y2").alias("fy")),
            F.struct(F.col("b").alias("v"), F.col("x2").alias("hx"), F.col("y2").alias("hy"), F.col("a").alias("far"), F.col("x1").alias("fx"), F.col("y1").alias("fy")),
        )).alias("e")).select(*PLAN, "wall_id", "e.*")
    )
    other = ends.select(*PLAN, "v", F.col("wall_id").alias("other"), F.col("far").alias("ofar"), F.col("fx").alias("ox"), F.col("fy").alias("oy"))
    m = ends.join(other, [*PLAN, "v"]).filter("wall_id <> other")
    return m.withColumn("angle", g.joint_angle_deg(g.xy("hx", "hy"), g.xy("fx", "fy"), g.xy("ox", "oy")))


def move_walls(t: PlanTables, ops: DataFrame):
    """Perpendicular wall moves; ops: target, p_dx, p_dy.

    The whole collinear run moves; a vertex where the run meets a wall at a
    right angle slides along that wall.
    """
    ops = settle(ops)
    known = t.walls.select(*PLAN, F.col("wall_id").alias("target"))
    unknown = ops.join(known, [*PLAN, "target"], "left_anti")
    touched = ops.select(*PLAN).distinct()
    sub = t.with_(walls=t.walls.join(touched, PLAN, "left_semi"), vertices=t.vertices.join(touched, PLAN, "left_semi"))
    js = settle(collinear_joints(sub))
    node = lambda c: F.struct(*PLAN, F.col(c).alias("w"))
    runs = js.filter(F.abs(F.col("angle") - 180.0) <= ORTHO)
    label = connected_components(runs.select(node("wall_id").alias("u"), node("other").alias("v")), sub.walls.select(node("wall_id").alias("id")))
    label = settle(label.select(F.col("id.plan_id").alias("plan_id"), F.col("id.level_id").alias("level_id"), F.col("id.w").alias("wall_id"), F.col("component.w").alias("run")))
    lines = lines_of(sub)
    d = g.unit(g.sub(g.xy("x2", "y2"), g.xy("x1", "y1")))
    n = g.left(d)
    amount = F.col("p_dx") * n.x + F.col("p_dy") * n.y
    push = ops.withColumnRenamed("target", "wall_id").join(lines, [*PLAN, "wall_id"]).filter((d.x != 0) | (d.y != 0))
    push = push.withColumns({"ax": n.x * amount, "ay": n.y * amount}).select(*PLAN, "wall_id", "ax", "ay")
    push = push.join(label, [*PLAN, "wall_id"]).select(*PLAN, "run", "ax", "ay")
    moving = settle(label.join(push, [*PLAN, "run"]))
    verts = moving.join(lines.select(*PLAN, "wall_id", "a", "b"), [*PLAN, "wall_id"]).select(*PLAN, "run", "ax", "ay", F.explode(F.array("a", "b")).alias("vertex_id")).distinct()
    # At each moving vertex: a run wall, and a neighbour off the run at a right angle to it.
    at = js.join(label.withColumnRenamed("run", "r1"), [*PLAN, "wall_id"]).join(label.select(*PLAN, F.col("wall_id").alias("other"), F.col("run").alias("r2")), [*PLAN, "other"])
    at = at.filter((F.col("r1") != F.col("r2")) & (F.abs(F.col("angle") - 90.0) <= ORTHO))
    best = at.groupBy(*PLAN, F.col("v").alias("vertex_id"), F.col("r1").alias("run")).agg(F.min(F.struct("other", "wall_id", "hx", "hy", "fx", "fy", "ox", "oy")).alias("k"))
    verts = verts.join(best, [*PLAN, "vertex_id", "run"], "left")
    here, far, off = g.P(F.col("k.hx"), F.col("k.hy")), g.P(F.col("k.fx"), F.col("k.fy")), g.P(F.col("k.ox"), F.col("k.oy"))
    start = g.P(here.x + F.col("ax"), here.y + F.col("ay"))
    hit = g.line_intersect(start, g.unit(g.sub(far, here)), off, g.sub(here, off))
    verts = verts.select(*PLAN, "vertex_id", hit.x.alias("_hx"), hit.y.alias("_hy"), "ax", "ay")
    moved = t.vertices.join(verts, [*PLAN, "vertex_id"], "left").withColumns(
        {"x": F.coalesce("_hx", F.col("x") + F.col("ax"), "x"), "y": F.coalesce("_hy", F.col("y") + F.col("ay"), "y")}
    ).select(*t.vertices.columns)
    return t.with_(vertices=settle(moved)), _reject(unknown, F.concat(F.lit("Unknown wall "), "target"))


def apply_lengths(t: PlanTables, ops: DataFrame):
    """Typed lengths; ops: a and b (struct<type,id,edge>) and p_length.

    Every vertex at or past the moving reference shifts; openings keep their
    place in the world unless they are past it too.
    """
    ops = settle(ops)
    ok = finite(F.col("p_length")) & (F.col("p_length") > 0)
    good = ops.filter(F.coalesce(ok, F.lit(False)))
    refs = good.select(*PLAN, "seq", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("a").alias("r")), F.struct(F.lit("b").alias("end"), F.col("b").alias("r")))).alias("e"))
    refs = refs.select(*PLAN, "seq", "e.end", F.col("e.r.type").alias("type"), F.col("e.r.id").alias("ref"), F.col("e.r.edge").alias("edge"))
    pts = resolve_refs(refs, t)
    pick = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    m = pts.groupBy(*PLAN, "seq").agg(pick("a", "x").alias("ax"), pick("a", "y").alias("ay"), pick("b", "x").alias("bx"), pick("b", "y").alias("by"))
    m = settle(good.select(*PLAN, "seq", "b", "p_length").join(m, [*PLAN, "seq"]))
    lost = _reject(m.filter("ax is null or bx is null"), "Unknown reference")
    axis = g.unit(g.sub(g.xy("bx", "by"), g.xy("ax", "ay")))
    m = m.filter("ax is not null and bx is not null").withColumns({"ux": axis.x, "uy": axis.y}).filter("ux <> 0 or uy <> 0")
    m = m.withColumns({"dx": F.col("ax") + F.col("ux") * F.col("p_length") - F.col("bx"), "dy": F.col("ay") + F.col("uy") * F.col("p_length") - F.col("by"), "lim": F.col("bx") * F.col("ux") + F.col("by") * F.col("uy")})
    m = settle(m.select(*PLAN, "b", "ux", "uy", "dx", "dy", "lim", "ax", "ay", "p_length"))
    v = t.vertices.join(m, PLAN, "left")
    past = ((F.col("b.type") == "vertex") & (F.col("b.id") == F.col("vertex_id"))) | (F.col("x") * F.col("ux") + F.col("y") * F.col("uy") >= F.col("lim"))
    v = settle(v.withColumns({"nx": F.when(past, F.col("x") + F.col("dx")).otherwise(F.col("x")), "ny": F.when(past, F.col("y") + F.col("dy")).otherwise(F.col("y"))}))
    new_v = v.select(*PLAN, "vertex_id", F.col("nx").alias("x"), F.col("ny").alias("y"))
    end = lambda e: v.select(*PLAN, F.col("vertex_id").alias(e), *[F.col(c).alias(f"{e}{c}") for c in ("x", "y", "nx", "ny")])
    w = t.walls.select(*PLAN, "wall_id", "a", "b").join(end("a"), [*PLAN, "a"]).join(end("b"), [*PLAN, "b"]).drop("a", "b")
    o = t.openings.join(w, [*PLAN, "wall_id"], "left").join(m.withColumnsRenamed({"ax": "ancx", "ay": "ancy"}), PLAN, "left")
    old = g.lerp(g.xy("ax", "ay"), g.xy("bx", "by"), F.col("offset"))
    beyond = old.x * F.col("ux") + old.y * F.col("uy") >= F.col("lim")
    c = g.P(F.when(beyond, old.x + F.col("dx")).otherwise(old.x), F.when(beyond, old.y + F.col("dy")).otherwise(old.y))
    a2, b2 = g.xy("anx", "any"), g.xy("bnx", "bny")
    along = g.unit(g.sub(b2, a2))
    # The opening that was referred to ends exactly at the target.
    target = g.P(F.col("ancx") + F.col("ux") * F.col("p_length"), F.col("ancy") + F.col("uy") * F.col("p_length"))
    half = F.col("width") / 2.0 * F.when(F.col("b.edge") == "start", 1.0).otherwise(F.lit(-1.0))
    own = (F.col("b.type") == "opening") & (F.col("b.id") == F.col("opening_id"))
    cx = F.when(own, target.x + along.x * half).otherwise(c.x)
    cy = F.when(own, target.y + along.y * half).otherwise(c.y)
    length = g.dist(a2, b2)
    new = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((cx - a2.x) * along.x + (cy - a2.y) * along.y) / length))
    o = o.withColumn("offset", F.when(F.col("lim").isNotNull() & (length > 0), new).otherwise(F.col("offset")))
    rej = _reject(ops.filter(~F.coalesce(ok, F.lit(False))), "Typed length must be a positive finite length").unionByName(lost)
    return t.with_(vertices=new_v, openings=settle(o.select(*t.openings.columns))), rej


def set_thickness_from_face(t: PlanTables, ops: DataFrame):
    """ops: target, p_thickness, p_keep (left, right or center)."""
    v = F.col("p_thickness")
    ok = F.coalesce(finite(v) & (v > 0) & (v <= 1.5), F.lit(False))
    fr = _frames(t).select(*PLAN, F.col("wall_id").alias("target"), "thickness", "dx", "dy")
    good = ops.filter(ok).join(fr, [*PLAN, "target"])
    shift = (F.col("thickness") - v) / 2.0 * F.when(F.col("p_keep") == "left", 1.0).when(F.col("p_keep") == "center", 0.0).otherwise(F.lit(-1.0))
    moves = settle(good.select(*PLAN, "seq", "target", (-F.col("dy") * shift).alias("p_dx"), (F.col("dx") * shift).alias("p_dy")))
    moved, r1 = move_walls(t, moves)
    done, r2 = set_thickness(moved, ops.select(*PLAN, "seq", "target", "p_thickness"))
    return done, r1.unionByName(r2).distinct()


def set_clear_distance(t: PlanTables, ops: DataFrame):
    """ops: target, other, p_distance: move the wall until the clear distance holds."""
    ok = F.coalesce(finite(F.col("p_distance")) & (F.col("p_distance") > 0), F.lit(False))
    ops = settle(ops)
    fr = settle(_frames(t))
    m = ops.filter(ok).withColumn("wall_id_l", F.col("target")).withColumn("wall_id_r", F.col("other"))
    m = m.join(_sides(fr, "l"), [*PLAN, "wall_id_l"]).join(_sides(fr, "r"), [*PLAN, "wall_id_r"])
    m = settle(_measured(m))
    push = -F.col("side") * (F.col("p_distance") - F.col("clear"))
    moves = m.filter("side <> 0").select(*PLAN, "seq", "target", (-F.col("dy_l") * push).alias("p_dx"), (F.col("dx_l") * push).alias("p_dy"))
    moved, _ = move_walls(t, moves)
    apart = ops.filter(ok).join(m.select(*PLAN, "seq"), [*PLAN, "seq"], "left_anti")
    rej = _reject(ops.filter(~ok), "Clear distance must be greater than 0").unionByName(_reject(apart, "The two walls are not parallel")).unionByName(
        _reject(m.filter("side = 0"), "The two walls share a centerline")
    )
    return moved, rej


def set_opening_edge(t: PlanTables, ops: DataFrame):
    """ops: target, p_edge (start or end), p_amount: grow one side of an opening."""
    fr = _frames(t).select(*PLAN, "wall_id", F.col("length").alias("_len"))
    df = t.openings.join(fr, [*PLAN, "wall_id"], "left")
    width = F.col("width") + F.col("p_amount")
    mid = F.col("offset") * F.col("_len") + F.col("p_amount") / 2.0 * F.when(F.col("p_edge") == "end", 1.0).otherwise(F.lit(-1.0))
    nw, nc = F.col("_n_width"), F.col("_n_offset") * F.col("_len")
    checks = [
        ((nw > 0) & (nc - nw / 2.0 >= -1e-9) & (nc + nw / 2.0 <= F.col("_len") + 1e-9), "The opening must stay on its wall"),
        (nw < F.col("_len"), "Opening width must be shorter than its wall"),
        (F.col("head") > F.col("sill"), "Opening head must be above the sill"),
    ]
    out, rej = patch(df, "opening_id", ops, {"width": width, "offset": mid / F.col("_len")}, checks, "opening")
    return t.with_(openings=out.select(*t.openings.columns)), rej


def rehost_openings(t: PlanTables, ops: DataFrame):
    """ops: target, p_wall, p_x, p_y: move an opening to the foot of a point on another wall."""
    fr = _frames(t).select(*PLAN, F.col("wall_id").alias("p_wall"), F.col("length").alias("p_len"), F.col("x1").alias("p_x1"), F.col("y1").alias("p_y1"), F.col("x2").alias("p_x2"), F.col("y2").alias("p_y2"))
    ops = ops.join(fr, [*PLAN, "p_wall"], "left")
    half = F.col("width") / 2.0 / F.col("p_len")
    foot = g.foot_param(g.xy("p_x", "p_y"), g.xy("p_x1", "p_y1"), g.xy("p_x2", "p_y2"))
    at = F.least(1.0 - half, F.greatest(half, F.coalesce(foot, F.lit(0.5))))
    checks = [(F.col("p_len").isNotNull(), "Unknown wall"), (F.col("width") < F.col("p_len"), "The opening is wider than that wall")]
    out, rej = patch(t.openings, "opening_id", ops, {"wall_id": F.col("p_wall"), "offset": at}, checks, "opening")
    return t.with_(openings=out), rej


def snap_rotation(degrees: Column) -> Column:
    return g.js_round(degrees / 15.0) * 15.0


def snap_fixtures(t: PlanTables, tolerance: float, ids: DataFrame | None = None) -> PlanTables:
    """Fixtures whose back is within `tolerance` of a wall face are put against it."""
    f = t.fixtures if ids is None else t.fixtures.join(ids.select(*PLAN, "fixture_id"), [*PLAN, "fixture_id"], "left_semi")
    fr = _frames(t)
    p, a = g.xy("x", "y"), g.xy("x1", "y1")
    s = (F.col("x") - F.col("x1")) * -F.col("dy") + (F.col("y") - F.col("y1")) * F.col("dx")
    # Meet the walls within reach of the deepest fixture in the fixture's own tiles.
    reach = F.col("depth") / 2.0 + tolerance + 0.75
    m = tiles.tile_box(f.select(*PLAN, "fixture_id", "x", "y", "depth"), F.col("x") - reach, F.col("y") - reach, F.col("x") + reach, F.col("y") + reach, 1.0)
    walls = tiles.tile_segment(fr, a, g.xy("x2", "y2"), 0.0, 1.0)
    m = m.join(walls, [*PLAN, *tiles.TILE]).drop(*tiles.TILE).distinct()
    along = g.foot_param(p, a, g.xy("x2", "y2"))
    m = m.withColumns({"s": s, "gap": F.abs(s) - F.col("thickness") / 2.0}).withColumn("back", F.col("gap") - F.col("depth") / 2.0)
    m = m.filter(along.between(0.0, 1.0) & (F.col("s") != 0) & (F.col("gap") > 0) & (F.abs("back") <= tolerance))
    sign = F.signum("s")
    best = m.groupBy(*PLAN, "fixture_id").agg(F.min(F.struct("gap", "wall_id", "back", (-F.col("dy") * sign).alias("ix"), (F.col("dx") * sign).alias("iy"))).alias("b"))
    out = t.fixtures.join(best, [*PLAN, "fixture_id"], "left")
    hit = F.col("b").isNotNull()
    turn = F.pmod(F.degrees(F.atan2(F.col("b.ix"), -F.col("b.iy"))), F.lit(360.0))
    out = out.withColumns(
        {
            "x": F.when(hit, F.col("x") - F.col("b.ix") * F.col("b.back")).otherwise(F.col("x")),
            "y": F.when(hit, F.col("y") - F.col("b.iy") * F.col("b.back")).otherwise(F.col("y")),
            "rotation_deg": F.when(hit, turn).otherwise(F.col("rotation_deg")),
        }
    )
    return t.with_(fixtures=out.select(*t.fixtures.columns))


def allocate_ids(t: PlanTables, wanted: DataFrame) -> DataFrame:
    """(plan, prefix, n, id): the lowest unused ids for rows (plan_id, level_id, prefix, n).

    `n` counts 1..k within a storey and prefix. Only as many numbers as there
    are used and wanted ones are tried, so there is always one for each.
    """
    used = all_ids(t).distinct()
    marked = wanted.select(*PLAN, "prefix").distinct()
    taken = used.withColumn("_p", F.regexp_extract("id", "^([A-Za-z]+)([1-9][0-9]*)$", 1)).withColumn("_i", F.expr("try_cast(regexp_extract(id, '^([A-Za-z]+)([1-9][0-9]*)$', 2) as int)"))
    taken = taken.filter("_i is not null").select(*PLAN, F.col("_p").alias("prefix"), F.col("_i").alias("i"))
    size = wanted.groupBy(*PLAN, "prefix").agg(F.max("n").alias("_k")).join(taken.groupBy(*PLAN, "prefix").agg(F.count(F.lit(1)).alias("_u")), [*PLAN, "prefix"], "left")
    free = size.withColumn("i", F.explode(F.sequence(F.lit(1), (F.col("_k") + F.coalesce("_u", F.lit(0))).cast("int"))))
    free = free.join(taken, [*PLAN, "prefix", "i"], "left_anti")
    free = free.withColumn("n", F.row_number().over(W.partitionBy(*PLAN, "prefix").orderBy("i")))
    return wanted.join(free.select(*PLAN, "prefix", "n", F.concat("prefix", F.col("i").cast("string")).alias("id")), [*PLAN, "prefix", "n"], "left")


def _numbered(df: DataFrame, prefix: str, *order) -> DataFrame:
    return number_rows(df, PLAN, list(order), "n").withColumn("prefix", F.lit(prefix))


def _with_ids(t: PlanTables, df: DataFrame, prefix: str, name: str, *order) -> DataFrame:
    """df with a fresh id column `name`."""
    df = settle(_numbered(df, prefix, *order))
    ids = allocate_ids(t, df.select(*PLAN, "prefix", "n"))
    return df.join(ids.select(*PLAN, "prefix", "n", F.col("id").alias(name)), [*PLAN, "prefix", "n"]).drop("prefix", "n")


def split_walls(t: PlanTables, ops: DataFrame):
    """ops: target, p_t: split walls between their ends; openings follow their half."""
    ok = F.coalesce((F.col("p_t") > 0) & (F.col("p_t") < 1), F.lit(False))
    ops = settle(ops)
    lines = lines_of(t)
    hit = ops.filter(ok).withColumnRenamed("target", "wall_id").join(lines, [*PLAN, "wall_id"])
    hit = _with_ids(t, hit, "v", "new_v", "seq")
    hit = settle(_with_ids(t, hit, "w", "new_w", "seq"))
    mid = g.lerp(g.xy("x1", "y1"), g.xy("x2", "y2"), F.col("p_t"))
    vertices = t.vertices.unionByName(hit.select(*PLAN, F.col("new_v").alias("vertex_id"), mid.x.alias("x"), mid.y.alias("y")))
    side = hit.select(*PLAN, "wall_id", "p_t", "new_v", "new_w")
    first = t.walls.join(side, [*PLAN, "wall_id"], "left").withColumn("b", F.coalesce("new_v", "b")).select(*t.walls.columns)
    second = hit.select(*PLAN, F.col("new_w").alias("wall_id"), F.col("new_v").alias("a"), "b", "thickness", "kind", "confidence")
    o = t.openings.join(side, [*PLAN, "wall_id"], "left")
    near = F.col("offset") <= F.col("p_t")
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    moved = F.when(near, clamp(F.col("offset") / F.col("p_t"))).otherwise(clamp((F.col("offset") - F.col("p_t")) / (1.0 - F.col("p_t"))))
    o = o.withColumns({"_o": F.when(F.col("p_t").isNull(), F.col("offset")).otherwise(moved), "_w": F.when(F.col("p_t").isNull() | near, F.col("wall_id")).otherwise(F.col("new_w"))})
    o = o.withColumns({"offset": F.col("_o"), "wall_id": F.col("_w")}).select(*t.openings.columns)
    unknown = ops.join(t.walls.select(*PLAN, F.col("wall_id").alias("target")), [*PLAN, "target"], "left_anti")
    rej = _reject(ops.filter(~ok), "Split the wall between its ends").unionByName(_reject(unknown, F.concat(F.lit("Unknown wall "), "target")))
    return t.with_(vertices=settle(vertices), walls=settle(first.unionByName(second)), openings=settle(o)), rej


def merge_walls(t: PlanTables, ops: DataFrame):
    """ops: target: join a wall with its first collinear neighbour; openings keep their place."""
    ops = settle(ops)
    js = collinear_joints(t).filter(F.abs(F.col("angle") - 180.0) <= ORTHO)
    hit = ops.withColumnRenamed("target", "wall_id").join(js, [*PLAN, "wall_id"])
    hit = hit.groupBy(*PLAN, "wall_id").agg(F.min(F.struct(F.length("other").alias("l"), "other", "v", "far", "ofar", "fx", "fy", "ox", "oy")).alias("k"))
    hit = settle(hit.select(*PLAN, "wall_id", "k.other", "k.v", F.col("k.far").alias("ka"), F.col("k.ofar").alias("kb"), "k.fx", "k.fy", "k.ox", "k.oy"))
    kept = t.walls.join(hit.select(*PLAN, F.col("other").alias("wall_id")), [*PLAN, "wall_id"], "left_anti")
    kept = kept.join(hit.select(*PLAN, "wall_id", "ka", "kb"), [*PLAN, "wall_id"], "left").withColumns({"a": F.coalesce("ka", "a"), "b": F.coalesce("kb", "b")}).select(*t.walls.columns)
    kept = settle(kept)
    both = hit.select(*PLAN, F.explode(F.array("wall_id", "other")).alias("host"), F.col("wall_id").alias("to"), "fx", "fy", "ox", "oy")
    lines = lines_of(t).select(*PLAN, F.col("wall_id").alias("host"), "x1", "y1", "x2", "y2")
    o = t.openings.withColumn("host", F.col("wall_id")).join(lines, [*PLAN, "host"], "left").join(both, [*PLAN, "host"], "left")
    c = g.lerp(g.xy("x1", "y1"), g.xy("x2", "y2"), F.col("offset"))
    s, e = g.xy("fx", "fy"), g.xy("ox", "oy")
    span = g.sub(e, s)
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), g.dot(g.sub(c, s), span) / g.dot(span, span)))
    o = o.withColumns({"offset": F.when(F.col("to").isNotNull(), at).otherwise(F.col("offset")), "wall_id": F.coalesce("to", "wall_id")}).select(*t.openings.columns)
    used = kept.select(*PLAN, F.explode(F.array("a", "b")).alias("vertex_id")).unionByName(t.separators.select(*PLAN, F.explode(F.array("a", "b")).alias("vertex_id"))).distinct()
    loose = hit.select(*PLAN, F.col("v").alias("vertex_id")).join(used, [*PLAN, "vertex_id"], "left_anti")
    vertices = t.vertices.join(loose, [*PLAN, "vertex_id"], "left_anti").select(*t.vertices.columns)
    unknown = ops.join(t.walls.select(*PLAN, F.col("wall_id").alias("target")), [*PLAN, "target"], "left_anti")
    return t.with_(walls=kept, openings=settle(o), vertices=settle(vertices)), _reject(unknown, F.concat(F.lit("Unknown wall "), "target"))


def place_openings(t: PlanTables, ops: DataFrame):
    """ops: target (wall), p_kind, p_end (a or b), p_distance, p_width, p_swing_side.

    The distance runs from the inner corner: half the thickest other wall
    that meets this one there.
    """
    ops = settle(ops)
    lines = settle(lines_of(t))
    ends = lines.select(*PLAN, "wall_id", "thickness", F.explode(F.array("a", "b")).alias("v"))
    other = ends.select(*PLAN, "v", F.col("wall_id").alias("_w"), F.col("thickness").alias("_t"))
    corner = ends.join(other, [*PLAN, "v"]).filter("wall_id <> _w").groupBy(*PLAN, "wall_id", "v").agg((F.max("_t") / 2.0).alias("inner"))
    inner = lambda e: corner.select(*PLAN, "wall_id", F.col("v").alias(e), F.col("inner").alias(f"i{e}"))
    m = ops.withColumnRenamed("target", "wall_id").join(lines, [*PLAN, "wall_id"]).join(inner("a"), [*PLAN, "wall_id", "a"], "left").join(inner("b"), [*PLAN, "wall_id", "b"], "left")
    length = g.dist(g.xy("x1", "y1"), g.xy("x2", "y2"))
    zero = F.lit(0.0)
    m = m.withColumns({"_len": length, "_s": F.coalesce("ia", zero), "_e": length - F.coalesce("ib", zero)})
    mid = F.when(F.col("p_end") == "a", F.col("_s") + F.col("p_distance") + F.col("p_width") / 2.0).otherwise(F.col("_e") - F.col("p_distance") - F.col("p_width") / 2.0)
    m = m.withColumn("_c", mid)
    sill = F.when(F.col("p_kind") == "window", 0.9).otherwise(zero)
    reason = (
        F.when(~F.coalesce(finite(F.col("p_distance")) & (F.col("p_distance") >= 0), F.lit(False)), "The distance must be zero or more")
        .when(~F.coalesce(F.col("p_width") > 0, F.lit(False)), "The opening width must be greater than 0")
        .when((F.col("_c") - F.col("p_width") / 2.0 < F.col("_s") - 1e-9) | (F.col("_c") + F.col("p_width") / 2.0 > F.col("_e") + 1e-9), "The opening does not fit between the inner corners")
        .when(F.col("p_width") >= F.col("_len"), "Opening width must be shorter than its wall")
    )
    m = settle(m.withColumn("_reason", reason))
    good = _with_ids(t, m.filter("_reason is null"), "o", "opening_id", "seq")
    rows = good.select(
        *PLAN, "opening_id", "wall_id", F.col("p_kind").alias("kind"), (F.col("_c") / F.col("_len")).alias("offset"), F.col("p_width").alias("width"), sill.alias("sill"),
        F.lit(2.1).alias("head"), F.when(F.col("p_kind") == "passage", "none").otherwise("left").alias("swing"), F.coalesce("p_swing_side", F.lit("positive")).alias("swing_side"), F.lit(1.0).alias("confidence"),
    )
    unknown = ops.join(t.walls.select(*PLAN, F.col("wall_id").alias("target")), [*PLAN, "target"], "left_anti")
    rej = _reject(m.filter("_reason is not null"), F.col("_reason")).unionByName(_reject(unknown, F.concat(F.lit("Unknown wall "), "target")))
    return t.with_(openings=t.openings.unionByName(rows)), rej


def add_dimensions(t: PlanTables, ops: DataFrame):
    """ops: refs array<struct<type,id,edge>>, p_offset."""
    ops = settle(ops)
    refs = ops.select(*PLAN, "seq", F.posexplode("refs").alias("i", "r"))
    w = W.partitionBy(*PLAN, "seq").orderBy("i")
    refs = refs.withColumn("_next", F.lead("r").over(w))
    known = t.vertices.select(*PLAN, F.lit("vertex").alias("type"), F.col("vertex_id").alias("id")).unionByName(t.openings.select(*PLAN, F.lit("opening").alias("type"), F.col("opening_id").alias("id")))
    lost = refs.select(*PLAN, "seq", F.col("r.type").alias("type"), F.col("r.id").alias("id")).join(known, [*PLAN, "type", "id"], "left_anti")
    lost = lost.groupBy(*PLAN, "seq").agg(F.min(F.concat(F.lit("Unknown "), "type", F.lit(" "), "id")).alias("_lost"))
    same = refs.groupBy(*PLAN, "seq").agg(F.bool_or(F.col("r").eqNullSafe(F.col("_next"))).alias("_same"))
    m = ops.join(lost, [*PLAN, "seq"], "left").join(same, [*PLAN, "seq"], "left")
    reason = (
        F.when(F.size("refs") < 2, F.lit("A dimension needs at least two points"))
        .when(~F.coalesce(finite(F.col("p_offset")), F.lit(False)), F.lit("The dimension offset must be a number"))
        .when(F.col("_lost").isNotNull(), F.col("_lost"))
        .when(F.col("_same"), F.lit("A dimension segment needs two different points"))
    )
    m = settle(m.withColumn("_reason", reason))
    good = _with_ids(t, m.filter("_reason is null"), "d", "dimension_id", "seq")
    segs = F.zip_with(F.slice("refs", F.lit(1), F.size("refs") - 1), F.slice("refs", F.lit(2), F.size("refs") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = good.select(*PLAN, "dimension_id", F.lit(False).alias("auto"), F.col("p_offset").alias("offset"), segs.alias("segments"))
    return t.with_(dimensions=t.dimensions.unionByName(rows)), _reject(m.filter("_reason is not null"), F.col("_reason"))


def clone_selection(t: PlanTables, ids: DataFrame, dx: float = 0.5, dy: float = 0.5) -> PlanTables:
    """Copy ids (plan_id, level_id, id) within their storey, moved by (dx, dy), under new ids."""
    want = settle(ids.select(*PLAN, "id").distinct())
    semi = lambda df, c: df.join(want.withColumnRenamed("id", c), [*PLAN, c], "left_semi")
    walls = settle(semi(t.walls, "wall_id").unionByName(semi(t.walls, "a").select(*t.walls.columns)).unionByName(semi(t.walls, "b").select(*t.walls.columns)).distinct())
    used = walls.select(*PLAN, F.explode(F.array("a", "b")).alias("vertex_id")).distinct()
    v = _with_ids(t, t.vertices.join(used, [*PLAN, "vertex_id"]), "v", "new", F.length("vertex_id"), "vertex_id")
    v = settle(v)
    w = settle(_with_ids(t, walls, "w", "new", F.length("wall_id"), "wall_id"))
    m = lambda e: v.select(*PLAN, F.col("vertex_id").alias(e), F.col("new").alias(f"n{e}"))
    wm = w.select(*PLAN, "wall_id", F.col("new").alias("nw"))
    new_walls = w.join(m("a"), [*PLAN, "a"]).join(m("b"), [*PLAN, "b"]).select(*PLAN, F.col("new").alias("wall_id"), F.col("na").alias("a"), F.col("nb").alias("b"), "thickness", "kind", "confidence")
    o = _with_ids(t, t.openings.join(wm, [*PLAN, "wall_id"]), "o", "new", F.length("opening_id"), "opening_id")
    new_openings = o.withColumns({"opening_id": F.col("new"), "wall_id": F.col("nw")}).select(*t.openings.columns)

    def plain(name, prefix):
        df = getattr(t, name)
        c = ELEMENTS[name][0]
        d = _with_ids(t, semi(df, c), prefix, "new", F.length(c), c).withColumn(c, F.col("new"))
        if name == "stairs":
            d = d.withColumn("outline", F.transform("outline", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))
        else:
            d = d.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
        return df.unionByName(d.select(*df.columns))

    moved = v.select(*PLAN, F.col("new").alias("vertex_id"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return t.with_(
        vertices=t.vertices.unionByName(moved), walls=t.walls.unionByName(new_walls.select(*t.walls.columns)), openings=t.openings.unionByName(new_openings),
        columns=plain("columns", "c"), stairs=plain("stairs", "s"), fixtures=plain("fixtures", "f"), texts=plain("texts", "t"),
    )


def weld_vertices(points: DataFrame, vertices: DataFrame, radius: float = JOIN) -> DataFrame:
    """For each point (id, x, y) the nearest vertex within `radius`, else NULL."""
    near = tiles.nearest_within(points, vertices, PLAN, ["x", "y"], radius, "vertex_id")
    return points.join(near.select(*PLAN, "id", "vertex_id"), [*PLAN, "id"], "left")


def offset_wall(df: DataFrame) -> DataFrame:
    """Centreline (x1..y2) of walls drawn along a face: columns px, py, qx, qy, thickness, location."""
    d = g.unit(g.sub(g.xy("qx", "qy"), g.xy("px", "py")))
    s = F.when(F.col("location") == "left", -F.col("thickness") / 2.0).when(F.col("location") == "right", F.col("thickness") / 2.0).otherwise(F.lit(0.0))
    n = g.left(d)
    return df.withColumns({"x1": F.col("px") + n.x * s, "y1": F.col("py") + n.y * s, "x2": F.col("qx") + n.x * s, "y2": F.col("qy") + n.y * s})


def add_rectangles(t: PlanTables, ops: DataFrame):
    """ops: p_x1, p_y1, p_x2, p_y2, p_thickness, p_mode (interior or centerline)."""
    ops = settle(ops)
    th = F.col("p_thickness")
    grow = F.when(F.col("p_mode") == "interior", th / 2.0).otherwise(F.lit(0.0))
    m = ops.withColumns({"x0": F.least("p_x1", "p_x2") - grow, "y0": F.least("p_y1", "p_y2") - grow, "x1": F.greatest("p_x1", "p_x2") + grow, "y1": F.greatest("p_y1", "p_y2") + grow})
    reason = F.when(~F.coalesce((th > 0) & (th <= 1.5), F.lit(False)), "Wall thickness must be greater than 0 and at most 1.5 m").when(
        ~((F.col("x1") - F.col("x0") > th) & (F.col("y1") - F.col("y0") > th)), "The rectangle is smaller than its walls"
    )
    m = settle(m.withColumn("_reason", reason))
    good = m.filter("_reason is null")
    spot = lambda i, x, y: F.struct(F.lit(i).alias("i"), F.col(x).alias("x"), F.col(y).alias("y"))
    corners = good.select(*PLAN, "seq", F.explode(F.array(spot(0, "x0", "y0"), spot(1, "x1", "y0"), spot(2, "x1", "y1"), spot(3, "x0", "y1"))).alias("c"))
    corners = corners.select(*PLAN, F.struct("seq", "c.i").alias("id"), "c.x", "c.y")
    welded = settle(weld_vertices(corners, t.vertices))
    fresh = settle(_with_ids(t, welded.filter("vertex_id is null").drop("vertex_id"), "v", "vertex_id", "id"))
    named = welded.filter("vertex_id is not null").unionByName(fresh.select(*welded.columns))
    pick = lambda i: F.max(F.when(F.col("id.i") == i, F.col("vertex_id")))
    loop = named.groupBy(*PLAN, F.col("id.seq").alias("seq")).agg(F.array(*[pick(i) for i in range(4)]).alias("_l"))
    sides = loop.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    sides = sides.select(*PLAN, "seq", "_i", F.get("_l", F.col("_i")).alias("a"), F.get("_l", (F.col("_i") + 1) % 4).alias("b"))
    pair = lambda df: df.withColumns({"_lo": F.least("a", "b"), "_hi": F.greatest("a", "b")})
    sides = pair(sides).join(pair(t.walls).select(*PLAN, "_lo", "_hi"), [*PLAN, "_lo", "_hi"], "left_anti").drop("_lo", "_hi")
    sides = sides.join(good.select(*PLAN, "seq", th.alias("thickness")), [*PLAN, "seq"])
    sides = _with_ids(t, sides, "w", "wall_id", "seq", "_i")
    walls = sides.select(*PLAN, "wall_id", "a", "b", "thickness", F.lit("exterior").alias("kind"), F.lit(1.0).alias("confidence"))
    seeds = t.rooms.select(*PLAN, F.col("seed.x").alias("sx"), F.col("seed.y").alias("sy"))
    seeded = good.join(seeds, PLAN).filter("sx > x0 and sx < x1 and sy > y0 and sy < y1").select(*PLAN, "seq").distinct()
    bare = _with_ids(t, good.join(seeded, [*PLAN, "seq"], "left_anti"), "r", "room_id", "seq")
    rooms = bare.select(*PLAN, "room_id", F.lit("Room").alias("name"), F.lit("").alias("number"), F.struct(((F.col("x0") + F.col("x1")) / 2.0).alias("x"), ((F.col("y0") + F.col("y1")) / 2.0).alias("y")).alias("seed"))
    vertices = t.vertices.unionByName(fresh.select(*PLAN, "vertex_id", "x", "y"))
    return t.with_(vertices=vertices, walls=t.walls.unionByName(walls), rooms=t.rooms.unionByName(rooms)), _reject(m.filter("_reason is not null"), F.col("_reason"))


ARGS = (
    "wallId string, openingId string, roomId string, thickness double, dx double, dy double, kind string, offset double, width double,"
    " sill double, head double, swing string, swingSide string, confidence double, name string, number string"
)


def op_rounds(parsed: DataFrame) -> DataFrame:
    """Adds _k, the round of every op (plan, level, seq, op, target): the longest chain of ops that it has to follow.

    Ops on one element follow each other. A wall move changes the geometry of its level, so it follows the moves
    before it and the opening edits since, which measure walls; these follow the move before them. All
    other ops stand alone, and a level's moves are all that can make its rounds many.
    """
    order = ["seq", "op", "target"]
    move, opening = F.col("op") == "move_wall", F.col("op") == "set_opening"
    before = W.partitionBy(*PLAN).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = parsed.withColumn("_epoch", F.when(move | opening, F.coalesce(F.sum(move.cast("int")).over(before), F.lit(0))).otherwise(F.lit(-1)))
    out = settle(out.withColumn("_turn", F.row_number().over(W.partitionBy(*PLAN, "op", "target", "_epoch").orderBy(*order))))
    # What an epoch takes: its opening edits, the longest list on one opening, and the move that ends it.
    epochs = out.filter("_epoch >= 0").groupBy(*PLAN, "_epoch").agg(F.coalesce(F.max(F.when(opening, F.col("_turn"))), F.lit(0)).alias("_depth"))
    past = W.partitionBy(*PLAN).orderBy("_epoch").rowsBetween(W.unboundedPreceding, -1)
    epochs = epochs.withColumn("_start", F.coalesce(F.sum(F.col("_depth") + 1).over(past), F.lit(0)))
    out = attach(out, epochs, [*PLAN, "_epoch"], "left")
    k = F.when(opening, F.col("_start") + F.col("_turn")).when(move, F.col("_start") + F.col("_depth") + 1).otherwise(F.col("_turn"))
    return out.withColumn("_k", k.cast("int")).drop("_epoch", "_turn", "_depth", "_start")


def apply_ops(t: PlanTables, ops: DataFrame) -> tuple[PlanTables, DataFrame]:
    """Typed ops (plan_id, level_id, seq, op, args JSON) in order, all or nothing per plan.

    A round applies all ops that wait for no other one, in all plans at once, so the number of rounds is the
    longest chain of ops that depend on each other. Only plans with ops are rewritten by the rounds.
    """
    parsed = ops.withColumn("_a", F.from_json("args", ARGS)).select(*PLAN, "seq", "op", "_a.*")
    target = F.when(F.col("op") == "set_room_name", F.col("roomId")).when(F.col("op") == "set_opening", F.col("openingId")).otherwise(F.col("wallId"))
    parsed = settle(parsed.withColumn("target", target))
    known = ["set_wall_thickness", "move_wall", "set_opening", "set_room_name"]
    required = F.col("target").isNotNull() & F.when(F.col("op") == "set_wall_thickness", F.col("thickness").isNotNull()).when(F.col("op") == "move_wall", F.col("dx").isNotNull() & F.col("dy").isNotNull()).when(
        F.col("op") == "set_room_name", F.col("name").isNotNull()).otherwise(F.lit(True))
    bad = parsed.filter(~F.coalesce(F.col("op").isin(*known) & required, F.lit(False)))
    rejects = [_reject(bad, F.concat(F.lit("Not an op: "), F.coalesce("op", F.lit("null"))))]
    parsed = settle(op_rounds(parsed.join(bad.select(*PLAN, "seq"), [*PLAN, "seq"], "left_anti")))
    present = parsed.groupBy("_k", "op").count().collect()  # one row per round and op kind
    rounds = sorted({r["_k"] for r in present})
    # Rounds see the plans with ops only; all others pass through untouched.
    touched = settle(parsed.select("plan_id").distinct())
    work = t.map(lambda _name, df: settle(attach(df, touched, ["plan_id"])))
    now = work
    for k in rounds:
        last, mine = now, parsed.filter(F.col("_k") == k)
        for op in [r["op"] for r in present if r["_k"] == k]:
            part = mine.filter(F.col("op") == op)
            if op == "set_wall_thickness":
                now, rej = set_thickness(now, part.select(*PLAN, "seq", "target", F.col("thickness").alias("p_thickness")))
            elif op == "move_wall":
                now, rej = move_walls(now, part.select(*PLAN, "seq", "target", F.col("dx").alias("p_dx"), F.col("dy").alias("p_dy")))
            elif op == "set_room_name":
                now, rej = rename_rooms(now, part.select(*PLAN, "seq", "target", F.col("name").alias("p_name"), F.col("number").alias("p_number")))
            else:
                payload = [F.col(c).alias(f"p_{n}") for c, n in (("kind", "kind"), ("offset", "offset"), ("width", "width"), ("sill", "sill"), ("head", "head"), ("swing", "swing"), ("swingSide", "swing_side"), ("confidence", "confidence"))]
                now, rej = set_openings(now, part.select(*PLAN, "seq", "target", *payload))
            rejects.append(settle(rej))
        # Only what the round changed is written.
        now = now.map(lambda name, df: df if df is getattr(last, name) else settle(df))
    from levelgrid.plans.validate import validate

    refused = settle(reduce(DataFrame.unionByName, rejects))
    # A plan that breaks a rule after its ops is refused like one with a failed op.
    broken = validate(now).select("plan_id", "level_id", F.lit(None).cast("int").alias("seq"), "rule")
    refused = settle(refused.unionByName(broken.select(*PLAN, F.col("seq").cast(dict(refused.dtypes)["seq"]).alias("seq"), F.col("rule").alias("reason")).distinct()))
    accepted = settle(touched.join(refused.select("plan_id").distinct(), "plan_id", "left_anti").withColumn("_accepted", F.lit(True)))

    def choose(name, df):
        old, new = getattr(work, name), getattr(now, name)
        if old is new:
            return df
        rest = attach(df, accepted, ["plan_id"], "left").filter("_accepted is null").select(*df.columns)
        return rest.unionByName(attach(new, accepted, ["plan_id"]).select(*df.columns))

    return t.map(choose), refused
