"""Plan documents: exploded tables, nested assembly, blank plans, revision diffs."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.plans import schemas
from levelgrid.functions.geometry import sq

PLAN = ["plan_id", "level_id"]

# List field, id column, and (document field, column) pairs of every element table.
ELEMENTS = {
    "vertices": ("vertex_id", [("x", "x"), ("y", "y")]),
    "walls": ("wall_id", [("a", "a"), ("b", "b"), ("thickness", "thickness"), ("kind", "kind"), ("confidence", "confidence")]),
    "openings": ("opening_id", [("wall", "wall_id"), ("kind", "kind"), ("offset", "offset"), ("width", "width"), ("sill", "sill"), ("head", "head"), ("swing", "swing"), ("swingSide", "swing_side"), ("confidence", "confidence")]),
    "columns": ("column_id", [("x", "x"), ("y", "y"), ("width", "width"), ("depth", "depth"), ("rotationDeg", "rotation_deg")]),
    "stairs": ("stair_id", [("outline", "outline"), ("direction", "direction"), ("riserCount", "riser_count"), ("fromElevation", "from_elevation"), ("toElevation", "to_elevation")]),
    "rooms": ("room_id", [("name", "name"), ("number", "number"), ("seed", "seed")]),
    "separators": ("separator_id", [("a", "a"), ("b", "b")]),
    "fixtures": ("fixture_id", [("symbol", "symbol"), ("x", "x"), ("y", "y"), ("rotationDeg", "rotation_deg"), ("width", "width"), ("depth", "depth"), ("confidence", "confidence"), ("role", "role")]),
    "texts": ("text_id", [("x", "x"), ("y", "y"), ("text", "text"), ("heightM", "height_m")]),
    "dimensions": ("dimension_id", [("auto", "auto"), ("offset", "offset"), ("segments", "segments")]),
}


@dataclass
class PlanTables:
    """The relational form of a corpus of plans, keyed by plan_id and level_id."""

    levels: DataFrame
    vertices: DataFrame
    walls: DataFrame
    openings: DataFrame
    columns: DataFrame
    stairs: DataFrame
    rooms: DataFrame
    separators: DataFrame
    fixtures: DataFrame
    texts: DataFrame
    dimensions: DataFrame

    def with_(self, **changes) -> "PlanTables":
        return replace(self, **changes)

    def names(self) -> list[str]:
        return [f.name for f in fields(self)]

    def map(self, fn) -> "PlanTables":
        return PlanTables(**{n: fn(n, getattr(self, n)) for n in self.names()})


def explode_plans(plans: DataFrame) -> PlanTables:
    """Element tables of nested documents (plan_id plus the document columns)."""
    level = plans.select("plan_id", F.posexplode("levels").alias("level_order", "l"))
    head = level.select(
        "plan_id", F.col("l.id").alias("level_id"), "level_order", F.col("l.name").alias("name"), F.col("l.elevation").alias("elevation"),
        F.col("l.ceilingHeight").alias("ceiling_height"), F.col("l.suppressedAutoDimensions").alias("suppressed"),
    )
    tables = {}
    for name, (id_col, cols) in ELEMENTS.items():
        e = level.select("plan_id", F.col("l.id").alias("level_id"), F.explode(f"l.{name}").alias("e"))
        tables[name] = e.select(*PLAN, F.col("e.id").alias(id_col), *[F.col(f"e.{f}").alias(c) for f, c in cols])
    return PlanTables(levels=head, **tables)


def nest_levels(tables: PlanTables) -> DataFrame:
    """(plan_id, levels): documents' level lists from element tables, in id order.

    One aggregate per element table over rows of one storey; nothing larger
    than a document is ever collected in one row.
    """
    out = tables.levels
    for name, (id_col, cols) in ELEMENTS.items():
        df = getattr(tables, name)
        # v2 comes before v10.
        key = F.struct(F.regexp_replace(id_col, "[0-9]+$", "").alias("p"), F.coalesce(F.expr(f"try_cast(regexp_extract({id_col}, '([0-9]+)$', 1) as bigint)"), F.lit(-1)).alias("n"), F.col(id_col).alias("i"))
        item = F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f) for f, c in cols])
        listed = df.groupBy(*PLAN).agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), item.alias("v")))), lambda s: s["v"]).alias(name))
        out = out.join(listed, PLAN, "left")
    level = F.struct(
        F.col("level_id").alias("id"), F.col("name"), F.col("elevation"), F.col("ceiling_height").alias("ceilingHeight"),
        *[F.coalesce(F.col(n), F.array().cast(schemas.PLAN["levels"].dataType.elementType[n].dataType)).alias(n) for n in ELEMENTS],
        F.coalesce(F.col("suppressed"), F.array().cast("array<string>")).alias("suppressedAutoDimensions"),
    )
    levels = out.groupBy("plan_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("level_order").alias("o"), F.col("level_id").alias("i"), level.alias("v")))), lambda s: s["v"]).alias("levels")
    )
    return levels


TITLE = ["company", "project", "address", "drawnBy", "date", "sheetTitle", "sheetNumber", "revisionNote"]


def blank_plans(names: DataFrame) -> DataFrame:
    """Blank documents from (plan_id, name): no levels, default sheet."""
    blank = {t: F.lit("") for t in TITLE}
    blank["project"] = F.coalesce("name", F.lit(""))
    types = {f.name: f.dataType for f in schemas.PLAN}
    return names.select(
        "plan_id",
        F.lit(2).alias("schemaVersion"), F.lit("m").alias("units"), F.lit(0).alias("revision"),
        F.struct(F.coalesce("name", F.lit("")).alias("name"), F.lit("").alias("address"), F.lit(0.0).alias("northAngleDeg")).alias("project"),
        F.array().cast(types["levels"]).alias("levels"),
        F.struct(F.lit("A3").alias("paper"), F.lit("landscape").alias("orientation"), F.lit(50).alias("scale"), F.struct(*[v.alias(k) for k, v in blank.items()]).alias("titleBlock")).alias("sheet"),
        F.struct(F.lit(None).cast(types["detection"]["source"].dataType).alias("source"), F.array().cast(types["detection"]["issues"].dataType).alias("issues")).alias("detection"),
    )


def assemble_plans(drafts: PlanTables, names: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Documents from drafted element tables.

    Confidence is clamped, stair directions are made unit, a stair that does
    not rise gets 0.15 m, and a ceiling of 1.5 m or less becomes 2.7 m.
    `issues` has plan_id, id, severity, code, message, level_id, element_id.
    """
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    length = F.sqrt(sq(F.col("direction.x")) + sq(F.col("direction.y")))
    stairs = drafts.stairs.withColumns(
        {
            "direction": F.when(length < 1e-8, F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))).otherwise(
                F.struct((F.col("direction.x") / length).alias("x"), (F.col("direction.y") / length).alias("y"))
            ),
            "to_elevation": F.when(F.col("to_elevation") <= F.col("from_elevation"), F.col("from_elevation") + 0.15).otherwise(F.col("to_elevation")),
            "riser_count": F.greatest(F.lit(1), F.col("riser_count")),
        }
    )
    ceiling = F.when(F.col("ceiling_height") > 1.5, F.col("ceiling_height")).otherwise(F.lit(2.7))
    tables = drafts.with_(
        walls=drafts.walls.withColumn("confidence", clamp("confidence")), stairs=stairs, levels=drafts.levels.withColumn("ceiling_height", ceiling)
    )
    out = blank_plans(names).drop("levels").join(nest_levels(tables), "plan_id", "left")
    out = out.withColumn("levels", F.coalesce("levels", F.array().cast(schemas.PLAN["levels"].dataType)))
    if issues is not None:
        listed = issues.groupBy("plan_id").agg(
            F.array_sort(F.collect_list(F.struct("id", "severity", "code", "message", F.col("level_id").alias("levelId"), F.col("element_id").alias("elementId")))).alias("_i")
        )
        out = out.join(listed, "plan_id", "left")
        out = out.withColumn("detection", F.struct(F.col("detection.source").alias("source"), F.coalesce("_i", F.col("detection.issues")).alias("issues"))).drop("_i")
    return out.select("plan_id", *[f.name for f in schemas.PLAN])


def changed_walls(before: PlanTables, after: PlanTables) -> DataFrame:
    """Walls that are missing, changed, or whose ends moved between two revisions."""
    def side(t: PlanTables, tag: str) -> DataFrame:
        v = lambda e: t.vertices.select(*PLAN, F.col("vertex_id").alias(e), F.struct("x", "y").alias(f"p{e}"))
        w = t.walls.select(*PLAN, "wall_id", "a", "b", "thickness").join(v("a"), [*PLAN, "a"], "left").join(v("b"), [*PLAN, "b"], "left")
        return w.select(*PLAN, "wall_id", *[F.col(c).alias(f"{c}_{tag}") for c in ("a", "b", "thickness", "pa", "pb")])

    shared = after.levels.select(*PLAN)
    m = side(before, "o").join(shared, PLAN, "left_semi").join(side(after, "n"), [*PLAN, "wall_id"], "left")
    moved = lambda e: ~F.coalesce(F.col(f"{e}_o") == F.col(f"{e}_n"), F.lit(False))
    reason = (
        F.when(F.col("a_n").isNull(), "missing")
        .when(F.col("thickness_o") != F.col("thickness_n"), "thickness")
        .when((F.col("a_o") != F.col("a_n")) | (F.col("b_o") != F.col("b_n")), "ends")
        .when(moved("pa") | moved("pb"), "moved")
    )
    return m.withColumn("reason", reason).filter("reason is not null").select(*PLAN, "wall_id", "reason")


def symbol_dim(spark) -> DataFrame:
    """Role, draw size and reply size of every symbol: twelve fixed rows."""
    rows = []
    for s in schemas.SYMBOLS:
        w, d = schemas.DRAW_SIZES.get(s, (0.6, 0.6))
        rw, rd = schemas.REPLY_SIZES[s]
        rows.append((s, "fixture" if s in schemas.FIXTURE_SYMBOLS else "furniture", w, d, rw, rd))
    return spark.createDataFrame(rows, "symbol string, role string, width double, depth double, reply_width double, reply_depth double")
