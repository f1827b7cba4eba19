"""Rule violations of plan tables and documents: (plan_id, level_id, element_id, rule)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.plans import schemas
from levelgrid.plans.documents import ELEMENTS, PLAN, PlanTables
from levelgrid.plans.rooms import wall_lines
from levelgrid.functions.geometry import sq


def _row(df: DataFrame, id_col, rule: str) -> DataFrame:
    element = F.col(id_col) if isinstance(id_col, str) else id_col
    return df.select(*PLAN, element.alias("element_id"), F.lit(rule).alias("rule"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def all_ids(t: PlanTables) -> DataFrame:
    return _union([getattr(t, n).select(*PLAN, F.col(i).alias("id")) for n, (i, _c) in ELEMENTS.items()])


def check_unique_ids(t: PlanTables) -> DataFrame:
    """Ids used twice in a storey, whatever the kind, and storey ids used twice in a plan."""
    twice = all_ids(t).groupBy(*PLAN, "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    levels = t.levels.groupBy(*PLAN).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _row(twice, "id", "duplicate_id").unionByName(_row(levels, "level_id", "duplicate_level"))


def check_references(t: PlanTables) -> DataFrame:
    """Walls, separators, openings and dimensions that name what is not there."""
    v = t.vertices.select(*PLAN, F.col("vertex_id").alias("ref")).distinct()
    ends = lambda df, i: df.select(*PLAN, F.col(i).alias("element_id"), F.explode(F.array("a", "b")).alias("ref"))
    missing = lambda df, known: df.join(known, [*PLAN, "ref"], "left_anti").select(*PLAN, "element_id").distinct()
    walls = t.walls.select(*PLAN, F.col("wall_id").alias("ref")).distinct()
    hosts = t.openings.select(*PLAN, F.col("opening_id").alias("element_id"), F.col("wall_id").alias("ref"))
    refs = dimension_refs(t.dimensions)
    openings = t.openings.select(*PLAN, F.col("opening_id").alias("ref")).distinct()
    return _union(
        [
            _row(t.walls.filter(F.col("a") == F.col("b")), "wall_id", "wall_same_vertex"),
            _row(missing(ends(t.walls, "wall_id"), v), "element_id", "wall_missing_vertex"),
            _row(missing(ends(t.separators, "separator_id"), v), "element_id", "separator_missing_vertex"),
            _row(missing(hosts, walls), "element_id", "opening_missing_wall"),
            _row(missing(refs.filter("type = 'vertex'"), v), "element_id", "dimension_missing_vertex"),
            _row(missing(refs.filter("type = 'opening'"), openings), "element_id", "dimension_missing_opening"),
        ]
    )


def dimension_refs(dimensions: DataFrame) -> DataFrame:
    """(plan, dimension, segment, end, type, ref, edge) of every dimension end."""
    s = dimensions.select(*PLAN, F.col("dimension_id").alias("element_id"), F.posexplode("segments").alias("segment", "s"))
    both = F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("s.a").alias("r")), F.struct(F.lit("b").alias("end"), F.col("s.b").alias("r")))).alias("e")
    return s.select(*PLAN, "element_id", "segment", both).select(*PLAN, "element_id", "segment", "e.end", F.col("e.r.type").alias("type"), F.col("e.r.id").alias("ref"), F.col("e.r.edge").alias("edge"))


def check_openings(t: PlanTables) -> DataFrame:
    """Head above sill, head under the ceiling, width under the wall's length."""
    lines = wall_lines(t.vertices, t.walls).select(*PLAN, "wall_id", F.sqrt(sq(F.col("x2") - F.col("x1")) + sq(F.col("y2") - F.col("y1"))).alias("length"))
    o = t.openings.join(t.levels.select(*PLAN, "ceiling_height"), PLAN).join(lines, [*PLAN, "wall_id"])
    rules = F.array_compact(
        F.array(
            F.when(F.col("head") <= F.col("sill"), F.lit("head_below_sill")),
            F.when(F.col("head") > F.col("ceiling_height") + 0.05, F.lit("head_above_ceiling")),
            F.when(F.col("width") >= F.col("length"), F.lit("wider_than_wall")),
        )
    )
    return o.select(*PLAN, F.col("opening_id").alias("element_id"), F.explode(rules).alias("rule"))


def check_stairs(t: PlanTables) -> DataFrame:
    length = F.sqrt(sq(F.col("direction.x")) + sq(F.col("direction.y")))
    rules = F.array_compact(
        F.array(
            F.when(F.abs(length - 1.0) > 1e-6, F.lit("direction_not_unit")),
            F.when(F.col("to_elevation") <= F.col("from_elevation"), F.lit("does_not_rise")),
            F.when(F.size("outline") < 3, F.lit("outline_too_short")),
            F.when(F.col("riser_count") < 1, F.lit("no_risers")),
        )
    )
    return t.stairs.select(*PLAN, F.col("stair_id").alias("element_id"), F.explode(rules).alias("rule"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _rules(name: str) -> dict[str, Column]:
    """Conditions that must hold for the rows of one element table."""
    col = F.col
    known = lambda c, values: col(c).isin(*values)
    share = lambda c: col(c).between(0.0, 1.0)
    plus = lambda c: finite(col(c)) & (col(c) > 0)
    id_col = ELEMENTS[name][0]
    out = {f"{id_col} pattern": col(id_col).rlike(schemas.ID_PATTERN)}
    if name == "vertices":
        out |= {"x finite": finite(col("x")), "y finite": finite(col("y"))}
    elif name == "walls":
        out |= {"thickness range": plus("thickness") & (col("thickness") <= 1.5), "kind known": known("kind", schemas.WALL_KINDS), "confidence range": share("confidence")}
    elif name == "openings":
        out |= {
            "kind known": known("kind", schemas.OPENING_KINDS), "offset range": share("offset"), "width range": plus("width"),
            "sill range": finite(col("sill")) & (col("sill") >= 0), "head finite": finite(col("head")), "swing known": known("swing", schemas.SWINGS),
            "swing_side known": known("swing_side", schemas.SWING_SIDES), "confidence range": share("confidence"),
        }
    elif name == "columns":
        out |= {"x finite": finite(col("x")), "y finite": finite(col("y")), "width range": plus("width"), "depth range": plus("depth"), "rotation finite": finite(col("rotation_deg"))}
    elif name == "fixtures":
        out |= {
            "symbol known": known("symbol", schemas.SYMBOLS), "x finite": finite(col("x")), "y finite": finite(col("y")), "rotation finite": finite(col("rotation_deg")),
            "width range": plus("width"), "depth range": plus("depth"), "confidence range": share("confidence"), "role known": known("role", ["fixture", "furniture"]),
        }
    elif name == "texts":
        out |= {"x finite": finite(col("x")), "y finite": finite(col("y")), "height range": plus("height_m")}
    elif name == "dimensions":
        out |= {"offset finite": finite(col("offset")), "segments present": F.size("segments") >= 1}
    elif name == "rooms":
        out |= {"seed finite": finite(col("seed.x")) & finite(col("seed.y")), "name present": col("name").isNotNull(), "number present": col("number").isNotNull()}
    elif name == "stairs":
        out |= {"elevation finite": finite(col("from_elevation")) & finite(col("to_elevation"))}
    return out


def check_fields(t: PlanTables) -> DataFrame:
    """Finite numbers, ranges, enumerations and id patterns of every element table."""
    parts = []
    for name in ELEMENTS:
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{name}.{rule}")) for rule, ok in _rules(name).items()]))
        parts.append(getattr(t, name).select(*PLAN, F.col(ELEMENTS[name][0]).alias("element_id"), F.explode(broken).alias("rule")))
    low = ~F.coalesce(finite(F.col("ceiling_height")) & (F.col("ceiling_height") > 1.5), F.lit(False))
    parts.append(_row(t.levels.filter(low), "level_id", "levels.ceiling range"))
    parts.append(_row(t.levels.filter(~F.coalesce(finite(F.col("elevation")), F.lit(False))), "level_id", "levels.elevation finite"))
    parts.append(_row(t.levels.filter(~F.coalesce(F.col("level_id").rlike(schemas.ID_PATTERN), F.lit(False))), "level_id", "levels.level_id pattern"))
    return _union(parts)


def check_heads(plans: DataFrame) -> DataFrame:
    """Document-level rules: version, units, revision, sheet and source."""
    ok = {
        "schemaVersion": F.col("schemaVersion") == 2,
        "units": F.col("units") == "m",
        "revision": F.col("revision") >= 0,
        "paper": F.col("sheet.paper").isin(*schemas.PAPERS),
        "orientation": F.col("sheet.orientation").isin(*schemas.ORIENTATIONS),
        "scale": F.col("sheet.scale").isin(*schemas.SCALES),
        "source": F.col("detection.source").isNull()
        | (
            F.col("detection.source.format").isin(*schemas.FORMATS) & F.col("detection.source.upAxis").isin(*schemas.AXES)
            & (F.col("detection.source.unitScaleToMeters") > 0)
        ),
        "issues": F.forall("detection.issues", lambda i: i["code"].isin(*schemas.ISSUE_CODES) & i["severity"].isin(*schemas.SEVERITIES)),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in ok.items()]))
    return plans.select("plan_id", F.lit(None).cast("string").alias("level_id"), F.lit(None).cast("string").alias("element_id"), F.explode(broken).alias("rule"))


def validate(t: PlanTables, plans: DataFrame | None = None) -> DataFrame:
    """All violations of plan tables (and of the document heads where given)."""
    parts = [check_unique_ids(t), check_references(t), check_openings(t), check_stairs(t), check_fields(t)]
    return _union(parts if plans is None else [*parts, check_heads(plans)])


def consolidate_issues(raw: DataFrame) -> DataFrame:
    """One issue per plan and known code, the first to arrive.

    `raw` has plan_id, arrival, code, severity, message, element_id.
    """
    known = raw.filter(F.col("code").isin(*schemas.ISSUE_CODES))
    first = known.groupBy("plan_id", "code").agg(F.min_by(F.struct("severity", "message", "element_id"), "arrival").alias("f"))
    severity = F.when(F.col("f.severity").isin(*schemas.SEVERITIES), F.col("f.severity")).otherwise("warning")
    element = F.when(F.col("f.element_id").rlike("^[A-Za-z]"), F.col("f.element_id"))
    message = F.coalesce(F.when(F.length("f.message") > 0, F.col("f.message")), F.regexp_replace("code", "_", " "))
    return first.select(
        "plan_id", F.concat(F.lit("i"), F.substring(F.regexp_replace("code", "_", ""), 1, 20)).alias("id"), severity.alias("severity"), "code",
        message.alias("message"), element.alias("element_id"),
    )


# Fields of an export record, shapes of URLs and tokens that it may not hold, and its messages.
EXPORT_FIELDS = ["fileId", "versionId", "folderId", "name", "savedAt"]
URL_SHAPE = r"(?i)://|[?&#]|=|\bbearer\b"
TOKEN_SHAPE = r"[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
NOT_A_TIME = "savedAt must be an ISO date and time."
HOLDS_SECRET = "The export record cannot hold a URL or a token ({})."
LACKS_VALUE = "The export record needs a value for {}."


def check_exports(records: DataFrame) -> DataFrame:
    """Export records with `reason`, NULL when the record is fine.

    Five filled fields of at most 300 characters, no URL or token shapes, an
    ISO time.
    """
    reason = F.lit(None).cast("string")
    iso = F.try_to_timestamp(F.col("savedAt")).isNotNull() & F.col("savedAt").rlike(r"^\d{4}-?\d{2}-?\d{2}")
    reason = F.when(~iso, F.lit(NOT_A_TIME))
    for f in reversed(EXPORT_FIELDS):
        c = F.col(f)
        secret = c.rlike(URL_SHAPE) | c.rlike(TOKEN_SHAPE)
        reason = F.when(secret, F.lit(HOLDS_SECRET.format(f))).otherwise(reason)
        empty = c.isNull() | (F.length(F.trim(c)) == 0) | (F.length(c) > 300)
        reason = F.when(empty, F.lit(LACKS_VALUE.format(f))).otherwise(reason)
    return records.withColumn("reason", reason)
