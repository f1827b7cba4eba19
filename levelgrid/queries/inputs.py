"""Operator inputs derived from the given tables, once as SQL text for both engines.

The text keeps to what Spark and DuckDB share; the few differences (generating
a series, rounding half to even) are filled in per dialect.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelgrid.plans.documents import PlanTables

TABLES = ["lineitem", "supplier", "orders", "part", "customer", "events", "documents", "embeddings"]

SPARK = {
    "series": lambda a, b, name: f"explode(sequence(CAST({a} AS BIGINT), CAST({b} AS BIGINT))) AS {name}",
}
DUCK = {
    "series": lambda a, b, name: f"unnest(generate_series(CAST({a} AS BIGINT), CAST({b} AS BIGINT))) AS {name}",
}

# A scan is a supplier class; a third of all rows belong to scan S0. Surface
# classes: floor, ceiling and four walls of an 8 m by 6 m building of two storeys.
_RAW = """
SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'S0' ELSE concat('S', CAST(l_suppkey % 8 AS STRING)) END AS scan_id,
       l_orderkey % 6 AS c,
       (l_partkey * 131 + l_orderkey * 17) % 8001 AS px,
       (l_partkey * 7919 + l_suppkey * 13) % 6001 AS py,
       (l_partkey * 37 + l_linenumber * 411) % 2701 AS ph,
       l_linenumber % 3 AS j,
       (CAST(floor(l_orderkey / 6) AS BIGINT) % 2) * 3000 AS st,
       CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey * 2 AS INT) % 256 AS g, CAST(l_linenumber * 30 AS INT) AS b
FROM {lineitem}
"""

_POINTS_MM = """
SELECT scan_id,
       CAST(CASE c WHEN 3 THEN 8000 + j WHEN 5 THEN 0 - j ELSE px END AS DOUBLE) AS x,
       CAST(CASE c WHEN 2 THEN 0 - j WHEN 4 THEN 6000 + j ELSE py END AS DOUBLE) AS y,
       CAST(CASE c WHEN 0 THEN st + j WHEN 1 THEN st + 2700 + j ELSE st + ph END AS DOUBLE) AS z,
       CAST(CASE c WHEN 3 THEN 1 WHEN 5 THEN -1 ELSE 0 END AS DOUBLE) AS nx,
       CAST(CASE c WHEN 4 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS DOUBLE) AS ny,
       CAST(CASE c WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS DOUBLE) AS nz,
       r, g, b
FROM ({raw}) q
"""


def points_mm(lineitem: str = "lineitem") -> str:
    return _POINTS_MM.format(raw=_RAW.format(lineitem=lineitem))


def points_m(lineitem: str = "lineitem") -> str:
    return f"SELECT scan_id, x / 1000.0 AS x, y / 1000.0 AS y, z / 1000.0 AS z, nx, ny, nz, r, g, b FROM ({points_mm(lineitem)}) mm"


# Rows that one task takes of tables whose rows are few bytes in a file but much work: a supplier is a whole plan
# or image, a part a ring to be cut. Their files are read by one task or a few, however many rows they hold.
TASK_ROWS = {"supplier": 2000, "part": 10_000, "customer": 10_000}


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A given table; the rows of a small file are dealt to as many tasks as they ask for."""
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    tasks = math.ceil(df.count() / TASK_ROWS[table]) if table in TASK_ROWS else 1
    return df.repartition(tasks, df.columns[0]) if tasks > 1 else df


def sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run shared SQL text; table names in braces become the given tables."""
    used = {t: load(spark, sf, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def scan_points_mm(spark, sf) -> DataFrame:
    return sql(spark, sf, points_mm("{lineitem}"))


def scan_points(spark, sf) -> DataFrame:
    return sql(spark, sf, points_m("{lineitem}"))


# Plans: one per supplier, a lattice of nx by ny rooms of 5 m by 4 m.
BASE = """SELECT s_suppkey AS s, 1 + s_suppkey % 3 AS nx, 1 + s_suppkey % 2 AS ny, (100 + 50 * (s_suppkey % 4)) / 1000.0 AS t,
       concat('P', CAST(s_suppkey AS STRING)) AS plan_id, 'L1' AS level_id FROM {supplier}"""


def plan_sql(d: dict, supplier: str = "supplier") -> dict[str, str]:
    """Element tables of the lattice plans as SQL, by name."""
    base = BASE.format(supplier=supplier)
    series = d["series"]
    key = "plan_id, level_id"
    grid_v = f"SELECT {key}, s, nx, ny, t, i, {series('0', 'ny', 'j')} FROM (SELECT {key}, s, nx, ny, t, {series('0', 'nx', 'i')} FROM ({base}) b) c"
    grid_h = f"SELECT {key}, s, nx, ny, t, i, {series('0', 'ny', 'j')} FROM (SELECT {key}, s, nx, ny, t, {series('0', 'nx - 1', 'i')} FROM ({base}) b) c"
    grid_u = f"SELECT {key}, s, nx, ny, t, i, {series('0', 'ny - 1', 'j')} FROM (SELECT {key}, s, nx, ny, t, {series('0', 'nx', 'i')} FROM ({base}) b) c"
    grid_r = f"SELECT {key}, s, nx, ny, t, i, {series('0', 'ny - 1', 'j')} FROM (SELECT {key}, s, nx, ny, t, {series('0', 'nx - 1', 'i')} FROM ({base}) b) c"
    n = lambda e: f"CAST({e} AS STRING)"
    v = lambda i, j: f"concat('v', {n(f'({j}) * (nx + 1) + ({i}) + 1')})"
    out = {"base": base, "grid_v": grid_v, "grid_h": grid_h, "grid_u": grid_u, "grid_r": grid_r}
    out["levels"] = f"SELECT {key}, s, 0 AS level_order, 'Level 1' AS name, CAST(0 AS DOUBLE) AS elevation, CAST(2.7 AS DOUBLE) AS ceiling_height FROM ({base}) b"
    out["vertices"] = f"""SELECT {key}, {v('i', 'j')} AS vertex_id, CAST(5 * i AS DOUBLE) AS x, CAST(4 * j AS DOUBLE) AS y FROM ({grid_v}) g
        UNION ALL SELECT {key}, 'u1', CAST(2.5 AS DOUBLE), CAST(0 AS DOUBLE) FROM ({base}) b WHERE s % 4 = 1
        UNION ALL SELECT {key}, 'u2', CAST(2.5 AS DOUBLE), CAST(4 AS DOUBLE) FROM ({base}) b WHERE s % 4 = 1"""
    out["walls"] = f"""SELECT {key}, concat('w', {n('j * nx + i + 1')}) AS wall_id, {v('i', 'j')} AS a, {v('i + 1', 'j')} AS b, CAST(t AS DOUBLE) AS thickness,
            CASE WHEN j = 0 OR j = ny THEN 'exterior' ELSE 'partition' END AS kind, CAST(1 AS DOUBLE) AS confidence,
            CAST(5 * i AS DOUBLE) AS x1, CAST(4 * j AS DOUBLE) AS y1, CAST(5 * i + 5 AS DOUBLE) AS x2, CAST(4 * j AS DOUBLE) AS y2 FROM ({grid_h}) g
        UNION ALL SELECT {key}, concat('w', {n('nx * (ny + 1) + j * (nx + 1) + i + 1')}), {v('i', 'j')}, {v('i', 'j + 1')}, CAST(t AS DOUBLE),
            CASE WHEN i = 0 OR i = nx THEN 'exterior' ELSE 'partition' END, CAST(1 AS DOUBLE),
            CAST(5 * i AS DOUBLE), CAST(4 * j AS DOUBLE), CAST(5 * i AS DOUBLE), CAST(4 * j + 4 AS DOUBLE) FROM ({grid_u}) g"""
    out["openings"] = f"""SELECT {key}, concat('o', {n('i + 1')}) AS opening_id, concat('w', {n('i + 1')}) AS wall_id, 'door' AS kind, CAST(0.5 AS DOUBLE) AS "offset",
            CAST(0.9 AS DOUBLE) AS width, CAST(0 AS DOUBLE) AS sill, CAST(2.1 AS DOUBLE) AS head, 'left' AS swing, 'positive' AS swing_side, CAST(1 AS DOUBLE) AS confidence
            FROM ({grid_h}) g WHERE j = 0
        UNION ALL SELECT {key}, concat('o', {n('nx + i + 1')}), concat('w', {n('ny * nx + i + 1')}), 'window', CAST(0.25 AS DOUBLE),
            CAST(1.2 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(2.1 AS DOUBLE), 'none', 'positive', CAST(1 AS DOUBLE) FROM ({grid_h}) g WHERE j = ny"""
    out["rooms"] = f"SELECT {key}, concat('r', {n('j * nx + i + 1')}) AS room_id, concat('Room ', {n('i + 1')}) AS name, {n('j * nx + i + 1')} AS number, CAST(5 * i + 2.5 AS DOUBLE) AS sx, CAST(4 * j + 2 AS DOUBLE) AS sy FROM ({grid_r}) g"
    out["columns"] = f"SELECT {key}, 'c1' AS column_id, CAST(1 AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS y, CAST(0.4 AS DOUBLE) AS width, CAST(0.4 AS DOUBLE) AS depth, CAST(0 AS DOUBLE) AS rotation_deg FROM ({base}) b WHERE s % 2 = 0"
    out["separators"] = f"SELECT {key}, 'p1' AS separator_id, 'u1' AS a, 'u2' AS b FROM ({base}) b WHERE s % 4 = 1"
    out["fixtures"] = f"""SELECT {key}, 'f1' AS fixture_id, 'toilet' AS symbol, CAST(1 AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS rotation_deg,
            CAST(0.4 AS DOUBLE) AS width, CAST(0.7 AS DOUBLE) AS depth, CAST(0.8 AS DOUBLE) AS confidence, 'fixture' AS role FROM ({base}) b
        UNION ALL SELECT {key}, 'f2', 'sofa', CAST(2.5 AS DOUBLE), CAST(3 AS DOUBLE), CAST(90 AS DOUBLE), CAST(2 AS DOUBLE), CAST(0.9 AS DOUBLE), CAST(0.8 AS DOUBLE), 'furniture' FROM ({base}) b
        UNION ALL SELECT {key}, 'f3', 'block', CAST(0 - s % 3 AS DOUBLE), CAST(2 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.3 AS DOUBLE), 'furniture' FROM ({base}) b WHERE s % 5 = 0"""
    out["texts"] = f"SELECT {key}, 't1' AS text_id, CAST(2.5 AS DOUBLE) AS x, CAST(2 AS DOUBLE) AS y, concat('note ', plan_id) AS text, CAST(0.2 AS DOUBLE) AS height_m FROM ({base}) b"
    return out


def plan_tables(spark: SparkSession, sf: str) -> PlanTables:
    text = plan_sql(SPARK, "{supplier}")
    get = lambda name: sql(spark, sf, text[name].replace('"offset"', "`offset`"))
    key = ["plan_id", "level_id"]
    base = get("base")
    ref = lambda i: F.struct(F.lit("vertex").alias("type"), F.lit(i).alias("id"), F.lit(None).cast("string").alias("edge"))
    at = lambda i, e: F.struct(F.lit("opening").alias("type"), F.lit(i).alias("id"), F.lit(e).alias("edge"))
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    none = F.array().cast("array<string>")
    levels = get("levels").withColumn("suppressed", F.when(F.col("s") % 7 == 0, F.array(F.lit("exterior-south-overall"))).otherwise(none)).drop("s")
    rooms = get("rooms").select(*key, "room_id", "name", "number", F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")).alias("seed"))
    stairs = base.filter("s % 3 = 0").select(
        *key, F.lit("s1").alias("stair_id"), F.array(p(1, 0.5), p(2, 0.5), p(2, 3.3), p(1, 3.3)).alias("outline"), p(0, 1).alias("direction"),
        F.lit(12).alias("riser_count"), F.lit(0.0).alias("from_elevation"), F.lit(2.2).alias("to_elevation"),
    )
    dimensions = base.select(
        *key, F.lit("d1").alias("dimension_id"), F.lit(False).alias("auto"), F.lit(0.5).alias("offset"),
        F.array(F.struct(ref("v1").alias("a"), at("o1", "start").alias("b")), F.struct(at("o1", "start").alias("a"), at("o1", "end").alias("b"))).alias("segments"),
    )
    plain = {n: get(n) for n in ("vertices", "openings", "columns", "separators", "fixtures", "texts")}
    walls = get("walls").drop("x1", "y1", "x2", "y2")
    return PlanTables(levels=levels, walls=walls, rooms=rooms, stairs=stairs, dimensions=dimensions, **plain)


def wall_segments(spark: SparkSession, sf: str) -> DataFrame:
    return sql(spark, sf, plan_sql(SPARK, "{supplier}")["walls"])


def seeds(t: PlanTables) -> DataFrame:
    return t.rooms.select("plan_id", "level_id", "room_id", "name", "number", F.col("seed.x").alias("x"), F.col("seed.y").alias("y"))
