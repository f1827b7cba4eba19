"""Readers and writers of scans, plans, manifests, projects and point blobs."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelgrid.operators.meshes import sample_triangles
from levelgrid.plans import schemas
from levelgrid.session import attach, settle


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Scan points with the fixed schema. Missing optional columns are NULL."""
    return spark.read.schema(schemas.POINTS).parquet(path)


def read_triangles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRIANGLES).parquet(path)


def scene_points(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Points of every scene: samples with face normals where it has faces (colours are
    dropped there), else its own points."""
    meshed = triangles.select("scan_id").distinct()
    marked = attach(points, meshed.withColumn("_meshed", F.lit(True)), ["scan_id"], "left")
    own = marked.filter("_meshed is null")
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    sampled = sample_triangles(triangles).select("scan_id", "x", "y", "z", "nx", "ny", "nz", *[null(c, "smallint") for c in "rgb"])
    return own.select("scan_id", "x", "y", "z", "nx", "ny", "nz", "r", "g", "b").unionByName(sampled)


CLOUD_SQL = "x float, y float, z float, nx float, ny float, nz float, r smallint, g smallint, b smallint, scan_id string"


def write_cloud(cloud, path: str) -> str:
    """Write a normalized cloud as a new batch folder and return it.

    Points are stored as float offsets from a whole-metre origin of their scan
    (table `origin`), so map coordinates lose nothing, partitioned by scan;
    frame, levels and issues are sibling tables. A batch is complete when its
    `ready` table is there: it is written last, so a reader never sees half a
    batch.
    """
    batch = f"{path}/batch-{uuid.uuid4().hex}"
    points = cloud.points
    origin = settle(points.groupBy("scan_id").agg(*[F.floor(F.min(c)).cast("double").alias(f"o{c}") for c in "xyz"], F.count(F.lit(1)).alias("points")))
    p = attach(points, origin.drop("points"), ["scan_id"])
    place = [(F.col(c) - F.col(f"o{c}")).cast("float").alias(c) for c in "xyz"]
    colours = [F.col(c).cast("smallint").alias(c) for c in ("r", "g", "b") if c in points.columns]
    p = p.select("scan_id", *place, *[F.col(c).cast("float").alias(c) for c in ("nx", "ny", "nz")], *colours)
    # Ranges of (scan, x): a large scan spans many files, a small one has one, whatever the tasks before.
    p.repartitionByRange("scan_id", "x").write.partitionBy("scan_id").parquet(f"{batch}/points")
    origin.drop("points").write.parquet(f"{batch}/origin")
    for name in ("frame", "levels", "issues"):
        getattr(cloud, name).write.parquet(f"{batch}/{name}")
    origin.select("scan_id", "points").write.parquet(f"{batch}/ready")
    return batch


def read_cloud(spark: SparkSession, batch: str) -> dict[str, DataFrame]:
    """Tables of a complete batch, points as double in their own coordinates, scan ids as they were written."""
    ready = spark.read.parquet(f"{batch}/ready")
    pts = attach(spark.read.schema(CLOUD_SQL).parquet(f"{batch}/points"), spark.read.parquet(f"{batch}/origin"), ["scan_id"])
    pts = pts.withColumns({c: F.col(c).cast("double") + F.col(f"o{c}") for c in "xyz"} | {c: F.col(c).cast("double") for c in ("nx", "ny", "nz")})
    pts = pts.drop("ox", "oy", "oz")
    return {"points": pts, "ready": ready, **{n: spark.read.parquet(f"{batch}/{n}") for n in ("frame", "levels", "issues")}}


def _unknown(text: Column, kind: T.StructType, path: str = "") -> Column:
    """Paths of the keys of a JSON object that its type lacks, at every depth."""
    known = [f.name for f in kind if f.name != "_bad"]
    own = F.array_except(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))
    found = [F.transform(own, lambda k: F.concat(F.lit(path), k))]
    for f in kind:
        inner = F.get_json_object(text, f"$.{f.name}")
        if isinstance(f.dataType, T.StructType):
            found.append(_unknown(inner, f.dataType, f"{path}{f.name}."))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            each = F.coalesce(F.from_json(inner, "array<string>"), F.array().cast("array<string>"))
            found.append(F.flatten(F.transform(each, _within(f.dataType.elementType, f"{path}{f.name}."))))
    return F.concat(*found)


def _within(kind: T.StructType, path: str):
    return lambda element: _unknown(element, kind, path)


def parse_plans(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans, rejects) of JSON documents (plan_id, value): strict about unknown fields at every depth.

    A document is rejected when it is no JSON, when a field has the wrong
    type, when its version is not 2, or when it holds a field the schema lacks.
    """
    schema = schemas.with_corrupt("PLAN")
    p = text.withColumn("_p", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    p = p.withColumn("_extra", _unknown(F.col("value"), schemas.PLAN))
    reason = (
        F.when(F.col("_p").isNull() | F.col("_p._bad").isNotNull() | F.json_object_keys("value").isNull(), F.lit("not a plan document"))
        .when(F.size("_extra") > 0, F.concat(F.lit("unknown field "), F.get("_extra", F.lit(0))))
        .when(~F.coalesce(F.col("_p.schemaVersion") == 2, F.lit(False)), F.lit("schemaVersion is not 2"))
        .when(~F.coalesce(F.col("_p.units") == "m", F.lit(False)), F.lit("units is not m"))
    )
    p = p.withColumn("reason", reason)
    good = p.filter("reason is null").select("plan_id", *[F.col(f"_p.{f.name}").alias(f.name) for f in schemas.PLAN if f.name != "_bad"])
    return good, p.filter("reason is not null").select("plan_id", "reason")


def read_plans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(plans, rejects) of a folder with one JSON document per file; plan_id is the file name."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("plan_id"), "value")
    return parse_plans(files)


def plan_json(plans: DataFrame) -> DataFrame:
    """(plan_id, value): documents in a fixed field order."""
    return plans.select("plan_id", F.to_json(F.struct(*[f.name for f in schemas.PLAN]), {"ignoreNullFields": "false"}).alias("value"))


def write_plans(plans: DataFrame, path: str) -> None:
    """JSON lines of (plan_id, value), many documents to a file."""
    plan_json(plans).write.json(path)


def read_plan_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(plans, rejects) of a folder that `write_plans` wrote."""
    return parse_plans(spark.read.schema("plan_id string, value string").json(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def resolve_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with `status`: present, missing (skipped), or set_skipped when none is there.

    `files` has column file (names that exist).
    """
    m = manifest.join(files.select("file").distinct().withColumn("_here", F.lit(1)), "file", "left")
    if m.filter("_here = 1").isEmpty():
        return m.withColumn("status", F.lit("set_skipped")).drop("_here")
    return m.withColumn("status", F.when(F.col("_here").isNull(), "missing").otherwise("present")).drop("_here")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) names under a folder, without reading their content."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project metadata; malformed entries are skipped."""
    schema = schemas.with_corrupt("PROJECT")
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return well_formed(df)


def well_formed(df: DataFrame) -> DataFrame:
    """Rows that parsed and have an id of 32 hex digits and a name."""
    ok = F.col("_bad").isNull() & F.col("id").rlike("^[0-9a-f]{32}$") & F.col("name").isNotNull()
    return df.filter(ok).drop("_bad")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, op, input, expect): the case corpus with its payloads as JSON text."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(*[F.get_json_object("value", f"$.{k}").alias(k) for k in ("name", "op", "input", "expect")]).filter("op is not null")


PTS_SCHEMA = "file string, point_id bigint, x float, y float, z float, r smallint, g smallint, b smallint"


def decode_pts(blobs: DataFrame, magic: bytes) -> DataFrame:
    """Points of binary previews (path, content).

    Layout: 8 magic bytes, count and flags as little-endian u32, then x, y, z
    as f32 per point, then, when flag 1 is set, r, g, b as u8 per point. Blobs
    with another magic or a short body give no rows. Decoding is by Arrow batch; one file is bounded
    by the preview's cap of 500 000 points.
    """
    import numpy as np
    import pandas as pd

    def batches(it):
        for pdf in it:
            for name, body in zip(pdf["path"], pdf["content"]):
                body = bytes(body)
                if len(body) < 16 or body[:8] != magic:
                    continue
                count, flags = struct.unpack_from("<II", body, 8)
                if len(body) < 16 + count * (15 if flags & 1 else 12):
                    continue
                xyz = np.frombuffer(body, "<f4", count * 3, 16).reshape(count, 3)
                rgb = np.frombuffer(body, "u1", count * 3, 16 + count * 12).reshape(count, 3).astype("int16") if flags & 1 else None
                out = pd.DataFrame({"file": name, "point_id": np.arange(count), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
                for i, c in enumerate("rgb"):
                    out[c] = pd.array(rgb[:, i], dtype="Int16") if rgb is not None else pd.array([None] * count, dtype="Int16")
                yield out

    return blobs.select("path", "content").mapInPandas(batches, PTS_SCHEMA)


def read_pts_blobs(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    return decode_pts(spark.read.format("binaryFile").load(path), magic)

