"""Inputs that used to run into silent limits."""

import pytest
from pyspark.sql import functions as F

from levelgrid.functions.numbering import running
from levelgrid.operators import meshes, metrics, normalize, rasters, surfaces
from levelgrid.plans import catalog, corrections
from levelgrid.sources import tables
from levelgrid.session import workspace


def test_saves_and_conflicts(spark):
    current = spark.createDataFrame([("p", 0), ("q", 5)], "plan_id string, revision int")
    rows = [("p", "a", 1, 0), ("p", "b", 2, 0), ("p", "c", 3, 1), ("p", "d", 4, 2), ("q", "e", 1, 4), ("q", "f", 2, 5), ("x", "g", 1, 0)]
    ok, lost = catalog.apply_saves(current, spark.createDataFrame(rows, "plan_id string, save_id string, ts int, if_match int"))
    assert {(r.save_id, r.revision) for r in ok.collect()} == {("a", 1), ("c", 2), ("d", 3), ("f", 6)}
    assert {(r.save_id, r.current_revision) for r in lost.collect()} == {("b", 1), ("e", 5), ("g", None)}


def test_long_save_chain(spark):
    current = spark.createDataFrame([("p", 0)], "plan_id string, revision int")
    saves = spark.range(1500).select(F.lit("p").alias("plan_id"), F.col("id").alias("save_id"), F.col("id").alias("ts"), F.col("id").alias("if_match"))
    ok, lost = catalog.apply_saves(current, saves)
    assert ok.count() == 1500 and lost.count() == 0


def test_running_over_ranges(spark):
    df = spark.createDataFrame([("k", i, (i * 7) % 11 if i % 3 else None) for i in range(60)], "k string, at int, v int").repartition(6)
    seen = {r["at"]: r for r in running(df, ["k"], "at", "v", "top").join(running(df, ["k"], "at", "v", "low", ahead=True).select("at", "low"), "at").collect()}
    value = lambda i: (i * 7) % 11 if i % 3 else None
    for i in range(60):
        assert seen[i].top == max([value(j) for j in range(i) if value(j) is not None], default=None)
        assert seen[i].low == min([value(j) for j in range(i + 1, 60) if value(j) is not None], default=None)


@pytest.mark.parametrize("at", [0.0, 500_000.0, 5_000_000.0])
def test_planes_far_from_the_origin(spark, at):
    wall = spark.range(4000).select(
        F.lit("s").alias("scan_id"), F.lit(0).alias("level_index"), F.lit(1).alias("plane"), (F.lit(at) + 3.0).alias("x"), (F.lit(at) + (F.col("id") % 80) * 0.05).alias("y"),
        (F.floor(F.col("id") / 80) * 0.05).alias("z"), F.lit(1.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.0).alias("nz"),
    )
    row = surfaces.fit_planes(wall, snap=False).first()
    assert abs(row.nx - 1) < 1e-9 and abs(row.ny) < 1e-6 and abs(row.offset - (at + 3.0)) < 1e-6
    plane = normalize.coarse_planes(wall.drop("level_index", "plane"), min_points=50).first()
    assert abs(abs(plane.nx) - 1) < 1e-6 and abs(plane.cx - (at + 3.0)) < 1e-6


def test_over_four_hundred_planes(spark):
    points = spark.range(450 * 25).select(
        F.lit("s").alias("scan_id"), (F.col("id") % 5 * 0.1).alias("x"), (F.floor(F.col("id") / 5) % 5 * 0.1).alias("y"), (F.floor(F.col("id") / 25) * 0.5).alias("z"),
        F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"),
    )
    assert normalize.coarse_planes(points, min_points=10).count() == 450


def test_outlier_in_height(spark):
    rows = [("s", 0.0)] * 10 + [("s", 1e7)]
    peaks = normalize.height_peaks(spark.createDataFrame(rows, "scan_id string, z double")).collect()
    assert sorted(r.weight for r in peaks) == [1, 10]


def test_wide_raster(spark):
    points = spark.createDataFrame([("s", 0, 0.0, 0.0), ("s", 0, 100.0, 0.0)], "scan_id string, level_index int, x double, y double")
    frames = rasters.raster_frames(points, points.select("scan_id", "level_index").distinct())
    assert rasters.density_raster(points, frames).count() == 2


def test_large_triangle(spark):
    t = [("s", 1, 0.0, 0.0, 0.0, 30.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(t, "scan_id string, face_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    samples = meshes.sample_triangles(df, df.select("scan_id", F.lit(0.05).alias("step")))
    assert samples.agg(F.max("i")).first()[0] >= 600


def test_long_chain_of_matches(spark):
    # Truth row t wants rows t and t + 1, and t + 1 more: decided one after the other.
    pairs = spark.range(12).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("p"))
    won = metrics._greedy(pairs, ["k"], -F.col("p"))
    assert {(r.t, r.p) for r in won.collect()} == {(t, t + 1) for t in range(12)}


def test_two_changes_of_one_target(spark):
    keys = ", ".join(f"{c} string" for c in corrections.PLAN)
    at = ["x"] * len(corrections.PLAN)
    walls = spark.createDataFrame([(*at, "w1", 0.2)], f"{keys}, wall_id string, thickness double")
    ops = spark.createDataFrame([(*at, 2, "w1", 0.4), (*at, 1, "w1", 0.3)], f"{keys}, seq int, target string, p_thickness double")
    out, rejects = corrections.patch(walls, "wall_id", ops, {"thickness": F.col("p_thickness")}, [], "wall")
    assert [r.thickness for r in out.collect()] == [0.3]
    assert [(r.seq, r.reason) for r in rejects.collect()] == [(2, "Another change of wall w1")]


def test_cloud_keeps_ids_and_coordinates(spark):
    points = spark.createDataFrame([("007", 5_000_000.001, 1.0, 2.0, 0.0, 0.0, 1.0), ("7", 3.0, 1.0, 2.0, 0.0, 0.0, 1.0)], "scan_id string, x double, y double, z double, nx double, ny double, nz double")
    ids = points.select("scan_id")
    back = tables.read_cloud(spark, tables.write_cloud(normalize.Normalized(points, ids, ids, ids), f"{workspace(spark)}/clouds"))
    found = {r.scan_id: r.x for r in back["points"].collect()}
    assert set(found) == {"007", "7"} and abs(found["007"] - 5_000_000.001) < 1e-6


def test_plans_round_trip_and_strictness(spark):
    from levelgrid.plans import documents

    plans = documents.blank_plans(spark.createDataFrame([("p1", "one"), ("p2", "two")], "plan_id string, name string"))
    path = f"{workspace(spark)}/plans-{id(plans)}"
    tables.write_plans(plans, path)
    good, bad = tables.read_plan_lines(spark, path)
    assert {(r.plan_id, r.project.name) for r in good.collect()} == {("p1", "one"), ("p2", "two")} and bad.count() == 0
    spoiled = tables.plan_json(plans).withColumn("value", F.replace("value", F.lit('"titleBlock":{'), F.lit('"titleBlock":{"odd":1,')))
    good, bad = tables.parse_plans(spoiled)
    assert good.count() == 0 and {r.reason for r in bad.collect()} == {"unknown field sheet.titleBlock.odd"}
