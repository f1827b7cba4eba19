"""The 5 m by 4 m box with walls of 0.20 m: literal results of its edits."""

import pytest
from pyspark.sql import functions as F

from levelgrid.operators import openings
from levelgrid.plans import corrections as C
from levelgrid.plans import rooms as R
from levelgrid.plans.documents import PLAN, PlanTables, assemble_plans, blank_plans, explode_plans
from levelgrid.plans.validate import consolidate_issues
from levelgrid.session import settle

CORNERS = [("v1", 0.0, 0.0), ("v2", 5.0, 0.0), ("v3", 5.0, 4.0), ("v4", 0.0, 4.0)]
SIDES = [("w1", "v1", "v2"), ("w2", "v2", "v3"), ("w3", "v3", "v4"), ("w4", "v4", "v1")]


def boxes(spark, names) -> PlanTables:
    """Boxes as element tables; the tables without rows come from a blank document."""
    blank = explode_plans(blank_plans(spark.createDataFrame([], "plan_id string, name string")))
    key = "plan_id string, level_id string, "
    make = lambda rows, schema: settle(spark.createDataFrame([(n, "L1", *r) for n in names for r in rows], key + schema))
    levels = make([(0, "Level 1", 0.0, 2.7, [])], "level_order int, name string, elevation double, ceiling_height double, suppressed array<string>")
    return blank.with_(
        levels=levels,
        vertices=make(CORNERS, "vertex_id string, x double, y double"),
        walls=make([(*s, 0.2, "exterior", 1.0) for s in SIDES], "wall_id string, a string, b string, thickness double, kind string, confidence double"),
        rooms=make([("r1", "Room", "01", (2.5, 2.0))], "room_id string, name string, number string, seed struct<x:double,y:double>"),
    )


def areas(t: PlanTables) -> dict:
    seeds = t.rooms.select(*PLAN, "room_id", "name", "number", F.col("seed.x").alias("x"), F.col("seed.y").alias("y"))
    net, issues = R.rooms(t.vertices, t.walls, seeds)
    assert issues.isEmpty()
    return {r.plan_id: round(r.area, 2) for r in net.collect()}


def ops(spark, rows, schema):
    return spark.createDataFrame([(p, "L1", i, *r) for i, (p, *r) in enumerate(rows)], "plan_id string, level_id string, seq int, " + schema)


def test_thickness_and_clear_distance(spark):
    t = boxes(spark, ["center", "left", "plain"])
    edits = ops(spark, [("center", "w1", 0.3, "center"), ("left", "w1", 0.3, "left")], "target string, p_thickness double, p_keep string")
    done, rejects = C.set_thickness_from_face(t, edits)
    assert rejects.isEmpty()
    assert areas(done) == {"center": 18.0, "left": 18.24, "plain": 18.24}
    done, rejects = C.set_clear_distance(boxes(spark, ["clear"]), ops(spark, [("clear", "w2", "w4", 4.0)], "target string, other string, p_distance double"))
    assert rejects.isEmpty() and areas(done) == {"clear": 15.2}


@pytest.mark.parametrize("location, y", [("left", -0.1), ("center", 0.0), ("right", 0.1)])
def test_wall_by_its_face(spark, location, y):
    drawn = spark.createDataFrame([(0.0, 0.0, 5.0, 0.0, 0.2, location)], "px double, py double, qx double, qy double, thickness double, location string")
    w = C.offset_wall(drawn).first()
    assert (w.x1, w.x2) == (0.0, 5.0) and abs(w.y1 - y) < 1e-9 and abs(w.y2 - y) < 1e-9


def test_many_ops_on_one_plan_leave_the_others_alone(spark):
    t = boxes(spark, ["busy", "idle", "wrong"])
    one = lambda plan, op, args: (plan, op, args)
    rows = [one("busy", "set_wall_thickness", f'{{"wallId": "w1", "thickness": {0.2 + k / 100}}}') for k in (2, 4)]
    rows += [one("busy", "set_room_name", '{"roomId": "r1", "name": "hall"}'), one("wrong", "set_room_name", '{"roomId": "r1", "name": "hall"}')]
    rows += [one("wrong", "set_wall_thickness", '{"wallId": "w1", "thickness": 9.0}')]
    done, refused = C.apply_ops(t, ops(spark, rows, "op string, args string"))
    names = {r.plan_id: r.name for r in done.rooms.collect()}
    assert names == {"busy": "hall", "idle": "Room", "wrong": "Room"}
    thick = {r.plan_id: round(r.thickness, 2) for r in done.walls.filter("wall_id = 'w1'").collect()}
    assert thick == {"busy": 0.24, "idle": 0.2, "wrong": 0.2}
    assert {r.plan_id for r in refused.collect()} == {"wrong"}
    assert done.walls.count() == 12 and done.vertices.count() == 12
    # Tables that no op touches are handed through as they are.
    assert done.columns is t.columns


def test_detection_issues_reach_the_plan(spark):
    faces = spark.createDataFrame(
        [("a", 0, 0.0, 0.0, 5.0, 0.0, False), ("a", 1, 0.0, 0.0, 3.0, 3.0, True), ("b", 0, 0.0, 0.0, 5.0, 0.0, False)],
        "scan_id string, level_index int, x1 double, y1 double, x2 double, y2 double, assumed boolean",
    )
    found = spark.createDataFrame([("a", 1, "o2", True), ("a", 0, "o7", True), ("b", 0, "o1", False)], "scan_id string, level_index int, opening_id string, low_confidence boolean")
    issues = consolidate_issues(openings.structure_issues(faces, found)).withColumn("level_id", F.lit(None).cast("string"))
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "plan_id string, name string")
    plans = assemble_plans(explode_plans(blank_plans(names)), names, issues)
    got = {p.plan_id: {(i.code, i.severity, i.elementId) for i in p.detection.issues} for p in plans.collect()}
    assert got == {"a": {("assumed_thickness", "warning", None), ("non_manhattan", "info", None), ("low_confidence_opening", "warning", "o7")}, "b": set()}
