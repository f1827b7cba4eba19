"""The synthetic two-storey building, end to end: a tilted mesh with known truth."""

import building as B
import pytest
from pyspark.sql import functions as F

from levelgrid.operators import fixtures, meshes, metrics, normalize, openings, surfaces, wallgraph
from levelgrid.plans import rooms
from levelgrid.session import attach, settle

LEVEL = ["scan_id", "level_index"]


@pytest.fixture(scope="module")
def found(spark):
    triangles = settle(spark.createDataFrame(B.triangles("t", tilt=3.0), B.SCHEMA))
    n = normalize.normalize(settle(meshes.sample_triangles(triangles)), triangles)
    points = settle(normalize.assign_levels(n.points, n.levels))
    faces = settle(surfaces.detect_faces(points))
    draft = wallgraph.draft_levels(faces, points, n.levels)
    mesh = settle(attach(n.triangles, n.levels, ["scan_id"]))
    vertices, walls, opens, columns, stairs = openings.attach_structure(draft, points, faces, mesh)
    fixed = settle(fixtures.detect_fixtures(points, draft.levels, walls, columns, stairs))
    return dict(n=n, faces=faces, draft=draft, vertices=vertices, walls=walls, openings=opens, columns=columns, stairs=stairs, fixtures=fixed)


def test_gravity_and_storeys(found):
    f = found["n"].frame.first()
    # A tilt of 3 degrees about x: the found up is within a tenth of a degree of it.
    assert abs(f.uz - 0.99863) < 1e-3 and abs(abs(f.uy) - 0.05234) < 1e-3
    levels = found["n"].levels.orderBy("elevation").collect()
    assert [round(v.elevation, 1) for v in levels] == [0.0, 3.0]
    assert all(abs(v.ceiling_height - 2.7) < 0.05 for v in levels)


def test_walls(spark, found):
    truth = spark.createDataFrame([("t", i, f"t{k}", *[float(v) for v in w]) for i in (0, 1) for k, w in enumerate(B.WALLS)], "scan_id string, level_index int, truth_id string, x1 double, y1 double, x2 double, y2 double, thickness double")
    walls = settle(found["walls"])
    assert walls.groupBy(*LEVEL).count().orderBy("level_index").collect()[0]["count"] == 5
    mae = metrics.thickness_mae(walls.withColumn("pred_id", F.col("wall_id")), truth).collect()
    assert all(m.mae <= 0.02 and m.walls == 5 for m in mae)
    iou = metrics.wall_iou(walls, truth).collect()
    assert all(v.iou >= 0.90 for v in iou)


def test_rooms(spark, found):
    d = found["draft"]
    net, issues = rooms.rooms(found["vertices"], found["walls"], d.rooms, keys=LEVEL)
    got = net.collect()
    assert len(got) == 4 and all(abs(v.area - 21.85) < 0.05 for v in got)
    assert issues.isEmpty() and d.issues.isEmpty()


def test_openings_columns_stairs(found):
    o = sorted((v.level_index, v.kind, round(v.width, 1)) for v in found["openings"].collect())
    assert o == [(0, "door", 0.9), (0, "window", 1.2), (1, "window", 1.2)]
    c = found["columns"].collect()
    assert len(c) == 1 and abs(c[0].x - 2) < 0.05 and abs(c[0].y - 2) < 0.05 and abs(c[0].width - 0.4) < 0.1
    s = [v for v in found["stairs"].collect() if v.level_index == 0][0]
    xs, ys = [p.x for p in s.outline], [p.y for p in s.outline]
    assert abs(min(xs) - 5.2) < 0.05 and abs(max(ys) - 3.2) < 0.05 and s.dir_y > 0.99 and s.riser_count == 12


def test_fixtures(found):
    f = {v.symbol: v for v in found["fixtures"].collect()}
    assert abs(f["toilet"].x - 1.0) <= 0.25 and abs(f["toilet"].y - 1.0) <= 0.25
    assert abs(f["sink"].x - 1.2) <= 0.25 and abs(f["sink"].y - 5.0) <= 0.25


def test_storey_without_ceiling(spark):
    rows = [("s", 0.7)] * 100 + [("s", 1.0)] * 5000 + [("s", 1.4)] * 100
    pts = spark.createDataFrame([(s, float(i % 70) * 0.1, float(i // 70) * 0.1, z, 0.0, 0.0, 1.0) for i, (s, z) in enumerate(rows)], "scan_id string, x double, y double, z double, nx double, ny double, nz double")
    levels, hints = normalize.find_storeys(pts)
    got = levels.collect()
    assert len(got) == 1 and abs(got[0].elevation - 1.0) < 0.06 and got[0].ceiling_height == 2.7
    assert "ceiling_missing" in [h.code for h in hints.collect()]


def test_empty_scan(spark):
    none = spark.createDataFrame([], "scan_id string, x double, y double, z double, nx double, ny double, nz double")
    n = normalize.normalize(none)
    assert n.points.isEmpty() and n.levels.isEmpty() and n.issues.isEmpty()
