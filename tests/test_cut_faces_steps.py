"""Faces between walls: pairs of segments are tried where their boxes meet, and probe points are worked out once."""

import random

from levelgrid.functions import arrangement as arr
from levelgrid.functions import tiles
from levelgrid.plans import rooms as R


def test_probes_are_written_before_the_join(spark, monkeypatch):
    met = []
    inside = tiles.points_in_rings
    monkeypatch.setattr(tiles, "points_in_rings", lambda points, *a, **k: met.append(points) or inside(points, *a, **k))
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    hole = [(0.5, 0.5), (3.5, 0.5), (3.5, 2.5), (0.5, 2.5)]
    walls = [("p", "l", f"w{i}", [ring[i], ring[(i + 1) % 4], hole[(i + 1) % 4], hole[i]]) for i in range(4)]
    polygons = spark.createDataFrame(walls, "plan_id string, level_id string, wall_id string, ring array<struct<x: double, y: double>>")
    faces = R.free_faces(polygons).collect()
    assert [round(r.area, 6) for r in faces] == [6.0]
    assert [getattr(p, "_settled", False) for p in met] == [True]


def test_crossings_of_random_segments(spark, monkeypatch):
    rng = random.Random(4)
    at = lambda: rng.choice([round(rng.uniform(0, 6), 1), round(rng.uniform(0, 6), 6)])
    rows = [("k", f"s{i}", at(), at(), at(), at()) for i in range(60)]
    rows += [("k", "h", 0.0, 2.0, 6.0, 2.0), ("k", "v", 3.0, 0.0, 3.0, 2.0), ("k", "n", 0.0, 2.000001, 6.0, 2.000001), ("k", "p", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, seg string, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in arr.crossings(df, ["k"]).collect()}
    tried = arr.crossings(df.crossJoin(spark.range(1)).drop("id"), ["k"], 50.0).collect()
    assert got == {tuple(r) for r in tried} and len(got) > 100
    assert {("k", "h", 3.0, 2.0), ("k", "n", 3.0, 2.0)} <= got
