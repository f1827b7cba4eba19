"""Snapping: the literal cases of the corpus, and alignment in a column of very many vertices."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_golden import boxes

from levelgrid.functions.numbering import nearest
from levelgrid.plans import lookup as L
from levelgrid.session import settle

KEY = "plan_id string, level_id string, "

# Vertices, walls, cursor (x, y, then the point before it and its direction), expected kind, item and place.
ROW = ([("v1", 0, 0), ("v2", 3, 0)], [("w1", "v1", "v2")])
CASES = {
    "alignment after extension": (*ROW, (3.5, 0.03), ("extension", "w1", 3.5, 0)),
    "alignment before angle": (*ROW, (3.04, 1, 3, 0, 1, 0), ("alignment", "v2", 3, 1)),
    "alignment both": ([*ROW[0], ("v3", 0, 2), ("v4", 0, 4)], [*ROW[1], ("w2", "v3", "v4")], (3.03, 2.04), ("alignment", "v2", 3, 2)),
    "alignment": (*ROW, (3.03, 1.5), ("alignment", "v2", 3, 1.5)),
    "angle": ([], [], (2, 0.03, 0, 0, 1, 0), ("angle", None, 2, 0)),
    "endpoint over grid": ([("v1", 0, 0), ("v2", 5, 0), ("v3", 5, 4), ("v4", 0, 4)], [("w1", "v1", "v2"), ("w2", "v2", "v3"), ("w3", "v3", "v4"), ("w4", "v4", "v1")], (0.05, 0.02), ("vertex", "v1", 0, 0)),
    "extension": ([("v1", 0, 0), ("v2", 2, 0)], [("w1", "v1", "v2")], (2.5, 0.02), ("extension", "w1", 2.5, 0)),
}


@pytest.fixture(scope="module")
def snapped(spark):
    """All cases as plans of one set."""
    vertices = [(n, "L1", v, float(x), float(y)) for n, c in CASES.items() for v, x, y in c[0]]
    walls = [(n, "L1", *w, 0.2, "exterior", 1.0) for n, c in CASES.items() for w in c[1]]
    cursors = [(n, "L1", 1, *[float(v) for v in (*c[2], *[0.0] * (6 - len(c[2])))]) for n, c in CASES.items()]
    t = boxes(spark, list(CASES)).with_(
        vertices=settle(spark.createDataFrame(vertices, KEY + "vertex_id string, x double, y double")),
        walls=settle(spark.createDataFrame(walls, KEY + "wall_id string, a string, b string, thickness double, kind string, confidence double")),
    )
    points = spark.createDataFrame(cursors, KEY + "point_id int, x double, y double, px double, py double, dir_x double, dir_y double")
    return {r.plan_id: r for r in L.snap(points, t, 100.0).collect()}


@pytest.mark.parametrize("case", CASES)
def test_corpus(snapped, case):
    kind, item, x, y = CASES[case][3]
    r = snapped[case]
    assert (r.kind, r.item) == (kind, item) and abs(r.x - x) < 1e-9 and abs(r.y - y) < 1e-9


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    sites = [("ab"[rng.integers(2)], f"i{k:03d}", float(rng.integers(0, 60)) / 4) for k in range(300)]
    rows = [("abc"[rng.integers(3)], k, float(rng.integers(-20, 200)) / 8) for k in range(400)]
    found = nearest(spark.createDataFrame(rows, "k string, n long, at double").repartition(4), spark.createDataFrame(sites, "k string, item string, q double"), ["k"], "at", "q", "item", "n")
    want = set()
    for k, n, at in rows:
        own = [(abs(at - q), i, q) for s, i, q in sites if s == k]
        if own:
            gap = min(own)[0]
            want.add((k, n, *min(o for o in own if o[0] == gap)))
    assert {tuple(r) for r in found.select("k", "n", "gap", "item", "value").collect()} == want


def test_many_vertices_in_one_column(spark):
    """20,000 vertices and cursors at one x: time grows in proportion, pairs are never formed."""
    def run(n):
        v = spark.range(n).select(F.lit("p").alias("plan_id"), F.lit("L1").alias("level_id"), F.format_string("v%06d", "id").alias("vertex_id"), F.lit(3.0).alias("x"), (F.col("id") * 10.0).alias("y"))
        q = spark.range(n).select(F.lit("p").alias("plan_id"), F.lit("L1").alias("level_id"), F.col("id").alias("point_id"), F.lit(3.05).alias("x"), (F.col("id") * 10.0 + 5).alias("y"))
        t = boxes(spark, ["p"])
        start = time.time()
        rows = L.snap(settle(q), t.with_(vertices=settle(v), walls=t.walls.limit(0)), 100.0).groupBy("kind", "item", "x").count().collect()
        assert [(r.kind, r.item, r.x, r["count"]) for r in rows] == [("alignment", "v000000", 3.0, n)]
        return time.time() - start

    run(100)
    small, large = run(1000), run(20_000)
    assert large < 6 * small + 5
