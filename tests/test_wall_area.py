"""Exact area of unions of walls against closed formulas and a fine grid."""

import math

import numpy as np
import pytest

from levelgrid.operators import metrics as M

SCHEMA = "scan_id string, level_index int, x1 double, y1 double, x2 double, y2 double, thickness double"
ROUND = math.pi * 0.01  # both ends of a wall of 0.2
CASES = {
    "one": ([(0, 0, 4, 0, 0.2)], 0.8 + ROUND),
    "point": ([(1, 1, 1, 1, 0.2)], ROUND),
    "twice and turned": ([(0, 0, 4, 0, 0.2), (4, 0, 0, 0, 0.2), (0, 0, 4, 0, 0.2)], 0.8 + ROUND),
    "in a row": ([(0, 0, 2, 0, 0.2), (2, 0, 4, 0, 0.2)], 0.8 + ROUND),
    "overlapping in a row": ([(0, 0, 3, 0, 0.2), (1, 0, 4, 0, 0.2)], 0.8 + ROUND),
    "corner": ([(0, 0, 4, 0, 0.2), (0, 0, 0, 3, 0.2)], 1.4 + 0.01 * (math.pi / 4 - 1) + ROUND),
    "cross": ([(-2, 0, 2, 0, 0.2), (0, -2, 0, 2, 0.2)], 1.6 - 0.04 + 2 * ROUND),
    "inside": ([(0, 0, 4, 0, 0.4), (1, 0, 3, 0, 0.2)], 1.6 + 4 * ROUND),
    "side by side": ([(0, 0, 4, 0, 0.2), (0, 0.2, 4, 0.2, 0.2)], 1.6 + 2 * ROUND),
    "far off": ([(500000, 900000, 500004, 900000, 0.2)], 0.8 + ROUND),
    "box with a hole": ([(0, 0, 5, 0, 0.2), (5, 0, 5, 4, 0.2), (5, 4, 0, 4, 0.2), (0, 4, 0, 0, 0.2)], 3.6 - 0.04 + ROUND),
}


def rows(name, walls):
    return [(name, 0, *map(float, w)) for w in walls]


@pytest.fixture(scope="module")
def areas(spark):
    df = spark.createDataFrame([r for n, (walls, _) in CASES.items() for r in rows(n, walls)], SCHEMA)
    return {r.scan_id: r.area for r in M.wall_area(df).collect()}


@pytest.mark.parametrize("case", CASES)
def test_closed_formulas(areas, case):
    assert abs(areas[case] - CASES[case][1]) < 1e-7


def test_random_walls_against_a_grid(spark):
    rng = np.random.default_rng(9)
    cases = {f"r{i}": [(*rng.uniform(0, 3, 4), rng.uniform(0.05, 0.8)) for _ in range(12)] for i in range(4)}
    df = spark.createDataFrame([r for n, w in cases.items() for r in rows(n, w)], SCHEMA)
    found = {r.scan_id: r.area for r in M.wall_area(df).collect()}
    step = 0.004
    x, y = np.meshgrid(*[np.arange(-0.6, 3.6, step) + step / 2] * 2)
    for name, walls in cases.items():
        hit = np.zeros(x.shape, bool)
        for x1, y1, x2, y2, t in walls:
            dx, dy = x2 - x1, y2 - y1
            u = np.clip(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0, 1)
            hit |= np.hypot(x - x1 - u * dx, y - y1 - u * dy) <= t / 2
        assert abs(found[name] - hit.sum() * step * step) < 0.01


def test_iou(spark):
    pred = spark.createDataFrame(rows("a", [(0, 0, 4, 0, 0.2)]) + rows("b", [(0, 0, 1, 0, 0.2)]) + rows("c", [(0, 0, 1, 0, 0.0)]) + rows("d", [(0, 0, 2, 0, 0.2)]), SCHEMA)
    truth = spark.createDataFrame(rows("a", [(0, 0, 2, 0, 0.2), (2, 0, 4, 0, 0.2)]) + rows("b", [(0, 9, 1, 9, 0.2)]) + rows("d", [(0, 0, 4, 0, 0.2)]), SCHEMA)
    found = {r.scan_id: r.iou for r in M.wall_iou(pred, truth).collect()}
    assert found == pytest.approx({"a": 1.0, "b": 0.0, "c": 1.0, "d": (0.4 + ROUND) / (0.8 + ROUND)}, abs=1e-7)
    assert M.wall_iou(pred.limit(0), truth.limit(0)).collect() == []


def test_places_where_outlines_meet_are_computed_once(spark):
    df = spark.createDataFrame(rows("cross", CASES["cross"][0]), SCHEMA)
    plan = M.wall_area(df)._jdf.queryExecution().optimizedPlan().toString()
    # Two sides of the other wall, each with two places on an arc.
    assert 0 < plan.count("ASIN(") <= 4
