"""The split tree and its neighbours: exact against brute force, leaves that follow density, defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelgrid.functions import splits, tiles
from levelgrid.session import settle

SCHEMA = "scan string, id long, x double, y double, z double"


def cloud(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "corner":
        # Nine tenths of the points in a thousandth of the side.
        wide, dense = rng.uniform(0, 100, (n // 10, 3)), rng.uniform(0, 0.1, (n - n // 10, 3))
        return np.concatenate([wide, dense])
    if kind == "grid":
        side = round(n ** (1 / 3))
        return np.stack(np.meshgrid(*[np.arange(side)] * 3), -1).reshape(-1, 3).astype(float)
    if kind == "line":
        return np.stack([rng.exponential(5, n), np.zeros(n), np.zeros(n)], 1)
    if kind == "same":
        return np.concatenate([np.full((n // 2, 3), 7.0), rng.uniform(0, 9, (n - n // 2, 3))])
    return rng.uniform(0, 1, (n, 3)) * 1e6


def brute(points, k):
    out = set()
    for i, p in enumerate(points):
        gap = np.sqrt(sum((p[c] - points[:, c]) ** 2 for c in range(3)))
        for rank, j in enumerate(np.lexsort((np.arange(len(points)), gap))[:k], 1):
            out.add((i, int(j), rank))
    return out


@pytest.mark.parametrize("kind, n, k", [("corner", 1500, 8), ("grid", 1000, 7), ("line", 700, 5), ("same", 600, 6), ("even", 900, 40), ("even", 30, 50)])
def test_neighbours_are_exact(spark, kind, n, k):
    points = cloud(kind, n)
    rows = [("s", i, *map(float, p)) for i, p in enumerate(points)] + [("t", 0, 1.0, 2.0, 3.0)]
    found = splits.knn(spark.createDataFrame(rows, SCHEMA).repartition(5), k, ["scan"], leaf=16).collect()
    assert {(r.id, r.nid, r.rank) for r in found if r.scan == "s"} == brute(points, k)
    assert [(r.id, r.nid, r.rank, r.gap) for r in found if r.scan == "t"] == [(0, 0, 1, 0.0)]
    assert all(tuple(points[r.nid]) == (r.nx, r.ny, r.nz) for r in found if r.scan == "s")


def test_leaves_follow_density(spark):
    """A scan with one dense corner: no leaf is larger than the bound, and few are small."""
    points = cloud("corner", 60_000)
    df = settle(spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(points)], SCHEMA))
    tree = splits.build(df, ["scan"], ["x", "y", "z"], 64)
    sizes = np.array([r["count"] for r in tree.points.groupBy("_node").count().collect()])
    assert sizes.sum() == len(points) and sizes.max() <= 64 and sizes.max() < 3 * np.median(sizes)
    # Rows of leaves dealt to tasks: the largest task stays near the median.
    tasks = tree.points.repartition(16, "_node").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert tasks.max() < 3 * tasks.median()
    # Cells of a fixed size put the corner into one.
    cells = df.groupBy(*[F.floor(F.col(c) / 0.5) for c in "xyz"]).count().agg(F.max("count")).first()[0]
    assert cells > 50_000


def test_agrees_with_fixed_cells(spark):
    rows = [("s", i, *map(float, p)) for i, p in enumerate(cloud("even", 500) / 1e6)]
    df = settle(spark.createDataFrame(rows, SCHEMA))
    a, b = splits.knn(df, 6, ["scan"]), tiles.knn(df, 6, ["scan"], 0.2)
    names = ["scan", "id", "nid", "rank", "gap", "nx", "ny", "nz"]
    assert sorted(a.select(*names).collect()) == sorted(b.select(*names).collect())


def test_cases(spark):
    assert splits.knn(spark.createDataFrame([], SCHEMA), 3, ["scan"]).collect() == []
    with pytest.raises(Exception, match="finite"):
        splits.knn(spark.createDataFrame([("s", 1, 1.0, float("nan"), 0.0)], SCHEMA), 3, ["scan"]).collect()
