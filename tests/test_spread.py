"""The work of a query is dealt to as many tasks as its rows ask for, however few bytes or files they take."""

import math

import pytest
from pyspark.sql import functions as F

from levelgrid.functions import splits, tiles
from levelgrid.queries import inputs
from levelgrid.session import PARTITION_BYTES, bound_partitions

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.mark.parametrize("table, key", [("supplier", "s_suppkey"), ("part", "p_partkey"), ("customer", "c_custkey")])
def test_small_files_are_dealt_out(spark, tmp_path, table, key):
    rows = 2 * inputs.TASK_ROWS[table] + 1
    spark.range(rows).withColumnRenamed("id", key).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    df = inputs.load(spark, str(tmp_path), table)
    held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 3 and sum(held) == rows and max(held) < rows / 2
    assert df.select(key).distinct().count() == rows


def test_partitions_follow_the_input(spark, tmp_path):
    before = spark.conf.get(INITIAL, None)
    paths = [f"{tmp_path}/{n}" for n in "abc"]
    try:
        for n, path in enumerate(paths[:2]):
            with open(path, "wb") as f:
                f.truncate((10 + n) * PARTITION_BYTES + 1)
        bound_partitions(spark, paths)
        assert int(spark.conf.get(INITIAL)) == 22
        bound_partitions(spark, paths[2:])
        assert spark.conf.get(INITIAL) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        spark.conf.unset(INITIAL) if before is None else spark.conf.set(INITIAL, before)


def test_crowded_cells_are_left_for_the_split_tree(spark, monkeypatch):
    asked, real = [], splits.knn
    monkeypatch.setattr(splits, "knn", lambda *a, **b: asked.append(1) or real(*a, **b))
    at = [(i, (i * 37) % 20 / 10.0, (i * 53) % 21 / 10.0, 0.0) for i in range(300)]
    points = spark.createDataFrame([("a", *p) for p in at], "scan string, id long, x double, y double, z double")
    for radius, crowded in ((0.1, False), (2.0, True)):
        asked.clear()
        got = {(r.id, r["rank"]): r.nid for r in tiles.knn(points, 4, ["scan"], radius).collect()}
        assert bool(asked) == crowded
        for p in at:
            near = sorted((math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2), q[0]) for q in at)[:4]
            assert [got[p[0], k] for k in range(1, 5)] == [q for _, q in near]
