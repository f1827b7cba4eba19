"""The registered elevation raster tells the cells that two points make solid from those that hold one."""

import duckdb

import __spark_entry__ as entry
from levelgrid.operators import openings as O
from levelgrid.session import workspace

PLAN = ["plan_id", "level_id"]


def test_solid_cells_are_told_apart(spark):
    sf = f"{workspace(spark)}/raster-threshold"
    spark.createDataFrame([(1,), (2,)], "s_suppkey int").write.mode("overwrite").parquet(f"{sf}/supplier.parquet")
    # Points on the south wall of their plan, 2.7 and 3.3 m along it; one place of the second plan holds two.
    lines = [(29, 17, 1, 1), (29, 17, 2, 1), (29, 17, 2, 2), (4, 25, 2, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey int, l_linenumber int").write.mode("overwrite").parquet(f"{sf}/lineitem.parquet")
    got = entry.queries()["elevation_raster"](spark, sf).collect()
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["elevation_raster"]).df()
    cells = lambda rows: sorted((r.plan_id, r.wall_id, int(r.row), int(r.col), int(r.points), bool(r.solid)) for r in rows)
    assert cells(got) == cells(want.itertuples())
    assert {(r.points, r.solid) for r in got} == {(1, False), (2, True)}


def test_operator_keeps_solid_cells(spark):
    rows = [("P", "L", "w", u, 0.5, 0.05, 10, 10) for u in (0.01, 0.01, 0.05)]
    points = spark.createDataFrame(rows, "plan_id string, level_id string, wall_id string, u double, z double, z0 double, cols int, rows int")
    assert [(r.col, r.points) for r in O.elevation_raster(points, PLAN).collect()] == [(0, 2)]
    assert sorted((r.col, r.solid) for r in O.elevation_raster(points, PLAN, every=True).collect()) == [(0, True), (2, False)]
