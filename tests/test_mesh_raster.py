"""Rasters of meshes: overlapping triangles give each cell once, and runs, not cells, are shuffled."""

from levelgrid.operators import openings as O

PLAN = ["plan_id", "level_id"]
TRI = "plan_id string, level_id string, " + ", ".join(f"{c}{n} double" for c in "abc" for n in "xyz")


def inputs(spark):
    walls = spark.createDataFrame([("P", "L", "w1", 0.0, 0.0, 5.0, 0.0, 0.2)], "plan_id string, level_id string, wall_id string, x1 double, y1 double, x2 double, y2 double, thickness double")
    levels = spark.createDataFrame([("P", "L", 0.0, 2.7)], "plan_id string, level_id string, elevation double, ceiling_height double")
    tri = lambda *p: ("P", "L", *[v for u, z in p for v in (u, 0.0, z)])
    # Overlapping, one inside another, apart in the same rows, and one given twice.
    rows = [tri((1, 1), (2, 1), (2, 2)), tri((1.5, 1), (2.5, 1), (2.5, 2)), tri((1.8, 1.1), (1.9, 1.1), (1.9, 1.2)), tri((3, 1), (4, 1), (4, 2)), tri((3, 1), (4, 1), (4, 2))]
    rows = [tuple(float(v) if not isinstance(v, str) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, TRI), O.wall_frames(walls, levels, PLAN)


def test_cells_of_overlapping_triangles_come_once(spark):
    triangles, frames = inputs(spark)
    runs = O.elevation_runs_mesh(triangles, frames, PLAN).collect()
    want = {(r["row"], c) for r in runs for c in range(r["c0"], r["c1"] + 1)}
    got = [(r["row"], r["col"]) for r in O.elevation_raster_mesh(triangles, frames, PLAN).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(got) < sum(r["c1"] - r["c0"] + 1 for r in runs)


def test_cells_are_laid_out_after_the_shuffle(spark):
    triangles, frames = inputs(spark)
    plan = O.elevation_raster_mesh(triangles, frames, PLAN)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence(c0") < plan.index("Exchange")
