"""Registered queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Quick ones of every group; the whole set is run by tools/check.py.
NAMES = [
    "extents", "unit_scale", "choose_voxel", "voxel_downsample", "voxel_mean", "manhattan_angle", "height_peaks", "band_area", "assign_levels", "density_raster",
    "top_view", "normalize_colors", "sample_triangles", "thin", "knn", "axis_align", "snap_ends", "node_segments", "cell_adjacency", "points_in_rings", "to_graph",
    "connected_components", "rank_cycles", "project_to_walls", "morph_close", "group_voids", "classify_openings", "classify_boxes", "away_from_walls", "min_rotated_rect",
    "vector_scalars", "point_in_ring", "wall_polygons", "rooms", "read_plans", "check_references", "check_fields", "consolidate_issues", "parallel_neighbors", "resolve_refs",
    "dimension_chains", "sheet_tiles", "move_walls", "split_walls", "apply_labels", "pixel_to_floor", "nearest_palette", "room_iou", "run_lengths", "apply_saves", "stream_voxels",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted("|".join(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
