"""Closing and opening by words of 64 cells against the same cell by cell, and what of it is shuffled."""

import random

import pytest

from levelgrid.functions import words
from levelgrid.operators import openings as O

RAGGED = ((0, 0), (0, 70), (-3, -5), (2, -64), (1, 1))


def brute(cells, rows, cols, offsets):
    """Dilated, then eroded cells of one raster; beyond the border counts as solid."""
    inside = lambda r, c: 0 <= r < rows and 0 <= c < cols
    grown = {(r + dr, c + dc) for r, c in cells for dr, dc in offsets if inside(r + dr, c + dc)}
    near = {(r - dr, c - dc) for r, c in grown for dr, dc in offsets if inside(r - dr, c - dc)}
    return {(r, c) for r, c in near if all((r + dr, c + dc) in grown for dr, dc in offsets if inside(r + dr, c + dc))}


def rasters(spark):
    rng = random.Random(5)
    sizes = {"a": (600, 70), "b": (3, 200), "c": (1, 1), "d": (40, 64)}
    cells = {k: {(rng.randrange(-1, r + 1), rng.randrange(-1, c + 1)) for _ in range(r * c // 2 + 1)} for k, (r, c) in sizes.items()}
    rows = [(k, *at) for k, own in cells.items() for at in own] + [(None, 1, 1), ("a", None, 1), ("a", 1, None), ("z", 0, 0)]
    dims = [(k, *v) for k, v in sizes.items()] + [(None, 5, 5)]
    return sizes, cells, spark.createDataFrame(rows * 2, "k string, row int, col int"), spark.createDataFrame(dims, "k string, rows int, cols int")


@pytest.mark.parametrize("offsets", [O.CROSS, O.SQUARE, RAGGED])
def test_closed_as_cell_by_cell(spark, offsets):
    sizes, cells, df, dims = rasters(spark)
    got = [tuple(r) for r in O.morph_close(df, dims, ["k"], offsets).collect()]
    want = {(k, *at) for k, own in cells.items() for at in brute(own, *sizes[k], offsets)}
    assert len(got) == len(set(got)) and set(got) == want


def empty_of(df, dims):
    solid = df.join(dims.distinct(), "k").filter("row >= 0 and row < rows and col >= 0 and col < cols and (row + col) % 5 > 0")
    return O.empty_cells(O.cell_runs(solid, ["k"]), dims.filter("k is not null"), ["k"])


@pytest.mark.parametrize("offsets", [O.CROSS, O.SQUARE, RAGGED])
def test_opened_as_cell_by_cell(spark, offsets):
    sizes, cells, df, dims = rasters(spark)
    empty = empty_of(df, dims)
    got = [tuple(r) for r in O.morph_open(empty, dims, ["k"], offsets).collect()]
    want = [tuple(r) for r in O._open_cells(empty, dims, ["k"], offsets).collect()]
    assert sorted(got) == sorted(want)


def test_keys_that_come_twice(spark):
    _, _, df, dims = rasters(spark)
    twice = dims.unionByName(dims.filter("k in ('b', 'd')"))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(O.morph_close(df, twice, ["k"])) == rows(O._close_cells(df, twice, ["k"], O.CROSS))
    empty = empty_of(df, twice)
    assert rows(O.morph_open(empty, twice, ["k"])) == rows(O._open_cells(empty, twice, ["k"], O.CROSS))


def test_words_are_shuffled_not_cells(spark):
    _, _, df, dims = rasters(spark)
    plan = O.morph_close(df, dims, ["k"])._jdf.queryExecution().executedPlan().toString()
    # Cells become words before the first shuffle and are laid out after the last one.
    assert plan.index("Generate") < plan.index("Exchange")
    assert all("w#" in line or "_b#" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_runs_of_words(spark):
    df = spark.createDataFrame([("a", 0, 3, 130), ("a", 1, 64, 64), ("a", 2, 0, 63)], "k string, row int, c0 int, c1 int")
    got = {(r.row, r.col) for r in words.to_cells(words.of_runs(df, ["k"]), ["k"]).collect()}
    assert got == {(0, c) for c in range(3, 131)} | {(1, 64)} | {(2, c) for c in range(64)}
