"""Tile buckets: spatial joins as equi-joins on (keys, tile) plus an exact test."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from levelgrid.functions import geometry as g
from levelgrid.functions import splits
from levelgrid.functions.graph import connected_components
from levelgrid.session import BROADCAST_BYTES, attach, settle
from levelgrid.functions.geometry import sq

TILE = ["_tx", "_ty"]
# Width in radii of the blocks that are linked up in one task, and the pairs looked at there at a time.
BLOCK = 32
PAIRS = 1 << 20
# Rows in a cell beyond which cells of one size are left for a split tree.
CROWD = 256


def cell(column, size) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / size)


def tile_points(df: DataFrame, x, y, size: float) -> DataFrame:
    """One tile per point."""
    return df.withColumns({"_tx": cell(x, size), "_ty": cell(y, size)})


def tile_box(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> DataFrame:
    """One row per tile touched by a box."""
    wide = df.withColumn("_tx", F.explode(F.sequence(F.floor(x0 / size), F.floor(x1 / size))))
    return wide.withColumn("_ty", F.explode(F.sequence(F.floor(y0 / size), F.floor(y1 / size))))


def tile_segment(df: DataFrame, a: g.P, b: g.P, pad, size: float) -> DataFrame:
    """One row per tile within `pad` of a segment.

    Walks the tile columns and, in each, the stretch of y the padded segment
    covers there, so a long diagonal costs its length and not its box.
    """
    pad = g.num(pad)
    x0, x1 = F.least(a.x, b.x), F.greatest(a.x, b.x)
    out = df.withColumn(
        "_tx", F.explode(F.sequence(F.floor((x0 - pad) / size), F.floor((x1 + pad) / size)))
    )
    slope = (b.y - a.y) / F.nullif(b.x - a.x, F.lit(0.0))
    lo = F.greatest(x0, F.col("_tx") * size - pad)
    hi = F.least(x1, (F.col("_tx") + 1) * size + pad)
    ya = F.coalesce(a.y + slope * (lo - a.x), a.y)
    yb = F.coalesce(a.y + slope * (hi - a.x), b.y)
    low = F.greatest(F.least(ya, yb), F.least(a.y, b.y)) - pad
    high = F.least(F.greatest(ya, yb), F.greatest(a.y, b.y)) + pad
    # Rounding may put the padded column just past the end of the segment.
    low, high = F.least(low, high), F.greatest(low, high)
    return out.withColumn("_ty", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))


def points_in_rings(points: DataFrame, rings: DataFrame, keys: list[str], x="x", y="y", ring="ring", size=2.0) -> DataFrame:
    """Pairs of points and the rings that hold them (inner join).

    A point has one tile, so a pair is found once and needs no deduplication.
    """
    box = g.ring_bounds(F.col(ring))
    tiled = tile_box(rings, box["min_x"], box["min_y"], box["max_x"], box["max_y"], size)
    joined = tile_points(points, x, y, size).join(tiled, [*keys, *TILE])
    return joined.filter(g.point_in_ring(g.xy(x, y), F.col(ring))).drop(*TILE)


def near_segments(
    points: DataFrame, segments: DataFrame, keys: list[str], reach, condition: Column, how="inner", size=1.0,
    x="x", y="y",
) -> DataFrame:
    """Points joined to segments (x1, y1, x2, y2) whose tiles lie within `reach`.

    `how` may be inner, left_semi or left_anti: a point has one tile, so every
    kind of join is exact on (keys, tile).
    """
    tiled = tile_segment(segments, g.xy("x1", "y1"), g.xy("x2", "y2"), reach, size)
    on = [*keys, *TILE]
    left = tile_points(points, x, y, size).alias("p")
    right = tiled.alias("s")
    if how == "inner":
        return left.join(right, on).filter(condition).drop(*TILE)
    match = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in on]
    return left.join(right, reduce(lambda a, b: a & b, [*match, condition]), how).drop(*TILE)


def band(pad_along, pad_across: Column, x="x", y="y", open_ended=False) -> Column:
    """Point within a segment's band: along it and across it."""
    a, b, p = g.xy("x1", "y1"), g.xy("x2", "y2"), g.xy(x, y)
    d = g.sub(b, a)
    length = g.norm(d)
    along = g.dot(g.sub(p, a), d) / length
    across = F.abs(g.cross(d, g.sub(p, a))) / length
    return (along >= -pad_along) & (along <= length + pad_along) & (across <= pad_across)


def eps_pairs(df: DataFrame, keys: list[str], coords: list[str], radius: float, strict=False) -> DataFrame:
    """Unordered pairs (u, v), u < v, of ids no farther apart than `radius`.

    Cells are as wide as the radius. Each row is sent to half of its
    neighbour cells only, so a pair is found once. Callers thin their rows
    first, which bounds the rows in a cell.
    """
    cells = [cell(c, radius) for c in coords]
    base = df.select(*keys, "id", *coords)
    here = base.select(*keys, F.col("id").alias("u"), *[F.col(c).alias(f"_{c}u") for c in coords], *[k.alias(f"_c{i}") for i, k in enumerate(cells)])
    spread = base.select(*keys, F.col("id").alias("v"), *[F.col(c).alias(f"_{c}v") for c in coords], *[k.alias(f"_k{i}") for i, k in enumerate(cells)])
    offsets = [[]]
    for _ in coords:
        offsets = [o + [d] for o in offsets for d in (-1, 0, 1)]
    half = [o for o in offsets if o >= [0] * len(coords)]
    options = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(o)]) for o in half])
    spread = spread.withColumn("_o", F.explode(options)).withColumns(
        {f"_c{i}": F.col(f"_k{i}") + F.col(f"_o.d{i}") for i in range(len(coords))}
    )
    same = reduce(lambda a, b: a & b, [F.col(f"_o.d{i}") == 0 for i in range(len(coords))])
    gap2 = reduce(lambda a, b: a + b, [sq(F.col(f"_{c}u") - F.col(f"_{c}v")) for c in coords])
    gap = F.sqrt(gap2)
    close = (gap < radius) if strict else (gap <= radius)
    pairs = here.join(spread, [*keys, *[f"_c{i}" for i in range(len(coords))]])
    pairs = pairs.filter(close & (~same | (F.col("u") < F.col("v"))) & (F.col("u") != F.col("v")))
    return pairs.select(*keys, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), gap.alias("gap"))


def _linked(table: pa.Table, names: list[str], radius: float) -> pa.Table:
    """(_r, _part) of one block's rows: _part is the least _r of the rows linked to a row inside the block."""
    row = table.column("_r").to_numpy()
    order = np.argsort(row)
    row, at = row[order], [table.column(c).to_numpy()[order] for c in names]
    cells = [np.floor(v / radius) for v in at]
    cells = [np.nan_to_num(c - np.nanmin(c) if np.isfinite(c).any() else c * 0).astype(np.int64) for c in cells]
    span = [int(c.max()) + 3 for c in cells]
    code = lambda shift: sum((c + 1 + d) * math.prod(span[i + 1 :]) for i, (c, d) in enumerate(zip(cells, shift)))
    here = code([0] * len(at))
    by = np.argsort(here, kind="stable")
    filled = here[by]
    root = np.arange(len(row))
    for shift in itertools.product((-1, 0, 1), repeat=len(at)):
        if shift < (0,) * len(at):
            continue
        want = code(shift)
        first, last = np.searchsorted(filled, want, "left"), np.searchsorted(filled, want, "right")
        ends = np.cumsum(last - first)
        start = 0
        while start < len(row):
            # So many rows that their pairs stay within bounds, one row at least.
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            n = (last - first)[start:stop]
            u = np.repeat(np.arange(start, stop), n)
            v = by[np.repeat(first[start:stop] - np.cumsum(n) + n, n) + np.arange(len(u))]
            near = np.sqrt(reduce(lambda a, b: a + b, [(c[u] - c[v]) ** 2 for c in at])) <= radius
            u, v = u[near], v[near]
            while len(u):
                a, b = root[u], root[v]
                apart = a != b
                u, v, a, b = u[apart], v[apart], a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
            start = stop
    return pa.table({"_r": row, "_part": row[root]})


def _with_parts(table: pa.Table, kept: list[str], names: list[str], radius: float) -> pa.Table:
    """One block's rows, in order of _r, with what is known of their part: _part, _open, _n, _least, _low, _high."""
    order = np.argsort(table.column("_r").to_numpy())
    part, of = np.unique(_linked(table, names, radius).column("_part").to_numpy(), return_inverse=True)
    at = [table.column(n).to_numpy()[order] for n in names]
    wide, small = radius * BLOCK, radius / math.sqrt(len(names)) * (1.0 - 1e-9)
    with np.errstate(invalid="ignore"):
        border = reduce(np.logical_or, [np.floor((v - 1.001 * radius) / wide) != np.floor((v + 1.001 * radius) / wide) for v in at])
        # Rows without a place, or too far out for a whole number, are left to the closure as well.
        border |= ~reduce(np.logical_and, [np.abs(v / small) < 2.0**62 for v in at])
        cells = [np.where(np.abs(v / small) < 2.0**62, np.floor(v / small), 0).astype(np.int64) for v in at]
    first = np.lexsort([*cells[::-1], of])
    starts = np.searchsorted(of[first], np.arange(len(part)))
    each = lambda fold, v: fold.reduceat(v[first], starts)[of]
    rows = lambda values: pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(values).ravel()), len(names)).cast(pa.list_(pa.array(values[0][:0]).type))
    out = table.select(kept).take(order).append_column("_part", pa.array(part[of])).append_column("_open", pa.array(each(np.logical_or, border)))
    out = out.append_column("_n", pa.array(np.bincount(of)[of])).append_column("_least", rows([c[first][starts][of] for c in cells]))
    return out.append_column("_low", rows([each(np.minimum, v) for v in at])).append_column("_high", rows([each(np.maximum, v) for v in at]))


def _seams(table: pa.Table, names: list[str], radius: float) -> pa.Table:
    """(u, v): parts of one block and those beside it that are linked, each with the least it is linked to."""
    part = table.column("_part").to_numpy()
    rows = table.append_column("_r", pa.array(np.arange(len(part))))
    met = np.unique(np.column_stack([_linked(rows, names, radius).column("_part").to_numpy(), part]), axis=0)
    first = np.searchsorted(met[:, 0], met[:, 0])
    u, v = met[first, 1], met[:, 1]
    return pa.table({"u": u[u != v], "v": v[u != v]})


PART = "_part long, _open boolean, _n long, _least array<long>, _low array<double>, _high array<double>"


def eps_parts(df: DataFrame, keys: list[str], coords: list[str], radius: float) -> tuple[DataFrame, DataFrame]:
    """(rows, names): the rows of `df` with their part, what is linked within a block, and (_part, component) of some parts.

    Rows are dealt to blocks of BLOCK radii, and each block is linked up where it lies, so pairs are never rows of a
    table, and rows pass through the block whole with the size and box of their part, so that nothing need be joined
    back to them. A part is open when a row of it is within reach of the block's border. Only such rows meet those of the
    blocks beside it, and the closure gets one node for each part that is linked over a border. The component is named by
    the least small cell in it, which is known at once (`closed_name`) but for those parts.
    """
    names = [f"_x{i}" for i in range(len(coords))]
    size = radius / math.sqrt(len(coords)) * (1.0 - 1e-9)
    # Rows are numbered as they are read from a written table, so a task that runs again gives the same numbers.
    base = settle(df)
    at = base.withColumn("_r", F.monotonically_increasing_id()).withColumns({n: F.col(c).cast("double") for c, n in zip(coords, names)})
    blocks = [cell(n, radius * BLOCK).alias(f"_b{i}") for i, n in enumerate(names)]
    kind = StructType([*base.schema.fields, *StructType.fromDDL(PART).fields])
    base_names = base.columns
    part = settle(at.groupBy(*keys, *blocks).applyInArrow(lambda t: _with_parts(t, base_names, names, radius), kind))
    # Rows at a border go to every block they reach, so that two that are near each other meet in the block of one of them.
    seam = part.filter("_open").select(*keys, "_part", *[F.col(c).cast("double").alias(n) for c, n in zip(coords, names)])
    reach = {n: [cell(F.col(n) + d * 1.001 * radius, radius * BLOCK) for d in (-1, 1)] for n in names}
    seam = seam.dropna(subset=keys).filter(reduce(lambda a, b: a | b, [lo != hi for lo, hi in reach.values()]))
    for i, (lo, hi) in enumerate(reach.values()):
        seam = seam.withColumn(f"_b{i}", F.explode(F.sequence(lo, hi)))
    edges = seam.groupBy(*keys, *[f"_b{i}" for i in range(len(names))]).applyInArrow(lambda t: _seams(t, names, radius), "u long, v long")
    label = settle(connected_components(edges.distinct()))
    linked = settle(label.select(F.col("id").alias("_part"), F.col("component").alias("_group")))
    odd = F.exists(F.concat("_low", "_high"), lambda v: F.isnan(v) | (F.abs(v / size) >= 2.0**62))
    far = _join_small(part.filter("_open"), linked).filter(odd | F.col("_group").isNotNull())
    node = F.min(F.struct(*keys, *[cell(c, size).alias(f"c_{c}") for c in coords]))
    least = settle(far.groupBy("_part").agg(F.first(F.coalesce("_group", "_part")).alias("_group"), node.alias("_node")))
    named_by = least.groupBy("_group").agg(F.min("_node").alias("component"))
    return part, settle(least.select("_part", "_group").join(named_by, "_group").drop("_group"))


def _join_small(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Left join by _part to a settled side that most often is small."""
    return rows.join(F.broadcast(side) if side._bytes <= BROADCAST_BYTES else side, "_part", "left")


def with_names(part: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with what `names` (settled) has for their part; only open parts can be in it."""
    if names._bytes <= BROADCAST_BYTES:
        return _join_small(part, names)
    return _join_small(part.filter("_open"), names).unionByName(part.filter("not _open"), allowMissingColumns=True)


def closed_name(keys: list[str], coords: list[str]) -> Column:
    """The component of a part that `names` does not have."""
    return F.struct(*keys, *[F.col("_least")[i].alias(f"c_{c}") for i, c in enumerate(coords)])


def eps_components(df: DataFrame, keys: list[str], coords: list[str], radius: float) -> DataFrame:
    """(id, component): single linkage of rows at most `radius` apart."""
    part, names = eps_parts(df.select(*keys, "id", *coords), keys, coords, radius)
    return with_names(part, names).select("id", F.coalesce("component", closed_name(keys, coords)).alias("component"))


def nearest_within(
    left: DataFrame, right: DataFrame, keys: list[str], coords: list[str], radius: float, right_id: str, strict=False
) -> DataFrame:
    """For each left row (column id) the nearest right row within `radius`; none gives no row."""
    size = radius
    near = right.select(*keys, F.col(right_id).alias("_rid"), *[F.col(c).alias(f"_r{c}") for c in coords])
    for i, c in enumerate(coords):
        near = near.withColumn(f"_c{i}", F.explode(F.sequence(cell(f"_r{c}", size) - 1, cell(f"_r{c}", size) + 1)))
    mine = left.select(*keys, "id", *coords).withColumns({f"_c{i}": cell(c, size) for i, c in enumerate(coords)})
    gap = F.sqrt(reduce(lambda a, b: a + b, [sq(F.col(c) - F.col(f"_r{c}")) for c in coords]))
    found = mine.join(near, [*keys, *[f"_c{i}" for i in range(len(coords))]]).withColumn("gap", gap)
    found = found.filter((F.col("gap") < radius) if strict else (F.col("gap") <= radius))
    best = found.groupBy(*keys, "id").agg(F.min(F.struct("gap", "_rid")).alias("_b"))
    return best.select(*keys, "id", F.col("_b._rid").alias(right_id), F.col("_b.gap").alias("gap"))


def knn(points: DataFrame, k: int, keys: list[str], radius: float, coords=("x", "y", "z")) -> DataFrame:
    """The k nearest rows of each row (itself included) within its keys.

    Rows (keys, id, coords) meet the rows of the 27 cells around them; a row
    with fewer than k hits within the radius is tried again with twice the
    radius until every row has min(k, rows of its keys) hits. Where a cell is
    crowded, pairs would grow with the square of its rows, so the leaves of a
    split tree take the place of the cells; gaps, ties and rows are the same.
    """
    coords = list(coords)
    base = settle(points.select(*keys, "id", *coords))
    crowd = base.groupBy(*keys, *[cell(c, radius).alias(f"_c{i}") for i, c in enumerate(coords)]).agg(F.count(F.lit(1)).alias("n"))
    if (crowd.agg(F.max("n")).first()[0] or 0) > CROWD:
        return splits.knn(base, k, keys, coords)
    totals = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    todo = settle(attach(base, totals, keys).withColumn("_want", F.least(F.lit(k), F.col("_total"))).drop("_total"))
    done = None
    while not todo.isEmpty():
        if not math.isfinite(radius):
            raise ValueError("rows without finite coordinates have no neighbours")
        others = base.select(*keys, F.col("id").alias("nid"), *[F.col(c).alias(f"n{c}") for c in coords])
        others = others.withColumns({f"_c{i}": cell(f"n{c}", radius) for i, c in enumerate(coords)})
        mine = todo
        for i, c in enumerate(coords):
            mine = mine.withColumn(f"_c{i}", F.explode(F.sequence(cell(c, radius) - 1, cell(c, radius) + 1)))
        gap = F.sqrt(reduce(lambda a, b: a + b, [sq(F.col(c) - F.col(f"n{c}")) for c in coords]))
        hits = mine.join(others, [*keys, *[f"_c{i}" for i in range(len(coords))]]).withColumn("gap", gap)
        hits = hits.filter(F.col("gap") <= radius)
        order = W.partitionBy(*keys, "id").orderBy("gap", "nid")
        ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("_want"))
        ranked = settle(ranked.select(*keys, "id", "nid", "gap", "rank", "_want", *[f"n{c}" for c in coords]))
        full = ranked.filter(F.col("rank") == F.col("_want")).select(*keys, "id")
        part = ranked.join(full, [*keys, "id"], "left_semi").drop("_want")
        done = part if done is None else done.unionByName(part)
        todo = settle(todo.join(full, [*keys, "id"], "left_anti"))
        radius *= 2.0
    if done is None:
        return base.limit(0).select(
            *keys, "id", F.col("id").alias("nid"), F.lit(0.0).alias("gap"), F.lit(0).alias("rank"),
            *[F.col(c).alias(f"n{c}") for c in coords],
        )
    return done
