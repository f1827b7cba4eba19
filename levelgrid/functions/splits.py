"""A split tree over points whose boxes follow their density, and exact neighbours by its leaves.

Every round cuts all nodes with too many rows at once, along their longest side, at quantiles of the node's own rows.
Points are never gathered: quantiles are aggregates, nodes a table, and a leaf holds a bounded number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions.geometry import sq
from levelgrid.session import attach, settle

LEAF = 64
# Children of a node at most, and the relative precision of their quantiles.
WAYS = 16
ACCURACY = 200


@dataclass
class SplitTree:
    """points: all rows with _node, their leaf. nodes: node, parent, n, low_/high_ of each axis, flat, leaf."""

    points: DataFrame
    nodes: DataFrame
    keys: list[str]
    coords: list[str]


def _boxes(points: DataFrame, keys: list[str], coords: list[str], parent: Column) -> DataFrame:
    sides = [f(c).alias(f"{name}_{c}") for c in coords for name, f in (("low", F.min), ("high", F.max))]
    box = points.groupBy(*keys, "_node").agg(F.count(F.lit(1)).alias("n"), parent.alias("parent"), *sides)
    extent = F.greatest(*[F.col(f"high_{c}") - F.col(f"low_{c}") for c in coords], F.lit(0.0))
    return box.withColumn("_extent", extent)


def _middle(c: str) -> Column:
    """A value from the low side on that lies below the high side, also where no number is between the two."""
    low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
    middle = low + (high - low) / 2
    return F.when(middle < high, middle).otherwise(low)


def build(points: DataFrame, keys: list[str], coords: list[str], leaf: int = LEAF) -> SplitTree:
    """The tree of every key. A node is a leaf when it has at most `leaf` rows, or rows in one place only (flat)."""
    keys, coords = list(keys), list(coords)
    names = points.columns
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == math.inf) for c in coords])
    checked = points.withColumn("_node", F.when(bad, F.raise_error(F.lit("rows without finite coordinates have no neighbours")).cast("long")).otherwise(F.lit(0).cast("long")))
    open_ = settle(checked.withColumn("_parent", F.lit(None).cast("long")))
    done, nodes = [], []
    while True:
        box = settle(_boxes(open_, keys, coords, F.first("_parent")))
        ends = (F.col("n") <= leaf) | (F.col("_extent") <= 0)
        nodes.append(box.withColumns({"leaf": ends, "flat": F.col("_extent") <= 0}).drop("_extent"))
        named = attach(open_, box.select(*keys, "_node", ends.alias("_ends"), "n", *[F.col(f"{s}_{c}").alias(f"_{s}_{c}") for s in ("low", "high") for c in coords]), [*keys, "_node"])
        done.append(named.filter("_ends").select(*names, "_node"))
        if box.filter(~ends).isEmpty():
            break
        longest = F.greatest(*[F.col(f"_high_{c}") - F.col(f"_low_{c}") for c in coords], F.lit(0.0))
        pick = lambda value: F.coalesce(*[F.when(F.col(f"_high_{c}") - F.col(f"_low_{c}") == longest, value(c)) for c in coords])  # noqa: E731, B023
        todo = settle(named.filter("not _ends").withColumns({"_at": pick(F.col), "_mid": pick(_middle)}).select(*names, "_node", "n", "_at", "_mid"))
        # As many children as halves of a leaf, so that leaves do not get small.
        shares = [(i + 1) / WAYS for i in range(WAYS - 1)]
        cuts = todo.groupBy(*keys, "_node").agg(F.percentile_approx("_at", shares, ACCURACY).alias("q"), F.first("n").alias("n"), F.first("_mid").alias("mid"))
        ways = F.least(F.lit(WAYS), F.ceil(F.col("n") * 2 / leaf)).cast("int")
        chosen = F.transform(F.sequence(F.lit(1), ways - 1), lambda i: F.element_at("q", F.greatest(F.lit(1), F.floor(i * WAYS / ways).cast("int"))))
        # The middle is always a cut, so that rows which share a value cannot hold a node together.
        cuts = cuts.select(*keys, "_node", F.array_distinct(F.array_append(chosen, F.col("mid"))).alias("_cuts"))
        child = F.size(F.filter("_cuts", lambda c: c < F.col("_at")))
        moved = attach(todo, cuts, [*keys, "_node"])
        open_ = settle(moved.withColumns({"_parent": F.col("_node"), "_node": F.xxhash64("_node", child)}).select(*names, "_node", "_parent"))
    return SplitTree(settle(reduce(DataFrame.unionByName, done)), settle(reduce(DataFrame.unionByName, nodes)), keys, coords)


def _gap2(at, box, coords) -> Column:
    """Squared distance of a point to a box."""
    return reduce(lambda a, b: a + b, [sq(F.greatest(box(f"low_{c}") - at(c), at(c) - box(f"high_{c}"), F.lit(0.0))) for c in coords])


def knn(points: DataFrame, k: int, keys: list[str], coords=("x", "y", "z"), leaf: int = LEAF) -> DataFrame:
    """The k nearest rows of each row (itself included) within its keys, by gap and then id: id, nid, gap, rank, n<coord>.

    Ids are unique within the keys.

    A row meets the rows of its own leaf first. The gap of its k-th hit bounds how far others may lie, so it goes down
    the tree to the leaves within that bound, and meets their rows too.
    """
    keys, coords = list(keys), list(coords)
    tree = build(points.select(*keys, "id", *coords), keys, coords, max(leaf, 4 * k))
    on = [*keys, "_node"]
    leaves = tree.nodes.filter("leaf")
    # Rows in one place are equally far from all, so the first k ids of them stand for the others.
    marked = attach(tree.points, leaves.select(*on, "flat"), on)
    first = F.row_number().over(W.partitionBy(*on).orderBy("id"))
    few = marked.filter("not flat").unionByName(marked.filter("flat").withColumn("_r", first).filter(F.col("_r") <= k).drop("_r"))
    hold = few.groupBy(*on).agg(F.collect_list(F.struct("id", *coords)).alias("_held"))
    parents = tree.nodes.select(*keys, F.col("_node").alias("parent"), *[F.col(f"{s}_{c}").alias(f"{s}p_{c}") for s in ("low", "high") for c in coords])
    whole = settle(leaves.select(*on, "parent").join(parents, [*keys, "parent"], "left").join(hold, on).drop("parent"))

    def hits(reach: Column | None) -> Column:
        gap = lambda h: F.sqrt(reduce(lambda a, b: a + b, [sq(F.col(c) - h[c]) for c in coords]))
        row = lambda h: F.struct(gap(h).alias("gap"), h["id"].alias("nid"), *[h[c].alias(f"n{c}") for c in coords])
        found = F.transform("_held", row)
        return F.slice(F.array_sort(found if reach is None else F.filter(found, lambda h: h["gap"] <= reach)), 1, k)

    # A leaf's rows are bounded, so this joins one bounded row per leaf; no point is moved twice.
    home = tree.points.join(whole, on).withColumn("_hits", hits(None))
    corner = reduce(lambda a, b: a + b, [sq(F.greatest(F.abs(F.col(c) - F.col(f"lowp_{c}")), F.abs(F.col(c) - F.col(f"highp_{c}")))) for c in coords])
    # With too few rows at home the parent, which has enough, bounds the reach; without a parent there are no others.
    reach = F.when(F.size("_hits") >= k, F.element_at("_hits", -1)["gap"]).otherwise(F.coalesce(F.sqrt(corner), F.lit(-1.0)))
    home = settle(home.withColumn("_reach", reach).select(*on, "id", *coords, "_hits", "_reach"))

    children = tree.nodes.filter("parent is not null").select(*keys, F.col("parent").alias("_at"), "_node", "leaf", *[f"{s}_{c}" for s in ("low", "high") for c in coords])
    children = settle(children.groupBy(*keys, "_at").agg(F.collect_list(F.struct("_node", "leaf", *[f"{s}_{c}" for s in ("low", "high") for c in coords])).alias("_below")))
    front = home.select(*keys, "id", *coords, "_reach", F.col("_node").alias("_home"), F.lit(0).cast("long").alias("_at"))
    visits = []
    while True:
        # The reach is a rounded root, so boxes are entered a little beyond it.
        near = lambda b: _gap2(F.col, lambda c: b[c], coords) <= sq(F.col("_reach")) * (1 + 1e-9)
        below = attach(front, children, [*keys, "_at"])
        down = below.withColumn("_b", F.explode(F.filter("_below", near))).filter((F.col("_b._node") != F.col("_home")) & (F.col("_reach") >= 0))
        down = settle(down.select(*keys, "id", *coords, "_reach", "_home", F.col("_b._node").alias("_at"), F.col("_b.leaf").alias("_leaf")))
        if down.isEmpty():
            break
        visits.append(down.filter("_leaf").select(*keys, "id", *coords, "_reach", F.col("_at").alias("_node")))
        front = down.filter("not _leaf").drop("_leaf")
    found = home.select(*keys, "id", "_hits")
    if visits:
        away = reduce(DataFrame.unionByName, visits).join(whole.select(*on, "_held"), on).select(*keys, "id", hits(F.col("_reach")).alias("_hits"))
        found = found.unionByName(away.filter(F.size("_hits") > 0)).groupBy(*keys, "id").agg(F.flatten(F.collect_list("_hits")).alias("_hits"))
    best = found.select(*keys, "id", F.posexplode(F.slice(F.array_sort("_hits"), 1, k)).alias("_r", "_h"))
    return best.select(*keys, "id", "_h.nid", "_h.gap", (F.col("_r") + 1).alias("rank"), *[F.col(f"_h.n{c}") for c in coords])
