"""Graph closures as DataFrame rounds: components and cycle ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.session import settle


def _both(edges: DataFrame) -> DataFrame:
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select("u", "v").unionByName(flipped)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u points at the least of u and its neighbours."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, points at the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """Components of an undirected graph by large-star / small-star rounds.

    `edges` has columns u, v of one orderable type; `nodes` (column id) adds
    isolated nodes. Returns (id, component), the component being the least id
    in it. (Kiveris et al., SoCC 2014.) Minima are hash aggregates with
    partial sums, and the join to them is one row per node on one side, so a
    hub with very many edges is split by the adaptive skew join.
    """
    current = settle(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    mark = None
    for _ in range(max_rounds):
        nxt = settle(_small_star(_large_star(current).distinct()).distinct())
        found = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        current = nxt
        if mark == tuple(found):
            break
        mark = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    labels = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = labels.unionByName(roots)
    if nodes is not None:
        alone = nodes.select("id").distinct().join(out.select("id"), "id", "left_anti")
        out = out.unionByName(alone.select("id", F.col("id").alias("component")))
    return out


def rank_cycles(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Label and order the cycles of a permutation (id -> nxt) by pointer doubling.

    Returns (id, cycle, behind): the least id of the cycle and the number of
    steps from this node to it. After k rounds a node knows 2^k successors.
    """
    current = settle(
        links.select("id", "nxt", F.col("id").alias("cycle"), F.lit(0).cast("long").alias("behind"))
    )
    step = 1
    for _ in range(max_rounds):
        ahead = current.select(
            F.col("id").alias("nxt"),
            F.col("nxt").alias("nxt2"),
            F.col("cycle").alias("cycle2"),
            F.col("behind").alias("behind2"),
        )
        better = F.col("cycle2") < F.col("cycle")
        nxt = settle(
            current.join(ahead, "nxt").select(
                "id",
                F.col("nxt2").alias("nxt"),
                F.when(better, F.col("cycle2")).otherwise(F.col("cycle")).alias("cycle"),
                F.when(better, F.col("behind2") + step).otherwise(F.col("behind")).alias("behind"),
                better.alias("moved"),
            )
        )
        moved = not nxt.filter("moved").isEmpty()
        current = nxt.drop("moved")
        step *= 2
        if not moved:
            return current.select("id", "cycle", "behind")
    raise RuntimeError("cycles did not settle")
