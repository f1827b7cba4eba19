"""Clusters whose rows stay in their block are named and measured there; only parts at a border are joined."""

import math
import random

from pyspark.sql import functions as F

from levelgrid.functions import tiles
from levelgrid.operators import fixtures as X
from test_clusters import brute

KEYS, AT, EPS = ["k"], ["x", "y", "z"], 0.15


def cloud(spark):
    rng = random.Random(8)
    rows = []
    for k in "ab":
        for n, spread in ((60, 0.3), (14, 0.1), (8, 0.3), (90, 0.4), (40, 0.2)) * 4:
            at = [rng.uniform(-6, 6) for _ in AT]
            rows += [(k, *(c + rng.uniform(-spread, spread) for c in at)) for _ in range(n)]
    # A chain over two borders, and rows without a place.
    rows += [("a", -5.0 + 0.1 * i, 2.4, 2.4) for i in range(100)] + [("b", None, 1.0, 1.0), ("b", float("nan"), 1.0, 1.0), ("b", 1e30, 1.0, 1.0)]
    return rows, spark.createDataFrame(rows, "k string, x double, y double, z double").repartition(5)


def test_parts_know_their_size(spark):
    rows, df = cloud(spark)
    part, names = tiles.eps_parts(df, KEYS, AT, EPS)
    got = part.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"l{c}") for c in AT], *[F.max(c).alias(f"h{c}") for c in AT], F.first("_n").alias("_n"), F.first("_low").alias("_l"), F.first("_high").alias("_h"), F.first("_open").alias("o"), F.count_distinct("_open", "_n", "_least").alias("d")).collect()
    closed = [r for r in got if not r.o]
    assert len(closed) > 5 and all(r.n == r._n and r.d == 1 and list(r._l) == [r.lx, r.ly, r.lz] and list(r._h) == [r.hx, r.hy, r.hz] for r in closed)
    # Only parts linked over a border, and rows without a place, are named by a join.
    assert 3 < names.count() < sum(r.o for r in got) and {r._part for r in names.collect()} <= {r._part for r in got if r.o}
    assert part.filter("_open").count() < 0.5 * len(rows)


def test_clusters_are_those_of_all_pairs(spark):
    rows, df = cloud(spark)
    good = [(k, i, x, y, z) for i, (k, x, y, z) in enumerate(rows) if x is not None and math.isfinite(x)]
    label = brute(good, EPS)
    groups = {}
    for k, i, x, y, z in good:
        groups.setdefault(label[i], []).append((k, x, y, z))
    span = lambda g, c: max(r[c] for r in g) - min(r[c] for r in g)
    want = {frozenset(g) for g in groups.values() if len(g) >= 12 and max(span(g, 1), span(g, 2)) >= 0.30}
    found = {}
    for r in X.cluster_points(df, EPS, KEYS).collect():
        found.setdefault(r.cluster, []).append((r.k, r.x, r.y, r.z))
    assert {frozenset(g) for g in found.values()} == want and 2 < len(want) < len(groups)
