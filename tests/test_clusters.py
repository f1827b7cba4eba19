"""Single linkage over the borders of blocks, and what of it is sent on as rows."""

import math
import random

from levelgrid.functions import tiles


def brute(points, radius):
    label = {p[1]: p[1] for p in points}
    find = lambda i: i if label[i] == i else find(label[i])
    for a in points:
        for b in points:
            if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:], b[2:]) <= radius:
                u, v = sorted((find(a[1]), find(b[1])))
                label[v] = u
    return {i: find(i) for i in label}


def test_linked_across_blocks(spark, monkeypatch):
    rng = random.Random(3)
    far = 0.1 * tiles.BLOCK
    # Two loose clouds over the corner of eight blocks, a chain along three blocks, and rows without a place.
    points = [(k, 1000 * n + i, *(rng.uniform(-0.5, 0.5) for _ in "xyz")) for n, k in enumerate("ab") for i in range(600)]
    points += [("a", 5000 + i, 1.0 + i * far / 40, 5.0, 5.0) for i in range(100)]
    points += [("b", 6000, float("nan"), 0.0, 0.0), ("b", 6001, 1e12, 0.0, 0.0)]
    met = []
    pairs = tiles.eps_pairs
    monkeypatch.setattr(tiles, "eps_pairs", lambda df, *a, **k: met.append(df.count()) or pairs(df, *a, **k))
    df = spark.createDataFrame(points, "k string, id long, x double, y double, z double").repartition(7)
    got = {r.id: r.component for r in tiles.eps_components(df, ["k"], ["x", "y", "z"], 0.1).collect()}
    want = brute(points, 0.1)
    assert len(got) == len(points)
    assert len(set(got.values())) == len(set(want.values())) == len({(got[i], want[i]) for i in got})
    # Rows that are well inside their block go through no join of pairs.
    assert sum(met) < 0.7 * len(points)
