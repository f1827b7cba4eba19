"""Clustering against a search without a tree, and its defined cases."""

import hashlib

import numpy as np
import pytest

from levelgrid.llm import vantage_clusters as V

VECTORS = "vec_id long, embedding array<double>, x long, cluster string"


def brute(rows, count, rounds):
    """The same by distances to all centroids."""
    kept = [(i, np.array([int(np.floor(V.SCALE * v)) for v in e], np.int64)) for i, e in rows]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))
    centroids = [x.copy() for _, x in kept[:count]]
    near = lambda x: min((int(((x - c) ** 2).sum()), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            members = [x for (_, x), o in zip(kept, own) if o == k]
            if members:
                centroids[k] = np.array([sum(int(m[d]) for m in members) // len(members) for d in range(len(members[0]))], np.int64)
    found = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = {k: sum(d for _, c, d in found if c == k) for k in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found]


@pytest.mark.parametrize("leaf", [1, 3])
def test_search_keeps_ties_and_skips(leaf):
    rng = np.random.default_rng(3)
    centroids = rng.integers(-4, 5, (60, 3)) + rng.integers(0, 2, (60, 1)) * 400
    centroids[10:20] = centroids[0:10]  # equal centroids: the smaller number wins
    vectors = np.concatenate([rng.integers(-6, 7, (500, 3)), centroids, rng.integers(390, 410, (100, 3))])
    best, far, measured = V.search(vectors, centroids, V.build(centroids, leaf))
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (far == every.min(1)).all()
    assert measured < 0.8 * every.size


def test_one_line_of_ties():
    """Every vector lies halfway between two centroids."""
    centroids = np.array([[2 * i, 0] for i in (5, 3, 1, 0, 2, 4, 6, 7)], np.int64)
    vectors = np.array([[2 * i + 1, y] for i in range(7) for y in (-3, 0, 3)], np.int64)
    best, far, _ = V.search(vectors, centroids, V.build(centroids, 1))
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (far == every.min(1)).all()


def test_clusters_match_brute_force(spark, frame):
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.normal(size=4) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [rows[0], (7, rows[9][1]), (None, rows[3][1])]
    df = frame(VECTORS, [{"vec_id": i, "embedding": e, "x": 1, "cluster": "clash"} for i, e in rows]).repartition(4)
    found = V.cluster(df, 6, 3, 4)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows, 6, 3), key=str)


def test_cases(spark, frame):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0], [1.0, None], [1.0, nan], [inf, 0.0], [0.0, -inf], [1.0, 2.0, 3.0]]
    rows = [{"vec_id": i, "embedding": e} for i, e in enumerate(bad)]
    assert V.cluster(frame(VECTORS, rows), dimensions=2).collect() == []
    assert V.cluster(frame(VECTORS), dimensions=2).collect() == []
    one = V.cluster(frame(VECTORS, [*rows, {"vec_id": 9, "embedding": [-0.01, 1.0]}]), dimensions=2).collect()
    assert [tuple(r) for r in one] == [(9, 0, 0, 0, 0, hashlib.sha256(b"-1,64").hexdigest())]
    with pytest.raises(Exception, match="too large"):
        V.cluster(frame(VECTORS, [{"vec_id": 1, "embedding": [1e30, 0.0]}]), dimensions=2).collect()
