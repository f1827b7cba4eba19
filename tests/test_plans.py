"""Small plans with known answers, and random checks against brute force."""

import math
import random

from pyspark.sql import functions as F

from levelgrid.functions import arrangement, geometry as g, graph, hulls, tiles
from levelgrid.operators import wallgraph
from levelgrid.plans import rooms as R
from levelgrid.session import settle

V = "plan_id string, level_id string, vertex_id string, x double, y double"
W = "plan_id string, level_id string, wall_id string, a string, b string, thickness double, kind string, confidence double"
S = "plan_id string, level_id string, room_id string, name string, number string, x double, y double"


def plan(spark, plans):
    """plans: name -> (points, walls as index pairs, thickness, seeds)."""
    v, w, s = [], [], []
    for name, (pts, pairs, t, sds) in plans.items():
        v += [(name, "L1", f"v{i}", float(x), float(y)) for i, (x, y) in enumerate(pts)]
        w += [(name, "L1", f"w{i}", f"v{a}", f"v{b}", t, "exterior", 1.0) for i, (a, b) in enumerate(pairs)]
        s += [(name, "L1", f"r{i}", "Room", str(i), float(x), float(y)) for i, (x, y) in enumerate(sds)]
    return spark.createDataFrame(v, V), spark.createDataFrame(w, W), spark.createDataFrame(s, S)


BOX = [(0, 0), (5, 0), (5, 4), (0, 4)]
LOOP = [(0, 1), (1, 2), (2, 3), (3, 0)]


def test_rooms_of_small_plans(spark):
    gap = lambda d: [(0, 0), (5, 0), (5, 4), (0, 4), (0, d)]
    open_loop = [(0, 1), (1, 2), (2, 3), (3, 4)]
    plans = {
        "box": (BOX, LOOP, 0.2, [(2.5, 2)]),
        "gap4": (gap(0.04), open_loop, 0.2, [(2.5, 2)]),
        "gap20": (gap(0.2), open_loop, 0.2, [(2.5, 2)]),
        "inwall": (BOX, LOOP, 0.2, [(0.02, 2)]),
        "lost": (BOX, LOOP, 0.2, [(-3, 2)]),
        "two": (BOX, LOOP, 0.2, [(1, 2), (4, 2)]),
        "small": ([(0, 0), (0.8, 0), (0.8, 0.8), (0, 0.8)], LOOP, 0.2, [(0.4, 0.4)]),
        "tee": (BOX + [(2.5, 0), (2.5, 4)], LOOP + [(4, 5)], 0.2, [(1, 2), (4, 2)]),
    }
    v, w, s = plan(spark, plans)
    net, issues = R.rooms(v, w, s)
    area = {}
    for r in net.collect():
        area.setdefault(r.plan_id, []).append(round(r.area, 2))
    codes = {(i.plan_id, i.code) for i in issues.collect()}
    assert area["box"] == [18.24] and area["inwall"] == [18.24]
    assert abs(area["gap4"][0] - 18.24) < 0.1
    assert sorted(area["tee"]) == [8.74, 8.74]
    assert "gap20" not in area and "lost" not in area and "small" not in area
    assert codes == {("gap20", "room_seed_lost"), ("lost", "room_seed_lost"), ("small", "room_seed_lost"), ("two", "room_not_split")}
    moved = [r for r in net.collect() if r.plan_id == "inwall"][0]
    assert moved.x > 0.1


def test_joints(spark):
    star = [(0, 0)] + [(4 * math.cos(math.radians(a)), 4 * math.sin(math.radians(a))) for a in (0, 120, 240)]
    plans = {
        "ell": ([(0, 0), (4, 0), (4, 3)], [(0, 1), (1, 2)], 0.2, []),
        "acute": ([(0, 0), (4, 0), (0.5, 0.8)], [(0, 1), (1, 2)], 0.2, []),
        "star": (star, [(0, 1), (0, 2), (0, 3)], 0.2, []),
    }
    v, w, _ = plan(spark, plans)
    poly = settle(R.wall_polygons(v, w))
    spike = {r.plan_id: r.spike for r in R.max_join_spike(v, w, poly).collect()}
    assert all(s <= 3 * 0.2 + 1e-9 for s in spike.values())
    # The three walls of a star fill the joint without overlap: their areas add up to the union.
    ring = {(r.plan_id, r.wall_id): [(p.x, p.y) for p in r.ring] for r in poly.collect()}
    assert all(len(r) >= 4 for r in ring.values())
    area = lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))) / 2
    assert abs(area(ring[("ell", "w0")]) - 0.8) < 1e-9


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, 400) for i in range(401, 460)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long"), spark.range(300)).collect()}
    want = {}
    for x in list(parent):
        want.setdefault(find(x), []).append(x)
    for members in want.values():
        assert {got[m] for m in members if m in got} == {min(members)}


def test_faces_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(5)
    segs = [("p", f"s{i}", *[rng.uniform(0, 10) for _ in range(4)]) for i in range(25)]
    schema = "k string, seg string, x1 double, y1 double, x2 double, y2 double"
    sums = []
    for parts in (1, 8, 64):
        rng.shuffle(segs)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts if parts < 64 else 16))
        df = spark.createDataFrame(segs, schema).repartition(parts)
        cells = arrangement.polygonize(arrangement.node_segments(df, ["k"]), ["k"])
        sums.append(sorted(round(c.area, 6) for c in cells.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sums[0] == sums[1] == sums[2] and len(sums[0]) > 10


def test_eps_pairs_and_knn_against_brute_force(spark):
    rng = random.Random(7)
    pts = [("k", i, rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(200)]
    df = spark.createDataFrame(pts, "k string, id long, x double, y double, z double")
    d = lambda a, b: math.dist(a[2:], b[2:])
    want = {(a[1], b[1]) for a in pts for b in pts if a[1] < b[1] and d(a, b) <= 0.5}
    got = {(r.u, r.v) for r in tiles.eps_pairs(df, ["k"], ["x", "y", "z"], 0.5).collect()}
    assert got == want
    near = {(r.id, r["rank"]): r.nid for r in tiles.knn(df, 5, ["k"], 0.2).collect()}
    for a in pts:
        order = sorted(pts, key=lambda b: (d(a, b), b[1]))[:5]
        assert [near[(a[1], i + 1)] for i in range(5)] == [b[1] for b in order]
    comp = {r.id: r.component for r in tiles.eps_components(df, ["k"], ["x", "y", "z"], 0.3).collect()}
    for a in pts:
        for b in pts:
            if d(a, b) <= 0.3:
                assert comp[a[1]] == comp[b[1]]
    assert len(set(comp.values())) > 10


def test_hull_against_brute_force(spark):
    rng = random.Random(11)
    pts = [(rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(3000)]
    df = spark.createDataFrame([("k", x, y) for x, y in pts], "k string, x double, y double")
    ring = [(p.x, p.y) for p in hulls.convex_hull(df, ["k"]).first().hull]
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    assert all(cross(a, b, p) >= -1e-9 for a, b in zip(ring, ring[1:] + ring[:1]) for p in pts)
    assert set(ring) <= set(pts)


def test_inside_labels_never_exceed_the_minimum_cut(spark):
    rng = random.Random(13)
    cells, adj, truth = [], [], {}
    for n in range(40):
        k, cols, rows = f"g{n}", rng.randint(1, 3), rng.randint(1, 3)
        ids = [(i, j) for i in range(cols) for j in range(rows)]
        sure = {c for c in ids if rng.random() < 0.5} or {ids[0]}
        nb = {c: [d for d in ids if abs(c[0] - d[0]) + abs(c[1] - d[1]) == 1] for c in ids}
        out = {c: c[0] in (0, cols - 1) or c[1] in (0, rows - 1) for c in ids}
        best = None
        for mask in range(1 << len(ids)):
            s = {c for b, c in enumerate(ids) if mask >> b & 1}
            if not sure <= s:
                continue
            cost = sum(out[c] for c in s) + sum(1 for c in s for d in nb[c] if d not in s)
            if best is None or cost < best[0] or (cost == best[0] and len(s) > len(best[1])):
                best = (cost, s)
        truth[k] = best[1]
        cells += [(k, f"{i}{j}", (i, j) in sure) for i, j in ids]
        adj += [(k, f"{c[0]}{c[1]}", f"{d[0]}{d[1]}") for c in ids for d in nb[c]] + [(k, f"{c[0]}{c[1]}", None) for c in ids if out[c]]
    c = spark.createDataFrame([(k, f"{k}-{i}", s) for k, i, s in cells], "k string, cell string, sure boolean")
    a = spark.createDataFrame([(k, f"{k}-{i}", f"{k}-{o}" if o else None, 1.0) for k, i, o in adj], "k string, cell string, other string, shared double")
    got = {}
    for r in wallgraph.label_inside(c, a, ["k"]).collect():
        if r.inside:
            got.setdefault(r.k, set()).add(tuple(int(v) for v in r.cell.split("-")[1]))
    equal = sum(got[k] == truth[k] for k in truth)
    assert all(got[k] <= truth[k] for k in truth) and equal >= 34


def test_ring_functions(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 3), (0, 3)]])
    row = spark.range(1).select(
        g.ring_area(ring).alias("area"), g.point_in_ring(g.P(F.lit(1.0), F.lit(1.0)), ring).alias("inside"), g.distance_to_ring(g.P(F.lit(6.0), F.lit(1.0)), ring).alias("gap"),
    ).first()
    assert row.area == 12 and row.inside and row.gap == 2
