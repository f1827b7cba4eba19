"""Ops by dependency: rounds as long as the longest chain, results as if one op came after the other."""

import json

import numpy as np
from pyspark.sql import functions as F
from test_golden import boxes, ops

from levelgrid.plans import corrections as C
from levelgrid.plans.documents import PLAN
from levelgrid.session import settle

SCHEMA = "op string, args string"


def op(plan, kind, **args):
    return (plan, kind, json.dumps(args))


def rounds(spark, rows):
    """The round of every op, by its place in the list."""
    key = {"set_room_name": "roomId", "set_opening": "openingId"}
    parsed = [(p, "L1", i, kind, json.loads(a)[key.get(kind, "wallId")]) for i, (p, kind, a) in enumerate(rows)]
    df = spark.createDataFrame(parsed, "plan_id string, level_id string, seq int, op string, target string")
    return [r["_k"] for r in C.op_rounds(df).orderBy("seq").collect()]


def test_rounds_follow_chains(spark):
    thick = lambda w: op("a", "set_wall_thickness", wallId=w, thickness=0.3)
    move = lambda w: op("a", "move_wall", wallId=w, dx=0.1, dy=0.1)
    opening = lambda o: op("a", "set_opening", openingId=o, width=0.8)
    assert rounds(spark, [thick(f"w{i}") for i in range(200)]) == [1] * 200
    assert rounds(spark, [thick("w1"), thick("w2"), thick("w1"), thick("w1")]) == [1, 1, 2, 3]
    assert rounds(spark, [opening("o1"), opening("o2"), move("w1"), opening("o1"), move("w2"), thick("w1")]) == [1, 1, 2, 3, 4, 1]
    assert rounds(spark, [opening("o1"), opening("o1"), move("w1"), op("b", "move_wall", wallId="w1", dx=0, dy=0)]) == [1, 2, 3, 1]


def test_many_independent_ops_take_two_rounds(spark):
    """200 ops on one plan: as the same ops one after the other."""
    t = boxes(spark, ["a"])
    rooms = spark.createDataFrame([("a", "L1", f"r{i}", "Room", str(i), (2.5, 2.0)) for i in range(198)], t.rooms.schema)
    rows = [op("a", "set_room_name", roomId=f"r{i}", name=f"name {i}") for i in range(198)]
    rows += [op("a", "set_wall_thickness", wallId="w1", thickness=0.3), op("a", "set_wall_thickness", wallId="w1", thickness=0.4)]
    assert max(rounds(spark, rows)) == 2
    done, refused = C.apply_ops(t.with_(rooms=settle(rooms)), ops(spark, rows, SCHEMA))
    assert refused.isEmpty()
    assert {r.room_id: r.name for r in done.rooms.collect()} == {f"r{i}": f"name {i}" for i in range(198)}
    assert {r.thickness for r in done.walls.filter("wall_id = 'w1'").collect()} == {0.4}


def test_as_one_by_one(spark):
    """Random lists of ops, in rounds and one call each."""
    rng = np.random.default_rng(12)
    rows = []
    for plan in ("a", "b"):
        for _ in range(6):
            w = f"w{rng.integers(1, 5)}"
            rows.append([op(plan, "set_wall_thickness", wallId=w, thickness=round(float(rng.uniform(0.1, 0.4)), 3)), op(plan, "move_wall", wallId=w, dx=round(float(rng.uniform(-0.3, 0.3)), 3), dy=round(float(rng.uniform(-0.3, 0.3)), 3)), op(plan, "set_room_name", roomId="r1", name=w)][rng.integers(3)])
    t = boxes(spark, ["a", "b"])
    done, refused = C.apply_ops(t, ops(spark, rows, SCHEMA))
    assert refused.isEmpty()
    step = t
    for i in range(6):
        step, refused = C.apply_ops(step, ops(spark, [rows[i], rows[6 + i]], SCHEMA))
        assert refused.isEmpty()
    show = lambda df, *c: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*PLAN, *c).collect())
    assert show(done.vertices, "vertex_id", "x", "y") == show(step.vertices, "vertex_id", "x", "y")
    assert show(done.walls, "wall_id", "thickness") == show(step.walls, "wall_id", "thickness")
    assert show(done.rooms, "room_id", "name") == show(step.rooms, "room_id", "name")
    assert done.walls.filter(F.col("thickness") != 0.2).count() > 0
