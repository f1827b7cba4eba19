"""Transfers that share a part: the same news as alone, and one call of the processor for all of them."""

import random

import numpy as np
import pandas as pd

from levelgrid.streaming import keyed
from test_keyed_streams import CHUNKS, at, drive


def alone(batches, limit, grace=10, idle=1440, watermark=10):
    """News of every transfer by the rules, a row at a time; times in minutes."""
    state, news, top = {}, [], None
    for rows in [*batches, []]:
        touched = {}
        for key, seq, size, last, ts in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[4])):
            total, chunks, over, seen = state.get(key, (0, 0, False, -1))
            if over:
                continue
            total, chunks = total + (size or 0), chunks + 1
            state[key] = (total, chunks, total > limit or bool(last), max(seen, ts))
            touched[key] = (key, total, chunks, total > limit, state[key][2])
        news += touched.values()
        if rows:
            top = max([r[4] for r in rows] + ([top] if top is not None else []))
        # Rows and timers of the next batch see the watermark of this one.
        for key, (total, chunks, over, seen) in list(state.items()):
            if seen + (grace if over else idle) <= top - watermark:
                del state[key]
                news += [] if over else [(key, total, chunks, total > limit, True)]
    return sorted(news, key=str)


def test_transfers_of_one_part(spark):
    rng = random.Random(11)
    batches, now = [], 0
    for step in (0, 5, 30, 1500, 20, 3000):
        now += step
        rows = []
        for _ in range(150):
            key = rng.choice([None, (1 << 60) + 1, (1 << 60) + 2, *range(40)])
            rows.append((key, rng.choice([None, *range(10**6)]), rng.choice([None, rng.randrange(60)]), rng.choice([None, False, False, False, rng.random() < 0.2]), now + rng.randrange(5)))
        batches.append(rows)
    stamped = [[(*r[:4], at(r[4])) for r in b] for b in batches]
    rows, _, base = drive(spark, CHUNKS, stamped, lambda s: keyed.stream_transfer_feed(s, 300, parts=2), "update")
    assert sorted(rows, key=str) == alone(batches, 300)
    assert keyed.state_rows(spark, base) <= 2


class Store:
    """Counts what a processor asks of the state store."""

    def __init__(self):
        self.kept, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.kept is not None

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, row):
        self.calls, self.kept = self.calls + 1, row

    def clear(self):
        self.calls, self.kept = self.calls + 1, None

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


def test_calls_do_not_grow_with_the_transfers(spark):
    n = 5000
    chunk = pd.DataFrame({"id": [str(i) for i in range(n)] * 2, "unordered": False, "seq": np.repeat([1, 2], n), "bytes": 10, "last": np.repeat([False, True], n), "at": 1_000_000})
    store, one = Store(), keyed._Transfers(100, 1000, 5000)
    one.init(store)
    out = pd.concat(list(one.handleInputRows((0,), iter([chunk]), None)))
    assert len(out) == n and out["finished"].all() and (out["bytes"] == 20).all()
    assert store.calls < 10 and store.timers == [2000]
