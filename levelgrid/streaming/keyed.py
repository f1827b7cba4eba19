"""Streams with keyed state that ends: timers by event time clear what is over.

Each operator keeps a row of state for a key while it is running. The end of a key (a terminal state, a last
chunk, the mark that a scan is complete) leaves a note for a grace time, so that rows that come late change
nothing; a timer then clears the key. A key that falls silent ends by a timer too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from levelgrid.streaming.jobs import TERMINAL

# The store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICRO = 1_000_000.0


def use_keyed_state(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _millis(column: pd.Series) -> int:
    return int(column.max().value // 1_000_000)


class _Ending(StatefulProcessor):
    """State of one row, and one timer that is moved with every change."""

    schema = ""

    def __init__(self, grace: int, idle: int):
        self.grace, self.idle = grace, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema + ", over boolean, seen long")

    def close(self) -> None:
        pass

    def later(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def keep(self, row: tuple, over: bool, seen: int) -> None:
        self.state.update((*row, over, seen))
        self.later(seen + (self.grace if over else self.idle))


class _Jobs(_Ending):
    schema = "state string, progress double, updates long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(rows)).sort_values(["seq", "ts"], kind="stable")
        old = self.state.get() if self.state.exists() else (None, None, 0, False, 0)
        if old[3]:
            return
        ends = np.flatnonzero(chunk["state"].isin(TERMINAL))
        chunk = chunk.iloc[: ends[0] + 1] if len(ends) else chunk
        last, over = chunk.iloc[-1], bool(len(ends))
        progress = None if pd.isna(last["progress"]) else float(last["progress"])
        now = (last["state"], progress, int(old[2]) + len(chunk))
        self.keep(now, over, max(int(old[4]), _millis(chunk["ts"])))
        yield pd.DataFrame([(key[0], *now, over)], columns=["job_id", "state", "progress", "updates", "finished"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, progress, updates, over, _ = self.state.get()
        self.state.clear()
        if not over:
            # A job that nobody runs any more counts as interrupted.
            yield pd.DataFrame([(key[0], "error", progress, updates, True)], columns=["job_id", "state", "progress", "updates", "finished"])


def stream_job_feed(events: DataFrame, grace: str = "10 minutes", idle: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """job_id, state, progress, updates, finished: a row for every change of a job, until its first terminal state.

    `events` has job_id, seq, state, progress and ts. Later rows of a finished job change nothing, and its state is
    cleared `grace` after its end; a job without news for `idle` ends as an error (update mode).
    """
    use_keyed_state(events.sparkSession)
    rows = events.select("job_id", "seq", "state", F.col("progress").cast("double").alias("progress"), "ts").withWatermark("ts", watermark)
    of = rows.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").transformWithStateInPandas(
        _Jobs(_span(grace), _span(idle)), f"job_id {of}, state string, progress double, updates long, finished boolean", "Update", "EventTime"
    )


# Parts that transfers are dealt to. A part is one key of the stream: its transfers lie in one row of state, by columns.
PARTS = 4096
HELD = {"id": "object", "bytes": "int64", "chunks": "int64", "rejected": "bool", "over": "bool", "seen": "int64"}


class _Transfers(StatefulProcessor):
    """The transfers of a part, all at once, and one timer for the first of them that ends or is to be forgotten."""

    def __init__(self, limit: int, grace: int, idle: int):
        self.limit, self.grace, self.idle = limit, grace, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "rows binary, due long")

    def close(self) -> None:
        pass

    def held(self) -> tuple[pd.DataFrame, int | None]:
        kept = self.state.get()
        if kept is None:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in HELD.items()}), None
        return pa.ipc.open_stream(kept[0]).read_all().to_pandas().astype(HELD), int(kept[1])

    def due(self, rows: pd.DataFrame) -> np.ndarray:
        return rows["seen"].to_numpy() + np.where(rows["over"].to_numpy(), self.grace, self.idle)

    def keep(self, rows: pd.DataFrame, before: int | None) -> None:
        first = int(self.due(rows).min()) if len(rows) else None
        if before is not None and first != before:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
        if first is None:
            self.state.clear()
            return
        if first != before:
            self.handle.registerTimer(first)
        table = pa.table([pa.array(rows["id"], pa.string())] + [pa.array(rows[c].to_numpy()) for c in list(HELD)[1:]], list(HELD))
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.state.update((out.getvalue().to_pybytes(), first))

    def news(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["id", "bytes", "chunks", "rejected"]].assign(finished=rows["over"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(rows), ignore_index=True)
        old, before = self.held()
        codes, ids = pd.factorize(np.concatenate([old["id"].to_numpy(object), chunk["id"].to_numpy(object)]), use_na_sentinel=False)
        spent = np.zeros(len(ids), bool)
        bytes_, chunks, seen = (np.zeros(len(ids), np.int64) for _ in range(3))
        was = codes[: len(old)]
        spent[was] = old["over"]
        bytes_[was], chunks[was], seen[was] = old["bytes"], old["chunks"], old["seen"]
        of = codes[len(old) :]
        # A transfer that has ended takes no more rows.
        order = chunk.assign(_of=of)[~spent[of]].sort_values(["_of", "unordered", "seq", "at"], kind="stable")
        if not len(order):
            return
        of, size, at = order["_of"].to_numpy(), order["bytes"].to_numpy(np.int64), order["at"].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        own = of[starts]
        group = np.cumsum(np.r_[True, of[1:] != of[:-1]]) - 1
        run = np.cumsum(size)
        total = run - (run[starts] - size[starts] - bytes_[own])[group]
        # The first chunk that passes the limit, or is marked as the last one, ends the transfer.
        place = np.arange(len(of))
        ends = np.where((total > self.limit) | order["last"].to_numpy(bool), place, len(of))
        first = np.minimum.reduceat(ends, starts)
        stop = np.minimum(first, np.r_[starts[1:], len(of)] - 1)
        late = np.where((place <= stop[group]) & (at != NEVER), at // 1000, 0)
        new = pd.DataFrame(
            {
                "id": ids[own], "bytes": total[stop], "chunks": chunks[own] + stop - starts + 1, "rejected": total[stop] > self.limit,
                "over": first < len(of), "seen": np.maximum(seen[own], np.maximum.reduceat(late, starts)),
            }
        )
        untouched = np.ones(len(ids), bool)
        untouched[own] = False
        rest = old[untouched[was]]
        self.keep(pd.concat([rest, new], ignore_index=True).astype(HELD) if len(rest) else new, before)
        yield self.news(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows, before = self.held()
        due = self.due(rows)
        gone = due <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self.keep(rows[~gone], before)
        silent = rows[gone & ~rows["over"].to_numpy()]
        if len(silent):
            yield self.news(silent.assign(over=True))


# A time after all others, of a chunk that has none.
NEVER = (1 << 63) - 1


def stream_transfer_feed(
    chunks: DataFrame, limit: int, grace: str = "10 minutes", idle: str = "1 day", watermark: str = "10 minutes", parts: int = PARTS
) -> DataFrame:
    """transfer_id, bytes, chunks, rejected, finished: a row for every change of a transfer, until it ends.

    `chunks` has transfer_id, seq, bytes, last and ts. A transfer ends with the first chunk beyond the limit or
    with its last one; later chunks change nothing, and its state is cleared `grace` after (update mode). Transfers are
    dealt to `parts` keys, as a call for each transfer and each of its timers takes milliseconds.
    """
    use_keyed_state(chunks.sparkSession)
    of = chunks.schema["transfer_id"].dataType.simpleString()
    seq = chunks.schema["seq"].dataType
    # Ids go as strings and numbers without nulls, so that pandas makes no floats of them.
    rows = chunks.select(
        F.pmod(F.xxhash64("transfer_id"), F.lit(parts)).cast("int").alias("part"), F.col("transfer_id").cast("string").alias("id"),
        F.col("seq").isNull().alias("unordered"), F.coalesce("seq", F.lit(0).cast(seq)).alias("seq"),
        F.coalesce(F.col("bytes").cast("long"), F.lit(0).cast("long")).alias("bytes"), F.coalesce("last", F.lit(False)).alias("last"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER)).alias("at"), "ts",
    ).withWatermark("ts", watermark)
    out = rows.groupBy("part").transformWithStateInPandas(
        _Transfers(limit, _span(grace), _span(idle)), "id string, bytes long, chunks long, rejected boolean, finished boolean", "Update", "EventTime"
    )
    return out.select(F.col("id").cast(of).alias("transfer_id"), "bytes", "chunks", "rejected", "finished")


# Voxels of a brick along each axis: a value of the map state holds at most the cube of it.
BRICK = 16


class _Voxels(StatefulProcessor):
    """Whole-number sums of the voxels of a part of a scan, brick by brick; all are given out when the scan is over."""

    def __init__(self, grace: int):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bricks = handle.getMapState("bricks", "bx long, by long, bz long", "cells binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(rows))
        done = chunk[chunk["complete"]]
        points = chunk[~chunk["complete"]]
        for brick, own in points.groupby(["bx", "by", "bz"]):
            at = tuple(int(b) for b in brick)
            cells = own[["cell", "n", "sx", "sy", "sz"]].to_numpy(np.int64)
            if self.bricks.containsKey(at):
                cells = np.concatenate([cells, np.frombuffer(self.bricks.getValue(at)[0], np.int64).reshape(-1, 5)])
            ids, where = np.unique(cells[:, 0], return_inverse=True)
            sums = np.zeros((len(ids), 4), np.int64)
            np.add.at(sums, where, cells[:, 1:])
            self.bricks.updateValue(at, (np.column_stack([ids, sums]).tobytes(),))
        if len(done) and not list(self.handle.listTimers()):
            self.handle.registerTimer(_millis(done["ts"]) + self.grace)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for brick, value in self.bricks.iterator():
            cells = np.frombuffer(value[0], np.int64).reshape(-1, 5)
            inside = np.unravel_index(cells[:, 0], (BRICK,) * 3)
            out = {"scan_id": key[0], **{f"v{c}": int(b) * BRICK + i for c, b, i in zip("xyz", brick, inside)}, "n": cells[:, 1]}
            yield pd.DataFrame(out | {c: cells[:, 2 + i] / cells[:, 1] / MICRO for i, c in enumerate("xyz")})
        self.bricks.clear()


def stream_scan_voxels(points: DataFrame, complete: DataFrame, voxel: float = 0.05, parts: int = 64, grace: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """scan_id, vx, vy, vz, n, x, y, z: the voxels of every scan, once it is complete (append mode).

    `points` has scan_id, x, y, z and ts, `complete` the scan_id and ts of scans that are over. Points that come up
    to `grace` after that still count; then the voxels are given out and leave the state. A scan is spread
    over `parts` keys, so that one large scan does not stand in one task.
    """
    use_keyed_state(points.sparkSession)
    p = points.withColumns({f"v{c}": F.floor(F.col(c) / voxel) for c in "xyz"})
    p = p.withColumns({f"b{c}": F.floor(F.col(f"v{c}") / BRICK) for c in "xyz"})
    inside = [F.col(f"v{c}") - F.col(f"b{c}") * BRICK for c in "xyz"]
    cell = (inside[0] * BRICK + inside[1]) * BRICK + inside[2]
    sums = [F.rint(F.col(c) * MICRO).cast("long").alias(f"s{c}") for c in "xyz"]
    part = F.pmod(F.xxhash64("bx", "by", "bz"), F.lit(parts)).cast("int")
    rows = p.select("scan_id", part.alias("part"), "bx", "by", "bz", cell.alias("cell"), F.lit(1).cast("long").alias("n"), *sums, F.lit(False).alias("complete"), "ts")
    none = [F.lit(0).cast("long").alias(c) for c in ("bx", "by", "bz", "cell", "n", "sx", "sy", "sz")]
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    marks = complete.select("scan_id", every, *none, F.lit(True).alias("complete"), "ts")
    both = rows.unionByName(marks).withWatermark("ts", watermark)
    of = both.schema["scan_id"].dataType.simpleString()
    return both.groupBy("scan_id", "part").transformWithStateInPandas(
        _Voxels(_span(grace)), f"scan_id {of}, vx long, vy long, vz long, n long, x double, y double, z double", "Append", "EventTime"
    )


def _span(text: str) -> int:
    """Milliseconds of a span such as "10 minutes"."""
    return int(pd.Timedelta(text).total_seconds() * 1000)


def state_rows(spark, folder: str) -> int:
    """Keys that the last state of a stream with this checkpoint folder holds."""
    return spark.read.format("statestore").option("stateVarName", "state").load(f"{folder}/state").count()
