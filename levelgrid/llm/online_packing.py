"""Bounded-space online packing of token sequences.

Each task keeps a fixed number of open windows. A document goes where it leaves the least room (best fit); when
it fits nowhere, the fullest window is emitted and a new one is opened. A document longer than a window is cut
into full windows and a rest. What is still open at the end of a task is merged with the open windows of other
tasks, in rounds of bounded groups.

Defined cases: a null or empty text has the one closing id; repeated rows are packed as often as they come.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.llm import text as T
from levelgrid.llm.tokens import encoder
from levelgrid.session import settle

CAPACITY = 2048
OPEN = 64
CLOSING_ID = 1
# Tasks whose open windows are merged in one group: at most FAN * OPEN rows.
FAN = 32

_PIECES = {
    "doc_id": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "ids_crc32": pa.int64(),
    "doc_tokens": pa.int64(),
    "window": pa.int64(),
    "offset": pa.int64(),
    "part": pa.int32(),
    "open": pa.bool_(),
}
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, part int, open boolean"


class Packer:
    """Open windows of one task, ordered by the room they have left."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN):
        self.capacity, self.most = capacity, most
        self.rooms: list[tuple[int, int]] = []
        self.content: dict[int, list] = {}
        self.made = 0

    def put(self, size: int, piece) -> list[tuple[int, list]]:
        """Place a piece; return the windows (number, [(offset, piece)]) that this closes."""
        closed = []
        at = bisect_left(self.rooms, (size, -1))
        if at == len(self.rooms):
            if len(self.rooms) >= self.most:
                _, fullest = self.rooms.pop(0)
                closed.append((fullest, self.content.pop(fullest)))
            room, window = self.capacity, self.made
            self.made += 1
            self.content[window] = []
        else:
            room, window = self.rooms.pop(at)
        self.content[window].append((self.capacity - room, piece))
        if room == size:
            closed.append((window, self.content.pop(window)))
        else:
            insort(self.rooms, (room - size, window))
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return sorted(self.content.items())


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full windows and a rest."""
    return [(i, min(capacity, length - i)) for i in range(0, length, capacity)]


def _pack_task(capacity: int, most: int, closing: int, path: str | None):
    end = closing.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, encode = TaskContext.get().partitionId(), Packer(capacity, most), encoder(path).encode

        def table(windows, is_open):
            rows = [(*piece, part << 32 | w, offset, part, is_open) for w, pieces in windows for offset, piece in pieces]
            columns = list(zip(*rows)) if rows else [()] * len(_PIECES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECES.values())], list(_PIECES))

        for batch in batches:
            closed = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                for start, length in cut(total, capacity):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    closed += packer.put(length, (doc_id, start, length, crc, total))
            yield table(closed, False)
        yield table(packer.rest(), True)

    return run


def _merge_group(capacity: int):
    """Best fit, largest first, over the windows of one group."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["window"].to_pylist(), group["fill"].to_pylist(), group["part"].to_pylist()), key=lambda r: (-r[1], r[0]))
        rooms: list[tuple[int, int]] = []
        out, fills = [], {}
        for window, fill, part in rows:
            at = bisect_left(rooms, (fill, -1))
            room, into = rooms.pop(at) if at < len(rooms) else (capacity, window)
            out.append((window, into, capacity - room, part))
            fills[into] = capacity - room + fill
            insort(rooms, (room - fill, into))
        return pa.table(
            {
                "window": pa.array([r[0] for r in out], pa.int64()),
                "into": pa.array([r[1] for r in out], pa.int64()),
                "shift": pa.array([r[2] for r in out], pa.int64()),
                "part": pa.array([r[3] for r in out], pa.int32()),
                "fill": pa.array([fills[r[1]] for r in out], pa.int64()),
            }
        )

    return run


def merge_open(pieces: DataFrame, capacity: int = CAPACITY, fan: int = FAN) -> DataFrame:
    """Merge the open windows of all tasks: (window, into, shift) for those of `pieces` that are open.

    A round merges the windows of `fan` tasks. Of each group at most one window stays at most half full (two
    such would have been merged), and only that one goes on to the next round, so a group never has more than
    fan windows after the first round and the rounds grow with the logarithm of the tasks.
    """
    windows = pieces.filter("open").groupBy("window", "part").agg(F.sum("length").alias("fill"))
    schema = "window long, into long, shift long, part int, fill long"
    found = None
    while True:
        grouped = windows.withColumn("group", F.floor(F.col("part") / fan))
        step = settle(grouped.groupBy("group").applyInArrow(_merge_group(capacity), schema))
        if found is None:
            found = step.select("window", "into", "shift")
        else:
            later = step.select(F.col("window").alias("into"), F.col("into").alias("into2"), F.col("shift").alias("shift2"))
            found = found.join(later, "into", "left").select(
                "window", F.coalesce("into2", "into").alias("into"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift")
            )
        windows = step.filter(f"window = into and fill * 2 <= {capacity}").select(
            "window", "fill", F.floor(F.col("part") / fan).cast("int").alias("part")
        )
        if windows.limit(2).count() < 2:
            return found


def pack(docs: DataFrame, capacity: int = CAPACITY, most: int = OPEN, closing: int = CLOSING_ID, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    T.bound_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = settle(slim.mapInArrow(_pack_task(capacity, most, closing, path), _PIECES_SQL))
    merged = pieces.filter("open").join(merge_open(pieces, capacity), "window")
    placed = merged.withColumn("window", F.col("into")).withColumn("offset", F.col("offset") + F.col("shift"))
    names = [c for c in _PIECES if c not in ("part", "open")]
    out = pieces.filter("not open").select(names).unionByName(placed.select(names))
    return out.withColumnRenamed("window", "sequence_id")
