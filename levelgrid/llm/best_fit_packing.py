"""Best-fit-decreasing packing into id matrices.

Documents are tokenized, overlong ones split without loss, and the pieces of a bounded shard placed largest
first into the window with the least sufficient room, which a segment tree over room sizes finds. Each row of
the result is one window: its ids (padded), cumulative segment lengths, and positions that start anew with
every segment.

Defined cases: a null or empty text has the closing id alone; repeated rows are packed as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.llm import text as T
from levelgrid.llm.online_packing import CAPACITY, CLOSING_ID, cut
from levelgrid.llm.tokens import encoder

PAD_ID = 0
# Ids that one task gathers before it packs them; windows at most half full then wait for the next shard.
SHARD = 2_000_000

_SCHEMA = pa.schema(
    [
        ("sequence_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("ids", pa.binary()),
        ("positions", pa.binary()),
    ]
)
_SQL = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


class RoomTree:
    """A segment tree over room sizes 0..capacity: how many windows have that room. Finds the least sufficient."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.counts[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the smallest room of at least `least`."""
        i, counts = least + self.size, self.counts
        while not counts[i]:
            # Up while this is a right child or its right neighbour is empty.
            while i & 1 or not counts[i + 1]:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i *= 2
            if not counts[i]:
                i += 1
        room = i - self.size
        self._count(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of indices into sizes, in order of placement."""
    tree, windows = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            room, w = capacity, len(windows)
            windows.append([])
        else:
            room, w = found
        windows[w].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], w)
    return windows


def _pack_task(capacity: int, shard: int, closing: int, path: str | None):
    end = closing.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        ids_type = np.dtype("<u4")
        pieces: list[tuple] = []
        held = 0

        def flush(last: bool):
            nonlocal pieces, held, made
            windows = best_fit_decreasing([len(p[2]) // 4 for p in pieces], capacity)
            keep, rows = [], []
            for window in windows:
                chosen = [pieces[i] for i in window]
                lengths = [len(p[2]) // 4 for p in chosen]
                total = sum(lengths)
                if not last and 2 * total <= capacity:
                    keep += chosen
                    continue
                ids = np.full(capacity, PAD_ID, ids_type)
                ids[:total] = np.frombuffer(b"".join([p[2] for p in chosen]), ids_type)
                positions = np.zeros(capacity, "<u2" if capacity <= 1 << 16 else "<u4")
                positions[:total] = np.concatenate([np.arange(n) for n in lengths])
                ends = np.cumsum([0, *lengths]).tolist()
                rows.append((part << 32 | made, total, [p[0] for p in chosen], [p[1] for p in chosen], ends, ids.tobytes(), positions.tobytes()))
                made += 1
            pieces, held = keep, sum(len(p[2]) // 4 for p in keep)
            for i in range(0, len(rows), T.BATCH_ROWS):
                columns = zip(*rows[i : i + T.BATCH_ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for start, length in cut(len(ids) // 4, capacity):
                    pieces.append((doc_id, start, ids[4 * start : 4 * (start + length)]))
                    held += length
                if held >= shard:
                    yield from flush(False)
        yield from flush(True)

    return run


def pack_matrices(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, closing: int = CLOSING_ID, path: str | None = None) -> DataFrame:
    """One row per window: sequence_id, n_tokens, doc_ids, starts, cu_seqlens, ids, positions.

    `ids` are `capacity` little-endian unsigned 32-bit ids, `positions` as many unsigned 16-bit ones (32-bit
    for windows over 65,536). Nothing is shuffled: a task packs what it reads, shard by shard.
    """
    T.bound_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_pack_task(capacity, shard, closing, path), _SQL)


def unpack(matrices: DataFrame) -> DataFrame:
    """The pieces read back from the matrices: doc_id, start, length, ids (binary), sequence_id, offset."""
    segment = F.posexplode("doc_ids").alias("i", "doc_id")
    rows = matrices.select("sequence_id", "starts", "cu_seqlens", "ids", segment)
    offset = F.col("cu_seqlens")[F.col("i")]
    length = F.col("cu_seqlens")[F.col("i") + 1] - offset
    return rows.select(
        "doc_id",
        F.col("starts")[F.col("i")].alias("start"),
        length.cast("long").alias("length"),
        F.expr("substring(ids, 4 * cu_seqlens[i] + 1, 4 * (cu_seqlens[i + 1] - cu_seqlens[i]))").alias("ids"),
        "sequence_id",
        offset.cast("long").alias("offset"),
    )
