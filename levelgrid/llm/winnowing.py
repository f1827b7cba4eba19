"""Document fingerprints by winnowing.

Hashes of all runs of `k` code points, of which the least in every window of `w` runs is kept; among equal
ones the rightmost. Two texts that share a run of `k + w - 1` code points share a kept hash, and positions say
where. (Schleimer, Wilkerson, Aiken, SIGMOD 2003.)

Defined cases: a null text is empty and has an empty fingerprint; a text shorter than `k` is one run; two
empty fingerprints are alike (1.0), an empty and another one are not (0.0). Texts go by whole code points,
without folding of case or blanks, so that positions are those of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.llm import text as T

K = 16
# Two texts that share K + WINDOW - 1 = 23 code points are sure to meet. So a text of 32 or more is neither apart
# from nor equal to itself with a quarter replaced, unless its grams repeat.
WINDOW = 8
# Ranges of ids for each shuffle partition.
RANGES = 4

_FIELDS = {
    "doc_id": pa.int64(),
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def winnow(text: str, k: int = K, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (32 bits) and their positions, in order of position."""
    codes = T.codes(text)
    if not len(codes):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    hashes = T.grams(T.prefix_sums(codes), min(k, len(codes))) >> np.uint64(32)
    # The complement of the position in the low half makes the minimum prefer the rightmost of equal hashes.
    least = hashes << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    w, done = min(w, len(least)), 1
    while done < w:
        step = min(done, w - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    kept = least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))]
    return (kept >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def spell(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits of the hash and eight of its position, for each kept run."""
    return np.stack([hashes, positions], 1).astype(">u4").tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a spelled fingerprint."""
    pairs = np.frombuffer(bytes.fromhex(fingerprint), ">u4").reshape(-1, 2).astype(np.uint32)
    return pairs[:, 0], pairs[:, 1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of kept hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def matches(a: str, b: str) -> list[tuple[int, int]]:
    """Positions of common kept hashes in two spelled fingerprints."""
    ah, ap = read(a)
    bh, bp = read(b)
    where: dict[int, list[int]] = {}
    for h, p in zip(bh.tolist(), bp.tolist()):
        where.setdefault(h, []).append(p)
    return [(p, q) for h, p in zip(ah.tolist(), ap.tolist()) for q in where.get(h, ())]


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the head of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _row(doc_id, text: str, following: str, own, nxt, k: int, w: int) -> tuple:
    changed = edited(text, following)
    other = winnow(changed, k, w) if changed != text else own
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), digest, spell(*own), spell(*other), likeness(own[0], other[0]), likeness(own[0], nxt[0]))


def _batch(rows: list[tuple], fields: dict) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], list(fields))


def _bucket(starts: list[int]) -> Column:
    """How many of the sorted starts are not over `_at`, less one, looked up in two steps."""
    step = 256
    at, every = F.col("_at"), F.array(*[F.lit(s) for s in starts])
    coarse = F.size(F.filter(F.array(*[F.lit(s) for s in starts[::step]]), lambda s: s <= at))
    block = F.slice(every, (coarse - 1) * step + 1, F.lit(step))
    return (coarse - 1) * step + F.size(F.filter(block, lambda s: s <= at)) - 1


def fingerprints(docs: DataFrame, k: int = K, w: int = WINDOW) -> DataFrame:
    """One row per document: fingerprint, that of its edited text, and likeness to that and to the next document.

    The next document is the one with the next doc_id (repeated ids: by text; no id: first of all); the last is
    followed by the first. A first look at the ids alone gives ranges of them. Documents are dealt out by range
    once, and the first of each range goes to the range before it as well, so that every task streams its
    sorted ranges and knows the text after each document.
    """
    spark = docs.sparkSession
    T.bound_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim = slim.withColumn("_at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # Several ranges for each task, so that their sizes even out; only where they start comes to the driver.
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.select("_at").repartitionByRange(ranges, "_at").groupBy(F.spark_partition_id()).agg(F.min("_at").alias("start"))
    starts = sorted(r["start"] for r in ranged.collect())
    if not starts:
        return spark.createDataFrame([], _OUT)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = []
            for doc_id, text, ahead in zip(*[c.to_pylist() for c in batch.columns]):
                if ahead and last is None:
                    continue
                own = winnow(text, k, w)
                if last is not None:
                    rows.append(_row(last[0], last[1], text, last[2], own, k, w))
                last = None if ahead else (doc_id, text, own)
            yield _batch(rows, _FIELDS)

    own = slim.withColumns({"bucket": _bucket(starts), "ahead": F.lit(False)})
    first = own.filter(F.col("_at").isin(starts)).withColumn("ahead", F.lit(True))
    first = first.withColumn("bucket", F.pmod(F.col("bucket") - 1, F.lit(len(starts))))
    order = ["bucket", "ahead", "_at", "text"]
    dealt = own.unionByName(first).repartition("bucket").sortWithinPartitions(*order)
    return dealt.select("doc_id", "text", "ahead").mapInArrow(stream, _OUT)
