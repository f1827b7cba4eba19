"""Join of documents on the Jaccard likeness of their word shingles, with Bayesian pruning of candidates.

Texts with the same words are one class from the start. Bands of MinHash values propose links, and the groups
they connect are compared block by block: MinHash values are compared a few at a time, a pair is dropped as
soon as the posterior probability that its likeness reaches the threshold falls below a tolerance (Satuluri and
Parthasarathy, VLDB 2012), and what is left is verified on the whole shingle sets. Blocks return, for every
text, the number of documents it is linked to and the least text of its part of the block, never the pairs.

Defined cases: a text without words (null, empty, marks only) is alike to nothing and stays alone; a text of
fewer words than a shingle is one shingle; documents with the same words are linked to each other; repeated
rows are documents of their own in the join, and kept once by `deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.functions.graph import connected_components
from levelgrid.llm import text as T
from levelgrid.session import attach, settle

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 5
HASHES = BANDS * ROWS
# Share of pairs at the threshold that the bands may fail to propose.
MISS = 1e-5
# MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP = 30
TOLERANCE = 1e-6
# Weight of one block: shingles and MinHash values of its texts together.
BLOCK = 1 << 18

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a shingle set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512, None] * _A + _B
        least = np.minimum(least, part.min(0))
    return (least >> np.uint64(32)).astype("<u4")


def banding(threshold: float) -> tuple[int, int]:
    """Bands and their rows for a threshold: as many rows as keep the loss of pairs at it within MISS."""
    for rows in range(ROWS, 0, -1):
        bands = HASHES // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return bands, rows
    raise ValueError(f"threshold {threshold} is too low: {HASHES} MinHash values lose more than {MISS} of the pairs")


@lru_cache(maxsize=None)
def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = HASHES, step: int = STEP) -> dict[int, int]:
    """For n compared values, the least number of equal ones at which P(likeness >= threshold) >= tolerance.

    The likeness has a uniform prior, so its posterior after m of n equal values is Beta(m + 1, n - m + 1).
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(log - log.max())
            if density[s >= threshold].sum() / density.sum() >= tolerance:
                out[n] = m
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks of signatures that no step of the comparison drops."""
    least = needed(threshold, tolerance)
    equal = np.zeros((len(a), len(b)), np.uint8)
    for h in range(STEP):
        equal += a[:, h, None] == b[None, :, h]
    keep = equal >= least[STEP]
    if same:
        keep &= np.triu(np.ones_like(keep), 1)
    i, j = np.nonzero(keep)
    m = equal[i, j].astype(np.int64)
    for n in range(STEP, HASHES, STEP):
        for at in range(0, len(i), 1 << 16):
            cut = slice(at, at + (1 << 16))
            m[cut] += (a[i[cut], n : n + STEP] == b[j[cut], n : n + STEP]).sum(1)
        left = m >= least[n + STEP]
        i, j, m = i[left], j[left], m[left]
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """The least index that each of n nodes is connected to."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def verified(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose exact likeness reaches the threshold."""
    keep = np.zeros(len(i), bool)
    if not len(i):
        return i, j
    vocabulary = np.unique(np.concatenate(sets))
    codes = [np.searchsorted(vocabulary, s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    mark = np.zeros(len(vocabulary), np.int32)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[order])) + 1
    for run in np.split(order, cuts):
        x = i[run[0]]
        mark[codes[x]] = 1
        for at in range(0, len(run), 1024):
            part = run[at : at + 1024]
            others = [codes[y] for y in j[part]]
            offsets = np.concatenate([[0], np.cumsum([len(o) for o in others])[:-1]])
            both = np.add.reduceat(mark[np.concatenate(others)], offsets)
            keep[part] = both >= threshold * (sizes[x] + sizes[j[part]] - both) - 1e-9
        mark[codes[x]] = 0
    return i[keep], j[keep]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first `keys` columns, from batches sorted by them."""
    held, held_key = [], None
    for batch in batches:
        if not len(batch):
            continue
        rows = list(zip(*[batch.column(k).to_pylist() for k in range(keys)]))
        start = 0
        for at in range(1, len(rows) + 1):
            if at == len(rows) or rows[at] != rows[start]:
                if held and held_key != rows[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                held_key = rows[start]
                held.append(batch.slice(start, at - start))
                start = at
    if held:
        yield pa.Table.from_batches(held)


def _compare(threshold: float, tolerance: float, exact: bool):
    """Compare the two blocks of every group; emit (key, root, linked) for the texts with a link."""
    names, types = ["key", "root", "linked"], [pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches, 3):
            first, second = group["first"][0].as_py(), group["second"][0].as_py()
            group = group.sort_by("key")
            keys, blocks = group["key"].to_pylist(), np.array(group["block"].to_pylist())
            signatures = np.stack([np.frombuffer(s, "<u4") for s in group["sig"].to_pylist()])
            left, right = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
            i, j = surviving(signatures[left], signatures[right], first == second, threshold, tolerance)
            i, j = left[i], right[j]
            copies = np.array(group["copies"].to_pylist())
            if exact:
                i, j = verified([np.frombuffer(s, "<u8") for s in group["shingles"].to_pylist()], i, j, threshold)
            linked = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
            roots = _roots(len(keys), i, j)
            out += [(keys[x], keys[roots[x]], int(linked[x])) for x in np.flatnonzero(linked).tolist()]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        columns = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _paired(members: DataFrame, weight) -> DataFrame:
    """Deal the members of every component into random blocks of bounded weight, and these to pairs of blocks.

    Only components of several blocks are looked up; they are few, and members of a large one stay where they are.
    """
    total = members.groupBy("component").agg(F.ceil(F.sum(weight) / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = attach(members, total, ["component"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = dealt.withColumn("other", other)
    return rows.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("other", "blocks")


def _in_pairs(rows: DataFrame, columns: list[str], run) -> DataFrame:
    keys = ["component", "first", "second"]
    dealt = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "key string, root string, linked long")


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (digest of the words; null without words), weight and MinHash values; written once."""
    T.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, weights, signatures = [], [], []
            for text in batch.column(2):
                tokens = T.words(text.as_py())
                found = T.shingles(tokens, SHINGLE)
                keys.append(hashlib.blake2b(b" ".join(tokens), digest_size=16).hexdigest() if tokens else None)
                weights.append(len(found))
                signatures.append(signature(found).tobytes() if tokens else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(weights, pa.int64()), pa.array(signatures, pa.binary())],
                ["doc_id", "text_hash", "key", "weight", "sig"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return settle(slim.mapInArrow(run, "doc_id long, text_hash long, key string, weight long, sig binary"))


def _shingled(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members' rows with the shingle sets of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [T.shingles(T.words(t.as_py()), SHINGLE).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "shingles"])

    wanted = members.select("key", F.col("rep").alias("_id"), F.col("rep_hash").alias("_hash"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    met = texts.join(wanted, ["_id", "_hash"]).select("key", "text")
    # A repeated row brings its text more than once; `key` is enough to keep one.
    return met.mapInArrow(run, "key string, shingles binary").dropDuplicates(["key"]).join(members, "key")


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: doc_id, text_hash, key, class_id and class_hash (least doc_id of its class and the
    text hash of that row; no hash where it is alone), n_links (documents it is alike to)."""
    base = describe(docs)
    known = base.filter("key is not null")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("rep"), F.col("text_hash").alias("rep_hash")))
    texts = known.groupBy("key").agg(
        least.alias("least"), F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"), F.first("sig").alias("sig")
    )
    texts = settle(texts.select("key", "least.*", "copies", "weight", "sig"))

    count, rows = banding(threshold)
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * 4 * rows + 1, F.lit(4 * rows)))))
    bands = settle(texts.select("key", band.alias("band")))
    heads = bands.groupBy("band").agg(F.min("key").alias("head"), F.max("key").alias("tail")).filter("head < tail")
    proposed = bands.join(heads.select("band", "head"), "band").filter("key <> head").select(F.col("key").alias("u"), F.col("head").alias("v"))
    proposed = connected_components(proposed.distinct())
    members = texts.join(proposed.withColumnRenamed("id", "key"), "key")
    compared = _paired(members, F.lit(HASHES))
    pruned = _in_pairs(compared, ["key", "block", "copies", "sig"], _compare(threshold, tolerance, False))
    kept = connected_components(pruned.filter("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")))

    members = settle(texts.join(kept.withColumnRenamed("id", "key"), "key"))
    compared = _paired(_shingled(docs, members), F.col("weight") + HASHES)
    links = settle(_in_pairs(compared, ["key", "block", "copies", "sig", "shingles"], _compare(threshold, tolerance, True)))
    joined = connected_components(links.filter("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")))

    grouped = texts.select("key", "rep", "rep_hash", "copies").join(joined.withColumnRenamed("id", "key"), "key", "left")
    linked = links.groupBy("key").agg(F.sum("linked").alias("linked"))
    told = grouped.filter("component is not null or copies > 1").join(linked, "key", "left")
    told = settle(told.withColumn("component", F.coalesce("component", "key")))
    least = told.groupBy("component").agg(F.min(F.struct(F.col("rep").alias("class_id"), F.col("rep_hash").alias("class_hash"))).alias("of"))
    side = told.join(least, "component").select("key", "of.*", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = base.select("doc_id", "text_hash", "key").join(side, "key", "left")
    return rows.select("doc_id", "text_hash", "key", F.coalesce("class_id", "doc_id").alias("class_id"), "class_hash", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One document of every class, that with the least doc_id (then text hash), with its own columns."""
    own, same = T.free_names(docs.columns, "_id", "_hash")
    found = classes(docs, threshold, tolerance).withColumn(own, F.coalesce("doc_id", F.lit(-1)))
    gone = found.filter((F.col(own) != F.col("class_id")) | (F.col("text_hash") != F.col("class_hash"))).select(own, F.col("text_hash").alias(same)).distinct()
    marked = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), same: F.xxhash64("text")})
    return marked.join(settle(gone), [own, same], "left_anti").dropDuplicates([own, same]).select(*docs.columns)
