"""A hidden Markov language model, trained by Baum-Welch over all training documents.

Every frequent word is a class of its own, all other words share a class with those that end alike. Hidden states
emit classes, and a class emits its words by their counts, so the model covers any vocabulary with a bounded number
of parameters: P(word | state) = P(class | state) * (c + 0.1) / D, where D sums c + 0.1 over the known words of the
class and 0.1 for all unknown ones. Word counts are exact and come from all training documents.

Expected counts of states, transitions and emissions are added up in each task and summed across tasks; a round of
Baum-Welch is one job. A text is scored by the scaled forward recursion over the whole sequence. Long texts are cut
into segments that are walked side by side: the matrix from the states before a segment to those behind it joins
them exactly, forward and backward.

Documents are read in blocks of bounded size; a block asks for the counts of its distinct words once, so that a
frequent word costs a row per block and not one per document.

Defined cases: null and empty texts are the end token alone; without training documents all words are unknown and the
model is the uniform one over classes; repeated rows and rows without an id count as often as they stand; an
empty table gives no rows; other columns are not read. Words over 64 bytes are held by their SHA-256.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.llm import text as T
from levelgrid.session import settle

STATES = 8
# At most so many frequent words are classes of their own; the others fall into so many classes by their ending.
OWN = 20_000
SHARED = 4096
ENDING = 3
# Rounds of Baum-Welch, each over all training documents: so many from the corpus shares, then so many more.
FIRST_ROUNDS = 5
ROUNDS = 3
# Pseudo-counts: of a known word, of each transition, and of the class shares of the corpus in each state.
ADD = 0.1
ADD_STEP = 1.0
ADD_EMIT = 500.0
STAY = 0.9
SEED = 29
# Tokens of a segment, and those walked in one go; rows and text bytes of a block.
SEGMENT = 1024
CHUNK = 1 << 19
BLOCK_ROWS = 1 << 15
BLOCK_BYTES = 24 << 20
# Expected counts are summed as whole parts of this size, so that their order does not matter.
PART = 1024
WORD_BYTES = 64
END = b" "

_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, starts array<int>, size long, ids binary, terms array<binary>, shapes array<int>, total array<long>"
_CODED = "block long, doc_ids array<long>, held array<boolean>, starts array<int>, size long, classes binary, known array<long>, logs array<double>"


@dataclass
class Model:
    """start (states), step (from, to), emit (class, state); share of the corpus and normalizer of every class."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    share: np.ndarray
    norm: np.ndarray

    def cast(self, kind) -> "Model":
        return Model(self.start.astype(kind), self.step.astype(kind), self.emit.astype(kind), self.share, self.norm)


# --- recursions over one block ---------------------------------------------------------------------------------


def _walk(model: Model, classes: np.ndarray, first: np.ndarray, widths: np.ndarray, ahead: np.ndarray, keep: bool):
    """Scaled forward recursion of many segments at once, the longest first.

    `ahead` holds the chances of the states before each segment's first token, and behind its last one on return.
    Gives the log likelihood of every segment and, where asked for, the states after each token, its class and scale.
    """
    logs, kept, at = np.zeros(len(first)), [], first.copy()
    scale, ones = np.ones(len(first)), np.ones(len(model.start), model.start.dtype)
    for t, w in enumerate(widths):
        seen = classes.take(at[:w])
        at += 1
        now = model.emit.take(seen, axis=0)
        now *= ahead[:w]
        size = now @ ones
        now /= size[:, None]
        scale[:w] *= size
        if t % 8 == 7:
            logs[:w] += np.log(scale[:w])
            scale[:w] = 1
        np.matmul(now, model.step, out=ahead[:w])
        if keep:
            kept.append((now, seen, size))
    return logs + np.log(scale), kept


def _widths(size: np.ndarray) -> np.ndarray:
    """How many of the segments, sorted from long to short, have a token at each place."""
    return np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")


class _Segments:
    """Segments of the documents of a block, and the states at their borders."""

    def __init__(self, model: Model, classes: np.ndarray, starts: np.ndarray, segment: int, back: bool):
        size = np.diff(starts)
        parts = -(-size // segment)
        self.base = np.cumsum(parts) - parts
        self.doc = np.repeat(np.arange(len(size)), parts)
        number = np.arange(len(self.doc)) - self.base[self.doc]
        self.first = starts[:-1][self.doc] + number * segment
        self.size = np.minimum(segment, starts[1:][self.doc] - self.first)
        self.last = number == parts[self.doc] - 1
        k = len(model.start)
        self.ahead = np.tile(model.start, (len(self.doc), 1))
        self.behind = np.ones_like(self.ahead)
        long = np.flatnonzero((parts > 1)[self.doc])
        if not len(long):
            return
        # One walk from each state gives the matrix over a segment.
        order = long[np.argsort(-self.size[long], kind="stable")]
        rows = np.repeat(order, k)
        over = np.tile(np.eye(k, dtype=model.start.dtype), (len(order), 1))
        logs, _ = _walk(model, classes, self.first[rows], _widths(self.size[rows]), over, False)
        logs = logs.reshape(-1, k)
        over = over.reshape(-1, k, k) * np.exp(logs - logs.max(1, keepdims=True))[:, :, None].astype(over.dtype)
        matrix = np.zeros((len(self.doc), k, k), over.dtype)
        matrix[order] = over
        for n in range(1, int(parts.max())):
            at = self.base[parts > n] + n
            moved = np.einsum("di,dij->dj", self.ahead[at - 1], matrix[at - 1])
            self.ahead[at] = moved / moved.sum(1, keepdims=True)
        for n in range(int(parts.max()) - 1, 0, -1) if back else ():
            at = self.base[parts > n] + n
            moved = np.einsum("dij,dj->di", matrix[at], self.behind[at])
            self.behind[at - 1] = moved / moved.sum(1, keepdims=True)

    def chunks(self, tokens: int) -> Iterator[np.ndarray]:
        """The segments from long to short, in runs of bounded tokens."""
        order = np.argsort(-self.size, kind="stable")
        run = np.cumsum(self.size[order]) // tokens
        yield from np.split(order, np.flatnonzero(np.diff(run)) + 1)


def log_likelihoods(model: Model, classes: np.ndarray, starts: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Natural log likelihood of the class sequence of every document of a block."""
    cut = _Segments(model, classes, starts, segment, False)
    out = np.zeros(len(starts) - 1)
    for at in cut.chunks(CHUNK):
        logs, _ = _walk(model, classes, cut.first[at], _widths(cut.size[at]), cut.ahead[at], False)
        np.add.at(out, cut.doc[at], logs)
    return out


def expectations(model: Model, classes: np.ndarray, starts: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states, transitions and emissions over the documents, and their log likelihood."""
    k = len(model.start)
    begin, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    cut = _Segments(model, classes, starts, segment, True)
    opens = cut.first == starts[:-1][cut.doc]
    for at in cut.chunks(CHUNK):
        widths = _widths(cut.size[at])
        logs, kept = _walk(model, classes, cut.first[at], widths, cut.ahead[at], True)
        total += logs.sum()
        rest, ends, posts = cut.behind[at], cut.last[at], []
        for t in range(len(widths) - 1, -1, -1):
            now, seen, size = kept[t]
            w, after = widths[t], widths[t + 1] if t + 1 < len(widths) else 0
            coming = rest[:w] @ model.step.T
            if after < w:
                # Where a segment ends its chances are brought to a sum of one; the scales keep them there.
                own = np.einsum("ij,ij->i", now[after:], coming[after:])[:, None]
                coming[after:] /= own
                rest[after:w] /= own
            post = now * coming
            posts.append(post)
            if after < w:
                # A document's last token is followed by nothing.
                now[after:][ends[after:w]] = 0
            moves += now.T @ rest[:w]
            coming *= model.emit.take(seen, axis=0)
            np.divide(coming, size[:, None], out=rest[:w])
        begin += posts[-1][opens[at]].sum(0)
        seen = np.concatenate([s for _, s, _ in kept[::-1]])
        posts = np.concatenate(posts)
        for state in range(k):
            emits[:, state] += np.bincount(seen, posts[:, state], len(emits))
    return begin, moves * model.step, emits, float(total)


def maximized(model: Model, begin: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
    """The model that fits the expected counts, smoothed."""
    start = (begin + ADD_STEP) / (begin + ADD_STEP).sum()
    step = (moves + ADD_STEP) / (moves + ADD_STEP).sum(1, keepdims=True)
    emit = emits + ADD_EMIT * model.share[:, None]
    return Model(start, step, emit / emit.sum(0), model.share, model.norm)


def blank(share: np.ndarray, norm: np.ndarray, states: int = STATES) -> Model:
    """States that differ by chance only and like to stay."""
    noise = np.random.default_rng(SEED).uniform(0.5, 1.5, (len(share), states))
    emit = share[:, None] * noise
    step = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(step, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(0), share, norm)


# --- words, counts and classes ---------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tokens(text: bytes) -> list[bytes]:
    """Words of a text between white space with A-Z lower-cased, and the end."""
    found = text.lower().split()
    found.append(END)
    return found


def held(word: bytes) -> bytes:
    """What stands for a word in the tables: a long one is held by its digest, behind a blank that no word has."""
    return word if len(word) <= WORD_BYTES else END + hashlib.sha256(word).hexdigest().encode()


def shape(word: bytes, shared: int = SHARED) -> int:
    """The class among the shared ones, by the last bytes."""
    return zlib.crc32(word[-ENDING:]) % shared


def _one_list(values, kind) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _pack(values: np.ndarray) -> pa.Array:
    return pa.array([pa.compress(values.tobytes(), "zstd", asbytes=True)], pa.binary())


def _unpack(blob: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, size * np.dtype(kind).itemsize, "zstd"), kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every run of documents that is bounded in rows and bytes, its words numbered by first place."""
    block = TaskContext.get().partitionId() << 32

    def row():
        codes = np.frombuffer(ids, np.int32)
        counted = np.repeat(~np.array(out, bool), np.diff(starts))
        total = np.bincount(codes[counted], minlength=len(numbers)).astype(np.int64)
        shapes = np.array([shape(w) for w in numbers], np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), _one_list(doc_ids, pa.int64()), _one_list(out, pa.bool_()), _one_list(np.array(starts, np.int32), pa.int32()), pa.array([len(codes)], pa.int64()),
                _pack(codes), _one_list([held(w) for w in numbers], pa.binary()), _one_list(shapes, pa.int32()), _one_list(total, pa.int64()),
            ],
            ["block", "doc_ids", "held", "starts", "size", "ids", "terms", "shapes", "total"],
        )

    doc_ids, out, starts, ids, numbers, size = [], [], [0], array("i"), _Numbers(), 0
    for batch in batches:
        for doc_id, left, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            text = text.as_py()
            ids.extend(map(numbers.__getitem__, tokens(text)))
            doc_ids.append(doc_id)
            out.append(left)
            starts.append(len(ids))
            size += len(text)
            if len(out) >= BLOCK_ROWS or size >= BLOCK_BYTES:
                yield row()
                block += 1
                doc_ids, out, starts, ids, numbers, size = [], [], [0], array("i"), _Numbers(), 0
    if out:
        yield row()


def blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """The documents in blocks, each with its words, their numbers in it and their counts in training documents."""
    T.bound_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text.alias("text"))
    return settle(slim.mapInArrow(_blocks, _BLOCKS))


def _block_terms(table: DataFrame) -> DataFrame:
    each = table.select("block", F.posexplode(F.arrays_zip("terms", "shapes", "total")).alias("at", "e"))
    return each.select("block", "at", F.col("e.terms").alias("term"), F.col("e.shapes").alias("shape"), F.col("e.total").alias("n"))


def counts(table: DataFrame, own: int = OWN) -> DataFrame:
    """term, n and class of every word of the training documents, settled."""
    words = settle(_block_terms(table).filter("n > 0").groupBy("term").agg(F.sum("n").alias("n"), F.min("shape").alias("shape")))
    # The least count of words that get a class of their own, at the edge of a bin of counts: a few hundred rows.
    fine = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(((r["bin"], r["words"]) for r in words.groupBy(fine.alias("bin")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    edge, room = None, own
    for at, held in bins:
        room -= held
        if room < 0:
            break
        edge = at
    frequent = words.filter(fine >= edge) if edge is not None else words.limit(0)
    # At most `own` rows are numbered in one task and sent to every task.
    numbered = frequent.select(F.col("term").alias("_t"), (F.row_number().over(W.orderBy(F.desc("n"), "term")) - 1).alias("_c"))
    joined = words.join(F.broadcast(numbered), F.col("term") == F.col("_t"), "left")
    return settle(joined.select("term", "n", F.coalesce("_c", F.col("shape") + own).cast("int").alias("class")))


def class_shares(words: DataFrame, own: int = OWN, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Share of the corpus and normalizer of every class. At most own + shared rows reach the driver."""
    norm = np.zeros(own + shared)
    norm[own:] = ADD
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        norm[r["class"]] = r["n"] + ADD * (r["v"] + (r["class"] >= own))
    return norm / norm.sum(), np.where(norm > 0, norm, 1.0)


def _coded(own: int):
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for at in range(table.num_rows):
            value = lambda name: table.column(name)[at]
            starts = value("starts").values.to_numpy(zero_copy_only=False)
            ids = _unpack(value("ids").as_py(), value("size").as_py(), np.int32)
            classes = value("shapes").values.to_numpy(zero_copy_only=False) + own
            n = np.zeros(len(classes), np.int64)
            where = found.column("at").to_numpy()
            classes[where], n[where] = found.column("class").to_numpy(), found.column("n").to_numpy()
            logs = np.log10(n + ADD)
            known = np.add.reduceat((n > 0)[ids].astype(np.int64), starts[:-1])
            sums = np.add.reduceat(logs[ids], starts[:-1])
            out.append(
                pa.table(
                    [
                        pa.array([value("block").as_py()], pa.int64()), pa.array([value("doc_ids")], pa.list_(pa.int64())), pa.array([value("held")], pa.list_(pa.bool_())),
                        _one_list(starts, pa.int32()), pa.array([len(ids)], pa.int64()), _pack(classes[ids].astype(np.uint16)), _one_list(known, pa.int64()), _one_list(sums, pa.float64()),
                    ],
                    names=["block", "doc_ids", "held", "starts", "size", "classes", "known", "logs"],
                )
            )
        return pa.concat_tables(out) if out else _NO_CODES

    return run


_NO_CODES = pa.table(
    [pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()))],
    names=["block", "doc_ids", "held", "starts", "size", "classes", "known", "logs"],
)


def coded(table: DataFrame, words: DataFrame, own: int = OWN) -> DataFrame:
    """The blocks as class sequences, with every document's known words and its sum of log10(c + 0.1), settled."""
    asked = _block_terms(table).select(F.col("block").alias("b"), "at", "term").join(words, "term").select("b", "at", "n", "class")
    slim = table.select("block", "doc_ids", "held", "starts", "size", "ids", "shapes")
    return settle(slim.groupBy("block").cogroup(asked.groupBy("b")).applyInArrow(_coded(own), _CODED))


# --- training and scoring --------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(batch.num_rows):
            value = lambda name: batch.column(batch.schema.get_field_index(name))[at]  # noqa: E731, B023
            starts = value("starts").values.to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch, at, _unpack(value("classes").as_py(), value("size").as_py(), np.uint16).astype(np.intp), starts


def _chosen(classes: np.ndarray, starts: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a block that are taken."""
    size = np.diff(starts)
    return classes[np.repeat(take, size)], np.concatenate([[0], np.cumsum(size[take])])


def improved(table: DataFrame, model: Model) -> tuple[Model, float]:
    """One round of Baum-Welch over the training documents of all blocks, and their log likelihood before it."""
    k, c = len(model.start), len(model.emit)
    sent = table.sparkSession.sparkContext.broadcast(model.cast(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((c + k + 2, k))
        for batch, at, classes, starts in _rows(batches):
            classes, starts = _chosen(classes, starts, ~np.array(batch.column(0)[at].as_py(), bool))
            if not len(classes):
                continue
            begin, moves, emits, total = expectations(sent.value, classes, starts)
            sums[:c] += emits
            sums[c : c + k] += moves
            sums[c + k] += begin
            sums[c + k + 1, 0] += total
        whole = np.rint(sums * PART).astype(np.int64)
        used = np.flatnonzero(whole.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(whole[used, i]) for i in range(k)]], ["row", *[f"n{i}" for i in range(k)]])

    parts = table.select("held", "starts", "size", "classes").mapInArrow(run, "row int, " + ", ".join(f"n{i} long" for i in range(k)))
    sums = np.zeros((c + k + 2, k))
    # One row a class and state.
    for r in parts.groupBy("row").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]).collect():
        sums[r["row"]] = [r[f"n{i}"] / PART for i in range(k)]
    return maximized(model, sums[c + k], sums[c : c + k], sums[:c]), float(sums[c + k + 1, 0])


def train(table: DataFrame, words: DataFrame, states: int = STATES, own: int = OWN, rounds: int = ROUNDS, first_rounds: int = FIRST_ROUNDS) -> Model:
    """Baum-Welch over all training documents in every round."""
    share, norm = class_shares(words, own)
    model = blank(share, norm, states)
    flags = F.aggregate("held", F.lit(0).cast("long"), lambda n, h: n + F.when(h, 0).otherwise(1))
    docs = table.select(F.sum(flags).alias("n")).first()["n"] or 0
    if not docs:
        return model
    for _ in range(first_rounds + rounds):
        model, _ = improved(table, model)
    return model


def scored(table: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, kinds = int(sums["n"] or 0), int(sums["v"])
    below = float(np.log10(total + ADD * (kinds + 1)))
    sent = table.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = np.log10(sent.value.norm)
        for batch, at, classes, starts in _rows(batches):
            size = np.diff(starts)
            logs = batch.column("logs")[at].values.to_numpy()
            # Rounded, so that equal texts score alike wherever they stand among others.
            found = log_likelihoods(sent.value, classes, starts) / np.log(10) + logs - np.add.reduceat(norm[classes], starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_ids")[at].values, batch.column("held")[at].values, pa.array(size, pa.int64()), batch.column("known")[at].values,
                    pa.array(np.full(len(size), total), pa.int64()), pa.array(logs - size * below), pa.array(np.round(found, 9)),
                ],
                names,
            )

    return table.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """Train on the documents that are not held out, and score all of them."""
    table = blocks(docs, held_out)
    words = counts(table, options.get("own", OWN))
    sequences = coded(table, words, options.get("own", OWN))
    return scored(sequences, words, train(sequences, words, **options))
