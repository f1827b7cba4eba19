"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subword grams (2 to 4 code points within a word and its borders,
hashed into a table); a linear layer and a softmax give the languages. Trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows. A temperature fitted on held-back rows calibrates the score.

A text is rejected by the share of its grams that stand in no learned row, whatever its score: a softmax is
sure of foreign texts, and unsure of mixed texts of learned languages, whose grams are all known. The bound on
the share of known grams comes from the rows themselves, each against all others (learned) and against those
of other languages (as if its own had not been learned).

Defined cases: a null text, or one without letters, is `und` with score 0 and rejected; with nothing to learn
from, all texts are `und`; ties between languages go to the first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.llm import text as T

BUCKETS = 1 << 16
WIDTH = 16
ORDERS = (2, 3, 4)
# Labelled rows per language that are learned from, at about this many, and the longest text among them.
SAMPLE_ROWS = 600
SAMPLE_CHARS = 20_000
EPOCHS = 6
# Grams known from learning are bits of a table of this size; the embeddings' buckets are its low bits.
SEEN = 1 << 22
# Share of learned rows that the threshold may reject, and share of the rows of every left-out language that it
# should catch; it lies between the two bounds, or at the first where they cross.
REJECT = 0.005
CATCH = 0.95
SEED = 7

UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None, orders=ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every gram that lies within a word and its borders."""
    codes = T.codes((text or "").lower())
    inside = letter_table()[codes] if len(codes) else np.zeros(0, bool)
    if not inside.any():
        return np.zeros(0, np.int64)
    # Runs of other characters become one border.
    keep = inside | np.concatenate([[True], inside[:-1]])
    codes = np.where(inside, codes, 32)[keep]
    codes = np.concatenate([[32], codes, [32]]) if codes[0] != 32 else np.concatenate([codes, [32]])
    border = codes == 32
    sums, found = T.prefix_sums(codes), []
    for k in orders:
        hashes = T.grams(sums, k)
        if k > 2:
            crossing = np.zeros(len(hashes), bool)
            for j in range(1, k - 1):
                crossing |= border[j : j + len(hashes)]
            hashes = hashes[~crossing]
        found.append(hashes & np.uint64(buckets - 1))
    return np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    """Languages, the product of embeddings and output layer (bucket by language), temperature, least share of
    known grams, bits of the known grams."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray

    def logits(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids & (len(self.table) - 1)].sum(0, dtype=np.float64) / len(ids) + self.bias

    def known(self, ids: np.ndarray) -> float:
        """Share of the grams that stand in a learned row."""
        return float((self.seen[ids >> 3] >> (ids & 7) & 1).mean())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        ids = features(text, buckets=SEEN)
        if not len(ids) or not self.langs:
            return UNKNOWN, 0.0, True
        p = _softmax(self.logits(ids) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), self.known(ids) < self.threshold


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def knowledge(docs: list[tuple[np.ndarray, np.ndarray, int]], reject: float = REJECT, catch: float = CATCH) -> tuple[np.ndarray, float]:
    """Bits of all grams of the (grams, counts, language) rows, and the least share of known grams to ask for.

    A row's grams are known if they stand in another row; without its language, if in a row of another one.
    The threshold lies halfway between that which rejects `catch` of every left-out language and that which
    rejects `reject` of the rows, and never over the latter.
    """
    grams = np.concatenate([g for g, *_ in docs])
    counts = np.concatenate([c for _, c, _ in docs])
    doc = np.repeat(np.arange(len(docs)), [len(g) for g, *_ in docs])
    truth = np.array([lang for *_, lang in docs])
    every, at = np.unique(grams, return_inverse=True)
    rows = np.bincount(at)[at]
    _, own = np.unique(at * (truth.max() + 1) + truth[doc], return_inverse=True)
    own = np.bincount(own)[own]
    total = np.bincount(doc, counts)
    among = np.sort(np.bincount(doc, counts * (rows > 1)) / total)
    without = np.bincount(doc, counts * (rows > own)) / total
    threshold = float(among[int(reject * len(among))])
    if truth.min() != truth.max():
        # Just over the share of the last row to be caught.
        caught = max(np.quantile(without[truth == lang], catch, method="higher") for lang in np.unique(truth))
        threshold = min(threshold, (threshold + float(np.nextafter(caught, 2))) / 2)
    bits = np.zeros(SEEN, bool)
    bits[every] = True
    return np.packbits(bits, bitorder="little"), threshold


def train(rows: list[tuple[str, str]], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, reject: float = REJECT) -> Model:
    """Learn from (text, language) rows; every fifth row is held back to calibrate the score."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(SEED)
    docs, whole = [], []
    for text, lang in rows:
        ids = features(text, buckets=SEEN)
        if len(ids):
            whole.append((*np.unique(ids, return_counts=True), langs.index(lang)))
            ids &= buckets - 1
            unique, counts = np.unique(ids, return_counts=True)
            docs.append((unique, (counts / len(ids)).astype(np.float32), langs.index(lang)))
    if not docs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 1.0, np.zeros(SEEN >> 3, np.uint8))
    order = rng.permutation(len(docs))
    held = [docs[i] for i in order[::5]] if len(docs) >= 20 else docs
    used = [docs[i] for j, i in enumerate(order) if j % 5] if len(docs) >= 20 else docs
    embed = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    out, bias = np.zeros((width, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, done = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            ids, weights, lang = used[i]
            rate = np.float32(0.5 * (1 - done / steps))
            done += 1
            hidden = weights @ embed[ids]
            slope = _softmax(hidden @ out + bias)
            slope[lang] -= 1
            back = out @ slope
            out -= rate * np.outer(hidden, slope)
            bias -= rate * slope
            # The mean has many terms of small weight; the row's own scale keeps rare grams learning.
            embed[ids] -= rate * 20 * weights[:, None] * back
    table = embed @ out
    logits = np.array([w @ table[ids] + bias for ids, w, _ in held])
    truth = np.array([lang for *_, lang in held])
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    seen, threshold = knowledge(whole, reject)
    return Model(langs, table.astype(np.float32), bias, float(temperature), threshold, seen)


def spread(column: Column) -> Column:
    """A number in [0, 1) from a column, the same on every run."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 20)) / F.lit(float(1 << 20))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """About `rows` labelled rows per language, chosen by a hash of doc_id, with texts of at most `chars`."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= chars))
    counts = usable.groupBy("lang").count().limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError("over 1000 languages: the sample has no bound")
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], rows / r["count"])])
    chosen = usable.filter(spread(F.col("doc_id")) < share[F.col("lang")]).select("text", "lang")
    return sorted((r["text"], r["lang"]) for r in chosen.limit(2 * rows * len(counts)).collect())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score and rejected to doc_id. The model is a table of fixed size, sent to every task once."""
    T.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with their own columns.

    A model that has learned no language would reject all of them: an error, unless there are none.
    """
    if not model.langs and not docs.isEmpty():
        raise ValueError("no language was learned: documents with a text and a language are needed")
    T.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not sent.value.predict(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
