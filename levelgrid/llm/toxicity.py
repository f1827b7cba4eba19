"""Toxicity by a linear classifier on character grams, scaled by naive Bayes log-count ratios.

A text is the set of hashed grams (3 to 6 code points) of its lower-cased letters. Each gram is scaled by the
log ratio of its share in toxic and other texts, and a logistic regression on the scaled grams gives the score
(Wang and Manning, ACL 2012). Trained on a bounded sample of labelled rows.

Defined cases: null and empty texts get the score of the bias; without labels of both kinds all scores are the
share of toxic labels (0 where there are none); repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.llm import text as T
from levelgrid.llm.langid import letter_table, spread

BUCKETS = 1 << 20
ORDERS = (3, 4, 5, 6)
# Labelled rows of each kind that are learned from, at about this many, and the longest text among them.
SAMPLE_ROWS = 2500
SAMPLE_CHARS = 20_000
# A gram must stand in so many sampled texts, and lean this much to one side.
LEAST_TEXTS = 8
LEAST_RATIO = 0.7
EPOCHS = 12
SEED = 11


def features(text: str | None, orders=ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every gram of the lower-cased text, with runs of other characters than letters as one blank."""
    codes = T.codes((text or "").lower())
    if not len(codes):
        return np.zeros(0, np.int64)
    inside = letter_table()[codes]
    keep = inside | np.concatenate([[True], inside[:-1]])
    codes = np.concatenate([[32], np.where(inside, codes, 32)[keep], [32]])
    sums = T.prefix_sums(codes)
    return np.concatenate([T.grams(sums, k) & np.uint64(buckets - 1) for k in orders]).astype(np.int64)


@dataclass
class Model:
    """The weight of every bucket (ratio times slope) and the bias."""

    weights: np.ndarray
    used: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        ids = features(text)
        ids = np.unique(ids[self.used[ids]])
        return float(1 / (1 + np.exp(-np.clip(self.weights[ids].sum(dtype=np.float64) + self.bias, -500, 500))))


def train(rows: list[tuple[str, int]], prior: float | None = None, buckets: int = BUCKETS, least: int = LEAST_TEXTS, epochs: int = EPOCHS) -> Model:
    """Learn from (text, label) rows. `prior` is the share of toxic rows where the sample was balanced."""
    labels = np.array([y for _, y in rows], bool)
    share = float(labels.mean()) if len(rows) else 0.0
    prior = share if prior is None else prior
    none = np.zeros(buckets, bool)
    if not len(rows) or labels.all() or not labels.any():
        return Model(np.zeros(buckets, np.float32), none, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    sets = [np.unique(features(text, buckets=buckets)).astype(np.int32) for text, _ in rows]
    counts = np.zeros((2, buckets))
    for ids, y in zip(sets, labels):
        counts[int(y), ids] += 1
    ratio = np.log((counts[1] + 1) / (labels.sum() + 2)) - np.log((counts[0] + 1) / ((~labels).sum() + 2))
    used = (counts.sum(0) >= least) & (np.abs(ratio) >= LEAST_RATIO)
    sets = [ids[used[ids]] for ids in sets]
    scaled = ratio.astype(np.float32)
    slope, bias = np.zeros(buckets, np.float32), 0.0
    rng, steps, done = np.random.default_rng(SEED), epochs * len(sets), 0
    for _ in range(epochs):
        for i in rng.permutation(len(sets)):
            ids = sets[i]
            rate = 0.3 * (1 - done / steps) + 1e-3
            done += 1
            x = scaled[ids]
            size = max(1.0, float(x @ x))
            z = float(slope[ids] @ x) + bias
            miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[i]
            slope[ids] -= np.float32(rate * miss * 8 / size) * x + np.float32(rate * 1e-4) * slope[ids]
            bias -= 0.05 * rate * miss
    # The sample is balanced by design; the bias is moved to the share of the corpus.
    odds = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    return Model(np.where(used, slope * scaled, 0).astype(np.float32), used, bias + odds(prior) - odds(share))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[tuple[str, int]], float | None]:
    """About `rows` labelled texts of each kind, chosen by a hash of doc_id, and the share of toxic labels."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return [], None
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, rows / n)])
    # At most a few thousand ids: small enough to go to every task.
    chosen = known.filter(spread(F.col("doc_id")) < share[F.col("toxic")]).limit(4 * rows)
    found = (
        docs.filter(F.col("text").isNotNull() & (F.length("text") <= chars))
        .join(F.broadcast(chosen), "doc_id")
        .select("text", "toxic")
        .limit(4 * rows)
        .collect()
    )
    return sorted((r["text"], r["toxic"]) for r in found), counts.get(1, 0) / sum(counts.values())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with score and predicted. The model has a fixed size and is sent to every task once."""
    T.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([sent.value.score(t.as_py()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array(found >= 0.5).cast(pa.int32())], ["doc_id", "score", "predicted"]
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not scored toxic, with their own columns.

    A model that has learned from toxic labels alone would drop all of them: an error, unless there are none.
    """
    if model.bias >= 0 and not model.used.any() and not docs.isEmpty():
        raise ValueError("no classifier was learned: labels of both kinds are needed")
    T.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
