"""The language model against sums over all state paths, plain counts and held-out text, and its defined cases."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelgrid.llm import hidden_markov as H
from levelgrid.llm import queries

SF = "/root/testdata/sf0.01"


def toy(states=3, classes=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = lambda *shape: (lambda v: v / v.sum(-1, keepdims=True))(rng.uniform(0.1, 1, shape))
    return H.Model(rows(states), rows(states, states), rows(states, classes).T.copy(), np.full(classes, 1 / classes), np.ones(classes))


def paths(model, sequence):
    """(states, chance of states and sequence) of every path."""
    for states in itertools.product(range(len(model.start)), repeat=len(sequence)):
        p = model.start[states[0]] * model.emit[sequence[0], states[0]]
        for a, b, seen in zip(states, states[1:], sequence[1:]):
            p *= model.step[a, b] * model.emit[seen, b]
        yield states, p


TEXTS = [[0, 1, 3, 3, 2, 0, 1], [2], [1, 1], [3, 0, 2, 2, 1]]
CLASSES, STARTS = np.concatenate(TEXTS), np.cumsum([0, *map(len, TEXTS)])


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_all_paths(segment):
    model = toy()
    found = H.log_likelihoods(model, CLASSES, STARTS, segment)
    assert np.allclose(found, [math.log(sum(p for _, p in paths(model, t))) for t in TEXTS])
    begin, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for text in TEXTS:
        total = sum(p for _, p in paths(model, text))
        for states, p in paths(model, text):
            begin[states[0]] += p / total
            for a, b in zip(states, states[1:]):
                moves[a, b] += p / total
            for s, seen in zip(states, text):
                emits[seen, s] += p / total
    got = H.expectations(model, CLASSES, STARTS, segment)
    assert np.allclose(got[0], begin) and np.allclose(got[1], moves) and np.allclose(got[2], emits)
    assert np.isclose(got[3], found.sum())


def test_segments_do_not_change_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    model = toy(5, 30)
    classes, starts = rng.integers(0, 30, 9000), np.array([0, 4000, 4001, 4700, 9000])
    whole = H.expectations(model, classes, starts, 10_000)
    monkeypatch.setattr(H, "CHUNK", 500)
    parts = H.expectations(model, classes, starts, 64)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts))
    assert np.allclose(H.log_likelihoods(model, classes, starts, 64).sum(), whole[3])


def words_of(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)) + [None]


def test_counts_and_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("known", F.lit("clash"))
    texts = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for r in texts if not held(r.doc_id) for w in words_of(r.text))
    total = sum(count.values())
    below = math.log10(total + 0.1 * (len(count) + 1))
    want = {r.doc_id: (held(r.doc_id), len(words_of(r.text)), sum(count[w] > 0 for w in words_of(r.text)), total) for r in texts}
    base = {r.doc_id: sum(math.log10(count[w] + 0.1) - below for w in words_of(r.text)) for r in texts}
    found = H.score(docs, queries._fold("doc_id", 10) == 0).collect()
    assert {r.doc_id: tuple(r[1:5]) for r in found} == want
    assert all(math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9) for r in found)
    # Text that was not learned from is likelier under the states than word by word.
    unseen = [r for r in found if r.held_out]
    assert sum(r.score for r in unseen) > 0.95 * sum(r.base_score for r in unseen)
    assert np.mean([r.score > r.base_score for r in unseen]) > 0.9


def test_chances_sum_to_one(spark, frame):
    """Over all known words, one unknown word a shared class and nothing else, in every state."""
    texts = ["a b c a the end", "the a the b", "b c", "zz yy the", None]
    docs = frame("doc_id long, text string", [{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    table = H.blocks(docs, F.lit(False))
    words = H.counts(table, own=3)
    assert {r.term.decode() if isinstance(r.term, bytes) else bytes(r.term).decode(): (r.n, r["class"] < 3) for r in words.collect()}[" "] == (5, True)
    model = H.train(H.coded(table, words, 3), words, 2, 3, 2, 2)
    chance = np.zeros(2)
    for r in words.collect():
        chance += model.emit[r["class"]] * (r.n + (H.ADD if r["class"] >= 3 else H.ADD)) / model.norm[r["class"]]
    chance += (model.emit[3:] * (H.ADD / model.norm[3:, None])).sum(0)
    assert np.allclose(chance, 1) and np.allclose(model.step.sum(1), 1) and np.isclose(model.start.sum(), 1)


def test_rounds_never_lose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = H.blocks(docs, F.lit(False))
    words = H.counts(table)
    share, norm = H.class_shares(words)
    every, model, before = H.coded(table, words), H.blank(share, norm, 4), -np.inf
    for _ in range(4):
        model, now = H.improved(every, model)
        assert now > before - 1
        before = now


def test_cases(spark, edge_docs, no_docs):
    found = H.score(edge_docs, F.col("doc_id") == 4, first_rounds=1, rounds=1).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0][2:4] == (1, 1) and by[1][0].score == by[2][0].score  # null and empty: the end alone
    assert by[3][0] == by[3][1] and len(by[None]) == 1
    assert by[4][0].held_out and by[4][0][2:4] == (3, 1)
    assert by[5][0].n_tokens == 60_001 and by[5][0].train_tokens == 60_001 + 1 + 1 + 4 + 4 + 6
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert H.score(no_docs, F.lit(False)).collect() == []
    unlearned = H.score(edge_docs, F.lit(True)).collect()
    assert len(unlearned) == 7 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in unlearned)


def test_long_words_are_held_by_digest(frame):
    a, b = H.held(b"x" * 5000), H.held(b"x" * 5001)
    assert a != b and len(a) == 65 and a[:1] == H.END and H.held(b"x" * 64) == b"x" * 64
    assert H.tokens("É Ab\x0bC\x1cd".encode()) == ["É".encode(), b"ab", b"c\x1cd", b" "]
    docs = frame("doc_id long, text string", [{"doc_id": 1, "text": "y" * 70 + " " + "y" * 70}, {"doc_id": 2, "text": "y" * 71}])
    found = {bytes(r.term): r.n for r in H.counts(H.blocks(docs, F.lit(False))).collect()}
    assert found == {H.held(b"y" * 70): 2, H.held(b"y" * 71): 1, H.END: 2}
