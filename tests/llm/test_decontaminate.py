import numpy as np
import pytest

from levelgrid.llm import decontaminate as D
from levelgrid.llm.text import words


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        tokens, hit, found = words(text), set(), set()
        for item_id, t in items:
            w = words(t)
            size = min(window, len(w))
            for s in range(len(w) - size + 1 if w else 0):
                for p in range(len(tokens) - size + 1):
                    if tokens[p : p + size] == w[s : s + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item_id))
        out.append((doc_id, len(tokens), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("sent", [D.SENT_TERMS, 0])
def test_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(D, "SENT_TERMS", sent)
    rng = np.random.default_rng(4)
    line = lambda n: " ".join(("a", "b", "c", "rare", "éx")[i] for i in rng.choice(5, n, p=[0.4, 0.3, 0.2, 0.05, 0.05]))
    items = [(i, line(int(rng.integers(0, 9)))) for i in range(30)]
    docs = [(i, line(int(rng.integers(0, 60))) + " " + items[i % 30][1]) for i in range(80)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.report(*frames, window=4)) == brute(docs, items, 4)


def test_edge_cases(spark, frame, edge_docs, no_docs):
    items = [(1, None), (2, ""), (3, "two THREE"), (3, "two three"), (None, "***"), (7, " ".join(["word"] * 12))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    short = [r for r in rows if len(r[1] or "") < 1000]
    found = got(D.report(edge_docs, benchmark))
    assert [r for r in found if r[0] != 5] == brute(short, items, D.WINDOW)
    assert [r for r in found if r[0] == 5] == [(5, 60_000, 60_000, 1, "7", True)]
    kept = D.keep_uncontaminated(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "None"]
    assert D.report(no_docs, benchmark).collect() == []
    assert not any(r.contaminated for r in D.report(edge_docs, benchmark.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x red y green z blue"), (2, "red q q q q q q q green blue"), (3, "blue green red"), (4, "red green")], "doc_id long, text string")
    items = D.tests(spark.createDataFrame([(9, "red green blue")], "item_id long, text string"))
    index = D.build_index(docs)
    found = D.proximity_matches(index, items, slop=2).join(index.select("row_id", "doc_id"), "row_id")
    assert sorted((r.doc_id, r.n_hit) for r in found.filter("n_hit > 0").collect()) == [(1, 5), (3, 3)]


def test_proximity_spans_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        tokens, w, slop = rng.integers(-1, 3, 14), rng.integers(0, 3, 3), int(rng.integers(0, 4))
        covered = lambda spans: {p for a, b in spans for p in range(a, b)}
        good = []
        for a in range(14):
            for b in range(a + 1, 15):
                inside = tokens[a:b].tolist()
                if b - a <= 3 + slop and all(inside.count(x) >= w.tolist().count(x) for x in w):
                    good.append((a, b))
        least = [s for s in good if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in good)]
        assert covered(least) <= covered(D.proximity_runs(tokens, w, slop)) <= covered(good)


def test_null_item_ids_and_clashing_columns(frame):
    phrase = "one two three four five six seven eight nine ten"
    docs = frame("doc_id long, text string, _id long, _hash string, __id long", [{"doc_id": 1, "text": phrase, "_id": 2, "_hash": "a"}, {"doc_id": 2, "text": "clean", "_id": 1, "_hash": "b", "__id": 5}])
    benchmark = frame("item_id string, text string", [{"text": phrase}, {"item_id": "x", "text": phrase}])
    found = {r.doc_id: (r.n_items, r["items"], r.contaminated) for r in D.report(docs, benchmark).collect()}
    assert found == {1: (2, ["", "x"], True), 2: (0, [], False)}
    kept = D.keep_uncontaminated(docs, benchmark)
    assert [tuple(r) for r in kept.collect()] == [(2, "clean", 1, "b", 5)]


def test_alignments_in_blocks(monkeypatch):
    """All alignments of a test are compared at once, in blocks; what is found stays what single ones give."""
    rng = np.random.default_rng(5)
    for k in range(300):
        monkeypatch.setattr(D, "CELLS", int(rng.integers(1, 60)))
        tokens, words = rng.integers(-1, 2, rng.integers(0, 40)), rng.integers(0, 2, rng.integers(1, 25))
        starts, window = rng.integers(-15, 42, rng.integers(0, 9)), int(rng.integers(1, 7))
        size = min(window, len(words))
        want = [
            (s + o, s + o + size)
            for s in starts.tolist()
            for o in range(len(words) - size + 1)
            if 0 <= s + o and s + o + size <= len(tokens) and (tokens[s + o : s + o + size] == words[o : o + size]).all()
        ]
        assert D.phrase_runs(tokens, words, starts, window) == want
