import numpy as np
import pytest

from levelgrid.llm import jaccard_join as J
from levelgrid.llm.text import shingles, words


def brute(rows, threshold=0.8):
    """Links and classes by comparing all texts with all texts."""
    sets = [set(shingles(words(t)).tolist()) for _, t in rows]
    n = len(rows)
    like = lambda a, b: bool(a and b) and len(a & b) >= threshold * len(a | b) - 1e-9
    links = [[j for j in range(n) if j != i and like(sets[i], sets[j])] for i in range(n)]
    group = list(range(n))
    for _ in range(n):
        new = [min([group[i], *(group[j] for j in links[i])]) for i in range(n)]
        if new == group:
            break
        group = new
    least = {g: min(rows[i][0] for i in range(n) if group[i] == g) for g in set(group)}
    return sorted((rows[i][0], least[group[i]], len(links[i])) for i in range(n))


def corpus(rng, n=60):
    text = lambda k: [f"w{i}" for i in rng.integers(0, 5000, k)]
    rows = []
    for _ in range(n):
        base = text(int(rng.integers(3, 160)))
        rows.append(base)
        for _ in range(int(rng.integers(0, 5))):
            near = list(base)
            for _ in range(int(rng.integers(0, 4))):
                near[int(rng.integers(len(near)))] = "new" + str(rng.integers(1000))
            rows.append(near)
    order = rng.permutation(len(rows))
    return [(int(i), " ".join(rows[j])) for i, j in enumerate(order)]


def got(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.collect())


def test_against_brute_force(spark):
    rows = corpus(np.random.default_rng(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(J.classes(docs)) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    """One large group of near copies dealt over many blocks, with exact copies among them."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        near = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 4))):
            near[at] = f"x{rng.integers(30)}"
        rows.append((i, " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "BLOCK", 4000)
    assert got(J.classes(docs)) == brute(rows)


def test_pruning_tables():
    least = J.needed()
    assert list(least) == list(range(J.STEP, J.HASHES + 1, J.STEP))
    rng = np.random.default_rng(1)
    # At the threshold itself, equal values fall below the last bound once in a hundred thousand at most.
    assert (rng.binomial(J.HASHES, J.THRESHOLD, 200_000) < least[J.HASHES]).mean() < 1e-4
    assert least[J.HASHES] > 0.5 * J.HASHES


def test_signature_estimates_likeness():
    a, b = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(201, 1201, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert abs((J.signature(a) == J.signature(b)).mean() - 800 / 1200) < 0.12


def test_edge_cases(edge_docs, no_docs):
    found = got(J.classes(edge_docs.filter("doc_id is not null")))
    assert found == [(1, 1, 0), (2, 2, 0), (3, 3, 1), (3, 3, 1), (4, 4, 0), (5, 5, 0)]
    assert J.classes(edge_docs).count() == 7
    kept = J.deduplicate(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "None"]
    assert J.classes(no_docs).collect() == [] and J.deduplicate(no_docs).collect() == []


def test_one_stays_of_a_class_with_shared_or_no_ids(frame):
    """Near copies under one id, or without an id, are told apart by their texts."""
    near = [" ".join(f"w{i}" for i in range(60)) + end for end in ("", " x", " y")]
    for ids in ([7, 7, 7], [None, None, None], [None, 7, 7]):
        docs = frame("doc_id long, text string", [{"doc_id": i, "text": t} for i, t in zip(ids, near)])
        kept = J.deduplicate(docs).collect()
        assert len(kept) == 1 and kept[0].text in near


def test_bands_follow_the_threshold(spark):
    assert J.banding(J.THRESHOLD) == (J.BANDS, J.ROWS)
    for bad in (0.0, 0.05):
        with pytest.raises(ValueError):
            J.banding(bad)
    rng, rows = np.random.default_rng(10), []
    for i in range(40):
        base = [f"w{i}x{j}" for j in range(100)]
        kept = int(rng.integers(46, 80))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:kept] + [f"v{i}x{j}" for j in range(kept, 100)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (0.5, 0.3):
        assert (1 - threshold ** J.banding(threshold)[1]) ** J.banding(threshold)[0] <= J.MISS
        assert got(J.classes(docs, threshold)) == brute(rows, threshold)


def test_clashing_columns_come_back_as_they_were(frame):
    text = "one two three four five six seven eight nine ten"
    docs = frame("doc_id long, text string, _id long, _hash string, __HASH string", [{"doc_id": i, "text": text, "_id": 9 - i, "_hash": f"h{i}", "__HASH": "k"} for i in (3, 1, 2)])
    assert [tuple(r) for r in J.deduplicate(docs).collect()] == [(1, text, 8, "h1", "k")]
