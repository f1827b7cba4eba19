import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from levelgrid.llm import winnowing as W
from levelgrid.llm.text import codes, grams, prefix_sums


def brute(text, k, w):
    """Rightmost least hash of every window, one window at a time."""
    k = min(k, len(text))
    if not text:
        return []
    hashes = [int(grams(prefix_sums(codes(text[i : i + k])), k)[0]) >> 32 for i in range(len(text) - k + 1)]
    w = min(w, len(hashes))
    kept = set()
    for i in range(len(hashes) - w + 1):
        least = min(hashes[i : i + w])
        kept.add(max(p for p in range(i, i + w) if hashes[p] == least))
    return [(hashes[p], p) for p in sorted(kept)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé😀 ", max_size=60), st.integers(1, 6), st.integers(1, 9))
def test_winnow_matches_windows(text, k, w):
    hashes, positions = W.winnow(text, k, w)
    assert list(zip(hashes.tolist(), positions.tolist())) == brute(text, k, w)
    assert [x.tolist() for x in W.read(W.spell(hashes, positions))] == [hashes.tolist(), positions.tolist()]


def test_common_run_is_found():
    rng = np.random.default_rng(0)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    for _ in range(20):
        run = word(W.K + W.WINDOW - 1)
        a, b = word(200) + run + word(90), word(77) + run + word(300)
        found = W.matches(W.spell(*W.winnow(a)), W.spell(*W.winnow(b)))
        assert any(a[p : p + W.K] == b[q : q + W.K] and 200 <= p < 200 + len(run) for p, q in found)


def test_short_texts_keep_several_hashes():
    rng = np.random.default_rng(2)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    for n in range(32, 160):
        text = word(n)
        own, other = (W.winnow(t)[0] for t in (text, W.edited(text, word(n))))
        assert 0 < W.likeness(own, other) < 1


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        q = len(text) // 4
        changed = text[: len(text) - q] + following[:q]
        own, other, nxt = (set(h for h, _ in brute(t, W.K, W.WINDOW)) for t in (text, changed, following))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(like(own, other), 9), round(like(own, nxt), 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def test_documents_against_brute_force(spark):
    rng = np.random.default_rng(1)
    text = lambda: "".join(chr(c) for c in rng.integers(97, 110, int(rng.integers(0, 400))))
    rows = [(int(i) * 7, text()) for i in rng.permutation(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(W.fingerprints(docs)) == expected(rows)


def test_edge_cases(edge_docs, no_docs):
    rows = [(r.doc_id, r.text or "") for r in edge_docs.collect() if len(r.text or "") < 1000]
    small = edge_docs.filter("length(coalesce(text, '')) < 1000")
    assert got(W.fingerprints(small)) == expected(rows)
    found = {r.doc_id: r for r in W.fingerprints(edge_docs).collect()}
    assert found[1].fingerprint == found[2].fingerprint == "" and found[1].near_next == 1.0
    assert found[5].n_chars == 300_000
    assert W.fingerprints(no_docs).collect() == []
    one = W.fingerprints(small.filter("doc_id = 4")).first()
    assert one.near_edited <= 1 and one.near_next == 1.0
