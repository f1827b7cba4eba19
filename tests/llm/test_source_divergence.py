"""The audit of sources against plain arithmetic over all terms, and its defined cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from levelgrid.llm import source_divergence as S
from tests.llm.conftest import DOCS


def brute(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower)))) for lang, source, text in rows]
    out = []
    for lang in {f[0] for f in found}:
        own = [f for f in found if f[0] == lang]
        docs, total = Counter(), Counter()
        for _, _, c in own:
            docs.update(c.keys())
            total.update(c)
        kept = {t for t, n in docs.items() if n >= min_docs}
        sums = defaultdict(Counter)
        for _, source, c in own:
            sums[source].update({t: n for t, n in c.items() if t in kept})
        p = {}
        for source, c in [*sums.items(), (None, Counter({t: total[t] for t in kept}))]:
            by = sum(c.values()) + len(kept)
            p[source] = {t: 1 + 10**9 * (c[t] + 1) // by for t in kept}
        for a in sums:
            pairs = [(-sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept), b) for b in sums if b != a]
            out += [(lang, a, "pair", b, -v, i + 1) for i, (v, b) in enumerate(sorted(pairs))]
            terms = [(-((p[a][t] - p[None][t]) ** 2 // p[None][t]), t.encode()) for t in kept if sums[a][t] and p[a][t] > p[None][t]]
            out += [(lang, a, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def test_matches_plain_arithmetic(spark, frame):
    rng = np.random.default_rng(5)
    words = np.array([*"a b c d e f g h".split(), "É", "é", "naïve", "the", "THE", "x1y", "日本", "ﬀ", "q"])
    rows = []
    for i in range(160):
        lang, source = ("en", "fr", None, "")[rng.integers(4)], ("s1", "s2", "s3", None, "")[min(4, rng.geometric(0.4) - 1)]
        rows.append((lang, source, None if i % 19 == 0 else " ".join(rng.choice(words, rng.integers(0, 12)))))
    rows += [("solo", "only", "one two"), ("dry", "p", "1 2"), ("dry", "q", None), rows[3], rows[3]]
    df = frame(DOCS, [{"doc_id": i if i % 7 else None, "lang": a, "source": s, "text": t, "key": "clash"} for i, (a, s, t) in enumerate(rows)]).repartition(5)
    for top in (200, 3):
        assert sorted(map(tuple, S.audit(df, 3, top).collect())) == brute(rows, 3, top)


def test_vectors_are_exact(spark, frame):
    rows = [{"doc_id": i, "lang": "en", "source": "s", "text": t} for i, t in enumerate(["b a b", "a b", "a B c", None, "a"])]
    table = S.blocks(frame(DOCS, rows))
    marked = S.numbered(table, 3)
    number = {r.term: r["index"] for r in S.vocabulary(marked).collect()}
    assert sorted((r.term, r.docs, r.total) for r in S.vocabulary(marked).collect()) == [("a", 4, 4), ("b", 3, 4)] and len(set(number.values())) == 2
    found = {r.doc_id: dict(zip(r["indices"], r.counts)) for r in S.vectors(table, marked).collect()}
    a, b = number["a"], number["b"]
    assert found == {0: {a: 1, b: 2}, 1: {a: 1, b: 1}, 2: {a: 1, b: 1}, 3: {}, 4: {a: 1}}
    assert sorted((r["index"], r.n) for r in S.group_sums(table, marked).collect()) == sorted([(a, 4), (b, 4)])


def test_pairs_in_any_chunks(monkeypatch):
    """Sums over the terms that two sources hold do not depend on how many are looked at in one go."""
    rng = np.random.default_rng(4)
    held = [("en", [{"source": f"s{i}", "p": int(rng.integers(1, 10**6)), "none": 7 + i} for i in sorted(rng.choice(6, rng.integers(2, 6), False))]) for _ in range(50)]
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("none", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([h[0] for h in held]), pa.array([h[1] for h in held], kind)], ["lang", "e"])
    run = lambda: sorted(map(str, next(S._both_hold(iter([batch.slice(0, 20), batch.slice(20)]))).to_pylist()))
    whole = run()
    monkeypatch.setattr(S, "CHUNK", 10)
    assert run() == whole and len(whole) == 30


def test_cases(edge_docs, no_docs):
    assert S.audit(no_docs).collect() == []
    assert S.audit(edge_docs).collect() == []  # one group without language, and no kept term that it holds more of
