import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from levelgrid.llm import best_fit_packing as B
from levelgrid.llm import online_packing as P
from levelgrid.llm.tokens import encoder


def ids_of(text):
    plain = encoder().model.encode(text or "", add_special_tokens=False).ids
    return np.array([*plain, P.CLOSING_ID], "<u4")


@pytest.mark.parametrize("text", ["Don't it's 12ab ß İstanbul Σας été a b x\x1cy <|endoftext|>z ﬁ!? ½ _a_ 'll'd 漢字", "", " \n\t ", "WORD, word. Word*** <tag> a|b"])
def test_memo_gives_the_tokenizer_s_ids(text):
    assert encoder().encode(text) == np.array(encoder().model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_memo_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder().encode(text) == np.array(encoder().model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_pieces(rows, texts, capacity):
    """Every id of every document in exactly one piece, sequences gapless and within capacity."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = ids_of(texts[doc_id]), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_online_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(2)
    texts = {i: " ".join(["ab", "the", "wonder", "xyz"][j] for j in rng.integers(0, 4, int(rng.integers(0, 90)))) for i in range(900)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(40)
    n, total = check_pieces(P.pack(docs, capacity=64, most=8).collect(), texts, 64)
    assert total / (64 * n) > 0.93


def test_open_windows_merge_over_rounds(spark):
    texts = {i: "the" for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(70)
    n, _ = check_pieces(P.pack(docs, capacity=64).collect(), texts, 64)
    assert n <= 9  # 400 ids in windows of 64, one left in each group of the first round at most


def test_packer_keeps_its_bound():
    packer = P.Packer(10, 3)
    closed = [w for size in [7, 8, 9, 6, 3, 10, 4] for w in packer.put(size, size)]
    assert len(packer.rooms) <= 3
    assert sorted(p for _, pieces in closed + packer.rest() for _, p in pieces) == [3, 4, 6, 7, 8, 9, 10]


def test_online_packing_edge_cases(edge_docs, no_docs):
    rows = P.pack(edge_docs).collect()
    assert sum(1 for r in rows if r.doc_id == 3) == 2  # the repeated row is packed twice
    once = {r.doc_id: r.text for r in edge_docs.filter("doc_id <> 3 or doc_id is null").collect()}
    check_pieces([r.asDict() for r in P.pack(edge_docs.filter("doc_id <> 3 or doc_id is null")).collect()], once, P.CAPACITY)
    assert P.pack(no_docs).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_tree_is_best_fit_decreasing(sizes):
    windows, rooms = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            rooms[rooms.index(min(fits))] -= sizes[i]
        else:
            rooms.append(16 - sizes[i])
    found = B.best_fit_decreasing(sizes, 16)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert sorted(16 - sum(sizes[i] for i in w) for w in found) == sorted(rooms)


def test_matrices_round_trip(edge_docs, no_docs):
    docs = edge_docs.filter("doc_id <> 3 or doc_id is null")
    matrices = B.pack_matrices(docs, shard=5000)
    rows = matrices.collect()
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == P.CAPACITY and r.cu_seqlens[-1] == r.n_tokens
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
        assert not ids[r.n_tokens :].any()
    assert len({r.sequence_id for r in rows}) == len(rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = [r.asDict() | {"ids_crc32": zlib.crc32(r.ids), "doc_tokens": len(ids_of(texts[r.doc_id]))} for r in B.unpack(matrices).collect()]
    check_pieces(pieces, texts, P.CAPACITY)
    assert B.pack_matrices(no_docs).collect() == []
