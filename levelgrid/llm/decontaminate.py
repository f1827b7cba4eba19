"""Benchmark decontamination by a distributed positional inverted index.

The index keeps, for every training document, its postings: each term with the positions where it stands. A
search takes the rarest term of every test phrase as its anchor, subtracts the anchor's offset in the phrase
from its postings, which gives the alignments to try, and intersects the other terms' postings at each
alignment. Exact phrases (windows of test words) and proximity matches (all words of a test within a span) are
returned.

Words are runs of anything but ASCII other than letters and digits, with A-Z lower-cased.

Defined cases: null and empty texts have no words and hit nothing; a test of fewer words than a window is one
window, a test without words matches nothing; repeated documents are searched one by one, repeated test ids
count once; a test without an id has the id ''; an empty benchmark leaves every document clean; columns of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelgrid.llm import text as T
from levelgrid.session import settle

WINDOW = 10
# Test vocabularies up to this size go to every task, which then keeps the postings of test terms only. A larger
# one is not sent: the index then has all terms, and joins find the test terms. Results are the same.
SENT_TERMS = 200_000
# Words compared at once: alignments times words of a test.
CELLS = 1 << 18

_POSTINGS = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
_INDEX_SQL = "row_id long, doc_id long, text_hash long, n_words long, postings array<struct<term:string,positions:array<int>>>"


def _words_column(column: str):
    spread = F.translate(F.coalesce(F.col(column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(spread, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def tests(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id (string) and words of every test that has words; written once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), _words_column("text").alias("words"))
    return settle(items.filter("size(words) > 0").distinct().withColumn("item", F.monotonically_increasing_id()))


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each list begins and the last one ends in the flat values."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _ints(values: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(values) if values else np.zeros(0, np.int64)


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The stored index: row_id, doc_id, text_hash, n_words, postings (term and positions). `terms` (term) limits what is kept."""
    spark = docs.sparkSession
    T.bound_batches(spark)
    sent = None
    if terms is not None:
        found = [r[0] for r in terms.select("term").distinct().limit(SENT_TERMS + 1).collect()]
        if len(found) <= SENT_TERMS:
            sent = spark.sparkContext.broadcast(sorted(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        fixed = {t.encode(): i for i, t in enumerate(sent.value)} if sent else None
        for batch in batches:
            number = fixed if fixed is not None else {}
            lengths, sizes, codes, places, each = [], [], [], [], []
            for text in batch.column(2):
                tokens = T.words(text.as_py())
                if fixed is None:
                    row = np.array([number.setdefault(t, len(number)) for t in tokens], np.int64)
                else:
                    row = np.array([number.get(t, -1) for t in tokens], np.int64)
                at = np.flatnonzero(row >= 0)
                at = at[np.argsort(row[at], kind="stable")]
                row = row[at]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                lengths.append(len(tokens))
                sizes.append(len(first))
                codes.append(row[first])
                places.append(at)
                each.append(np.diff(np.concatenate([first, [len(row)]])))
            names = pa.array([t.decode() for t in number], pa.string())
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(_ints(each))]), pa.int32()), pa.array(_ints(places), pa.int32()))
            terms_of = names.take(pa.array(_ints(codes), pa.int64()))
            pairs = pa.StructArray.from_arrays([terms_of, inner], ["term", "positions"])
            postings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pairs)
            ids = pa.array((part << 33) + seen + np.arange(len(batch)), pa.int64())
            seen += len(batch)
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), postings.cast(_POSTINGS)], ["row_id", "doc_id", "text_hash", "n_words", "postings"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return settle(slim.mapInArrow(run, _INDEX_SQL))


def _entries(index: DataFrame) -> DataFrame:
    return index.select("row_id", F.explode("postings").alias("p")).select("row_id", "p.term", "p.positions")


def _ranked(index: DataFrame, items: DataFrame) -> DataFrame:
    """items with `ranked`: the corpus frequency, offset and term of each of their words, in order of offset."""
    counts = _entries(index).groupBy("term").agg(F.sum(F.size("positions")).alias("frequency"))
    words = items.select("item", F.posexplode("words").alias("offset", "term"))
    known = words.join(counts, "term", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    ranked = known.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("offset", "frequency", "term"))).alias("ranked"))
    return items.join(ranked, "item")


def _alignments(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """row_id, item, starts: where the item would begin, by the postings of its anchors (item, term, offset)."""
    hits = _entries(index).join(anchors, "term").select(
        "row_id", "item", F.transform("positions", lambda p: p - F.col("offset")).alias("starts")
    )
    return hits.groupBy("row_id", "item").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def _verify(index: DataFrame, items: DataFrame, tries: DataFrame, check) -> DataFrame:
    """Run check(tokens, words, starts, n_words) -> [(begin, end)] for every document and the items tried on it.

    Gives row_id, n_hit and items (ids). The postings of a document and its tries meet in one row, which is
    bounded by the document's own matches.
    """
    tried = tries.join(items.select("item", "item_id", "words"), "item")
    tried = tried.groupBy("row_id").agg(F.collect_list(F.struct("item_id", "words", "starts")).alias("tries"))
    met = index.select("row_id", "n_words", "postings").join(tried, "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Terms are numbered once a batch; what a row takes of the flat arrays are slices.
            n_words = batch.column(1).to_numpy(zero_copy_only=False)
            terms, positions = batch.column(2).flatten().flatten()
            coded = terms.dictionary_encode()
            of_row, of_term = _bounds(batch.column(2)), _bounds(positions)
            places = positions.flatten().to_numpy(zero_copy_only=False)
            codes = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(of_term))
            item_ids, words, starts = batch.column(3).flatten().flatten()
            tries_of, words_of, starts_of = _bounds(batch.column(3)), _bounds(words), _bounds(starts)
            # A word that no row of the batch has is equal to no token.
            wanted = pc.fill_null(pc.index_in(words.flatten(), value_set=coded.dictionary), -2).to_numpy(zero_copy_only=False)
            begins = starts.flatten().to_numpy(zero_copy_only=False)
            out = []
            for i, row_id in enumerate(batch.column(0).to_pylist()):
                tokens = np.full(n_words[i], -1, np.int64)
                own = slice(of_term[of_row[i]], of_term[of_row[i + 1]])
                tokens[places[own]] = codes[own]
                covered, found = np.zeros(n_words[i] + 1, np.int64), set()
                for t in range(tries_of[i], tries_of[i + 1]):
                    for begin, end in check(tokens, wanted[words_of[t] : words_of[t + 1]], begins[starts_of[t] : starts_of[t + 1]]):
                        covered[begin] += 1
                        covered[end] -= 1
                        found.add(item_ids[t].as_py())
                out.append((row_id, int((np.cumsum(covered) > 0).sum()) if found else 0, sorted(found)))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string()))], ["row_id", "n_hit", "items"]
            )

    return met.select("row_id", "n_words", "postings", "tries").mapInArrow(run, "row_id long, n_hit long, items array<string>")


def phrase_runs(tokens: np.ndarray, words: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of the document where a window of the test stands, at the given alignments."""
    size, out = min(window, len(words)), []
    starts, at = np.asarray(starts, np.int64), np.arange(len(words))
    if not len(tokens):
        return out
    # All alignments at once, in blocks of bounded cells.
    block = max(1, CELLS // len(words))
    for k in range(0, len(starts), block):
        begin = starts[k : k + block]
        place = begin[:, None] + at
        same = (tokens.take(place, mode="clip") == words) & (place >= 0) & (place < len(tokens))
        some = np.flatnonzero(same.sum(axis=1) >= size)
        if not len(some):
            continue
        total = np.zeros((len(some), len(words) + 1), np.int64)
        np.cumsum(same[some], axis=1, out=total[:, 1:])
        for r, s in np.argwhere(total[:, size:] - total[:, :-size] == size).tolist():
            low = int(begin[some[r]]) + s
            out.append((low, low + size))
    return out


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_id, n_hit, items for the documents in which a window of a test stands word for word."""
    ranked = _ranked(index, items)
    size = F.least(F.lit(window), F.size("words"))
    # The anchor of a window is its rarest word; a window with a word that no document has cannot occur.
    rarest = F.transform(
        F.sequence(F.lit(0), F.size("words") - size),
        lambda s: F.array_min(F.transform(F.slice("ranked", s + 1, size), lambda r: F.struct(r["frequency"], r["offset"], r["term"]))),
    )
    anchors = ranked.select("item", F.explode(F.array_distinct(rarest)).alias("a")).filter("a.frequency > 0")
    anchors = settle(anchors.select("item", "a.term", "a.offset"))
    return _verify(index, items, _alignments(index, anchors), lambda t, w, s: phrase_runs(t, w, s, window))


def proximity_runs(tokens: np.ndarray, words: np.ndarray, slop: int) -> list[tuple[int, int]]:
    """The shortest spans that hold every word of the test, where they are at most `slop` longer than the test."""
    need: dict[int, int] = {}
    for w in words.tolist():
        need[w] = need.get(w, 0) + 1
    at = [p for p in np.flatnonzero(tokens >= 0).tolist() if int(tokens[p]) in need]
    have: dict[int, int] = {}
    out, left, missing = [], 0, len(need)
    for p in at:
        code = int(tokens[p])
        have[code] = have.get(code, 0) + 1
        missing -= have[code] == need[code]
        while not missing:
            if p + 1 - at[left] <= len(words) + slop:
                out.append((at[left], p + 1))
            first = int(tokens[at[left]])
            have[first] -= 1
            missing += have[first] < need[first]
            left += 1
    return out


def proximity_matches(index: DataFrame, items: DataFrame, slop: int = 5) -> DataFrame:
    """row_id, n_hit, items for the documents in which all words of a test stand close together, in any order."""
    rarest = F.array_min(F.transform("ranked", lambda r: F.struct(r["frequency"], r["offset"], r["term"])))
    anchors = settle(_ranked(index, items).select("item", rarest.alias("a")).filter("a.frequency > 0").select("item", "a.term", "a.offset"))
    return _verify(index, items, _alignments(index, anchors), lambda t, w, _: proximity_runs(t, w, slop))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, contaminated."""
    items = tests(benchmark)
    index = build_index(docs, items.select(F.explode("words").alias("term")))
    hits = phrase_matches(index, items, window)
    rows = index.select("row_id", "doc_id", "n_words").join(hits, "row_id", "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns."""
    items = tests(benchmark)
    own, same = T.free_names(docs.columns, "_id", "_hash")
    marked = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), same: F.xxhash64("text")})
    # The index goes by rows; a hit is told apart by id and text, so repeated rows share its fate.
    index = build_index(docs, items.select(F.explode("words").alias("term")))
    hits = phrase_matches(index, items, window).join(index.select("row_id", "doc_id", "text_hash"), "row_id")
    gone = hits.filter("n_hit > 0").select(F.coalesce("doc_id", F.lit(-1)).alias(own), F.col("text_hash").alias(same)).distinct()
    return marked.join(settle(gone), [own, same], "left_anti").select(*docs.columns)
