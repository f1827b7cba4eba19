"""Audit of how the sources of a language differ from each other in their words.

Each language gets a count vectorizer of its own: a vocabulary of the terms that stand in enough of its documents
(minDF), of any size, and an exact sparse count vector of every document. Sums of these
vectors over a group (language, source) give smoothed shares p in billionths, and two groups are held against each
other by f = floor((p - q)^2 / q), summed over the vocabulary.

The vocabulary stays a table. Documents are read in blocks of bounded size; a block asks for the numbers of its
distinct terms once, so a frequent word costs a row per block and not one per document. Sums over a pair of groups
are taken sparsely: a term that neither group holds adds a constant, a term that one of them holds adds what depends
on its count alone, and only terms that both hold are visited for the pair.

Defined cases: null text, language and source count as ''; a language without kept terms has pairs of value 0;
repeated rows and rows without an id count as often as they stand; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.llm import text as T
from levelgrid.session import attach, settle

MIN_DOCS = 3
TOP = 200
# Rows and text bytes of a block.
BLOCK_ROWS = 1 << 15
BLOCK_BYTES = 32 << 20
# A group's terms are ranked in so many parts before the best of all parts are.
PARTS = 32
# Pairs of entries that are looked at in one go.
CHUNK = 1 << 20

# Bytes to terms: A-Z are lower-cased, all other ASCII but a-z separates, bytes over 0x7F stay.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

_BLOCKS = "block long, lang string, doc_ids array<long>, sources array<string>, starts array<int>, ids binary, counts binary, terms array<binary>, docs array<int>, total array<long>"


def _one_list(values, kind) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _pack(values: np.ndarray) -> pa.Array:
    return pa.array([pa.compress(values.tobytes(), "zstd", asbytes=True)], pa.binary())


def _unpack(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * size, "zstd"), np.int32)


class _Numbers(dict):
    """Numbers terms in the order in which they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class _Block:
    """Documents of one language with numbers of their own for its terms."""

    def __init__(self):
        self.doc_ids, self.sources, self.starts = [], [], [0]
        self.ids, self.counts, self.numbers = array("i"), array("i"), _Numbers()

    def add(self, doc_id, source, text: bytes):
        found = Counter(text.translate(TERM_BYTES).split())
        self.ids.extend(map(self.numbers.__getitem__, found))
        self.counts.extend(found.values())
        self.starts.append(len(self.ids))
        self.doc_ids.append(doc_id)
        self.sources.append(source)

    def row(self, block: int, lang: str) -> pa.RecordBatch:
        ids, counts = np.array(self.ids, np.int32), np.array(self.counts, np.int32)
        total = np.zeros(len(self.numbers), np.int64)
        np.add.at(total, ids, counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()), pa.array([lang]), _one_list(self.doc_ids, pa.int64()), _one_list(self.sources, pa.string()),
                _one_list(np.array(self.starts, np.int32), pa.int32()), _pack(ids), _pack(counts),
                _one_list(list(self.numbers), pa.binary()), _one_list(np.bincount(ids, minlength=len(total)).astype(np.int32), pa.int32()), _one_list(total, pa.int64()),
            ],
            ["block", "lang", "doc_ids", "sources", "starts", "ids", "counts", "terms", "docs", "total"],
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every language of a run of documents that is bounded in rows and bytes."""
    block = TaskContext.get().partitionId() << 32
    held, rows, size = {}, 0, 0
    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        for doc_id, lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), (t.as_py() for t in texts)):
            held.setdefault(lang, _Block()).add(doc_id, source, text)
            rows, size = rows + 1, size + len(text)
            if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                for name, part in held.items():
                    yield part.row(block, name)
                block, held, rows, size = block + 1, {}, 0, 0
    for name, part in held.items():
        yield part.row(block, name)


def named(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and text, nulls but those of doc_id as ''."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *plain)


def blocks(docs: DataFrame) -> DataFrame:
    """The documents in blocks, each with its terms, their numbers in it, and every document's counts."""
    T.bound_batches(docs.sparkSession)
    return settle(named(docs).mapInArrow(_blocks, _BLOCKS))


def _block_terms(table: DataFrame) -> DataFrame:
    entries = F.posexplode(F.arrays_zip("terms", "docs", "total")).alias("at", "e")
    each = table.select("block", "lang", entries)
    return each.select("block", "lang", "at", F.col("e.terms").cast("string").alias("term"), F.col("e.docs").alias("docs"), F.col("e.total").alias("total"))


def numbered(table: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """block, lang, at, index of the kept terms of every block; term, docs and total stand in one row of each term.

    A term has one row a block, so one deal of them by term gives its sums and its number (that of its least row:
    numbers are unique, of any size, and have gaps).
    """
    each = _block_terms(table).withColumn("_row", F.monotonically_increasing_id())
    own = W.partitionBy("lang", "term")
    summed = each.withColumns({"docs": F.sum("docs").over(own), "total": F.sum("total").over(own), "index": F.min("_row").over(own)})
    once = lambda c: F.when(F.col("_row") == F.col("index"), F.col(c)).alias(c)
    return settle(summed.filter(F.col("docs") >= min_docs).select("block", "lang", "at", "index", once("term"), once("docs"), once("total")))


def vocabulary(marked: DataFrame) -> DataFrame:
    """lang, term, index, docs and total of all kept terms."""
    return marked.filter("term is not null").select("lang", "term", "index", "docs", "total")


def _counted(row: int, table: pa.Table, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The count vectors of a block as triples (document, index, count), in order, and the number of documents."""
    starts = table.column("starts")[row].values.to_numpy(zero_copy_only=False)
    ids, counts = (_unpack(table.column(c)[row].as_py(), int(starts[-1])) for c in ("ids", "counts"))
    number = np.full(int(ids.max(initial=-1)) + 1, -1, np.int64)
    number[found.column("at").to_numpy()] = found.column("index").to_numpy()
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    index = number[ids]
    kept = np.flatnonzero(index >= 0)
    return doc[kept], index[kept], counts[kept].astype(np.int64), len(starts) - 1


def _per_document(table: pa.Table, found: pa.Table) -> pa.Table:
    out = []
    for row in range(table.num_rows):
        doc, index, counts, docs = _counted(row, table, found)
        order = np.lexsort((index, doc))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order])) for v in (index, counts)]
        lang = pa.array([table.column("lang")[row].as_py()] * docs, pa.string())
        out.append(pa.table([table.column("doc_ids")[row].values, lang, table.column("sources")[row].values, *lists], names=list(_VECTOR)))
    return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in _VECTOR.items()})


def _per_source(table: pa.Table, found: pa.Table) -> pa.Table:
    """The document vectors of a block added up by source, sparse."""
    out = []
    for row in range(table.num_rows):
        doc, index, counts, _ = _counted(row, table, found)
        coded = table.column("sources")[row].values.dictionary_encode()
        names, source = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        terms, term = np.unique(index, return_inverse=True)
        cells, cell = np.unique(source[doc] * max(len(terms), 1) + term, return_inverse=True)
        sums = np.zeros(len(cells), np.int64)
        np.add.at(sums, cell, counts)
        ends = np.searchsorted(cells // max(len(terms), 1), np.arange(len(names) + 1))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (terms[cells % max(len(terms), 1)] if len(cells) else cells, sums)]
        out.append(pa.table([pa.array([table.column("lang")[row].as_py()] * len(names), pa.string()), names, *lists], names=list(_SUMS)))
    return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in _SUMS.items()})


_VECTOR = {"doc_id": pa.int64(), "lang": pa.string(), "source": pa.string(), "indices": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
_SUMS = {n: _VECTOR[n] for n in ("lang", "source", "indices", "counts")}


def _met(table: DataFrame, marked: DataFrame, run, schema: str) -> DataFrame:
    """Every block with the numbers of its terms."""
    asked = marked.select(F.col("block").alias("b"), F.col("lang").alias("l"), "at", "index")
    slim = table.select("block", "lang", "doc_ids", "sources", "starts", "ids", "counts")
    return slim.groupBy("block", "lang").cogroup(asked.groupBy("b", "l")).applyInArrow(run, schema)


def vectors(table: DataFrame, marked: DataFrame) -> DataFrame:
    """doc_id, lang, source and the sparse count vector (indices ascending, counts) of every document."""
    return _met(table, marked, _per_document, "doc_id long, lang string, source string, indices array<long>, counts array<long>")


def group_sums(table: DataFrame, marked: DataFrame) -> DataFrame:
    """lang, source, index and n: the sums of the document vectors of every group, sparse.

    Vectors are added up in their block first, so that a group costs a row per block and term.
    """
    found = _met(table, marked, _per_source, "lang string, source string, indices array<long>, counts array<long>")
    each = found.select("lang", "source", F.explode(F.arrays_zip("indices", "counts")).alias("e"))
    return each.groupBy("lang", "source", F.col("e.indices").alias("index")).agg(F.sum("e.counts").alias("n"))


def share(count: Column, rows: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (rows + size)) by long division, three digits a step, within 64 bits."""
    by, rest, out = F.greatest(rows + size, F.lit(1).cast("long")), count + F.lit(1).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        step = rest * F.lit(1000).cast("long")
        out, rest = out * F.lit(1000).cast("long") + _div(step, by), step % by
    return out + F.lit(1).cast("long")


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of numbers that are not negative, exact over all 64 bits."""
    return F.call_function("div", a, b)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def _both_hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the terms that two groups hold, what their pair differs by from what either count alone gives; sums by pair."""
    f = lambda p, q: (p - q) ** 2 // q
    total: dict[tuple[str, str, str], int] = {}

    def flush(lang, names, source, p, none, lengths):
        source, p, none, lengths = np.concatenate(source), np.concatenate(p), np.concatenate(none), np.concatenate(lengths)
        starts = np.cumsum(lengths) - lengths
        partners = np.repeat(lengths, lengths)
        a = np.repeat(np.arange(len(source)), partners)
        b = np.arange(len(a)) - np.repeat(np.cumsum(partners) - partners, partners) + np.repeat(np.repeat(starts, lengths), partners)
        a, b = a[source[a] != source[b]], b[source[a] != source[b]]
        value = f(p[a], p[b]) - f(p[a], none[b]) - f(none[a], p[b]) + f(none[a], none[b])
        keys, at = np.unique(source[a] * len(names) + source[b], return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, value)
        for key, v in zip(keys.tolist(), sums.tolist()):
            pair = (lang, names[key // len(names)], names[key % len(names)])
            total[pair] = total.get(pair, 0) + v

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        # One language after the other; their rows stand mixed.
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        entry = lists.values
        coded = entry.field("source").dictionary_encode()
        names, source = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        p, none = (entry.field(c).to_numpy() for c in ("p", "none"))
        for lang in sorted(set(langs)):
            held, pairs = [[], [], [], []], 0
            for row in np.flatnonzero(langs == lang):
                s = slice(offsets[row], offsets[row + 1])
                for part, v in zip(held, (source[s], p[s], none[s], np.array([s.stop - s.start]))):
                    part.append(v)
                pairs += (s.stop - s.start) ** 2
                if pairs >= CHUNK:
                    flush(lang, names, *held)
                    held, pairs = [[], [], [], []], 0
            if pairs:
                flush(lang, names, *held)
    if total:
        columns = list(zip(*((*k, v) for k, v in total.items())))
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.int64())], ["lang", "source", "item", "value"])


def pair_values(groups: DataFrame, held: DataFrame) -> DataFrame:
    """lang, source, item and value of every ordered pair of groups of a language, summed over the whole vocabulary.

    `groups` has lang, source, rows, size and none (the share of a term that the group does not hold), `held` has
    lang, source, index, p and none of the terms that a group holds.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), "size")
    base = groups.drop("size").join(other, "lang").filter("source <> item")
    size = F.col("size").cast("long")
    base = base.select("lang", "source", "item", (size * apart(F.col("none"), F.col("item_none"))).alias("value"))
    # Terms with equal shares count together, so this has a row per distinct count of a group.
    alike = held.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("m"))
    one = alike.join(other.drop("size"), "lang").filter("source <> item")
    p, none, item = F.col("p"), F.col("none"), F.col("item_none")
    mine = one.select("lang", "source", "item", (F.col("m") * (apart(p, item) - apart(none, item))).alias("value"))
    theirs = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (apart(item, p) - apart(item, none))).alias("value"))
    terms = held.groupBy("lang", "index").agg(F.collect_list(F.struct("source", "p", "none")).alias("e")).filter(F.size("e") > 1)
    both = terms.select("lang", "e").mapInArrow(_both_hold, "lang string, source string, item string, value long")
    parts = base.unionByName(mine).unionByName(theirs).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(held: DataFrame, words: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value and rank of the `top` terms of every group that its language holds less of."""
    q = attach(words, sizes, ["lang"]).withColumn("q", share(F.col("total"), F.col("rows"), F.col("size")))
    each = held.select("lang", "source", "index", "p").join(q.select("lang", "index", F.col("term").alias("item"), "q"), ["lang", "index"])
    each = each.filter("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"), F.pmod("index", F.lit(PARTS)).alias("_part"))
    order = [F.desc("value"), F.asc("item")]
    best = each.withColumn("_r", F.row_number().over(W.partitionBy("lang", "source", "_part").orderBy(*order))).filter(F.col("_r") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value and rank."""
    table = blocks(docs)
    marked = numbered(table, min_docs)
    words = vocabulary(marked)
    sums = settle(group_sums(table, marked))
    # One row a language, and one a group.
    sizes = settle(words.groupBy("lang").agg(F.sum("total").alias("rows"), F.count(F.lit(1)).alias("size")))
    rows = sums.groupBy("lang", "source").agg(F.sum("n").alias("rows"))
    seen = table.select("lang", F.explode("sources").alias("source")).distinct()
    groups = seen.join(rows, ["lang", "source"], "left").join(sizes.select("lang", "size"), "lang", "left").na.fill(0, ["rows", "size"])
    groups = settle(groups.withColumn("none", share(F.lit(0).cast("long"), F.col("rows"), F.col("size"))))
    held = attach(sums, groups, ["lang", "source"])
    held = held.select("lang", "source", "index", share(F.col("n"), F.col("rows"), F.col("size")).alias("p"), "none")
    pairs = pair_values(groups, held)
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))
    terms = term_values(held, words, sizes, top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
