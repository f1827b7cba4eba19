"""Sparse rasters as words: 64 cells of a row are the bits of one long, so shifts and masks take the place of rows for cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelgrid.session import BROADCAST_BYTES, dealt, settle

# Rows of a raster that are worked on in one task.
BLOCK = 256

_call = F.call_function
_up = lambda v, n: _call("shiftleft", v, n)
_down = lambda v, n: _call("shiftrightunsigned", v, n)
_word = lambda c: _call("shiftright", F.col(c) if isinstance(c, str) else c, F.lit(6)).cast("int")
_block = lambda row: _call("shiftright", row, F.lit(BLOCK.bit_length() - 1))
_long = lambda v: F.lit(v).cast("long")


def span(lo: Column, hi: Column, w: str = "w") -> Column:
    """The bits of a word's columns from lo to hi."""
    a, b = F.greatest(lo - F.col(w) * 64, F.lit(0)).cast("int"), F.least(hi - F.col(w) * 64, F.lit(63)).cast("int")
    return F.when(a <= b, _down(_long(-1), 63 - b).bitwiseAND(_up(_long(-1), a))).otherwise(_long(0))


def of_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One word with one bit for each cell (row, col)."""
    bit = _up(_long(1), F.col("col").bitwiseAND(F.lit(63)).cast("int"))
    return cells.select(*keys, "row", _word("col").alias("w"), bit.alias("bits"))


def of_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The words of runs (row, c0, c1)."""
    at = runs.select(*keys, "row", "c0", "c1", F.explode(F.sequence(_word("c0"), _word("c1"))).alias("w"))
    return at.select(*keys, "row", "w", span(F.col("c0"), F.col("c1")).alias("bits"))


def to_cells(words: DataFrame, keys: list[str], kind="int") -> DataFrame:
    """The cells of words, one by one."""
    each = words.select(*keys, "row", "w", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_b"))
    set_ = _down(F.col("bits"), F.col("_b")).bitwiseAND(_long(1)) == 1
    return each.filter(set_).select(*keys, "row", (F.col("w") * 64 + F.col("_b")).cast(kind).alias("col"))


def packed(words: DataFrame, keys: list[str]) -> DataFrame:
    return words.groupBy(*keys, "row", "w").agg(F.bit_or("bits").alias("bits"))


def in_blocks(words: DataFrame, dims: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Packed words with rows, cols and _b, the rows of a block and those within `reach` of it dealt to one task."""
    row = F.col("row")
    on = words.join(F.broadcast(dims) if dims._bytes <= BROADCAST_BYTES else dims, keys)
    on = on.withColumn("_b", F.explode(F.sequence(_block(row - reach), _block(row + reach))))
    return packed(on.repartition(dealt(words.sparkSession), *keys, "_b"), [*keys, "rows", "cols", "_b"])


def _moved(words: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Words moved by every offset (dr, dc), told apart by _o."""
    steps = []
    for i, (dr, dc) in enumerate(offsets):
        q, s = divmod(dc, 64)
        steps.append((i, dr, q, _up(F.col("bits"), F.lit(s))))
        if s:
            steps.append((i, dr, q + 1, _down(F.col("bits"), F.lit(64 - s))))
    each = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(r).alias("r"), F.lit(q).alias("q"), b.alias("b")) for i, r, q, b in steps])
    out = words.select(*keys, "row", "w", F.explode(each).alias("_s")).filter(F.col("_s.b") != 0)
    return out.select(*keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("w") + F.col("_s.q")).alias("w"), F.col("_s.b").alias("bits"), F.col("_s.o").alias("_o"))


def _inside(words: DataFrame) -> DataFrame:
    """Words without the bits beyond the raster."""
    within = words.filter((F.col("row") >= 0) & (F.col("row") < F.col("rows")))
    return within.withColumn("bits", F.col("bits").bitwiseAND(span(F.lit(0), F.col("cols") - 1))).filter("bits <> 0")


def dilated(words: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Cells within the raster that an offset leads to; `keys` hold rows and cols."""
    return _inside(packed(_moved(words, keys, offsets), keys))


def eroded(words: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Cells whose neighbours within the raster are all there, one at least."""
    back = [(-dr, -dc) for dr, dc in offsets]
    votes = _moved(words, keys, back).groupBy(*keys, "row", "w").agg(
        *[F.coalesce(F.bit_or(F.when(F.col("_o") == i, F.col("bits"))), _long(0)).alias(f"_v{i}") for i in range(len(offsets))]
    )
    every, some = [], []
    for i, (dr, dc) in enumerate(offsets):
        r = F.col("row") + dr
        there = F.when((r >= 0) & (r < F.col("rows")), span(F.lit(-dc), F.col("cols") - 1 - dc)).otherwise(_long(0))
        every.append(F.col(f"_v{i}").bitwiseOR(F.bitwise_not(there)))
        some.append(F.col(f"_v{i}").bitwiseAND(there))
    bits = reduce(lambda a, b: a.bitwiseAND(b), every).bitwiseAND(reduce(lambda a, b: a.bitwiseOR(b), some))
    return _inside(votes.select(*keys, "row", "w", bits.alias("bits")))


def own(words: DataFrame, keys: list[str]) -> DataFrame:
    """The words of a block's own rows."""
    return words.filter(_block(F.col("row")) == F.col("_b")).select(*keys, "row", "w", "bits")


def close(cells: DataFrame, dims: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Words of the dilated, then eroded cells; `dims` is settled and has keys, rows, cols, each key once."""
    full = [*keys, "rows", "cols", "_b"]
    known = cells.filter(F.col("row").isNotNull() & F.col("col").isNotNull())
    words = in_blocks(packed(of_cells(known, keys), keys), dims, keys, 2 * max(abs(dr) for dr, _ in offsets))
    return own(eroded(dilated(words, full, offsets), full, offsets), keys)


def open(words: DataFrame, dims: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Words of the eroded, then dilated cells; `dims` as above."""
    full = [*keys, "rows", "cols", "_b"]
    words = in_blocks(words, dims, keys, 2 * max(abs(dr) for dr, _ in offsets))
    return own(dilated(eroded(words, full, offsets), full, offsets), keys)


def by_dims(dims: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(dims of keys that come once, those of keys that come more often or None), settled."""
    side = dims.select(*keys, "rows", "cols")
    n = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first("rows").alias("rows"), F.first("cols").alias("cols"))
    n = settle(n)
    again = n.filter("_n > 1").select(*keys)
    once = n if again.isEmpty() else settle(n.filter("_n = 1"))
    out = once.drop("_n")
    out._bytes = once._bytes
    return out, None if once is n else settle(side.join(again, keys))
