"""Row numbers within keys without gathering a key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.session import attach, settle


def number_rows(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Adds `name`: 1, 2, ... within `keys` in the given order (columns that settle ties).

    Rows are cut into ranges of (keys, order), so a key with very many rows
    spans many tasks. Each range numbers its own rows and adds the sizes of
    the key's ranges before it.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    cols = [f"_o{i}" for i in range(len(order))]
    ranged = settle(named.repartitionByRange(*keys, *cols).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    w = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*cols))
    out = attach(ranged.withColumn("_local", local), before, [*keys, "_range"])
    return out.withColumn(name, (F.col("_local") + F.col("_before")).cast("int")).drop("_local", "_before", "_range", *cols)


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str, ahead: bool = False) -> DataFrame:
    """Adds `name`: the largest `value` of the rows before within `keys`, or the least of those after (`ahead`).

    Cut into ranges as above: each range folds its own rows, and takes what the ranges before (or after) it hold.
    """
    keys = list(keys)
    fold, best = (F.min, F.least) if ahead else (F.max, F.greatest)
    turned = lambda c: F.desc_nulls_last(c) if ahead else F.asc_nulls_first(c)
    ranged = settle(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()))
    each = ranged.groupBy(*keys, "_range").agg(fold(value).alias("_v"))
    w = W.partitionBy(*keys).orderBy(turned("_range")).rowsBetween(W.unboundedPreceding, -1)
    other = each.select(*keys, "_range", fold("_v").over(w).alias("_other"))
    local = fold(value).over(W.partitionBy(*keys, "_range").orderBy(turned(order)).rowsBetween(W.unboundedPreceding, -1))
    out = attach(ranged.withColumn("_local", local), other, [*keys, "_range"])
    return out.withColumn(name, best("_local", "_other")).drop("_local", "_other", "_range")


def nearest(rows: DataFrame, sites: DataFrame, keys: list[str], at: str, value: str, item: str, id: str) -> DataFrame:
    """keys, id, gap, item, value of the site whose value is nearest to a row's `at` (ties: the least item).

    An as-of join to both sides: values and rows are sorted together, and the last value below and the first
    above are carried to each row, over range borders too. A value counts once, however many sites share it, so the
    work is linear in rows and sites.
    """
    keys = list(keys)
    alone = settle(sites.groupBy(*keys, F.col(value).alias("_v")).agg(F.min(item).alias("_item")))
    marks = alone.select(*keys, F.col("_v").alias("_at"), "_v", F.lit(None).cast(rows.schema[id].dataType).alias("_id"))
    marks = marks.unionByName(rows.select(*keys, F.col(at).alias("_at"), F.lit(None).cast("double").alias("_v"), F.col(id).alias("_id")))
    near = running(running(marks, keys, "_at", "_v", "_below"), keys, "_at", "_v", "_above", ahead=True).filter("_id is not null")
    # A site at the row's own place is neither before nor after it.
    tried = near.select(*keys, "_id", "_at", F.explode(F.array_distinct(F.array("_below", "_above", "_at"))).alias("_v"))
    met = tried.join(alone, [*keys, "_v"]).withColumn("_gap", F.abs(F.col("_at") - F.col("_v")))
    best = met.groupBy(*keys, "_id").agg(F.min(F.struct("_gap", "_item", "_v")).alias("_b"))
    return best.select(*keys, F.col("_id").alias(id), F.col("_b._gap").alias("gap"), F.col("_b._item").alias("item"), F.col("_b._v").alias("value"))
