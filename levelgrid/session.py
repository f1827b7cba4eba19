"""Session defaults and the two ways a plan is cut: settled tables and attached sides."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of the settled files of a side that may still be broadcast. Columns of ids and numbers take some
# times as much in memory, so this stays within tens of MB.
BROADCAST_BYTES = 2 << 20
SALTS = 32
# Bytes of a shuffled side, as counted while it ran, up to which a join may still become a broadcast.
MEASURED_BYTES = 4 << 20
# Bytes of input files for which a shuffle gets one more partition.
PARTITION_BYTES = 4 << 20


def build_session(app: str = "levelgrid", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def bound_broadcasts(spark: SparkSession) -> None:
    """Broadcast only what was measured or asked for, never what was estimated before the run.

    The optimizer takes a table for as large as its files, also after an explode has made a hundred rows of one
    and where ids compress to almost nothing, so by its estimate it would send plans and points whole through
    the driver. What a side holds when it runs decides instead. A lower bound of the session stays.
    """
    given = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    given = str(given or spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    bound = -1 if given.startswith("-") else min(bytes_of(given), MEASURED_BYTES)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(bound))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def bound_partitions(spark: SparkSession, paths: list[str]) -> None:
    """Deal shuffles to as many partitions as the input asks for, so that what one task holds does not grow with it.

    Small ones are put together again while the query runs, by their measured size. A higher number of the session stays.
    """
    total = 0
    for path in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += files.getContentSummary(path).getLength() if files.exists(path) else 0
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(given, math.ceil(total / PARTITION_BYTES))))


def dealt(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with."""
    given = spark.conf.get("spark.sql.shuffle.partitions")
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", given) or given)


def workspace(spark: SparkSession) -> str:
    """The shared folder for settled tables: the cluster's checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = os.path.join(tempfile.mkdtemp(prefix="levelgrid-"))
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, and its
    size is known to the optimizer, so joins to it are broadcast only when it
    is small.
    """
    if getattr(df, "_settled", False):
        return df
    spark = df.sparkSession
    path = f"{workspace(spark)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = True
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out._bytes = files.getContentSummary(folder).getLength()
    return out


def clear_workspace(spark: SparkSession) -> None:
    """Delete all settled tables, once nothing that was read from them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{workspace(spark)}/settled")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a per-key side (one row per scan, storey or plan) to a large table.

    The side is settled, and broadcast when its files are under the bound.
    Beyond it the join is salted, so that one hot key spreads over many tasks.
    """
    side = settle(small)
    if side._bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(side), on, how)
    # Row and input partition together: every retry of a task gives the same salt, and
    # copies of one row still spread over as many salts as they have partitions.
    mark = F.xxhash64(*[F.col(c) for c in big.columns], F.spark_partition_id())
    salted = big.withColumn("_salt", F.pmod(mark, F.lit(SALTS)))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
