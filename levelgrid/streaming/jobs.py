"""Streaming forms: voxel totals, job state, cancels, transfers, stalled jobs, scan statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from levelgrid.operators.normalize import micro

TERMINAL = ["done", "error", "cancelled"]


def stream_voxels(points: DataFrame, voxel: float = 0.05) -> DataFrame:
    """Running centroid of every voxel as chunks of points arrive (update or complete mode).

    State is one row of integer sums per (scan, voxel), kept in the state
    store; sums do not depend on arrival order.
    """
    p = points.withColumns({f"v{c}": F.floor(F.col(c) / voxel) for c in "xyz"})
    sums = p.groupBy("scan_id", "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), *[F.sum(micro(F.col(c))).alias(f"_s{c}") for c in "xyz"])
    return sums.select("scan_id", "vx", "vy", "vz", "n", *[(F.col(f"_s{c}") / F.col("n") / 1e6).alias(c) for c in "xyz"])


def stream_job_state(events: DataFrame) -> DataFrame:
    """Latest state of every job (update or complete mode). After a terminal state the first
    one stays: later progress is ignored."""
    over = F.col("state").isin(*TERMINAL)
    out = events.groupBy("job_id").agg(
        F.max_by(F.struct("state", "progress"), "seq").alias("_last"),
        F.min_by(F.struct("state", "progress"), F.when(over, F.col("seq"))).alias("_end"),
        F.bool_or(over).alias("finished"), F.count(F.lit(1)).alias("updates"),
    )
    pick = lambda c: F.when(F.col("finished"), F.col(f"_end.{c}")).otherwise(F.col(f"_last.{c}"))
    return out.select("job_id", pick("state").alias("state"), pick("progress").alias("progress"), "finished", "updates")


def stream_first_cancels(cancels: DataFrame) -> DataFrame:
    """First cancel of every cancelled job (update mode); the state is one time per such job."""
    return cancels.groupBy("job_id").agg(F.min("ts").alias("cancelled_at"))


def stream_cancel(progress: DataFrame, first: DataFrame) -> DataFrame:
    """Stage boundaries with `cancelled`: a cancel of the job came at or before the boundary (append mode).

    `first` is the table of `stream_first_cancels`. A boundary gives one row, however many cancels its job has
    and however long ago they came, and waits for no later event.
    """
    side = first.select(F.col("job_id").alias("_job"), F.col("cancelled_at").alias("_at"))
    out = progress.join(side, F.expr("job_id = _job AND _at <= ts"), "leftOuter")
    return out.select(*progress.columns, F.col("_at").isNotNull().alias("cancelled"))


def stream_transfers(chunks: DataFrame, limit: int) -> DataFrame:
    """Bytes of every transfer so far and whether it went over the limit (update or complete mode)."""
    total = F.sum("bytes")
    return chunks.groupBy("transfer_id").agg(total.alias("bytes"), F.count(F.lit(1)).alias("chunks"), (total > limit).alias("rejected"))


def stream_stalled(events: DataFrame, timeout: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Quiet spells of jobs: sessions that ended without a terminal state (append mode)."""
    s = events.withWatermark("ts", watermark).groupBy("job_id", F.session_window("ts", timeout).alias("s"))
    out = s.agg(F.count(F.lit(1)).alias("updates"), F.bool_or(F.col("state").isin(*TERMINAL)).alias("finished"))
    return out.filter("not finished").select("job_id", F.col("s.start").alias("start"), F.col("s.end").alias("stalled_at"), "updates")


def stream_scan_stats(points: DataFrame, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Points per scan and window, with chunks that are sent twice counted once and late rows
    dropped by the watermark (append mode)."""
    once = points.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["scan_id", "point_id"])
    return once.groupBy("scan_id", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("points")).select(
        "scan_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "points"
    )


def run_to_table(df: DataFrame, mode: str, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Drive a bounded stream to its end into a table of the shared store and return that table.

    Every micro-batch is a folder of its own that a retried batch overwrites.
    With `keys` (update mode) the newest row of every key is returned, else
    (append mode) all rows are.
    """
    spark, out = df.sparkSession, f"{folder}/table"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.createDataFrame([], df.schema).write.parquet(f"{out}/batch=-1")
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(out)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in df.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in df.columns])
