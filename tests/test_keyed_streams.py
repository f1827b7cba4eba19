"""Streams whose state ends: rows by micro-batch, late rows, timers, and the state that is left."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from levelgrid.session import workspace
from levelgrid.streaming import keyed

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def drive(spark, schema, batches, build, mode):
    """Feed lists of rows one micro-batch each; gives the rows of every batch and the checkpoint folder."""
    base = f"{workspace(spark)}/keyed-test/{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out, metrics = [], []
    df = build(stream)

    def sink(batch, number):
        out.append([tuple(r) for r in batch.collect()])

    for rows in batches:
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        metrics += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return [r for rows in out for r in rows], metrics[-1], base


JOBS = "job_id string, seq long, state string, progress double, ts timestamp"


def test_finished_jobs_leave_the_state(spark):
    batches = [
        [("a", 1, "running", 0.1, at(0)), ("b", 1, "running", 0.2, at(0)), ("c", 1, "running", None, at(1))],
        [("a", 2, "done", 1.0, at(2)), ("a", 3, "running", 0.5, at(3))],
        [("a", 4, "error", 0.0, at(5)), ("b", 2, "running", 0.4, at(5))],
        [("z", 1, "running", 0.0, at(60))],
        [("a", 5, "error", 0.0, at(6)), ("z", 2, "running", 0.1, at(61))],
        [("z", 3, "done", 1.0, at(2000))],
        [("y", 1, "done", 1.0, at(2100))],
        [("x", 1, "done", 1.0, at(2200))],
    ]
    rows, left, base = drive(spark, JOBS, batches, keyed.stream_job_feed, "update")
    news = lambda job: [r[1:] for r in rows if r[0] == job]
    # The first terminal state ends the feed; what comes later, also after the state is gone, changes nothing.
    assert news("a") == [("running", 0.1, 1, False), ("done", 1.0, 2, True)]
    # Silent for over a day: interrupted.
    assert news("b") == [("running", 0.2, 1, False), ("running", 0.4, 2, False), ("error", 0.4, 2, True)]
    assert news("c") == [("running", None, 1, False), ("error", None, 1, True)]
    assert news("z") == [("running", 0.0, 1, False), ("running", 0.1, 2, False), ("done", 1.0, 3, True)]
    # Only the last one is still within its grace.
    assert keyed.state_rows(spark, base) == 1


CHUNKS = "transfer_id long, seq long, bytes long, last boolean, ts timestamp"


def test_transfers_end_by_limit_or_last_chunk(spark):
    batches = [
        [(1, 1, 40, False, at(0)), (1, 2, 70, False, at(0)), (1, 3, 5, False, at(0)), (2, 1, 10, None, at(0)), (3, 1, None, False, at(0))],
        [(1, 4, 1, True, at(1)), (2, 2, 20, True, at(1)), (2, 3, 500, False, at(1))],
        [(9, 1, 1, True, at(5000))],
        [(8, 1, 1, True, at(6000))],
    ]
    rows, left, base = drive(spark, CHUNKS, batches, lambda s: keyed.stream_transfer_feed(s, 100), "update")
    assert sorted(r for r in rows if r[0] < 4) == [(1, 110, 2, True, True), (2, 10, 1, False, False), (2, 30, 2, False, True), (3, 0, 1, False, False), (3, 0, 1, False, True)]
    assert keyed.state_rows(spark, base) == 1


POINTS = "scan_id string, x double, y double, z double, complete boolean, ts timestamp"


def test_voxels_are_given_out_when_the_scan_is_complete(spark):
    build = lambda s: keyed.stream_scan_voxels(s.filter("not complete"), s.filter("complete"), 0.5, 3)
    batches = [
        [("a", 0.1, 0.2, 0.3, False, at(0)), ("a", 0.3, 0.2, 0.1, False, at(0)), ("b", -9.1, 70.0, 0.0, False, at(0))],
        [("a", None, None, None, True, at(1)), ("a", 30.1, 0.0, 0.0, False, at(2))],
        [("a", 0.2, 0.2, 0.2, False, at(4)), ("b", -9.1, 70.0, 0.0, False, at(4))],
        [("c", 1.0, 1.0, 1.0, False, at(100))],
        [("c", 1.0, 1.0, 1.0, False, at(200))],
    ]
    rows, left, base = drive(spark, POINTS, batches, build, "append")
    assert sorted(rows) == [("a", 0, 0, 0, 3, 0.2, 0.2, 0.2), ("a", 60, 0, 0, 1, 30.1, 0.0, 0.0)]
    kept = spark.read.format("statestore").option("stateVarName", "bricks").load(f"{base}/state").select(F.col("key.scan_id")).distinct().collect()
    assert sorted(r[0] for r in kept) == ["b", "c"]


def test_no_rows(spark):
    with pytest.raises(ValueError):
        keyed._span("soon")
    rows, _, _ = drive(spark, JOBS, [[("a", 1, "done", 1.0, at(0))]], keyed.stream_job_feed, "update")
    assert rows == [("a", "done", 1.0, 1, True)]
