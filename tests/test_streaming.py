"""Streams give what the batch operators give."""

from __future__ import annotations

import time
from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwell.operators import temporal, voxel
from driftwell.sources.tables import POINT_KEY, micros, points, series, table, triggers
from driftwell.streaming import align, map_state


def _inputs(rows, steps):
    return [map_state.as_sweeps(df, "ts", steps) for df in rows]


def test_aligned_streams_equal_batch(spark, sf_dir):
    """Three streams in steps; sweeps that the least watermark has passed are those of the batch operators."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), micros("ts").alias("ts"), "value", "event_type")
    kinds = ("view", "click"), ("purchase", "error"), ("signup",)
    rows = [events.filter(F.col("event_type").isin(*k)).drop("event_type") for k in kinds]
    reached = min(df.agg(F.max("ts")).first()[0] for df in rows) // 1000 * 1000
    samples = rows[1].withColumnRenamed("id", "sample_id")
    oldest = samples.groupBy("user_id").agg(F.min("ts").alias("oldest"))
    ends = rows[2].select("user_id", F.col("ts").alias("end_ts")).join(oldest, "user_id").filter((F.col("end_ts") > F.col("oldest")) & (F.col("end_ts") <= reached))
    batch = temporal.assign_sweeps(rows[0].unionByName(rows[1]), ends.select("user_id", "end_ts")).filter("end_ts IS NOT NULL")
    expected = sorted((r.user_id, r.id, r.end_ts) for r in batch.collect())
    for steps in (1, 4):
        out = map_state.run_to_end(align.align_sweeps(*_inputs(rows, steps), longest_ms=10**11))
        assert sorted((r.user_id, r.id, r.end_ts) for r in out.collect()) == expected and len(expected) > 100


def test_alignment_leaves_no_state(spark, tmp_path):
    """After rows far in the future, what waited in vain is gone; a point at a sweep's end belongs to the next one."""
    schema, second = "user_id long, id long, ts long, value double", 1_000_000
    points = [(1, 1, 5 * second, 1.0), (1, 2, 10 * second, 1.0), (1, 3, 25 * second, 1.0), (2, 4, 7 * second, 1.0), (9, 90, 1000 * second, 0.0), (9, 91, 5000 * second, 0.0)]
    samples = [(1, 11, 4 * second, 1.0), (1, 12, 12 * second, 1.0), (2, 13, 9 * second, 1.0), (9, 92, 1000 * second, 0.0), (9, 93, 5000 * second, 0.0)]
    triggers = [(1, 21, 3 * second, 0.0), (1, 22, 10 * second, 0.0), (1, 23, 20 * second, 0.0), (2, 24, 8 * second, 0.0), (9, 94, 1000 * second, 0.0), (9, 95, 5000 * second, 0.0)]
    streams = _inputs([spark.createDataFrame(x, schema) for x in (points, samples, triggers)], 3)
    out = map_state.run_to_end(align.align_sweeps(*streams, longest_ms=60_000))
    assert sorted((r.id, r.end_ts // second) for r in out.collect() if r.user_id < 9) == [(1, 10), (2, 20), (11, 10), (12, 20)]
    state = spark.read.format("statestore").option("stateVarName", "held").load(out.inputFiles()[0].rsplit("/rows/", 1)[0] + "/state")
    assert {r.key.user_id for r in state.collect()} <= {9}


def test_windows_close_by_watermark(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp")).drop("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = align.windowed_counts(align.replay(spark, str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    whole = events.groupBy(F.window("time", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert rows.count() > 0
    assert rows.join(whole.select(F.col("w.start").alias("start"), "event_type", F.col("n").alias("all")), ["start", "event_type"]).filter("n <> all").count() == 0


@pytest.mark.parametrize("steps", [1, 3, 7])
def test_streamed_map_equals_batch(spark, sf_dir, steps):
    df = points(spark, sf_dir).withColumn("frame", F.floor(F.col("l_orderkey") / 100)).drop("ts", "l_shipdate")
    order = ["frame", *(k for k in POINT_KEY if k != "l_shipdate")]
    batch = voxel.insert_spaced(df, 8.0, 6, 2.0, order)
    streamed = map_state.run_to_end(map_state.insert_spaced(map_state.as_sweeps(df, "frame", steps), 8.0, 6, 2.0, order))
    assert streamed.columns == batch.columns or sorted(streamed.columns) == sorted(batch.columns)
    got, expected = ([tuple(r) for r in x.select(sorted(batch.columns)).collect()] for x in (streamed, batch))
    assert sorted(got) == sorted(expected) and len(got) > 100
    assert max(r["count"] for r in streamed.groupBy(*voxel.CELL).count().collect()) <= 6


def test_cells_that_nobody_visits_go(spark, tmp_path):
    """A cell's state is dropped after its time; later points find it empty, and a visited cell stays full."""
    schema = "id long, x double, y double, z double, time timestamp"
    at = lambda s: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=s)
    steps = [[(1, 0.1, 0.1, 0.1, at(0)), (2, 5.1, 0.1, 0.1, at(0))], [(3, 5.2, 0.1, 0.1, at(60))], [(4, 5.3, 0.1, 0.1, at(100))], [(5, 0.2, 0.1, 0.1, at(130)), (6, 5.4, 0.1, 0.1, at(130))]]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if k < 3 else 0)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = map_state.run_to_end(map_state.insert_spaced(stream, 1.0, 1, 0.01, ["id"], keep="1 second", keep_ms=70_000))
    assert sorted(r.id for r in out.collect()) == [1, 2, 5]


def test_steps_of_many_files(spark, sf_dir):
    """A step is written and read by many tasks, and still comes whole and in order, small steps too."""
    df = points(spark, sf_dir).withColumn("frame", F.when(F.col("l_orderkey") < 30, 0).when(F.col("l_orderkey") < 40, 1).otherwise(2)).drop("ts", "l_shipdate")
    order = ["frame", *(k for k in POINT_KEY if k != "l_shipdate")]
    stream = map_state.as_sweeps(df, "frame", 3, file_rows=500)
    streamed = map_state.run_to_end(map_state.insert_spaced(stream, 8.0, 6, 2.0, order))
    batch = voxel.insert_spaced(df, 8.0, 6, 2.0, order)
    got, expected = (sorted(tuple(r) for r in x.select(sorted(batch.columns)).collect()) for x in (streamed, batch))
    assert got == expected and len(got) > 100


def test_one_timer_takes_all_due_triggers():
    """A user's triggers have one timer, that of the next one."""

    class Held:
        value = None
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)

    class Handle:
        timers: list = []
        registerTimer = lambda self, t: self.timers.append(t)

    aligner = align.SweepAligner(10**9)
    aligner.handle, aligner.held = Handle(), Held()
    rows = pd.DataFrame({"id": range(6), "ts": [1000, 2000, 3000, 4000, 5000, 6000], "value": 0.0, "kind": [align.SAMPLE] + [align.TRIGGER] * 5})
    list(aligner.handleInputRows((1,), iter([rows]), None))
    assert sorted(Handle.timers) == [2, 6 + 10**9]
