"""Alignment and folds over streams: the same semantics as the batch operators, by keyed state and watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def replay(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A recorded table as a stream, a few files in each step."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


#: What a row of an aligned stream is; samples decide with points how far time has come, triggers end sweeps.
POINT, SAMPLE, TRIGGER = 0, 1, 2
ROW = "user_id long, id long, ts long, value double, kind int"
ALIGNED = f"{ROW}, end_ts long"
KINDS = "int64", "int64", "float64", "int32"
WAITING = "ids array<long>, times array<long>, values array<double>, kinds array<int>, ends array<long>, oldest long"


class SweepAligner(StatefulProcessor):
    """One user's points and samples wait for the first trigger later than them; a trigger is used once the watermark, which is
    the least of all inputs', has passed it, so nothing older can come any more.

    Triggers no later than the user's oldest sample are left out. Rows that no trigger has ended longest_ms after them are
    dropped; a user without waiting rows and triggers has no state but its oldest sample, and after as long none at all.
    """

    def __init__(self, longest_ms: int) -> None:
        self.longest_ms = longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", WAITING)

    def _read(self) -> tuple[list[np.ndarray], list[int], int | None]:
        """What waits (ids, times, values, kinds), the triggers to come in order, and the oldest sample."""
        s = self.held.get() or ([], [], [], [], [], None)
        return [np.array(list(c), kind) for c, kind in zip(s[:4], KINDS, strict=True)], list(s[4]), s[5]

    def _write(self, waiting: list[np.ndarray], ends: list[int], oldest: int | None) -> None:
        self.held.update((*(c.tolist() for c in waiting), ends, oldest))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        waiting, ends, oldest = self._read()
        parts = [[part[c].to_numpy() for c in ("id", "ts", "value", "kind")] for part in rows]
        fresh = [np.concatenate(c) for c in zip(*parts, strict=True)]
        samples, new = fresh[1][fresh[3] == SAMPLE], np.unique(fresh[1][fresh[3] == TRIGGER]).tolist()
        if len(samples):
            oldest = int(samples.min()) if oldest is None else min(oldest, int(samples.min()))
        latest = int(fresh[1].max())
        kept = fresh[3] != TRIGGER
        self._write([np.concatenate([w, f[kept]]) for w, f in zip(waiting, fresh, strict=True)], sorted({*ends, *new}), oldest)
        if new and (not ends or new[0] < ends[0]):  # the next trigger's timer alone: it takes all that are due
            self.handle.registerTimer(-(-new[0] // 1000))
        self.handle.registerTimer(-(-latest // 1000) + self.longest_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, ends, oldest = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        due = [e for e in ends if -(-e // 1000) <= now]
        used = np.array([e for e in due if oldest is not None and e > oldest], np.int64)
        place = np.searchsorted(used, waiting[1], side="right")
        done = place < len(used)
        out = dict(zip(("id", "ts", "value", "kind"), (c[done] for c in waiting), strict=True))
        left = ~done & (waiting[1] // 1000 + self.longest_ms >= now)
        ends = ends[len(due) :]
        if ends and due:
            self.handle.registerTimer(-(-ends[0] // 1000))
        if left.any() or ends or expiredTimerInfo.getExpiryTimeInMs() + self.longest_ms > now and oldest is not None and oldest // 1000 + self.longest_ms >= now:
            self._write([c[left] for c in waiting], ends, oldest)
        else:
            self.held.clear()
        if done.any():
            yield pd.DataFrame({"user_id": np.full(done.sum(), key[0]), **out, "end_ts": used[place[done]]})

    def close(self) -> None:
        pass


def align_sweeps(points: DataFrame, samples: DataFrame, triggers: DataFrame, longest_ms: int, delay: str = "0 seconds") -> DataFrame:
    """Points and samples with the end of their sweep, from three streams (user_id, id, ts in microseconds, value), each with its
    own watermark; see SweepAligner. Late rows, older than the watermark, are dropped. Equals `temporal.assign_sweeps` with the
    triggers of `temporal.ready`, as far as the watermark has come."""
    time = F.timestamp_micros("ts").alias("time")
    parts = [df.select("user_id", "id", "ts", F.col("value").cast("double").alias("value"), F.lit(kind).alias("kind"), time).withWatermark("time", delay) for kind, df in enumerate((points, samples, triggers))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("user_id").transformWithStateInPandas(SweepAligner(longest_ms), ALIGNED, "Append", "eventTime")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of values in tumbling windows, closed by a watermark; later rows are dropped."""
    return events.withWatermark("time", late).groupBy(F.window("time", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
