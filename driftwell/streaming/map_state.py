"""The map as state of a stream: each cell holds the points it has taken, and each step of the stream adds to them.

What a step adds is what a publisher sends; in all it is what `voxel.insert_spaced` takes from the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.voxel import CELL, with_cells
from ..sources.scratch import shared_path

HELD = "xs array<double>, ys array<double>, zs array<double>, seen_ms long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CellInserter(StatefulProcessor):
    """One cell of the map: takes points in order while it has room and none that it holds is within the least distance.

    State is the places of the taken points, `capacity` at most. A cell that was last visited over keep_ms ago is empty to
    the points that come then; a timer drops its state when the watermark has passed that time.
    """

    def __init__(self, capacity: int, least_distance: float, order: list[str], columns: list[str], keep_ms: int | None) -> None:
        self.capacity, self.least, self.order, self.columns, self.keep_ms = capacity, least_distance, order, columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.held.get() if self.held.exists() else None
        held = [np.array(p) for p in zip(state[0], state[1], state[2], strict=True)] if state else []
        waiting, newest = [], state[3] if state else 0
        for part in rows:
            if self.keep_ms is not None:
                if state and int(part["time"].min().timestamp() * 1000) > state[3] + self.keep_ms:
                    held, state = [], None  # its timer hasn't come yet
                newest = max(newest, int(part["time"].max().timestamp() * 1000))
            if len(held) < self.capacity:  # what is near a point that is held already never comes in: drop it before sorting
                waiting.append(part[self._free(part, held)])
        taken = self._taken(pd.concat(waiting).sort_values(self.order), held) if waiting else None
        if taken is not None and len(taken) or self.keep_ms is not None:
            xyz = np.array(held).reshape(-1, 3)
            self.held.update((*(c.tolist() for c in xyz.T), newest))
        if self.keep_ms is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(newest + self.keep_ms)
        if taken is not None:
            yield taken[self.columns]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _free(self, part: pd.DataFrame, held: list[np.ndarray]) -> np.ndarray:
        points, free = part[["x", "y", "z"]].to_numpy(float), np.ones(len(part), bool)
        for p in held:
            free &= ((points - p) ** 2).sum(1) > self.least**2
        return free

    def _taken(self, part: pd.DataFrame, held: list[np.ndarray]) -> pd.DataFrame:
        """The rows that are taken, in order; their places are added to held."""
        points, free, taken = part[["x", "y", "z"]].to_numpy(float), np.arange(len(part)), []
        while len(free) and len(held) < self.capacity:
            taken.append(free[0])
            held.append(points[free[0]])
            free = free[1:][((points[free[1:]] - held[-1]) ** 2).sum(1) > self.least**2]
        return part.iloc[taken]


def insert_spaced(points: DataFrame, size: float, capacity: int, least_distance: float, order: list[str], keep: str | None = None, keep_ms: int | None = None) -> DataFrame:
    """The points of a stream (x, y, z and the order's columns) that the map takes, with their cells, as they come.

    Sweeps must come in order, whole or in parts: a step's rows come after all rows of earlier steps, within a step they are
    sorted. With `keep_ms` and a watermark delay `keep`, cells not visited for so long go; points then have a timestamp
    `time`. A step's rows of one cell are held in memory but for those next to a point that the cell already holds.
    """
    cells = with_cells(points.withWatermark("time", keep) if keep else points, size)
    schema = ", ".join(f"{n} {t}" for n, t in cells.dtypes)
    inserter = CellInserter(capacity, least_distance, order, cells.columns, keep_ms)
    return cells.groupBy(*CELL).transformWithStateInPandas(inserter, schema, "Append", "eventTime" if keep else "none")


def run_to_end(stream: DataFrame, schema_of: DataFrame | None = None) -> DataFrame:
    """Runs a stream over all that there is now, and reads what it gave; outputs and state are in the shared folder."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        out = shared_path(spark, "stream")
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema((schema_of or stream).schema).parquet(f"{out}/rows")


#: Rows of a file of a step or so.
FILE_ROWS = 250_000


def as_sweeps(df: DataFrame, frame: str, steps: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """A table as a stream of its frames in order, in so many steps or so: frames are written as files by range, and files are
    read in the order in which they are given their times.

    Every step has the same number of files, some of them empty if need be, and the stream reads as many at once; each is
    written and read by its own task. Steps are about even: their edges are quantiles within a hundredth.
    """
    spark = df.sparkSession
    path = shared_path(spark, "sweeps")
    edges = df.select(frame).distinct().approxQuantile(frame, [k / steps for k in range(1, steps)], 0.01) if steps > 1 else []
    files = max(1, -(-df.count() // (steps * file_rows)))
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None], strict=True), 1):
        part = df.filter((F.lit(True) if lo is None else F.col(frame) > lo) & (F.lit(True) if hi is None else F.col(frame) <= hi))
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.option("maxRecordsPerFile", 0).mode("append").parquet(path)
        for _ in range(k * files - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
