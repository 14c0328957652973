"""Regions of space with about as many points each, and the search for neighbours region by region.

Halves of a bounded sample give the planes between regions, so a crowd is many regions, however dense; every point and query
is dealt by them. A query meets its own region for a bound, the distance of its k-th neighbour there, and then just the
regions that the bound reaches. Results don't depend on the planes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of a region or so, queries that meet it at once, distances in a matrix at a time.
POINTS, QUERIES, AT_ONCE = 1024, 4096, 1 << 20
#: A sample has so many points a region; there are at most 2 ** MOST_HALVINGS regions, which are larger beyond.
SAMPLED, MOST_HALVINGS = 32, 13


@dataclass(frozen=True)
class Regions:
    """A full tree of halvings, node i above 2 i + 1 (below the cut on its axis) and 2 i + 2; leaves are regions. Boxes hold
    their points exactly, since both come from the same comparisons."""

    halvings: int
    axes: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, xyz: np.ndarray) -> np.ndarray:
        at = np.zeros(len(xyz), np.int64)
        for _ in range(self.halvings):
            at = 2 * at + np.where(xyz[np.arange(len(xyz)), self.axes[at]] < self.cuts[at], 1, 2)
        return at - (2**self.halvings - 1)

    def reached(self, xyz: np.ndarray, d2: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the regions that come as near as d2 and meet the boxes from low to high."""
        row, at = np.arange(len(xyz)), np.zeros(len(xyz), np.int64)
        for level in range(self.halvings + 1):
            if level:
                row, at = np.repeat(row, 2), np.column_stack([2 * at + 1, 2 * at + 2]).ravel()
            off = np.maximum(np.maximum(self.low[at] - xyz[row], xyz[row] - self.high[at]), 0.0)
            off = off * off
            near = (off[:, 0] + off[:, 1] + off[:, 2] <= d2[row]) & (self.low[at] <= high[row]).all(1) & (self.high[at] >= low[row]).all(1)
            row, at = row[near], at[near]
        return row, at - (2**self.halvings - 1)


def regions(points: DataFrame, points_each: int = POINTS) -> Regions:
    """Of points (x, y, z), by a sample of SAMPLED points a region, which alone comes to the driver."""
    n = points.count()
    halvings = min(MOST_HALVINGS, max(0, (n // points_each).bit_length()))
    inner = 2**halvings - 1
    axes, cuts = np.zeros(inner, np.int64), np.zeros(inner)
    low, high = np.full((2 * inner + 1, 3), -np.inf), np.full((2 * inner + 1, 3), np.inf)
    share = min(1.0, SAMPLED * 2**halvings / max(n, 1))
    picked = {0: points.select("x", "y", "z").sample(share, 1).dropna().toPandas().to_numpy(float) if inner else np.zeros((0, 3))}
    for i in range(inner):
        mine = picked.pop(i)
        axes[i] = np.argmax(np.ptp(mine, axis=0)) if len(mine) else 0
        cuts[i] = np.partition(mine[:, axes[i]], len(mine) // 2)[len(mine) // 2] if len(mine) else 0.0
        below = mine[:, axes[i]] < cuts[i]
        for child, part in ((2 * i + 1, mine[below]), (2 * i + 2, mine[~below])):
            low[child], high[child], picked[child] = low[i], high[i], part
        low[2 * i + 2, axes[i]] = high[2 * i + 1, axes[i]] = cuts[i]
    return Regions(halvings, axes, cuts, low, high)


def dealt(df: DataFrame, tree: Regions) -> DataFrame:
    """df with the `region` of its x, y, z."""

    @F.pandas_udf("int")
    def region(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(tree.of(np.column_stack([x, y, z]).astype(float))).astype("int32")

    return df.withColumn("region", region("x", "y", "z"))


def _numbers(rows: pa.Table, names: list[str], kind: type) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy() for c in names]).astype(kind) if len(rows) else np.zeros((0, len(names)), kind)


def _distances(asked: pa.Table, held: pa.Table, cell: list[str], reach: int):
    """(first row, squared distances of rows to all held points; infinite beyond the cells in reach), block by block."""
    q, p = _numbers(asked, ["x", "y", "z"], float), _numbers(held, ["nx", "ny", "nz"], float)
    cq, cp = _numbers(asked, cell, np.int64), _numbers(held, [f"n{c}" for c in cell], np.int64)
    step = max(1, AT_ONCE // max(len(p), 1))
    for lo in range(0, len(q), step):
        a, c = q[lo : lo + step], cq[lo : lo + step]
        d2 = np.zeros((len(a), len(p)))
        for k in range(3):
            off = a[:, k, None] - p[:, k]
            d2 += off * off
        for k in range(3):
            if len(p) and max(c[:, k].max() - cp[:, k].min(), cp[:, k].max() - c[:, k].min()) > reach:
                d2[np.abs(c[:, k, None] - cp[:, k]) > reach] = np.inf
        yield lo, d2


def _met(asked: DataFrame, held: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """f over each region's queries and points. Queries are cut in parts of QUERIES or so, each of which meets the points."""
    parts = asked.groupBy("region").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    asked = asked.join(F.broadcast(parts), "region").withColumn("part", F.pmod(F.xxhash64("query_id", "x", "y", "z"), "parts")).drop("parts")
    held = held.join(F.broadcast(parts), "region").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return asked.groupBy("region", "part").cogroup(held.groupBy("region", "part")).applyInArrow(f, schema)


def bounds(asked: DataFrame, held: DataFrame, cell: list[str], reach: int, k: int) -> DataFrame:
    """asked (query_id, x, y, z, cell, region) with `bound`, the squared distance of the k-th of the region's points (point, nx, ny,
    nz, their cells with an n before); infinite where there are fewer."""

    def run(asked_: pa.Table, held_: pa.Table) -> pa.Table:
        found = np.full(len(asked_), np.inf)
        if len(held_) >= k:
            for lo, d2 in _distances(asked_, held_, cell, reach):
                found[lo : lo + len(d2)] = np.partition(d2, k - 1, axis=1)[:, k - 1]
        return asked_.select([*columns]).append_column("bound", pa.array(found, pa.float64()))

    columns = ["query_id", *"xyz", *cell]
    schema = T.StructType([*asked.select(*columns).schema, T.StructField("bound", T.DoubleType())])
    return _met(asked, held, run, schema)


def visits(asked: DataFrame, tree: Regions, cell: list[str], size: float, reach: int) -> DataFrame:
    """bounds() rows with each region that their bound reaches and that the cells in reach meet."""
    schema = T.StructType([*asked.schema, T.StructField("region", T.IntegerType())])

    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            cells = _numbers(rows, cell, float)
            first, last = cells - reach, cells + reach  # cells truncate toward zero; room for the rounding of their edges
            low = (np.where(first > 0, first, first - 1) - 1e-6 * (1 + np.abs(first))) * size
            high = (np.where(last < 0, last, last + 1) + 1e-6 * (1 + np.abs(last))) * size
            at, region = tree.reached(_numbers(rows, ["x", "y", "z"], float), rows.column("bound").to_numpy(), low, high)
            for lo in range(0, len(at), 10_000):
                yield from rows.take(at[lo : lo + 10_000]).append_column("region", pa.array(region[lo : lo + 10_000], pa.int32())).to_batches()

    return asked.mapInArrow(run, schema)


def nearest(asked: DataFrame, held: DataFrame, cell: list[str], reach: int, k: int) -> DataFrame:
    """(query_id, point, d2, nx, ny, nz): of each visit the k nearest points within the bound, ties to smaller ids."""

    def run(asked_: pa.Table, held_: pa.Table) -> pa.Table:
        held_ = held_.take(pc.sort_indices(held_, sort_keys=[("point", "ascending")]))
        bound, rows, cols, far = _numbers(asked_, ["bound"], float)[:, 0], [], [], []
        for lo, d2 in _distances(asked_, held_, cell, reach):
            most = bound[lo : lo + len(d2), None]
            if d2.shape[1] > k:
                most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1, None])
            r, c = np.nonzero((d2 <= most) & (d2 < np.inf))
            order = np.lexsort((c, d2[r, c], r))
            r, c = r[order], c[order]
            kept = np.arange(len(r)) - np.searchsorted(r, r) < k
            rows.append(lo + r[kept])
            cols.append(c[kept])
            far.append(d2[r[kept], c[kept]])
        at = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)]).astype(kind)
        mine, its = asked_.select(["query_id"]).take(at(rows, np.int64)), held_.select(["point", "nx", "ny", "nz"]).take(at(cols, np.int64))
        return pa.table([mine.column(0), its.column(0), pa.array(at(far, float)), *its.columns[1:]], names=["query_id", "point", "d2", "nx", "ny", "nz"])

    schema = T.StructType([*asked.select("query_id").schema, *held.select("point").schema, *(T.StructField(c, T.DoubleType()) for c in ("d2", "nx", "ny", "nz"))])
    return _met(asked, held, run, schema)
