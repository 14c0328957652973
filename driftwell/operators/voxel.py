"""The voxel layer: cells, sampling, bounded insertion, neighbours and local planes.

Cells truncate toward zero, so those that touch zero are double width; this defines results and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import regions

CELL = ["kx", "ky", "kz"]


def with_cells(df: DataFrame, size: float) -> DataFrame:
    return df.withColumns({k: (F.col(c) / size).cast("int") for k, c in zip(CELL, "xyz", strict=True)})


def downsample(df: DataFrame, size: float, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The first point of each cell in the given order. The minimum of a row struct is taken before the shuffle, so a crowded
    cell is not one window."""
    cells = with_cells(df, size)
    rest = [c for c in df.columns if c not in order and c not in (by or [])]
    row = F.min(F.struct(*order, *rest)).alias("__row")
    return cells.groupBy(*(by or []), *CELL).agg(row).select(*(by or []), *CELL, "__row.*")


def counts(df: DataFrame, size: float) -> DataFrame:
    return with_cells(df, size).groupBy(*CELL).agg(F.count("*").alias("n_points"))


def insert_spaced(df: DataFrame, size: float, capacity: int, least_distance: float, order: list[str]) -> DataFrame:
    """Points that a map takes, cell by cell and in order: while the cell has under `capacity` points and none of them is
    within `least_distance`.

    Cells are sorted within partitions and streamed: a cell's state is the points it has taken, so a crowded one stays bounded.
    """
    cells = with_cells(df, size).repartition(*CELL).sortWithinPartitions(*CELL, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for rows in batches:
            keys = np.nan_to_num(rows[CELL].to_numpy(float), nan=np.inf)
            points, taken = rows[["x", "y", "z"]].to_numpy(float), []
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(rows)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if key is None or (keys[lo] != key).any():  # a cell may go on from the last batch
                    key, held = keys[lo], []
                free = np.arange(lo, hi)
                for p in held:
                    free = free[((points[free] - p) ** 2).sum(1) > least_distance**2]
                while len(free) and len(held) < capacity:
                    taken.append(free[0])
                    held.append(points[free[0]].copy())
                    free = free[1:][((points[free[1:]] - held[-1]) ** 2).sum(1) > least_distance**2]
            yield rows.iloc[taken]

    return cells.mapInPandas(run, cells.schema)


def neighbours(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, size: float, reach: int, k: int, least_in_cell: int = 1, crowd: int | None = None, tree: regions.Regions | None = None) -> DataFrame:
    """(query_id, rank, point_id, d2, and the point's nx, ny, nz): the k nearest points in the cells around each query.

    Cells under `least_in_cell` points are left out. Ties go to the smaller id, a number or a string; of points in one place
    the k first are enough. Points and queries meet by regions of about `crowd` points (see regions.py), so neither crowded
    cells nor copies make pairs; bounds are written between the two meetings. tree: regions of these points or of others
    that lie alike, to be used again.
    """
    tree = tree or regions.regions(points, crowd or regions.POINTS)
    held = with_cells(points.select(F.col(point_id).alias("point"), *(F.col(c).cast("double").alias(c) for c in "xyz")), size).dropna(subset=CELL)
    if least_in_cell > 1:
        held = held.join(held.groupBy(*CELL).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least_in_cell), CELL, "left_semi")
    place = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("point"))
    held = regions.dealt(held.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place"), tree)
    held = held.select("region", "point", *(F.col(c).alias(f"n{c}") for c in (*"xyz", *CELL)))
    asked = with_cells(queries.select(F.col(query_id).alias("query_id"), *(F.col(c).cast("double").alias(c) for c in "xyz")), size).dropna(subset=CELL)
    bound = written(regions.bounds(regions.dealt(asked, tree), held, CELL, reach, k), "bounds")
    met = regions.nearest(regions.visits(bound, tree, CELL, size, reach), held, CELL, reach, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "point"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("point").alias(point_id), "d2", "nx", "ny", "nz")


def moments(near: DataFrame, by: str = "query_id", more: list[Column] | None = None) -> DataFrame:
    """Count, barycentre and scatter (not divided by the count) of each query's neighbours, from sums; and `more`
    aggregates, by their names."""
    sums = {"n": F.count("*")} | {f"s{c}": F.sum(f"n{c}") for c in "xyz"} | {f"s{a}{b}": F.sum(F.col(f"n{a}") * F.col(f"n{b}")) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    out = near.groupBy(by).agg(*(v.alias(k) for k, v in sums.items()), *(more or []))
    means = {f"m{c}": F.col(f"s{c}") / F.col("n") for c in "xyz"}
    scatter = {f"c{a}{b}": F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return out.select(by, "n", *(v.alias(k) for k, v in means.items()), *(v.alias(k) for k, v in scatter.items()), *out.columns[1 + len(sums) :])


#: Eigenvalues that differ by less than this share of the largest one count as equal.
EQUAL = 1e-9


def _dot(a: list[Column], b: list[Column]) -> Column:
    return sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _longest(vectors: list[list[Column]]) -> Column:
    """The longest of three vectors, the first of those of one length, as an array."""
    lengths = [_dot(v, v) for v in vectors]
    most = F.greatest(*lengths)
    return F.when(lengths[0] == most, F.array(*vectors[0])).when(lengths[1] == most, F.array(*vectors[1])).otherwise(F.array(*vectors[2]))


def eigenvalues(df: DataFrame, parts: list[str], names: list[str]) -> DataFrame:
    """df with the three eigenvalues, largest first, of symmetric 3 by 3 matrices (xx, xy, xz, yy, yz, zz), by the roots'
    cosines. Each step is a column, so no expression is repeated within another."""
    xx, xy, xz, yy, yz, zz = (F.col(c) for c in parts)
    q = F.col("__q")
    df = df.withColumn("__q", (xx + yy + zz) / 3)
    df = df.withColumn("__p", F.sqrt((_dot([xx - q, yy - q, zz - q], [xx - q, yy - q, zz - q]) + 2 * _dot([xy, xz, yz], [xy, xz, yz])) / 6))
    determinant = (xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)
    half = F.when(F.col("__p") > 0, determinant / (2 * F.col("__p") * F.col("__p") * F.col("__p"))).otherwise(F.lit(1.0))
    df = df.withColumn("__phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3)
    df = df.withColumns({names[0]: q + 2 * F.col("__p") * F.cos("__phi"), names[2]: q + 2 * F.col("__p") * F.cos(F.col("__phi") + 2 * math.pi / 3)})
    return df.withColumn(names[1], 3 * q - F.col(names[0]) - F.col(names[2])).drop("__q", "__p", "__phi")


def planes(scatters: DataFrame) -> DataFrame:
    """moments() rows with the unit normal (of the smallest eigenvalue, its largest part positive) and planarity
    a2d = (s2 - s3) / s1 with s the square roots of the eigenvalues, 0 for a point cloud without spread.

    Where the two smaller eigenvalues are equal (a line), any normal across the axis would do: it is the axis crossed with
    the coordinate axis that it leans to least. Where all three are equal it is that of z.
    """
    xx, xy, xz, yy, yz, zz = (F.col(f"c{c}") for c in ("xx", "xy", "xz", "yy", "yz", "zz"))
    df = eigenvalues(scatters, ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"], ["__l1", "__l2", "__l3"])
    l1, l2, l3 = (F.col(f"__l{k}") for k in (1, 2, 3))
    rows = [[xx - l3, xy, xz], [xy, yy - l3, yz], [xz, yz, zz - l3]]
    df = df.withColumns({"__across": _longest([_cross(rows[a], rows[b]) for a, b in ((0, 1), (0, 2), (1, 2))]), "__axis": _longest(rows)})
    axis = [F.col("__axis")[k] for k in range(3)]
    zero = F.lit(0.0)
    least = F.least(*(F.abs(a) for a in axis))
    beside = F.when(F.abs(axis[0]) == least, F.array(zero, axis[2], -axis[1])).when(F.abs(axis[1]) == least, F.array(-axis[2], zero, axis[0])).otherwise(F.array(axis[1], -axis[0], zero))
    round_, line = (l1 <= 0) | (l1 - l3 <= EQUAL * l1), l2 - l3 <= EQUAL * l1
    df = df.withColumn("__n", F.when(round_, F.array(zero, zero, F.lit(1.0))).when(line, beside).otherwise(F.col("__across")))
    n = [F.col("__n")[k] for k in range(3)]
    most = F.greatest(*(F.abs(v) for v in n))
    largest = F.when(F.abs(n[0]) == most, n[0]).when(F.abs(n[1]) == most, n[1]).otherwise(n[2])
    df = df.withColumn("__length", F.sqrt(_dot(n, n)) * F.when(largest < 0, -1).otherwise(1))
    s = [F.sqrt(F.abs(v)) for v in (l1, l2, l3)]
    flat = {"a2d": F.when(s[0] > 0, (s[1] - s[2]) / s[0]).otherwise(zero)}
    return df.withColumns({f"normal_{c}": v / F.col("__length") for c, v in zip("xyz", n, strict=True)} | flat).drop("__across", "__axis", "__n", "__length", "__l1", "__l2", "__l3")


def facing(fitted: DataFrame, place: list[Column], body: list[Column]) -> DataFrame:
    """planes() rows with the normal turned toward a place, seen from the point on the body: n (place - body) is not below
    0."""
    n = [F.col(f"normal_{c}") for c in "xyz"]
    away = _dot(n, [p - b for p, b in zip(place, body, strict=True)]) < 0
    return fitted.withColumn("__away", away).withColumns({f"normal_{c}": F.when(F.col("__away"), -v).otherwise(v) for c, v in zip("xyz", n, strict=True)}).drop("__away")


def plane_residuals(queries: DataFrame, near: DataFrame, fitted: DataFrame, query_id: str, max_distance: float, least_neighbours: int, last: list[Column], body: list[str] | None = None, share: float = 0.9, power: float = 2.0) -> DataFrame:
    """Point-to-plane rows: signed distance to the nearest neighbour's plane under the one-sided gate, weight and the six
    Jacobian parts. The weight mixes planarity and nearness.

    The gate is one-sided, so a normal's side matters: it looks toward `last`, the place of the pose before, from the
    point on the body (columns `body` of queries; x, y, z where none are given).
    """
    first = near.filter("rank = 1").select("query_id", "nx", "ny", "nz", "d2")
    rows = queries.withColumnRenamed(query_id, "query_id").join(fitted.filter(F.col("n") >= least_neighbours), "query_id").join(first, "query_id")
    rows = facing(rows, last, [F.col(c) for c in body or "xyz"])
    n = [F.col(f"normal_{c}") for c in "xyz"]
    distance = _dot(n, [F.col(c) - F.col(f"n{c}") for c in "xyz"])
    weight = share * F.pow("a2d", F.lit(power)) + (1 - share) * F.exp(-F.sqrt("d2") / (max_distance * least_neighbours))
    rows = rows.withColumns({"distance": distance, "weight": weight}).filter(F.col("distance") < max_distance)
    turn = _cross([F.col(c) for c in "xyz"], n)
    return rows.select("query_id", "distance", "weight", *((v * F.col("weight")).alias(f"j{k}") for k, v in enumerate([*n, *turn])))


def normal_equations(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Upper triangle of J'J, J'r and the loss, as partial sums on the executors."""
    parts = [F.sum(F.col(f"j{a}") * F.col(f"j{b}")).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    parts += [F.sum(F.col(f"j{a}") * F.col("distance") * F.col("weight")).alias(f"g{a}") for a in range(6)]
    return rows.groupBy(*(by or [])).agg(*parts, F.sum(F.col("distance") * F.col("distance")).alias("loss"), F.count("*").alias("n_residuals"))


def evict_far(df: DataFrame, origin: tuple[float, float, float], distance: float, order: list[str]) -> DataFrame:
    """Cells whose first point lies within `distance` of the origin, with all their points (df has cells)."""
    first = df.groupBy(*CELL).agg(F.min(F.struct(*order, "x", "y", "z")).alias("p"))
    d2 = sum(((F.col(f"p.{c}") - o) * (F.col(f"p.{c}") - o) for c, o in zip("xyz", origin, strict=True)), F.lit(0.0))
    return df.join(first.filter(d2 <= distance * distance).select(*CELL), CELL, "left_semi")
