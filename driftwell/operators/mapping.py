"""The colour map on two grids, and which of its points each frame projects.

A coarse cell has room for so many points; a fine cell registers one of those. Which points a cell holds depends on it alone,
so both are groupings with no order over the whole map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import camera, folds, voxel

FINE = ["fx", "fy", "fz"]
#: Regions that a scan of the stored map is narrowed to by name; of more, all are read and the join sorts them out.
MOST_REGIONS = 4096


def every_nth_of_frames(points: DataFrame, frame: str, order: list[str], step: int) -> DataFrame:
    """Of each frame's points in order the first and every step-th after it."""
    place = F.row_number().over(Window.partitionBy(frame).orderBy(*order)) - 1
    return points.withColumn("__place", place).filter(F.col("__place") % step == 0).drop("__place") if step > 1 else points


def stored(points: DataFrame, frame: str, order: list[str], size: float, fine: float, capacity: int, step: int = 1) -> DataFrame:
    """The points that the colour map stores, with their coarse cell and whether they are `registered`.

    A point is stored while its coarse cell has room, in order of frames; of those stored, the first in each fine cell is
    registered. The points of one fine cell may lie in several coarse ones.
    """
    cells = voxel.with_cells(every_nth_of_frames(points, frame, order, step), size)
    room = F.row_number().over(Window.partitionBy(*voxel.CELL).orderBy(frame, *order))
    held = cells.withColumn("__room", room).filter(F.col("__room") <= capacity).drop("__room")
    held = held.withColumns({f: (F.col(c) / fine).cast("int") for f, c in zip(FINE, "xyz", strict=True)})
    first = held.groupBy(*FINE).agg(F.min(F.struct(frame, *order)).alias("__first"))
    mine = F.struct(F.col(frame), *(F.col(c) for c in order))
    return held.join(first, FINE).withColumn("registered", mine == F.col("__first")).drop("__first", *FINE)


def visited_cells(points: DataFrame, frame: str, order: list[str], size: float, step: int = 1) -> DataFrame:
    """(cell, shown): the coarse cells that each frame's points lie in."""
    return voxel.with_cells(every_nth_of_frames(points, frame, order, step), size).select(*voxel.CELL, F.col(frame).alias("shown")).distinct()


def latest_of_visited(points: DataFrame, held: DataFrame, frame: str, order: list[str], size: float, step: int = 1) -> DataFrame:
    """(at, frame, order, x, y, z): for each frame (`shown`) and coarse cell that it visits, the point that the cell took last, up
    to and with that frame. Cells are followed over frames by a window on one row for each cell and frame."""
    visits = visited_cells(points, frame, order, size, step)
    row = F.struct(frame, *order, "x", "y", "z")
    taken = held.groupBy(*voxel.CELL, F.col(frame).alias("shown")).agg(F.max(row).alias("row"))
    both = visits.join(taken, [*voxel.CELL, "shown"], "left")
    last = F.last("row", ignorenulls=True).over(Window.partitionBy(*voxel.CELL).orderBy("shown"))
    return both.withColumn("row", last).select("shown", "row.*")


def projected(candidates: DataFrame, order: list[str], world: list[Column], eye: list[Column], intrinsics: tuple[float, float, float, float], cols: int, rows: int, grid: float, nearest: float = 0.1, farthest: float = 200.0, margin: float = 0.005) -> DataFrame:
    """(shown, order, u, v, depth, gu, gv): of each frame's candidates (shown, order, x, y, z) the nearest in each grid cell of pixels.

    world: a point in the camera's frame, eye: the camera's place, as Columns on candidates. Depth is the distance from the
    eye; points out of its range, behind the camera or outside the image go. Ties go to the first in order.
    """
    away = [F.col(c) - e for c, e in zip("xyz", eye, strict=True)]
    depth = F.sqrt(sum((a * a for a in away), F.lit(0.0)))
    seen = candidates.select("shown", *order, depth.alias("far"), *(w.alias(c) for w, c in zip(world, "xyz", strict=True)))
    seen = camera.project(seen.filter(F.col("far").between(nearest, farthest)), *intrinsics).drop("depth").withColumnRenamed("far", "depth")
    seen = seen.filter(camera.in_image(F.col("u"), F.col("v"), cols, rows, margin))
    cell = [F.round(F.col(c) / grid).cast("int").alias(f"g{c}") for c in "uv"]
    best = seen.groupBy("shown", *cell).agg(F.min(F.struct("depth", *order, "u", "v")).alias("__row"))
    return best.select("shown", "gu", "gv", "__row.*")


# -- rendering of the cells that a frame visits ---------------------------------------------------------------


def with_region(df: DataFrame, side: int) -> DataFrame:
    """df with the name of the block of side by side by side cells that its cell is in."""
    return df.withColumn("region", F.concat_ws("_", *(F.floor(F.col(k) / side).cast("string") for k in voxel.CELL)))


def save_regions(held: DataFrame, path: str, side: int) -> None:
    """Writes the map's points, with their cells, in a folder for each region; a region is bounded by its cells' room."""
    with_region(held, side).repartition("region").sortWithinPartitions("region", *voxel.CELL).write.partitionBy("region").parquet(path)


def regions_of(path_table: DataFrame, visits: DataFrame, side: int, most: int = MOST_REGIONS) -> DataFrame:
    """The stored map, narrowed to the regions of visited cells, whose folders alone are read."""
    names = [r.region for r in with_region(visits, side).select("region").distinct().limit(most + 1).collect()]
    return path_table.filter(F.col("region").isin(names)) if len(names) <= most else path_table


def rendered_recent(held: DataFrame, visits: DataFrame, rasters: DataFrame, frame: str, order: list[str], world: list[Column], eye: list[Column], intrinsics: tuple[float, float, float, float], cols: int, rows: int, margin: float = 0.005) -> DataFrame:
    """(order, r, g, b, distance, n_rgb): map points fused with the colours of the frames that visit their cells.

    held: the map's points with their cells and the frame that stored them; visits: visited_cells(); rasters: (frame, row, col,
    r, g, b); world, eye: as in projected(). A frame renders the points that its visited cells hold by then, itself included:
    those in its image, from between the pixels, in order of frames. Points behind the camera, outside the image or without
    all four pixels around them aren't seen; a point that no frame sees gives no row.
    """
    met = visits.join(held.select(*voxel.CELL, F.col(frame).alias("__since"), *order, *"xyz"), voxel.CELL).filter(F.col("__since") <= F.col("shown"))
    away = [F.col(c) - e for c, e in zip("xyz", eye, strict=True)]
    distance = F.sqrt(sum((a * a for a in away), F.lit(0.0)))
    seen = met.select("shown", *order, distance.alias("distance"), *(w.alias(c) for w, c in zip(world, "xyz", strict=True)))
    seen = camera.project(seen, *intrinsics).filter(camera.in_image(F.col("u"), F.col("v"), cols, rows, margin))
    at = seen.select(F.struct("shown", *order, "distance").alias("at"), F.col("shown").alias("frame"), "u", "v")
    sampled = camera.bilinear(at, rasters, "at", ("r", "g", "b"))
    observed = sampled.select(*(F.col(f"at.{c}").alias(c) for c in (*order, "distance")), F.col("at.shown").cast("double").alias("ts"), *"rgb")
    kinds = ", ".join(f"{c} {observed.schema[c].dataType.simpleString()}" for c in order)
    return folds.fold_sorted(observed, order, ["ts"], lambda: ((0, 0, 0), (0.0,) * 3, 0.0, 0.0, 0), folds.colour_step, f"{kinds}, r int, g int, b int, distance double, n_rgb int", last_only=True)
