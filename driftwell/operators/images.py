"""Lens distortion, resampling, colour spaces and tiled equalisation, on long-form rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distortion: two radial parts, two tangential ones, and the third radial one.
Lens = tuple[float, float, float, float, float]


def distorted(x: Column, y: Column, lens: Lens) -> tuple[Column, Column]:
    """Where the lens puts a place (in units of the focal length from the middle)."""
    k1, k2, p1, p2, k3 = lens
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def undistorted_places(df: DataFrame, x: str, y: str, lens: Lens, steps: int = 12) -> DataFrame:
    """df with the places that the lens puts at x and y, found by so many steps of a fixed-point iteration; each step is a
    projection of its own, so expressions don't grow."""
    k1, k2, p1, p2, k3 = lens
    df = df.withColumns({"__x": F.col(x), "__y": F.col(y)})
    a, b, r2 = F.col("__x"), F.col("__y"), F.col("__r2")
    for _ in range(steps):
        df = df.withColumn("__r2", a * a + b * b)
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        df = df.withColumns({"__x": (F.col(x) - 2 * p1 * a * b - p2 * (r2 + 2 * a * a)) / radial, "__y": (F.col(y) - p1 * (r2 + 2 * b * b) - 2 * p2 * a * b) / radial})
    return df.withColumns({x: F.col("__x"), y: F.col("__y")}).drop("__x", "__y", "__r2")


def resampled(places: DataFrame, raster: DataFrame) -> DataFrame:
    """(frame, row, col, value) of target pixels (frame, row, col, u, v): the raster between its pixels at u, v. Pixels outside
    the raster count as 0."""
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    du, dv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    weight = F.when(F.col("o.b") == 1, du).otherwise(1 - du) * F.when(F.col("o.a") == 1, dv).otherwise(1 - dv)
    asked = places.withColumn("o", corners).select("frame", F.col("row").alias("to_row"), F.col("col").alias("to_col"), (F.floor("v") + F.col("o.a")).cast("int").alias("row"), (F.floor("u") + F.col("o.b")).cast("int").alias("col"), weight.alias("w"))
    met = asked.join(raster, ["frame", "row", "col"], "left").groupBy("frame", F.col("to_row").alias("row"), F.col("to_col").alias("col"))
    return met.agg(F.sum(F.col("w") * F.coalesce(F.col("value"), F.lit(0.0))).alias("value"))


def undistorted(raster: DataFrame, lens: Lens, intrinsics: tuple[float, float, float, float], rows: int, cols: int) -> DataFrame:
    """Rasters as a lens without distortion would see them: each target pixel is taken from where the lens put it."""
    fx, fy, cx, cy = intrinsics
    frames = raster.select("frame").distinct()
    grid = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    x, y = distorted((F.col("col") - cx) / fx, (F.col("row") - cy) / fy, lens)
    return resampled(grid.select("*", (fx * x + cx).alias("u"), (fy * y + cy).alias("v")), raster)


# -- colour spaces --------------------------------------------------------------------------------------------


def _thousandths(value: Column) -> Column:
    """A number of thousandths, rounded to the nearest whole, halves up."""
    return F.floor((value + 500) / 1000).cast("int")


def luma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luma and the two colour differences (128: none) of whole channels, in whole numbers."""
    y = _thousandths(299 * r + 587 * g + 114 * b)
    return y, _thousandths(713 * (r - y)) + 128, _thousandths(564 * (b - y)) + 128


def channels(y: Column, cr: Column, cb: Column) -> tuple[Column, Column, Column]:
    """The channels r, g, b of luma() values, kept in 0 to 255."""
    kept = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), v))
    a, b = cr - 128, cb - 128
    return kept(y + _thousandths(1403 * a)), kept(y + _thousandths(-714 * a - 344 * b)), kept(y + _thousandths(1773 * b))


# -- tiled equalisation ---------------------------------------------------------------------------------------


def _padding(n: int, tiles: int, both: bool) -> int:
    return 0 if both else tiles - n % tiles


def tiled_equalised(raster: DataFrame, rows: int, cols: int, tiles: tuple[int, int], clip: float, levels: int = 256) -> DataFrame:
    """(frame, row, col, level): values (whole, 0 to levels - 1) spread by the histograms of tiles, between the four nearest.

    A tile's counts over the limit (clip times the mean count, 1 at least) are cut; what is cut is dealt to all levels alike,
    and the rest one each to levels at even steps. Where the tiles don't divide the sides, both sides are first continued
    by their mirror image, without its edge, up to the next multiple beyond. All is worked out in whole numbers, halves up.
    Raises ValueError if a side is too short for its continuation. Frames are dealt whole, once; a tile holds its counts, and
    a level's rank is summed from them where a pixel asks for it.
    """
    down, across = tiles
    both = rows % down == 0 and cols % across == 0
    more_rows, more_cols = _padding(rows, down, both), _padding(cols, across, both)
    if more_rows >= rows or more_cols >= cols:
        raise ValueError(f"{rows} by {cols} pixels are too few for {down} by {across} tiles")
    high, wide = (rows + more_rows) // down, (cols + more_cols) // across
    total = high * wide
    limit = max(1, int(clip * total / levels))

    def places(c: str, n: int, more: int) -> Column:
        mirror = 2 * (n - 1) - F.col(c)
        return F.explode(F.when(mirror.between(n, n + more - 1), F.array(F.col(c), mirror)).otherwise(F.array(F.col(c))))

    raster = raster.repartition("frame")  # the only shuffle: tiles, lookups and sums are all within frames
    whole = raster.withColumn("__r", places("row", rows, more_rows)).withColumn("__c", places("col", cols, more_cols))
    tile = [F.floor(F.col("__r") / high).cast("int").alias("ty"), F.floor(F.col("__c") / wide).cast("int").alias("tx")]
    counts = whole.groupBy("frame", *tile, "value").agg(F.count("*").alias("n"))
    real = F.col("value").between(0, levels - 1)
    kept = F.when(real, F.struct("value", F.least(F.col("n"), F.lit(limit)).alias("n")))
    table = counts.groupBy("frame", "ty", "tx").agg(F.collect_list(kept).alias("kept"), F.sum(F.when(real, F.greatest(F.col("n") - limit, F.lit(0))).otherwise(0)).alias("over"))
    value, over = F.col("value"), F.col("over")
    step = F.greatest(F.floor(F.lit(levels) / F.greatest(over % levels, F.lit(1))), F.lit(1))
    below = F.aggregate("kept", F.lit(0).cast("long"), lambda s, e: s + F.when(e["value"] <= value, e["n"]).otherwise(0))
    upto = below + (value + 1) * F.floor(over / levels) + F.least(over % levels, F.floor(value / step) + 1)
    mapped = F.least(F.lit(levels - 1), F.floor((2 * (levels - 1) * upto + total) / (2 * total)))

    def between(c: str, side: int, n: int) -> tuple[Column, Column]:
        """The tiles on both sides of a pixel, and how near it is to the second, in 2 side parts."""
        at = 2 * F.col(c) - side
        first = F.floor(at / (2 * side))
        near = at - first * 2 * side
        pair = F.array(F.struct(F.greatest(first, F.lit(0)).cast("int").alias("t"), (2 * side - near).alias("w")), F.struct(F.least(first + 1, F.lit(n - 1)).cast("int").alias("t"), near.alias("w")))
        return F.explode(pair)

    asked = raster.filter(real).withColumn("a", between("row", high, down)).withColumn("b", between("col", wide, across))
    asked = asked.select("frame", "row", "col", "value", F.col("a.t").alias("ty"), F.col("b.t").alias("tx"), (F.col("a.w") * F.col("b.w")).alias("w"))
    parts = 4 * total
    met = asked.join(table, ["frame", "ty", "tx"]).groupBy("frame", "row", "col").agg(F.sum(F.col("w") * mapped).alias("s"))
    return met.select("frame", "row", "col", F.floor((2 * F.col("s") + parts) / (2 * parts)).cast("int").alias("level"))
