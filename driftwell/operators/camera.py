"""Projection, rasters in long form (frame, row, col, value), and masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project(df: DataFrame, fx: float, fy: float, cx: float, cy: float, near: float = 1e-3) -> DataFrame:
    """Pixel places u, v and depth of points in camera coordinates; points behind the camera go."""
    return df.filter(F.col("z") >= near).withColumns({"u": fx * F.col("x") / F.col("z") + cx, "v": fy * F.col("y") / F.col("z") + cy, "depth": F.col("z")})


def in_image(u: Column, v: Column, cols: int, rows: int, margin: float = 0.005, scale: float = 1.0) -> Column:
    """Whether a pixel place lies in the image but for a margin, a share of its sides."""
    inside = lambda x, n: (x / scale >= margin * n + 1) & (F.ceil(x / scale) < (1 - margin) * n)
    return inside(u, cols) & inside(v, rows)


def z_buffer(df: DataFrame, grid: float, order: list[str]) -> DataFrame:
    """The nearest point of each grid cell of pixels, ties to the first in order."""
    cell = [F.round(F.col(c) / grid).cast("int").alias(f"g{c}") for c in "uv"]
    rest = [c for c in df.columns if c not in (*order, "depth")]
    return df.groupBy(*cell).agg(F.min(F.struct("depth", *order, *rest)).alias("__row")).select("gu", "gv", "__row.*")


def pixels(df: DataFrame, frame: str, values: str, cols: int) -> DataFrame:
    """A raster held as an array, row by row, in long form."""
    return df.select(F.col(frame).alias("frame"), F.posexplode(values).alias("at", "value")).select("frame", F.floor(F.col("at") / cols).cast("int").alias("row"), (F.col("at") % cols).cast("int").alias("col"), "value")


def lookup(df: DataFrame, raster: DataFrame) -> DataFrame:
    """The pixel value at the whole part of each (frame, u, v)."""
    return df.withColumns({"row": F.floor("v").cast("int"), "col": F.floor("u").cast("int")}).join(raster, ["frame", "row", "col"]).drop("row", "col")


def bilinear(df: DataFrame, raster: DataFrame, key: str, values: tuple[str, ...] = ("value",)) -> DataFrame:
    """(key, values): the raster between its pixels; places whose four pixels aren't all there are left out."""
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    asked = df.select(key, "frame", "u", "v", corners.alias("o")).select(key, "frame", (F.floor("v") + F.col("o.a")).cast("int").alias("row"), (F.floor("u") + F.col("o.b")).cast("int").alias("col"), "u", "v", "o")
    du, dv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    weight = F.when(F.col("o.b") == 1, du).otherwise(1 - du) * F.when(F.col("o.a") == 1, dv).otherwise(1 - dv)
    met = asked.join(raster, ["frame", "row", "col"]).groupBy(key).agg(*(F.sum(weight * F.col(c)).alias(c) for c in values), F.count("*").alias("n"))
    return met.filter("n = 4").drop("n")


def gradients(df: DataFrame, raster: DataFrame, key: str, reach: int = 4) -> DataFrame:
    """(key, dx, dy) at places (key, frame, u, v): differences of the raster between its pixels at 1 to `reach` pixels on
    both sides, over the sum of their distances. Places that reach over the edge are left out."""
    steps = [(axis, k) for axis in "xy" for k in range(-reach, reach + 1) if k]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(k).alias("k")) for a, k in steps)))
    asked = df.select(key, "frame", "u", "v", each.alias("s"))
    moved = {c: F.col(c) + F.when(F.col("s.axis") == a, F.col("s.k")).otherwise(0) for c, a in (("u", "x"), ("v", "y"))}
    found = bilinear(asked.withColumn("at", F.struct(key, "s")).withColumns(moved), raster, "at")
    side = F.signum(F.col("at.s.k")) * F.col("value") / (reach * (reach + 1))
    out = found.groupBy(F.col(f"at.{key}").alias(key)).agg(*(F.sum(F.when(F.col("at.s.axis") == a, side)).alias(f"d{a}") for a in "xy"), F.count("*").alias("n"))
    return out.filter(F.col("n") == len(steps)).drop("n")


#: Thousandths of the first, second and third channel in a grey value.
GREY = (299, 587, 114)


def grey(channels: list[Column]) -> Column:
    """The grey value of whole channels, rounded to the nearest, halves up; it is worked out in whole numbers."""
    return F.floor((sum((w * c for w, c in zip(GREY, channels, strict=True)), F.lit(0)) + 500) / 1000).cast("int")


def new_tracks(candidates: DataFrame, tracked: DataFrame, frame: str, key: list[str], cell: float, most: int) -> DataFrame:
    """Candidates (frame, key, u, v) to be tracked as well: not tracked yet, and in no cell of pixels that holds a tracked
    point or an earlier candidate; `most` points are tracked in a frame at most."""
    at = [F.floor(F.col(c) / cell).cast("int").alias(f"g{c}") for c in "uv"]
    held = tracked.select(frame, *at)
    fresh = candidates.join(tracked.select(frame, *key), [frame, *key], "left_anti").select("*", *at)
    fresh = fresh.join(held.distinct(), [frame, "gu", "gv"], "left_anti")
    rest = [c for c in fresh.columns if c not in (frame, "gu", "gv", *key)]
    first = fresh.groupBy(frame, "gu", "gv").agg(F.min(F.struct(*key, *rest)).alias("__row")).select(frame, "__row.*")
    counts = tracked.groupBy(frame).agg(F.count("*").alias("__held"))
    place = F.row_number().over(Window.partitionBy(frame).orderBy(*key))
    out = first.join(counts, frame, "left").withColumn("__place", place + F.coalesce("__held", F.lit(0)))
    return out.filter(F.col("__place") <= most).drop("__place", "__held")


def _shifted(raster: DataFrame, reach: int = 1) -> DataFrame:
    """Each pixel's value told to the pixels around it: (frame, row, col, dr, dc, value)."""
    span = range(-reach, reach + 1)
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in span for b in span)))
    told = raster.select("frame", "row", "col", "value", at.alias("o"))
    return told.select("frame", (F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), F.col("o.dr").alias("dr"), F.col("o.dc").alias("dc"), "value")


def scharr(raster: DataFrame) -> DataFrame:
    """Derivatives dx, dy with 3-10-3 smoothing, of pixels whose eight neighbours are there."""
    side = lambda c: F.when(F.col(c) == 0, 10).otherwise(3)
    told = _shifted(raster).groupBy("frame", "row", "col").agg(F.sum(F.col("dc") * side("dr") * F.col("value")).alias("dx"), F.sum(F.col("dr") * side("dc") * F.col("value")).alias("dy"), F.count("*").alias("n"), F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("value"))).alias("value"))
    return told.filter("n = 9").drop("n")


def halved(raster: DataFrame) -> DataFrame:
    """The next level of a pyramid: means of two by two pixels."""
    return raster.groupBy("frame", F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def equalised(raster: DataFrame, levels: int = 256) -> DataFrame:
    """Values (whole, from 0) spread by each frame's cumulative histogram, of which one row per level is kept."""
    counted = raster.groupBy("frame", "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("frame").orderBy("value"))
    every = Window.partitionBy("frame")
    spread = counted.withColumns({"upto": upto, "all": F.sum("n").over(every)}).withColumn("least", F.min("upto").over(every))
    level = F.when(F.col("all") == F.col("least"), F.lit(0)).otherwise(F.round((F.col("upto") - F.col("least")) * (levels - 1) / (F.col("all") - F.col("least")))).cast("int")
    return raster.join(spread.select("frame", "value", level.alias("level")), ["frame", "value"])


def flow(raster: DataFrame, least_eigenvalue: float = 1e-4) -> DataFrame:
    """Motion (du, dv) from each frame to the next by one step of the gradient method, from sums over its pixels; frames
    without texture, whose smaller eigenvalue is under the threshold, give none."""
    after = raster.select((F.col("frame") - 1).alias("frame"), "row", "col", F.col("value").alias("next"))
    rows = scharr(raster).join(after, ["frame", "row", "col"])
    dx, dy, dt = F.col("dx") / 32, F.col("dy") / 32, F.col("next") - F.col("value")
    sums = rows.groupBy("frame").agg(F.sum(dx * dx).alias("a"), F.sum(dx * dy).alias("b"), F.sum(dy * dy).alias("c"), F.sum(dx * dt).alias("p"), F.sum(dy * dt).alias("q"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    small = (F.col("a") + F.col("c") - F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) + 4 * F.col("b") * F.col("b"))) / 2
    return sums.filter(small > least_eigenvalue).select("frame", ((F.col("b") * F.col("q") - F.col("c") * F.col("p")) / det).alias("du"), ((F.col("b") * F.col("p") - F.col("a") * F.col("q")) / det).alias("dv"))


# -- masks ----------------------------------------------------------------------------------------------------


def decoded_runs(texts: list[str]) -> list[np.ndarray]:
    """The counts of masks' run-length texts, all texts at once: five bits a character from '0', 0x20 continues, 0x10 on
    the last one is the sign; from the fourth number on each is a difference to the one two before. A number that a text
    breaks off is left out."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8).astype(np.int64) - 48
    if not len(codes):
        return [np.zeros(0, np.int64)] * len(texts)
    last = np.cumsum(sizes[sizes > 0]) - 1
    closed = (codes & 0x20) == 0
    stop = closed.copy()
    stop[last] = True
    first = np.flatnonzero(np.append(True, stop[:-1]))
    end = np.flatnonzero(stop)
    number = np.repeat(np.arange(len(first)), end - first + 1)
    place = np.arange(len(codes)) - first[number]
    value = np.add.reduceat((codes & 0x1F) << (5 * place), first)
    value -= np.where(codes[end] & 0x10, np.int64(1) << (5 * (end - first + 1)), 0)
    text = np.repeat(np.arange(len(texts)), sizes)[end]
    text, value = text[closed[end]], value[closed[end]]
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    k = np.arange(len(value)) - starts[text]
    chain = 3 * text + np.where(k == 0, 0, 1 + (k % 2 == 0))
    order = np.argsort(chain, kind="stable")
    total = np.cumsum(value[order])
    head = np.flatnonzero(np.diff(chain[order], prepend=-1))
    total -= np.repeat((total - value[order])[head], np.diff(np.append(head, len(order))))
    out = np.empty_like(value)
    out[order] = total
    return np.split(out, starts[1:-1])


@F.pandas_udf(T.ArrayType(T.LongType()))
def run_lengths(text: pd.Series) -> pd.Series:
    """decoded_runs() of a column; null for null."""
    known = text.notna()
    out = pd.Series([None] * len(text), dtype=object)
    out[known.to_numpy()] = pd.Series([x.tolist() for x in decoded_runs(text[known].tolist())], dtype=object).to_numpy()
    return out


def encode_runs(counts: list[int]) -> str:
    """The text of a mask's counts; the inverse of run_lengths."""
    out = []
    for k, n in enumerate(counts):
        value = n - counts[k - 2] if k > 2 else n
        while True:
            bits, value = value & 0x1F, value >> 5
            more = not (value == 0 and not bits & 0x10 or value == -1 and bits & 0x10)
            out.append(chr(48 + (bits | 0x20 if more else bits)))
            if not more:
                break
    return "".join(out)


def mask_pixels(masks: DataFrame, keys: list[str]) -> DataFrame:
    """The set pixels (row, col) of masks (keys, h, w, counts): runs alternate unset and set, column by column; what runs
    past the end is cut. Starts of runs are one running sum over each mask's runs."""
    runs = masks.select(*keys, "h", "w", F.posexplode("counts").alias("k", "n"))
    before = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("k % 2 = 1 AND n > 0")
    runs = runs.withColumn("end", F.least(F.col("start") + F.col("n"), F.col("h") * F.col("w")))
    at = F.explode(F.sequence(F.col("start"), F.col("end") - 1))
    return runs.filter("end > start").select(*keys, "h", at.alias("i")).select(*keys, (F.col("i") % F.col("h")).cast("int").alias("row"), F.floor(F.col("i") / F.col("h")).cast("int").alias("col"))


def segmentation(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ordinal, label, instance, h, w, counts) of segmentation messages (keys, masks, ids, instances: arrays).

    A mask is JSON text with its size and run-length counts; one that is empty, can't be read or has no id is skipped, and
    the others keep their ordinals. Labels are ids from 1.
    """
    each = messages.select(*keys, F.posexplode(F.arrays_zip("masks", "ids", "instances")).alias("ordinal", "m"))
    read = F.from_json("m.masks", "size array<int>, counts string")
    each = each.select(*keys, "ordinal", (F.col("m.ids") + 1).alias("label"), F.col("m.instances").alias("instance"), read.alias("read"))
    good = (F.size("read.size") == 2) & F.col("read.counts").isNotNull() & F.col("label").isNotNull()
    return each.filter(good).select(*keys, "ordinal", "label", "instance", F.col("read.size")[0].alias("h"), F.col("read.size")[1].alias("w"), run_lengths("read.counts").alias("counts"))


def first_mask(points: DataFrame, mask_pixels_: DataFrame, key: str) -> DataFrame:
    """(key, label) of points (frame, u, v): the first mask, by ordinal, that has the rounded pixel; label is that mask's."""
    at = points.withColumns({"row": F.round("v").cast("int"), "col": F.round("u").cast("int")})
    return at.join(mask_pixels_, ["frame", "row", "col"]).groupBy(key).agg(F.min_by("label", "ordinal").alias("label"))
