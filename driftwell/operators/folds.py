"""Ordered folds, votes and keyed upserts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the colour filter: deviation of an observation, noise a second, and the distance gate.
COLOUR_SIGMA, NOISE_A_SECOND, GATE = 15.0, 0.1, 1.2


def fold_sorted(df: DataFrame, by: list[str], order: list[str], start: Callable, step: Callable, schema: str, last_only: bool = False, read: list[str] | None = None) -> DataFrame:
    """An ordered fold of each key. Rows are sorted within partitions of keys and streamed, so memory holds one state.

    step(state, row) gives (state, output tuple); outputs have the key's columns before them. With `last_only`, each key
    gives its last output. Steps see the columns in `read`, all if none are given.
    """
    columns = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out, pending = None, None, [], None
        for rows in batches:
            for row in rows.itertuples(index=False):
                mine = tuple(getattr(row, c) for c in by)
                if mine != key:
                    if pending is not None:
                        out.append(pending)
                        pending = None
                    key, state = mine, start()
                state, value = step(state, row)
                if value is not None:
                    if last_only:
                        pending = (*mine, *value)
                    else:
                        out.append((*mine, *value))
            yield pd.DataFrame(out, columns=columns)
            out = []
        if pending is not None:
            yield pd.DataFrame([pending], columns=columns)

    rows = df.repartition(*by).sortWithinPartitions(*by, *order)
    return (rows.select(*by, *read) if read else rows).mapInPandas(run, schema)


def colour_step(state, row):
    """State: (channels, sigmas, best distance, last time, accepted count); row: r, g, b, distance, ts in seconds."""
    seen, sigma, best, last, n = state
    if best and row.distance > GATE * best:
        return state, (*seen, best, n)
    colour = (row.r, row.g, row.b)
    if not n:
        state = (tuple(int(c + 0.5) for c in colour), (COLOUR_SIGMA,) * 3, row.distance, row.ts, 1)
    else:
        grown = [s + NOISE_A_SECOND * (row.ts - last) for s in sigma]
        # products and sqrt round right; ** need not, and a colour that is cut off shows it
        tight = [1 / math.sqrt(1 / (s * s) + 1 / (COLOUR_SIGMA * COLOUR_SIGMA)) for s in grown]
        mixed = tuple(int(t * t * (c / (g * g) + o / (COLOUR_SIGMA * COLOUR_SIGMA))) for t, c, g, o in zip(tight, seen, grown, colour, strict=True))
        state = (mixed, tuple(tight), min(best, row.distance), row.ts, n + 1)
    return state, (*state[0], state[2], state[4])


def colour_fold(observations: DataFrame, key: str = "point_id") -> DataFrame:
    """Each point's fused colour (r, g, b), best distance and accepted observations, by time and then obs_id, which
    may be a struct."""
    return fold_sorted(observations, [key], ["ts", "obs_id"], lambda: ((0, 0, 0), (0.0,) * 3, 0.0, 0.0, 0), colour_step, f"{key} long, r int, g int, b int, distance double, n_rgb int", last_only=True, read=["r", "g", "b", "distance", "ts"])


def running_noise(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Running mean and variance, n from 1: m += (x - m) / n, v = v (n-1)/n + (x - m)^2 (n-1)/n^2 with the new m.

    n v telescopes to a running sum of (x - m)^2 (n-1)/n, so both are window sums.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({"n": F.count("*").over(w), "mean": F.avg(value).over(w)})
    term = (F.col(value) - F.col("mean")) * (F.col(value) - F.col("mean")) * (F.col("n") - 1) / F.col("n")
    return out.withColumn("variance", F.sum(term).over(w) / F.col("n"))


def majority(votes: DataFrame, key: str, label: str) -> DataFrame:
    """The label with most votes of each key; 0 is no vote, ties go to the smallest label."""
    counted = votes.filter(F.col(label) != 0).groupBy(key, label).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.max_by(label, F.struct("n", -F.col(label))).alias(label), F.max("n").alias("n_votes"), F.sum("n").alias("n_semantic"))


def histogram(votes: DataFrame, key: str, label: str) -> DataFrame:
    """A map from label to its count, of each key."""
    counted = votes.filter(F.col(label) != 0).groupBy(key, label).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("histogram"))


def upsert(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last write."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*key, "__row.*")


def insert_if_absent(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first write."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*key, "__row.*")


def erase(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return df.join(keys.select(*key).distinct(), key, "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two keyed tables hold the same rows, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def rendered(seen: DataFrame, raster: DataFrame, masks: DataFrame, key: str) -> DataFrame:
    """Map points seen by frames, from (key, frame, u, v, distance), rasters (frame, row, col, value) and set mask pixels
    (frame, row, col, label): key, colour (r, g, b), distance, n_rgb, label, n_semantic.

    Colours are sampled between pixels and fused in order of frames; each seen frame's mask at the rounded pixel is a
    vote. Points that no raster holds are left out; those that no mask holds have no label and no vote.
    """
    from . import camera

    at = seen.withColumn("at", F.struct(key, "frame"))
    level = camera.bilinear(at, raster, "at")
    placed = at.join(level, "at").withColumns({"row": F.round("v").cast("int"), "col": F.round("u").cast("int")})
    observed = placed.select(F.col(key), F.col("frame").cast("double").alias("ts"), F.col("frame").alias("obs_id"), *(F.col("value").alias(c) for c in "rgb"), "distance")
    votes = placed.select(key, "frame", "row", "col").join(masks, ["frame", "row", "col"])
    out = colour_fold(observed, key).join(majority(votes, key, "label"), key, "left")
    return out.select(key, "r", "g", "b", "distance", "n_rgb", "label", F.coalesce("n_semantic", F.lit(0)).cast("long").alias("n_semantic"))
