"""One sweep from raw records to world points: state before it, de-skew, sampling, transforms, map increments.

Poses are columns: a quaternion (w, x, y, z) and a shift, as lists of four and three Columns. All steps are expressions, bound
to columns between them, but for sampling, which is one minimum per frame and cell and comes before the rotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from . import temporal, voxel

#: Fixed value: times nearer than this many seconds to an end of an interval count as just inside it.
EDGE_S = 1e-6
IDENTITY = (1.0, 0.0, 0.0, 0.0)

Pose = tuple[list[Column], list[Column]]


def constants(*values: float) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def applied(pose: Pose, p: list[Column]) -> list[Column]:
    """R p + t."""
    return [a + b for a, b in zip(geometry.rotate(pose[0], p), pose[1], strict=True)]


def inverse(pose: Pose) -> Pose:
    """The pose that undoes this one: R', -R' t."""
    q = [pose[0][0], *(-c for c in pose[0][1:])]
    return q, [-c for c in geometry.rotate(q, pose[1])]


def bound(df: DataFrame, name: str, values: list[Column]) -> tuple[DataFrame, list[Column]]:
    """df with values as columns of their own, and these columns: what follows names them and doesn't repeat how they came
    about, so expressions of several steps stay short."""
    names = [f"__{name}{k}" for k in range(len(values))]
    return df.withColumns(dict(zip(names, values, strict=True))), [F.col(n) for n in names]


def inside(t: Column, begin: Column, end: Column) -> Column:
    """A time (seconds) that lies at an end of an interval, moved just inside it."""
    return F.when(F.abs(t - begin) < EDGE_S, begin + EDGE_S).when(F.abs(t - end) < EDGE_S, end - EDGE_S).otherwise(t)


def deskewed_steadily(df: DataFrame, p: list[Column], t: Column, begin: Column, end: Column, first: Pose, last: Pose) -> tuple[DataFrame, list[Column]]:
    """A body point at time t of a sweep, laid out by motion of constant speed between the poses at the sweep's ends: df
    with the steps' columns (their names begin with two underscores), and the place."""
    alpha = (inside(t, begin, end) - begin) / (end - begin)
    df, (alpha,) = bound(df, "steady", [F.least(F.lit(1.0), F.greatest(F.lit(0.0), alpha))])
    df, a = bound(df, "first", [*first[0], *first[1]])
    df, b = bound(df, "last", [*last[0], *last[1]])
    df, p = bound(df, "body", p)
    df, q = bound(df, "turn", geometry.slerp(a[:4], b[:4], alpha))
    shift = [(1 - alpha) * u + alpha * v for u, v in zip(a[4:], b[4:], strict=True)]
    return bound(df, "laid", applied((q, shift), p))


def deskewed_inertially(df: DataFrame, p: list[Column], dt: Column, start: Pose, speed: list[Column], acceleration: list[Column], turn: list[Column]) -> tuple[DataFrame, list[Column]]:
    """A body point dt seconds into an inertial segment: its start's pose, carried on by constant acceleration and turn. df
    with the steps' columns, and the place."""
    df, a = bound(df, "start", start[0])
    df, b = bound(df, "carried", geometry.exponential([c * dt for c in turn]))
    df, q = bound(df, "product", geometry.quaternion_product(a, b))
    df, q = bound(df, "unit", geometry.unit(q))
    shift = [t + v * dt + 0.5 * c * dt * dt for t, v, c in zip(start[1], speed, acceleration, strict=True)]
    return bound(df, "laid", applied((q, shift), p))


def in_segments(points: DataFrame, states: DataFrame, by: str) -> DataFrame:
    """points (by, ts in microseconds) with the inertial segment that holds them: `state` at its start and `after` at its
    end, structs of the other columns of states; points in no segment are left out."""
    w = Window.partitionBy(by).orderBy("ts")
    row = F.struct(*(c for c in states.columns if c not in (by, "ts")))
    segments = states.select(by, F.col("ts").alias("seg_start"), row.alias("state"), F.lead("ts").over(w).alias("seg_end"), F.lead(row).over(w).alias("after"))
    return temporal.asof(points, segments, by, "ts", "seg_start", forward=False, strict=False).filter("seg_end IS NOT NULL")


def shuffled_place(*key: str, seed: int = 0) -> Column:
    """Where a row stands in a seeded shuffle: the same for the same key and seed on every cluster."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))


def sampled(df: DataFrame, frame: str, size: Column, key: list[str], seed: int = 0) -> DataFrame:
    """One point of each frame and cell of `size`, the first of the seeded shuffle."""
    cells = df.withColumns({k: (F.col(c) / size).cast("int") for k, c in zip(voxel.CELL, "xyz", strict=True)})
    cells = cells.withColumn("__place", shuffled_place(frame, *key, seed=seed))
    rest = [c for c in cells.columns if c not in (frame, *voxel.CELL, *key, "__place")]
    row = F.min(F.struct("__place", *key, *rest)).alias("__row")
    return cells.groupBy(frame, *voxel.CELL).agg(row).select(frame, "__row.*").drop("__place")


def first_residuals(df: DataFrame, frame: str, key: list[str], most: int, step: int = 1, seed: int = 0) -> DataFrame:
    """Of each frame the first `most` rows of the seeded shuffle (below 0: all), of every step-th row of it."""
    place = F.row_number().over(Window.partitionBy(frame).orderBy(shuffled_place(frame, *key, seed=seed), *key)) - 1
    out = df.withColumn("place", place).filter(F.col("place") % step == 0)
    return out if most < 0 else out.filter(F.col("place") < most * step)


def build_frame(points: DataFrame, frame: str, key: list[str], first: Pose, last: Pose, state: Pose, mount: Pose, size: Column, early: Column) -> DataFrame:
    """World points of whole sweeps, from points (frame, key, x, y, z, ts, begin_ts, end_ts in seconds).

    Stamp, lay out by the poses at the sweep's ends, sample a point per cell, take back to the sensor at the sweep's
    end, and out by the frame's state; `early` frames are laid out by no state and have alpha 1. mount is the sensor's
    pose on the body. Columns: frame, key, alpha, x, y, z (in the sensor at the end), wx, wy, wz.
    """
    xyz = [F.col(c) for c in "xyz"]
    span = (F.col("ts") - F.col("begin_ts")) / (F.col("end_ts") - F.col("begin_ts"))
    alpha = F.when(early, F.lit(1.0)).when(span > 1, 1 - 1e-5).otherwise(span)
    # cells are those of the raw points, as the sensor saw them
    df = sampled(points.withColumn("alpha", alpha), frame, size, key)
    df, laid = deskewed_steadily(df, applied(mount, xyz), F.col("ts"), F.col("begin_ts"), F.col("end_ts"), first, last)
    df, on_body = bound(df, "back", applied(inverse(last), laid))
    df = df.withColumns(dict(zip("xyz", applied(inverse(mount), on_body), strict=True)))
    df, on_body = bound(df, "again", applied(mount, xyz))
    df, pose = bound(df, "state", [*state[0], *state[1]])
    world = [F.when(early, b).otherwise(w) for b, w in zip(on_body, applied((pose[:4], pose[4:]), on_body), strict=True)]
    return df.select(frame, *key, "alpha", *"xyz", *(w.alias(f"w{c}") for c, w in zip("xyz", world, strict=True)))


def predicted_pose(before: Pose, earlier: Pose) -> Pose:
    """What the last two poses predict: the last one, moved on by its difference to the one before it."""
    undo = inverse((earlier[0], constants(0, 0, 0)))[0]
    turn = geometry.quaternion_product(before[0], undo)
    step = [a - b for a, b in zip(before[1], earlier[1], strict=True)]
    return geometry.quaternion_product(turn, before[0]), [t + d for t, d in zip(before[1], geometry.rotate(turn, step), strict=True)]


def initial_state(number: Column, mode: Column, pose: list[str], measured: list[str], by: str, order: str) -> dict[str, Column]:
    """A frame's first guess, as Columns named as in `pose` (four parts of a quaternion, three of a shift): none for the
    first two frames, then by mode the `measured` pose, what the last two predict, or the last one."""
    w = Window.partitionBy(by).orderBy(order)
    lagged = lambda k: ([F.lag(c, k).over(w) for c in pose[:4]], [F.lag(c, k).over(w) for c in pose[4:]])
    before = lagged(1)
    q, t = predicted_pose(before, lagged(2))
    guess = zip(pose, [*q, *t], measured, [*before[0], *before[1]], [*IDENTITY, 0.0, 0.0, 0.0], strict=True)
    return {f"guess_{name}": F.when(number <= 2, F.lit(none)).when(mode == "measured", F.col(m)).when(mode == "predicted", p).otherwise(b) for name, p, m, b, none in guess}


def map_increment(points: DataFrame, frame: str, order: list[str], size: float) -> DataFrame:
    """(frame, cell, key and place of the point): what each frame adds to the map, the first point ever of each cell."""
    return voxel.downsample(points, size, [frame, *order])


def visited(points: DataFrame, frame: str, size: float) -> DataFrame:
    """(frame, n_visited, n_new, weight): cells that a frame touches, those that none touched before, and the camera's
    measurement weight that follows from their number."""
    cells = voxel.with_cells(points, size).select(frame, *voxel.CELL).distinct()
    since = cells.groupBy(*voxel.CELL).agg(F.min(frame).alias(frame), F.lit(1).alias("new"))
    met = cells.join(since, [frame, *voxel.CELL], "left").groupBy(frame).agg(F.count("*").alias("n_visited"), F.count("new").alias("n_new"))
    return met.withColumn("weight", measurement_weight(F.col("n_new")))


def measurement_weight(n_new: Column) -> Column:
    return F.greatest(F.lit(0.001), F.least(5.0 / n_new, F.lit(0.01)))


def colour_points(points: DataFrame, frame: str, order: list[str], size: float, capacity: int, step: int) -> DataFrame:
    """Points that the colour map takes: every step-th of a frame, while its cell has room."""
    place = F.row_number().over(Window.partitionBy(frame).orderBy(*order)) - 1
    every = voxel.with_cells(points, size).withColumn("__place", place).filter(F.col("__place") % step == 0).drop("__place")
    room = F.row_number().over(Window.partitionBy(*voxel.CELL).orderBy(frame, *order))
    return every.withColumn("__room", room).filter(F.col("__room") <= capacity).drop("__room")


def changed(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value is another than that of the row before; the first of a group is one."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col(value))).drop("__before")
