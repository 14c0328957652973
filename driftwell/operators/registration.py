"""Registration of many sweeps side by side: rounds over all sweeps that have not converged yet.

A round is one Spark job: the active sweeps' points meet their poses, then the map's cells; planes and residual rows become 28
sums a sweep, and a table of one row a sweep takes the step that its sums and its prior ask for. The table is written each
round. Sweeps leave when they converge, run out of rounds, or find too few residuals; so a round's work is that of the
sweeps still moving.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import exp_matrix, log_matrix, skew
from ..sources.scratch import written
from . import voxel
from .estimation import GRAVITY, InertialFilter, initial_covariance
from .regions import Regions, regions


@dataclass(frozen=True)
class Options:
    """Of neighbours, gates and rounds. Frames numbered under early_frames look at cells farther away, take cells with any
    number of points, and get EARLY_ROUNDS rounds at least; a negative most_residuals means all."""

    size: float = 1.0
    reach: int = 1
    least_in_cell: int = 1
    neighbours: int = 20
    least_neighbours: int = 20
    max_distance: float = 0.3
    weight_planarity: float = 0.9
    weight_nearness: float = 0.1
    power: float = 2.0
    most_residuals: int = -1
    rounds: int = 5
    early_frames: int = 20
    small_shift: float = 1e-3
    small_degrees: float = 1e-4
    point_variance: float = 1e-3


EARLY_REACH, EARLY_ROUNDS = 2, 15
#: Steps beyond these (units, degrees) are left out.
WILD_SHIFT, WILD_DEGREES = 100.0, 100.0
#: Poses of so many sweeps are broadcast (about 200 bytes each); more are joined by a shuffle.
FEW_SWEEPS = 100_000

STATE = "sweep long, number long, pose array<double>, prior array<double>, cov array<double>, last array<double>, status string, rounds int, n_residuals long, loss double"


def packed(r: np.ndarray, p: np.ndarray, v=None, ba=None, bg=None, g=None) -> list[float]:
    """A state as 24 numbers: rotation by rows, place, velocity, biases of accelerometer and gyroscope, gravity."""
    zero = np.zeros(3)
    parts = (np.asarray(r).ravel(), p, zero if v is None else v, zero if ba is None else ba, zero if bg is None else bg, np.array([0, 0, GRAVITY]) if g is None else g)
    return [float(x) for x in np.concatenate(parts)]


def starting_covariance(scale: float = 1.0) -> list[float]:
    """The covariance once biases and gravity are set from a still start: theirs are shrunk."""
    return (initial_covariance() * scale).ravel().tolist()


def started(sweeps: DataFrame) -> DataFrame:
    """States of sweeps (sweep, number, pose, cov, last): the pose is the prior too, and all are active. last is the place of
    the pose before."""
    return sweeps.select("sweep", F.col("number").cast("long").alias("number"), "pose", F.col("pose").alias("prior"), "cov", "last", F.lit("active").alias("status"), F.lit(0).alias("rounds"), F.lit(0).cast("long").alias("n_residuals"), F.lit(0.0).alias("loss"))


def placed(points: DataFrame, states: DataFrame) -> DataFrame:
    """points (sweep, id, x, y, z on the body) of the sweeps in states, as (sweep, number, point, bx, by, bz, x, y, z, pose, last)
    with x, y, z in the world; point is unique over sweeps."""
    of = states.select("sweep", "number", "pose", "last")
    met = points.join(F.broadcast(of) if of.count() <= FEW_SWEEPS else of, "sweep")
    body = [F.col(c) for c in "xyz"]
    world = [sum((F.col("pose")[3 * i + k] * b for k, b in enumerate(body)), F.col("pose")[9 + i]) for i in range(3)]
    return met.select("sweep", "number", F.struct("sweep", "id").alias("point"), *(b.alias(f"b{c}") for c, b in zip("xyz", body, strict=True)), *(w.alias(c) for c, w in zip("xyz", world, strict=True)), "pose", "last")


def residual_rows(at: DataFrame, target: DataFrame, o: Options, tree: Regions | None = None) -> DataFrame:
    """(sweep, point, distance, weight, j0 to j5) of placed points: signed distance to the nearest neighbour's plane, which
    faces the pose before, under the one-sided gate; parts of a step of the place and of a turn on the body's side."""
    tree = tree or regions(target)
    first = F.min_by(F.struct("nx", "ny", "nz", "d2"), "rank").alias("first")

    def fitted(asked: DataFrame, reach: int, least: int) -> DataFrame:
        near = voxel.neighbours(asked, target, "point", "id", o.size, reach, o.neighbours, least, tree=tree)
        planes = voxel.planes(voxel.moments(near, more=[first])).filter(F.col("n") >= o.least_neighbours)
        return asked.withColumnRenamed("point", "query_id").join(planes, "query_id").select("*", "first.*")

    rows = fitted(at.filter(F.col("number") < o.early_frames), EARLY_REACH, 1).unionByName(fitted(at.filter(F.col("number") >= o.early_frames), o.reach, o.least_in_cell))
    rows = voxel.facing(rows, [F.col("last")[k] for k in range(3)], [F.col(f"b{c}") for c in "xyz"])
    n = [F.col(f"normal_{c}") for c in "xyz"]
    share = o.weight_planarity / (o.weight_planarity + o.weight_nearness)
    weight = share * F.pow("a2d", F.lit(o.power)) + (1 - share) * F.exp(-F.sqrt("d2") / (o.max_distance * o.least_neighbours))
    distance = sum((n[k] * (F.col(c) - F.col(f"n{c}")) for k, c in enumerate("xyz")), F.lit(0.0))
    turned = {f"__t{k}": sum((F.col("pose")[3 * i + k] * n[i] for i in range(3)), F.lit(0.0)) for k in range(3)}
    rows = rows.withColumns({"distance": distance, "weight": weight, **turned}).filter(F.col("distance") < o.max_distance)
    if o.most_residuals >= 0:
        rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy("sweep").orderBy("query_id"))).filter(F.col("__place") <= o.most_residuals)
    b, t = [F.col(f"b{c}") for c in "xyz"], [F.col(f"__t{k}") for k in range(3)]
    turn = [b[1] * t[2] - b[2] * t[1], b[2] * t[0] - b[0] * t[2], b[0] * t[1] - b[1] * t[0]]
    return rows.select("sweep", F.col("query_id").alias("point"), "distance", "weight", *((v * F.col("weight")).alias(f"j{k}") for k, v in enumerate([*n, *turn])))


def sweep_sums(points: DataFrame, states: DataFrame, target: DataFrame, o: Options, tree: Regions | None = None) -> DataFrame:
    """A round's sums of each sweep, as voxel.normal_equations()."""
    return voxel.normal_equations(residual_rows(placed(points, states), target, o, tree), ["sweep"])


def _tangent(g: np.ndarray) -> np.ndarray:
    f = InertialFilter()
    f.g = g
    return f.tangent()


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation vector from the direction of a to that of b."""
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    axis, dot = np.cross(a, b), float(np.clip(a @ b, -1, 1))
    size = np.linalg.norm(axis)
    return np.zeros(3) if size < 1e-9 else axis / size * np.arccos(dot)


def stepped(pose: np.ndarray, prior: np.ndarray, cov: np.ndarray, h: np.ndarray, g: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One iterated step of the filter: (new state, step, covariance if this is the last one).

    The prior pulls back by the offset from it, carried to the present tangent spaces; with P the carried covariance, W =
    (noise P^-1 + J'J)^-1: step = -W J'r - (I - W J'J) offset.
    """
    r0, r1 = prior[:9].reshape(3, 3), pose[:9].reshape(3, 3)
    dg = _between(prior[21:], pose[21:])
    b0, b1 = _tangent(prior[21:]), _tangent(pose[21:])
    offset = np.concatenate([pose[9:12] - prior[9:12], log_matrix(r0.T @ r1), pose[12:21] - prior[12:21], b0.T @ dg])
    carry = np.eye(17)
    carry[3:6, 3:6] -= 0.5 * skew(offset[3:6])
    carry[15:, 15:] += 0.5 * b0.T @ skew(dg) @ b0
    p = carry @ cov @ carry.T
    full = np.zeros((17, 17))
    full[:6, :6] = h
    w = np.linalg.inv(np.linalg.inv(p / noise) + full)
    step = -w[:, :6] @ g - (np.eye(17) - w @ full) @ (carry @ offset)
    new = np.concatenate([(r1 @ exp_matrix(step[3:6])).ravel(), pose[9:12] + step[:3], pose[12:21] + step[6:15], exp_matrix(b1 @ step[15:]) @ pose[21:]])
    carry = np.eye(17)
    carry[3:6, 3:6] -= 0.5 * skew(step[3:6])
    carry[15:, 15:] += 0.5 * b1.T @ skew(b1 @ step[15:]) @ b1
    return new, step, carry @ (np.eye(17) - w @ full) @ p @ carry.T


def _round(o: Options):
    """States after a round, from states joined with their sums; see register()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                pose, cov, status, done = np.array(r.pose), np.array(r.cov).reshape(17, 17), r.status, r.rounds
                found = 0 if pd.isna(r.found) else int(r.found)
                if status == "active" and found < o.least_neighbours:
                    status, done, n, loss = "failed", done + 1, found, 0.0 if pd.isna(r.new_loss) else r.new_loss
                elif status == "active":
                    h = np.array([[getattr(r, f"h{min(a, b)}{max(a, b)}") for b in range(6)] for a in range(6)])
                    new, step, last = stepped(pose, np.array(r.prior), cov, h, np.array([getattr(r, f"g{a}") for a in range(6)]), o.point_variance)
                    done, n, loss = done + 1, found, r.new_loss
                    degrees = np.degrees(np.linalg.norm(step[3:6]))
                    rounds = (max(EARLY_ROUNDS, o.rounds) if r.number < o.early_frames else o.rounds) + 1
                    if np.linalg.norm(step[:3]) <= WILD_SHIFT and degrees <= WILD_DEGREES:
                        pose = new
                        small = r.number > 1 and np.linalg.norm(step[:3]) < o.small_shift and degrees < o.small_degrees
                        if small or done >= rounds:
                            status, cov = "converged" if small else "stopped", last
                    if done >= rounds and status == "active":
                        status = "stopped"
                else:
                    n, loss = r.n_residuals, r.loss
                out.append((r.sweep, r.number, pose.tolist(), list(r.prior), cov.ravel().tolist(), list(r.last), status, done, n, loss))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in STATE.split(", ")])

    return run


def register(points: DataFrame, target: DataFrame, states: DataFrame, o: Options | None = None) -> DataFrame:
    """States (see STATE) of all sweeps, each registered to the map.

    points: (sweep, id, x, y, z) on the body; target: the map's (id, x, y, z); states: started(). status is `converged`,
    `stopped` after the last round, or `failed` with fewer residuals than least_neighbours, in which case the pose stays
    where it was. Wild steps are left out, and their round counts. Frames 0 and 1 never count as converged. A sweep
    without points fails; points of unknown sweeps aren't read. The covariance is that of the last step.
    """
    o = o or Options()
    states, tree = written(states.selectExpr(*(x.split()[0] for x in STATE.split(", "))), "states"), regions(target)
    for _ in range(max(EARLY_ROUNDS, o.rounds) + 1):
        active = states.filter("status = 'active'")
        if active.isEmpty():
            break
        sums = sweep_sums(points, active, target, o, tree).withColumnsRenamed({"n_residuals": "found", "loss": "new_loss"})
        states = written(states.join(sums, "sweep", "left").mapInPandas(_round(o), STATE), "states")
    return states
