"""State estimation: the recursive filter over ordered series, and pose updates from distributed normal equations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.geometry import exp_matrix, skew
from . import voxel

GRAVITY = 9.81
#: Variances of the accelerometer, gyroscope and their biases.
NOISE = (0.1, 0.1, 1e-4, 1e-4)
#: Initialisation wants so many samples, a longer time, and variances whose norms are no larger.
INIT_SAMPLES, INIT_SECONDS, MOST_GYR_NOISE, MOST_ACC_NOISE = 10, 3.0, 0.5, 0.6
#: Variances at the start: place, rotation and velocity; the accelerometer's bias; the gyroscope's; gravity's two parts.
START_VARIANCES = (1.0, 1e-3, 1e-4, 1e-5)


def initial_covariance() -> np.ndarray:
    """The covariance of a trajectory that has just been initialised."""
    return np.diag(np.repeat(START_VARIANCES, (9, 3, 3, 2)))


class InertialFilter:
    """Position, rotation, velocity, biases and gravity with their covariance (p, theta, v, ba, bg, g with 2 of 3 parts)."""

    def __init__(self) -> None:
        self.p, self.v, self.ba, self.bg = (np.zeros(3) for _ in range(4))
        self.r, self.g = np.eye(3), np.array([0, 0, GRAVITY])
        self.cov = initial_covariance()
        self.last: tuple | None = None

    def tangent(self) -> np.ndarray:
        """Two unit vectors across gravity, as columns: geometry.sphere_basis()."""
        x, y, z = self.g / np.linalg.norm(self.g)
        if z <= -1 + 1e-12:
            return np.array([[1.0, 0], [0, -1], [0, 0]])
        return np.array([[1 - x * x / (1 + z), -x * y / (1 + z)], [-x * y / (1 + z), 1 - y * y / (1 + z)], [-x, -y]])

    def predict(self, t: float, acc: np.ndarray, gyr: np.ndarray) -> None:
        if self.last is not None:
            dt, acc0, gyr0 = t - self.last[0], self.last[1], self.last[2]
            w, a = (gyr0 + gyr) / 2 - self.bg, (acc0 + acc) / 2 - self.ba
            turn = exp_matrix(w * dt)
            f, n = np.eye(17), np.zeros((17, 12))
            f[0:3, 6:9] = np.eye(3) * dt
            f[3:6, 3:6], f[3:6, 12:15] = np.eye(3) - skew(w * dt), -np.eye(3) * dt
            f[6:9, 3:6], f[6:9, 9:12], f[6:9, 15:17] = -self.r @ skew(a) * dt, -self.r * dt, skew(self.g) @ self.tangent() * dt
            n[6:9, 0:3], n[3:6, 3:6], n[9:12, 6:9], n[12:15, 9:12] = -self.r * dt, -np.eye(3) * dt, np.eye(3) * dt, np.eye(3) * dt
            self.cov = f @ self.cov @ f.T + n @ np.diag(np.repeat(NOISE, 3)) @ n.T
            self.p = self.p + self.v * dt
            self.v = self.v + self.r @ a * dt - self.g * dt
            self.r = self.r @ turn
        self.last = (t, acc, gyr)

    def observe(self, d: np.ndarray) -> None:
        """A correction of 17 parts."""
        self.p, self.r, self.v = self.p + d[0:3], self.r @ exp_matrix(d[3:6]), self.v + d[6:9]
        self.ba, self.bg = self.ba + d[9:12], self.bg + d[12:15]
        self.g = exp_matrix(self.tangent() @ d[15:17]) @ self.g

    def correct(self, h: np.ndarray, g: np.ndarray, noise: float = 1e-3) -> np.ndarray:
        """The correction by normal equations of the pose (6 x 6 and 6): with information S = P / noise,
        d = -(S^-1 + J'J)^-1 J'r; the covariance follows."""
        full = np.zeros((17, 17))
        full[:6, :6] = h
        gain = np.linalg.inv(np.linalg.inv(self.cov / noise) + full)
        d = -gain[:, :6] @ g
        self.observe(d)
        self.cov = (np.eye(17) - gain @ full) @ self.cov
        return d


#: Trajectories that one task steps side by side, or so.
SIDE_BY_SIDE = 256


def _rotations(v: np.ndarray) -> np.ndarray:
    """exp_matrix() of rows."""
    angle = np.linalg.norm(v, axis=1)
    k = _crosses(v / np.where(angle < 1e-10, 1, angle)[:, None])
    turned = np.eye(3) + np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)
    return np.where((angle < 1e-10)[:, None, None], np.eye(3) + _crosses(v), turned)


def _crosses(v: np.ndarray) -> np.ndarray:
    """skew() of rows."""
    out = np.zeros((len(v), 3, 3))
    out[:, [2, 0, 1], [1, 2, 0]], out[:, [1, 2, 0], [2, 0, 1]] = v, -v
    return out


class InertialFilters:
    """InertialFilter.predict() of many trajectories side by side, with biases and gravity as they start."""

    def __init__(self) -> None:
        self.slots: dict = {}
        self.state: dict[str, np.ndarray] = {}
        self._grow(SIDE_BY_SIDE)

    def _grow(self, size: int) -> None:
        fresh = {"p": np.zeros((size, 3)), "v": np.zeros((size, 3)), "r": np.tile(np.eye(3), (size, 1, 1)), "cov": np.tile(initial_covariance(), (size, 1, 1)), "t": np.zeros(size), "acc": np.zeros((size, 3)), "gyr": np.zeros((size, 3)), "begun": np.zeros(size, bool)}
        for name, held in self.state.items():
            fresh[name][: len(held)] = held
        self.state = fresh

    def predict(self, keys: list, t: np.ndarray, acc: np.ndarray, gyr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, velocities and the covariances' traces after one sample of each of these trajectories."""
        at = np.array([self.slots.setdefault(k, len(self.slots)) for k in keys])
        if len(self.slots) > len(self.state["t"]):
            self._grow(2 * len(self.slots))
        s = self.state
        on = at[s["begun"][at]]
        if len(on):
            mine = s["begun"][at]
            dt = (t[mine] - s["t"][on])[:, None]
            w, a, r = (s["gyr"][on] + gyr[mine]) / 2, (s["acc"][on] + acc[mine]) / 2, s["r"][on]
            turn, still = _rotations(w * dt), InertialFilter()
            f, n = np.tile(np.eye(17), (len(on), 1, 1)), np.zeros((len(on), 17, 12))
            step = np.eye(3) * dt[:, :, None]
            f[:, 0:3, 6:9] = n[:, 9:12, 6:9] = n[:, 12:15, 9:12] = step
            f[:, 3:6, 3:6], f[:, 3:6, 12:15] = np.eye(3) - _crosses(w * dt), -step
            f[:, 6:9, 3:6], f[:, 6:9, 9:12] = -r @ _crosses(a) * dt[:, :, None], -r * dt[:, :, None]
            f[:, 6:9, 15:17] = skew(still.g) @ still.tangent() * dt[:, :, None]
            n[:, 6:9, 0:3], n[:, 3:6, 3:6] = -r * dt[:, :, None], -step
            noisy = n * np.repeat(NOISE, 3)
            s["cov"][on] = f @ s["cov"][on] @ f.transpose(0, 2, 1) + noisy @ n.transpose(0, 2, 1)
            s["p"][on] += s["v"][on] * dt
            s["v"][on] += (r @ a[:, :, None])[:, :, 0] * dt - still.g * dt
            s["r"][on] = r @ turn
        s["t"][at], s["acc"][at], s["gyr"][at], s["begun"][at] = t, acc, gyr, True
        return s["p"][at], s["v"][at], np.trace(s["cov"][at], axis1=1, axis2=2)


def trajectory(imu: DataFrame, by: str) -> DataFrame:
    """Positions and velocities after each sample (ts in seconds, ax..az, gx..gz) of each trajectory, in time order.

    Trajectories are dealt over the executors; a task steps about SIDE_BY_SIDE of them at once, sample by sample, so it
    holds as many states, and then the next ones.
    """
    spark = imu.sparkSession
    n = imu.agg(F.approx_count_distinct(by)).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    bunch = F.pmod(F.xxhash64(by, F.lit(1)), F.lit(max(1, n // (parts * SIDE_BY_SIDE)))).alias("__bunch")
    sample = F.row_number().over(Window.partitionBy(by).orderBy("ts")).alias("__sample")
    inputs = ["ax", "ay", "az", "gx", "gy", "gz"]
    rows = imu.select(by, "ts", *inputs, sample, bunch).sortWithinPartitions("__bunch", "__sample")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bunch_, filters = None, InertialFilters()
        for part in batches:
            place = part[["__bunch", "__sample"]].to_numpy()
            values, keys, times = part[inputs].to_numpy(float), part[by].tolist(), part["ts"].to_numpy(float)
            out = np.empty((len(part), 7))
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1), len(part)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if place[lo, 0] != bunch_:
                    bunch_, filters = place[lo, 0], InertialFilters()
                p, v, spread = filters.predict(keys[lo:hi], times[lo:hi], values[lo:hi, :3], values[lo:hi, 3:])
                out[lo:hi, :3], out[lo:hi, 3:6], out[lo:hi, 6] = p, v, spread
            yield pd.DataFrame({by: part[by], "ts": times, **dict(zip(["px", "py", "pz", "vx", "vy", "vz", "spread"], out.T, strict=True))})

    return rows.mapInPandas(run, f"{by} long, ts double, px double, py double, pz double, vx double, vy double, vz double, spread double")


def corrected(states: DataFrame, by: str) -> DataFrame:
    """states (p, q, v, ba, bg, g as arrays) after their corrections of 17 numbers in `by`: q turns on the right and stays of
    unit length, g turns about the vector that the last two numbers name in the sphere's basis."""
    at = lambda name, n=3, first=0: [F.col(name)[first + k] for k in range(n)]
    basis = geometry.sphere_basis(at("g"))
    lean = [basis[2 * k] * F.col(by)[15] + basis[2 * k + 1] * F.col(by)[16] for k in range(3)]
    out = states.withColumns({"__turn": F.array(*geometry.exponential(at(by, 3, 3))), "__lean": F.array(*lean)})
    out = out.withColumns({"__lean": F.array(*geometry.exponential(at("__lean"))), "q": F.array(*geometry.quaternion_product(at("q", 4), at("__turn", 4)))})
    moved = {name: F.array(*(s + d for s, d in zip(at(name), at(by, 3, first), strict=True))) for name, first in (("p", 0), ("v", 6), ("ba", 9), ("bg", 12))}
    return out.withColumns({"q": F.array(*geometry.unit(at("q", 4))), "g": F.array(*geometry.rotate(at("__lean", 4), at("g"))), **moved}).drop("__turn", "__lean")


def _vectors_of(q: np.ndarray) -> np.ndarray:
    """geometry.logarithm() of rows."""
    half = np.arccos(np.minimum(1, np.abs(q[:, 0])))
    small = np.sin(half) < geometry.SMALL
    return q[:, 1:] * (np.where(small, 2.0, 2 * half / np.where(small, 1, np.sin(half))) * np.where(q[:, 0] < 0, -1, 1))[:, None]


def _quaternions(v: np.ndarray) -> np.ndarray:
    """geometry.exponential() of rows, of unit length."""
    angle = np.linalg.norm(v, axis=1)
    small = angle < geometry.SMALL
    q = np.column_stack([np.where(small, 1.0, np.cos(angle / 2)), v * np.where(small, 0.5, np.sin(angle / 2) / np.where(small, 1, angle))[:, None]])
    return q / np.linalg.norm(q, axis=1)[:, None]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """geometry.quaternion_product() of rows."""
    return np.column_stack(geometry.quaternion_product(list(a.T), list(b.T)))


def _upright(g: np.ndarray) -> np.ndarray:
    """geometry.upright_basis() of rows, as 3 by 2 matrices."""
    a = g / np.linalg.norm(g, axis=1)[:, None]
    up = (g[:, 0] == 0) & (g[:, 1] == 0)
    b = np.where(up[:, None], [1.0, 0, 0], [0, 0, 1.0] - a * a[:, 2:])
    b /= np.linalg.norm(b, axis=1)[:, None]
    return np.stack([b, np.cross(a, b)], axis=2)


def pose_gain(p: np.ndarray, q: np.ndarray, cov: np.ndarray, place: np.ndarray, turn: np.ndarray, variances: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Corrections of 17 numbers and covariances of rows whose pose was observed as (place, turn).

    The turn's residual is taken by the inverse right Jacobian of the rotation held; gain K = P H' (H P H' + V)^-1.
    """
    v = _vectors_of(q)
    angle = np.linalg.norm(v, axis=1)
    small = angle < geometry.SMALL
    safe = np.where(small, 1, angle)
    along = np.where(small, np.cos(angle / 2), safe / 2 / np.tan(safe / 2))
    outer = np.where(small, 0.125, (1 - along) / safe**2)
    h = np.zeros((len(p), 6, 17))
    h[:, :3, :3] = np.eye(3)
    h[:, 3:, 3:6] = along[:, None, None] * np.eye(3) + outer[:, None, None] * v[:, :, None] * v[:, None, :] + _crosses(v) / 2
    seen = h @ cov
    gain = np.linalg.solve(seen @ h.transpose(0, 2, 1) + np.diag(np.repeat(variances, 3)), seen).transpose(0, 2, 1)
    off = np.concatenate([place - p, _vectors_of(_products(q * [1, -1, -1, -1], turn))], axis=1)
    d = (gain @ off[:, :, None])[:, :, 0]
    reset = np.tile(np.eye(17), (len(p), 1, 1))
    reset[:, 3:6, 3:6] -= _crosses(d[:, 3:6]) / 2
    return d, reset @ (np.eye(17) - gain @ h) @ cov @ reset.transpose(0, 2, 1)


def observe_poses(states: DataFrame, place: str, turn: str, variances: tuple[float, float]) -> DataFrame:
    """states (p, q, v, ba, bg, g and the covariance cov's 289 entries, as arrays) once their poses are observed as `place`
    and the unit quaternion `turn`. Gravity moves in its upright basis; the covariance is carried to the new rotation.

    Each row is on its own: any number of trajectories, batch by batch, without a shuffle. Other columns stay.
    """
    names = ["p", "q", "v", "ba", "bg", "g", "cov"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            s = {n: np.stack(part[n].to_list()).astype(float) for n in (*names, place, turn)}
            d, cov = pose_gain(s["p"], s["q"], s["cov"].reshape(-1, 17, 17), s[place], s[turn], variances)
            g = s["g"] + (_upright(s["g"]) @ d[:, 15:, None])[:, :, 0]
            new = {"p": s["p"] + d[:, :3], "q": _products(s["q"], _quaternions(d[:, 3:6])), "v": s["v"] + d[:, 6:9], "ba": s["ba"] + d[:, 9:12], "bg": s["bg"] + d[:, 12:15], "g": g, "cov": cov.reshape(-1, 289)}
            yield part.assign(**{n: list(v) for n, v in new.items()})

    return states.mapInPandas(run, states.schema)


def initial_bias(imu: DataFrame, by: str) -> DataFrame:
    """Of trajectories long and still enough: mean gyroscope (bias), gravity (mean accelerometer scaled to its norm).

    Stillness is judged by running variances in order of ts, v += ((x - m)^2 (n-1)/n - v) / n with the mean m that x already
    is part of; those of the accelerometer are scaled as its mean is. n v telescopes to a sum over the samples.
    """
    inputs = ["ax", "ay", "az", "gx", "gy", "gz"]
    upto = Window.partitionBy(by).orderBy("ts", *inputs).rowsBetween(Window.unboundedPreceding, 0)
    rows = imu.select(by, "ts", *inputs, F.count("*").over(upto).alias("__k"), *(F.avg(c).over(upto).alias(f"__m{c}") for c in inputs))
    off = lambda c: (F.col(c) - F.col(f"__m{c}")) * (F.col(c) - F.col(f"__m{c}")) * (F.col("__k") - 1) / F.col("__k")
    parts = [v for c in inputs for v in (F.avg(c).alias(f"m_{c}"), F.avg(off(c)).alias(f"v_{c}"))]
    out = rows.groupBy(by).agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("seconds"), *parts)
    norm = lambda *c: F.sqrt(sum((F.col(x) * F.col(x) for x in c), F.lit(0.0)))
    out = out.withColumn("__scale", GRAVITY / norm("m_ax", "m_ay", "m_az"))
    scale = F.col("__scale")
    still = (F.col("n") >= INIT_SAMPLES) & (F.col("seconds") > INIT_SECONDS) & (norm("v_gx", "v_gy", "v_gz") <= MOST_GYR_NOISE) & (norm("v_ax", "v_ay", "v_az") * scale * scale <= MOST_ACC_NOISE)
    return out.filter(still).select(by, "n", *(F.col(f"m_g{c}").alias(f"b{c}") for c in "xyz"), *((F.col(f"m_a{c}") * scale).alias(f"g{c}") for c in "xyz"))


def register(points: DataFrame, target: DataFrame, size: float, k: int = 8, max_distance: float = 0.5, iterations: int = 5, least_shift: float = 1e-4) -> tuple[InertialFilter, int]:
    """The pose that lays points (id, x, y, z) on target (id, x, y, z): neighbours, planes and residual rows are one Spark job
    for each iteration, of which 28 sums come to the driver. Stops on small or on wild steps (over 100 units or degrees)."""
    state, used = InertialFilter(), 0
    began = state.p
    for _ in range(iterations):
        moved = [sum((F.lit(float(state.r[i, j])) * F.col(c) for j, c in enumerate("xyz")), F.lit(float(state.p[i]))) for i in range(3)]
        at = points.select("id", *(m.alias(c) for m, c in zip(moved, "xyz", strict=True)))
        near = voxel.neighbours(at, target, "id", "id", size, 1, k)
        last = [F.lit(float(v)) for v in began]
        rows = voxel.plane_residuals(at.join(points.select("id", *(F.col(c).alias(f"b{c}") for c in "xyz")), "id"), near, voxel.planes(voxel.moments(near)), "id", max_distance, k, last, ["bx", "by", "bz"])
        sums = voxel.normal_equations(rows).first()
        if sums is None or not sums["n_residuals"]:
            break
        used = sums["n_residuals"]
        h = np.array([[sums[f"h{min(a, b)}{max(a, b)}"] for b in range(6)] for a in range(6)])
        g = np.array([sums[f"g{a}"] for a in range(6)])
        # rows turn about the origin of the target's frame; the filter's rotation is applied on the right
        turn = np.eye(6)
        turn[3:, 3:] = state.r
        turn[:3, 3:] = skew(state.p) @ state.r
        before = state.p, state.r
        d = state.correct(turn.T @ h @ turn, turn.T @ g)
        if np.linalg.norm(d[:3]) > 100 or np.degrees(np.linalg.norm(d[3:6])) > 100:
            state.p, state.r = before
            break
        if np.linalg.norm(d[:6]) < least_shift:
            break
    return state, used
