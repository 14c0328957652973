"""Rotations, affine maps and de-skewing as Column expressions; quaternions are (w, x, y, z)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Angles under this count as zero.
SMALL = 1e-4


def affine(rotation: np.ndarray, shift: np.ndarray, names: tuple[str, str, str] = ("x", "y", "z")) -> list[Column]:
    """R p + t for constant R and t."""
    return [sum((F.lit(float(rotation[i, k])) * F.col(c) for k, c in enumerate(names)), F.lit(float(shift[i]))) for i in range(3)]


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    w, x, y, z = a
    p, q, r, s = b
    return [w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p]


def rotate(q: list[Column], p: list[Column]) -> list[Column]:
    """A vector turned by a unit quaternion: p + 2 u x (u x p + w p)."""
    w, u = q[0], q[1:]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    inner = [c + w * v for c, v in zip(cross(u, p), p, strict=True)]
    return [v + 2 * c for v, c in zip(p, cross(u, inner), strict=True)]


def exponential(v: list[Column]) -> list[Column]:
    """The quaternion of a rotation vector."""
    angle = F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    scale = F.when(angle < SMALL, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
    return [F.when(angle < SMALL, F.lit(1.0)).otherwise(F.cos(angle / 2)), *(c * scale for c in v)]


def logarithm(q: list[Column]) -> list[Column]:
    """The rotation vector of a unit quaternion, at most half a turn; q and -q give the same, cosines are kept in [0, 1]."""
    half = F.acos(F.least(F.lit(1.0), F.abs(q[0])))
    scale = F.when(F.sin(half) < SMALL, F.lit(2.0)).otherwise(2 * half / F.sin(half)) * F.when(q[0] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return [c * scale for c in q[1:]]


def rotation_vector(r: list[Column]) -> list[Column]:
    """The rotation vector of a rotation's nine entries; under SMALL the axis isn't scaled."""
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (r[0] + r[4] + r[8] - 1) / 2)))
    scale = F.when(angle < SMALL, F.lit(0.5)).otherwise(angle / (2 * F.sin(angle)))
    return [(r[7] - r[5]) * scale, (r[2] - r[6]) * scale, (r[3] - r[1]) * scale]


def slerp(a: list[Column], b: list[Column], alpha: Column) -> list[Column]:
    """Between two unit quaternions the short way; alpha is kept in [0, 1]."""
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), alpha))
    dot = sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0))
    sign = F.when(dot < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    angle = F.acos(F.least(F.lit(1.0), F.abs(dot)))
    near = F.sin(angle) < SMALL
    p = F.when(near, 1 - alpha).otherwise(F.sin((1 - alpha) * angle) / F.sin(angle))
    q = F.when(near, alpha).otherwise(F.sin(alpha * angle) / F.sin(angle)) * sign
    return [p * u + q * v for u, v in zip(a, b, strict=True)]


def angular_distance(a: list[Column], b: list[Column]) -> Column:
    """Degrees between two unit quaternions."""
    dot = F.abs(sum((p * q for p, q in zip(a, b, strict=True)), F.lit(0.0)))
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), dot)))


def unit(q: list[Column]) -> list[Column]:
    norm = F.sqrt(sum((c * c for c in q), F.lit(0.0)))
    return [c / norm for c in q]


def from_array(values: Column, size: int) -> list[Column]:
    """The entries of an array that must have `size` of them; another one fails the job."""
    held = F.when(F.size(values) == size, values).otherwise(F.raise_error(F.lit(f"an array of {size} numbers is needed")).cast("array<double>"))
    return [held[k] for k in range(size)]


def matrix_columns(q: list[Column]) -> list[Column]:
    """The nine entries, row by row, of a unit quaternion's rotation."""
    w, x, y, z = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def left_jacobian(v: list[Column]) -> list[Column]:
    """The nine entries, row by row, of the left Jacobian of a rotation vector: a I + b [v] + c v v'."""
    angle = F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    small = angle < SMALL
    a = F.when(small, F.lit(1.0)).otherwise(F.sin(angle) / angle)
    b = F.when(small, F.lit(0.5)).otherwise((1 - F.cos(angle)) / (angle * angle))
    c = F.when(small, F.lit(0.0)).otherwise((1 - F.sin(angle) / angle) / (angle * angle))
    x, y, z = v
    cross = [F.lit(0.0), -z, y, z, F.lit(0.0), -x, -y, x, F.lit(0.0)]
    return [(a if i == j else F.lit(0.0)) + b * cross[3 * i + j] + c * v[i] * v[j] for i in range(3) for j in range(3)]


def right_jacobian(v: list[Column]) -> list[Column]:
    return left_jacobian([-c for c in v])


def inverse_left_jacobian(v: list[Column]) -> list[Column]:
    """The nine entries of the left Jacobian's inverse: a I + c v v' - [v] / 2."""
    angle = F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    small, half = angle < SMALL, angle / 2
    a = F.when(small, F.cos(half)).otherwise(half / F.tan(half))
    c = F.when(small, F.lit(0.125)).otherwise((1 - half / F.tan(half)) / (angle * angle))
    x, y, z = v
    cross = [F.lit(0.0), -z, y, z, F.lit(0.0), -x, -y, x, F.lit(0.0)]
    return [(a if i == j else F.lit(0.0)) + c * v[i] * v[j] - cross[3 * i + j] / 2 for i in range(3) for j in range(3)]


def inverse_right_jacobian(v: list[Column]) -> list[Column]:
    return inverse_left_jacobian([-c for c in v])


def sphere_basis(g: list[Column]) -> list[Column]:
    """The six entries, row by row, of the two vectors across g that moving along the sphere from the top would carry there:
    e1 and e2 less what leans to g. At the very bottom, where that isn't defined, e1 and -e2."""
    norm = F.sqrt(sum((c * c for c in g), F.lit(0.0)))
    x, y, z = (c / norm for c in g)
    bottom = z <= -1 + 1e-12
    part = lambda value, there: F.when(bottom, F.lit(there)).otherwise(value)
    return [part(1 - x * x / (1 + z), 1.0), part(-x * y / (1 + z), 0.0), part(-x * y / (1 + z), 0.0), part(1 - y * y / (1 + z), -1.0), part(-x, 0.0), part(-y, 0.0)]


def upright_basis(g: list[Column]) -> list[Column]:
    """The six entries, row by row, of two vectors across g: what of the vertical (for a vertical g, of the first axis) is
    across it, and the one that completes them."""
    norm = F.sqrt(sum((c * c for c in g), F.lit(0.0)))
    a = [c / norm for c in g]
    up = (g[0] == 0) & (g[1] == 0)
    across = [F.when(up, F.lit(one)).otherwise(e - c * a[2]) for one, e, c in zip((1.0, 0.0, 0.0), (0.0, 0.0, 1.0), a, strict=True)]
    size = F.when(up, F.lit(1.0)).otherwise(F.sqrt(sum((c * c for c in across), F.lit(0.0))))
    b = [c / size for c in across]
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return [e for pair in zip(b, c, strict=True) for e in pair]


def yaw_degrees() -> Column:
    return F.degrees(F.atan2("y", "x"))


def huber(residual: Column, threshold: float = 1.0) -> Column:
    """1 under the threshold, beyond it (2 sqrt(r) - 1) / r of the residual in thresholds."""
    r = residual / threshold
    return F.when(r < 1, F.lit(1.0)).otherwise((2 * F.sqrt(r) - 1) / r)


# -- small matrices, for folds and tests ----------------------------------------------------------------------


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def exp_matrix(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v)
    if angle < 1e-10:
        return np.eye(3) + skew(v)
    k = skew(v / angle)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def log_matrix(r: np.ndarray) -> np.ndarray:
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    w = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    return w if angle < 1e-6 else w * angle / np.sin(angle)


def matrix_of(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
