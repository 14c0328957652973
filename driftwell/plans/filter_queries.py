"""Registered queries of the rotation maps, the filter's corrections, and the written map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import estimation
from ..sources import sinks
from ..sources.scratch import shared_path
from ..sources.tables import points, table, vectors
from .queries import POINT_KEY, query, r6


def _even(parts: dict) -> list:
    """Columns with six decimals and zeros without a sign."""
    return [(r6(c) + 0.0).alias(n) for n, c in parts.items()]


def _sql(parts: dict[str, str]) -> str:
    return ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in parts.items())


def _numbered(name: str, parts: list, width: int = 3) -> dict:
    return {f"{name}{k // width}{k % width}": c for k, c in enumerate(parts)}


# -- rotation maps --------------------------------------------------------------------------------------------

#: Rotations by the sine and cosine of the angle about a unit axis; their vectors by the trace.
_TURN = """tu AS (SELECT vec_id, 6 * x AS x, 6 * y AS y, 6 * z AS z, 6 * sqrt(x * x + y * y + z * z) AS t FROM vec),
ma AS (SELECT *, CASE WHEN t < 1e-4 THEN [1 - (y * y + z * z) / 2, x * y / 2 - z, x * z / 2 + y, x * y / 2 + z, 1 - (x * x + z * z) / 2, y * z / 2 - x, x * z / 2 - y, y * z / 2 + x, 1 - (x * x + y * y) / 2]
ELSE [c + a * a * d, a * b * d - e * s, a * e * d + b * s, a * b * d + e * s, c + b * b * d, b * e * d - a * s, a * e * d - b * s, b * e * d + a * s, c + e * e * d] END AS m
FROM tu, LATERAL (SELECT sin(t) AS s, cos(t) AS c, 1 - cos(t) AS d, x / t AS a, y / t AS b, z / t AS e)),
lo AS (SELECT *, acos(greatest(-1.0, least(1.0, (m[1] + m[5] + m[9] - 1) / 2))) AS th FROM ma),
lg AS (SELECT *, CASE WHEN th < 1e-4 THEN 0.5 ELSE th / (2 * sin(th)) END AS k FROM lo)"""
_MAPS = {**_numbered("r", [f"m[{k}]" for k in range(1, 10)]), **{f"q{c}": (f"CASE WHEN t < 1e-4 THEN {c} / 2 ELSE {c} / t * sin(t / 2) END") for c in "xyz"}, "qw": "CASE WHEN t < 1e-4 THEN 1 ELSE cos(t / 2) END", "lx": "(m[8] - m[6]) * k", "ly": "(m[3] - m[7]) * k", "lz": "(m[4] - m[2]) * k"}


@query(f"SELECT vec_id, {_sql(_MAPS)}, {_sql({f'b{c}': f'(m[{i}] - m[{j}]) * k' for c, i, j in (('x', 8, 6), ('y', 3, 7), ('z', 4, 2))})} FROM lg WHERE abs(th - pi()) > 1e-3", _TURN)
def so3_maps(spark, sf_dir) -> DataFrame:
    """Of each rotation vector, of up to more than half a turn: its quaternion, its matrix, and the vector back from the
    matrix (l) and from the quaternion (b), the short way; next to half a turn either vector will do, so those are left out."""
    df = vectors(spark, sf_dir).select("vec_id", F.array(*(6 * F.col(c) for c in "xyz")).alias("v"))
    df = df.withColumn("q", F.array(*geometry.exponential([F.col("v")[k] for k in range(3)])))
    q = [F.col("q")[k] for k in range(4)]
    df = df.withColumn("m", F.array(*geometry.matrix_columns(q)))
    m = [F.col("m")[k] for k in range(9)]
    df = df.withColumns({"l": F.array(*geometry.rotation_vector(m)), "b": F.array(*geometry.logarithm(q))})
    df = df.filter(F.abs(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (m[0] + m[4] + m[8] - 1) / 2))) - F.pi()) > 1e-3)
    parts = {**_numbered("r", m), **{f"q{c}": q[k] for k, c in enumerate("wxyz")}, **{f"{n}{c}": F.col(n)[k] for n in "lb" for k, c in enumerate("xyz")}}
    return df.select("vec_id", *_even(parts))


_SIGNED = {"00": "0", "01": "-z", "02": "y", "10": "z", "11": "0", "12": "-x", "20": "-y", "21": "x", "22": "0"}
_OUTER = {f"{i}{j}": f"{a} * {b}" for i, a in enumerate("xyz") for j, b in enumerate("xyz")}
_ONE = {k: "1" if k[0] == k[1] else "0" for k in _SIGNED}
_JACOBIANS = {
    **{f"right{k}": f"CASE WHEN t < 1e-4 THEN {_ONE[k]} - ({s}) / 2 ELSE {_ONE[k]} * sin(t) / t + (1 - sin(t) / t) * {_OUTER[k]} / (t * t) - (1 - cos(t)) / t * ({s}) / t END" for k, s in _SIGNED.items()},
    **{f"{name}{k}": f"CASE WHEN t < 1e-4 THEN {_ONE[k]} * cos(t / 2) + 0.125 * {_OUTER[k]} {sign} ({s}) / 2 ELSE {_ONE[k]} * h + (1 - h) * {_OUTER[k]} / (t * t) {sign} ({s}) / 2 END" for name, sign in (("left_inverse", "-"), ("right_inverse", "+")) for k, s in _SIGNED.items()},
}


@query(f"SELECT vec_id, {_sql(_JACOBIANS)} FROM (SELECT *, 0.5 * t / tan(t / 2) AS h FROM (SELECT *, sqrt(x * x + y * y + z * z) AS t FROM vec))")
def so3_inverse_jacobians(spark, sf_dir) -> DataFrame:
    """The right Jacobian of each rotation vector, and the inverses of the left and the right one."""
    v = [F.col(c) for c in "xyz"]
    parts = {"right": geometry.right_jacobian(v), "left_inverse": geometry.inverse_left_jacobian(v), "right_inverse": geometry.inverse_right_jacobian(v)}
    return vectors(spark, sf_dir).select("vec_id", *_even({k: c for name, cs in parts.items() for k, c in _numbered(name, cs).items()}))


_BASES = {**_numbered("s", ["1 - a * a / (1 + c)", "-a * b / (1 + c)", "-a * b / (1 + c)", "1 - b * b / (1 + c)", "-a", "-b"], 2), **_numbered("u", ["-a * c / n", "b * ((1 - c * c) / n) - c * (-b * c / n)", "-b * c / n", "c * (-a * c / n) - a * ((1 - c * c) / n)", "(1 - c * c) / n", "a * (-b * c / n) - b * (-a * c / n)"], 2)}


@query(f"SELECT vec_id, {_sql(_BASES)} FROM (SELECT vec_id, x / s AS a, y / s AS b, z / s AS c FROM (SELECT *, sqrt(x * x + y * y + z * z) AS s FROM vec)), LATERAL (SELECT sqrt(a * a * c * c + b * b * c * c + (1 - c * c) * (1 - c * c)) AS n)")
def gravity_bases(spark, sf_dir) -> DataFrame:
    """Two vectors across each vector, as the sphere's basis (s) and as the upright one (u)."""
    v = [F.col(c) for c in "xyz"]
    parts = {**_numbered("s", geometry.sphere_basis(v), 2), **_numbered("u", geometry.upright_basis(v), 2)}
    return vectors(spark, sf_dir).select("vec_id", *_even(parts))


# -- corrections ----------------------------------------------------------------------------------------------

_STATE = {"p": (1, 3), "v": (8, 10), "ba": (11, 13), "bg": (14, 16)}
_OBSERVED = """st AS (SELECT vec_id, e, e[20:36] AS d, e[4] / s AS qw, e[5] / s AS qx, e[6] / s AS qy, e[7] / s AS qz, 9.81 * e[17] AS g1, 9.81 * e[18] AS g2, 9.81 * (1 + e[19]) AS g3 FROM (SELECT vec_id, e, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6] + e[7] * e[7]) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))),
tn AS (SELECT *, CASE WHEN t < 1e-4 THEN 1 ELSE cos(t / 2) END AS w, CASE WHEN t < 1e-4 THEN 0.5 ELSE sin(t / 2) / t END AS k FROM st, LATERAL (SELECT sqrt(d[4] * d[4] + d[5] * d[5] + d[6] * d[6]) AS t)),
qn AS (SELECT *, qw * w - qx * a - qy * b - qz * c AS nw, qw * a + qx * w + qy * c - qz * b AS nx, qw * b - qx * c + qy * w + qz * a AS ny, qw * c + qx * b - qy * a + qz * w AS nz FROM tn, LATERAL (SELECT d[4] * k AS a, d[5] * k AS b, d[6] * k AS c)),
gn AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS ut FROM qn, LATERAL (SELECT sqrt(g1 * g1 + g2 * g2 + g3 * g3) AS gs), LATERAL (SELECT g1 / gs AS h1, g2 / gs AS h2, g3 / gs AS h3),
LATERAL (SELECT (1 - h1 * h1 / (1 + h3)) * d[16] - h1 * h2 / (1 + h3) * d[17] AS ux, (1 - h2 * h2 / (1 + h3)) * d[17] - h1 * h2 / (1 + h3) * d[16] AS uy, -h1 * d[16] - h2 * d[17] AS uz)),
gr AS (SELECT *, g1 + f * (uy * g3 - uz * g2) + o * (ux * dot - g1 * ut * ut) AS gx, g2 + f * (uz * g1 - ux * g3) + o * (uy * dot - g2 * ut * ut) AS gy, g3 + f * (ux * g2 - uy * g1) + o * (uz * dot - g3 * ut * ut) AS gz
FROM gn, LATERAL (SELECT CASE WHEN ut < 1e-4 THEN 1 ELSE sin(ut) / ut END AS f, CASE WHEN ut < 1e-4 THEN 0.5 ELSE (1 - cos(ut)) / (ut * ut) END AS o, ux * g1 + uy * g2 + uz * g3 AS dot))"""
_CORRECTED = {**{f"{n}{c}": f"e[{lo + k}] + d[{at + k}]" for (n, (lo, _)), at in zip(_STATE.items(), (1, 7, 10, 13), strict=True) for k, c in enumerate("xyz")}, **{f"q{c}": f"n{c} / sqrt(nw * nw + nx * nx + ny * ny + nz * nz)" for c in "wxyz"}, "gx": "gx", "gy": "gy", "gz": "gz"}


@query(f"SELECT vec_id, {_sql(_CORRECTED)} FROM gr", _OBSERVED)
def filter_corrections(spark, sf_dir) -> DataFrame:
    """States with a correction each, all from a vector's parts, and the states that the corrections leave."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    held = {n: F.slice("e", lo, hi - lo + 1) for n, (lo, hi) in _STATE.items()}
    q = F.array(*geometry.unit([F.col("e")[k] for k in range(3, 7)]))
    g = F.array(F.col("e")[16] * 9.81, F.col("e")[17] * 9.81, (1 + F.col("e")[18]) * 9.81)
    out = estimation.corrected(df.select("vec_id", *(c.alias(n) for n, c in held.items()), q.alias("q"), g.alias("g"), F.slice("e", 20, 17).alias("d")), "d")
    parts = {f"{n}{c}": F.col(n)[k] for n in ("p", "v", "ba", "bg", "g") for k, c in enumerate("xyz")}
    return out.select("vec_id", *_even({**parts, **{f"q{c}": F.col("q")[k] for k, c in enumerate("wxyz")}}))


#: Place and turn variances of the observed poses.
_SEEN = (0.1, 0.05)
#: With a prior of equal variances the gain is known: along the held turn's axis 1 / (1 + a), across it by the Jacobian's square.
_POSES = """ob AS (SELECT vec_id, e, e[4] / s AS qw, [e[5] / s, e[6] / s, e[7] / s] AS qv, e[11] / t AS tw, [e[12] / t, e[13] / t, e[14] / t] AS tv FROM (SELECT vec_id, e, sqrt(list_inner_product(e[4:7], e[4:7])) AS s, sqrt(list_inner_product(e[11:14], e[11:14])) AS t FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))),
tu AS (SELECT *, qw * tw + list_inner_product(qv, tv) AS rw, [qw * tv[i] - tw * qv[i] - (qv[i % 3 + 1] * tv[(i + 1) % 3 + 1] - qv[(i + 1) % 3 + 1] * tv[i % 3 + 1]) for i in [1, 2, 3]] AS rv FROM ob),
lo AS (SELECT *, [c * CASE WHEN qw < 0 THEN -1 ELSE 1 END / sqrt(list_inner_product(qv, qv)) for c in qv] AS u, 2 * acos(least(1.0, abs(qw))) AS th, [c * CASE WHEN rw < 0 THEN -2 ELSE 2 END * acos(least(1.0, abs(rw))) / sqrt(list_inner_product(rv, rv)) for c in rv] AS w FROM tu),
ga AS (SELECT *, th / 2 / tan(th / 2) AS h, list_inner_product(u, w) AS along FROM lo),
de AS (SELECT *, h * h + th * th / 4 AS sq, [u[i] * along / 1.05 + (h * (w[i] - u[i] * along) - th / 2 * (u[i % 3 + 1] * w[(i + 1) % 3 + 1] - u[(i + 1) % 3 + 1] * w[i % 3 + 1])) / (h * h + th * th / 4 + 0.05) for i in [1, 2, 3]] AS d FROM ga),
fi AS (SELECT *, 0.05 / 1.05 AS pu, 0.05 / (sq + 0.05) AS pa, list_inner_product(d, d) AS dd, list_inner_product(u, d) AS du, [c * sin(sqrt(list_inner_product(d, d)) / 2) / sqrt(list_inner_product(d, d)) for c in d] AS dv, cos(sqrt(list_inner_product(d, d)) / 2) AS dw FROM de)"""
_UPDATED = {**{f"p{c}": f"e[{k}] + (e[{k + 7}] - e[{k}]) / 1.1" for k, c in enumerate("xyz", 1)}, "qw": "qw * dw - list_inner_product(qv, dv)", **{f"q{c}": f"qw * dv[{k}] + dw * qv[{k}] + qv[{k % 3 + 1}] * dv[{(k + 1) % 3 + 1}] - qv[{(k + 1) % 3 + 1}] * dv[{k % 3 + 1}]" for k, c in enumerate("xyz", 1)}, "gx": "9.81 * e[24]", "spread": "0.3 / 1.1 + pu + 2 * pa + 0.25 * (dd * (pu + 2 * pa) - pu * du * du - pa * (dd - du * du)) + 3 + 0.003 + 0.0003 + 0.00002"}


@query(f"SELECT vec_id, {_sql(_UPDATED)} FROM fi", _POSES)
def pose_updates(spark, sf_dir) -> DataFrame:
    """States whose pose was observed, both from a vector's parts: pose, gravity and the covariance's trace after it."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    part = lambda first, n=3: [F.col("e")[first - 1 + k] for k in range(n)]
    cov = F.array(*(F.lit(v) for v in estimation.initial_covariance().ravel().tolist()))
    held = {"p": part(1), "q": geometry.unit(part(4, 4)), "place": part(8), "turn": geometry.unit(part(11, 4)), "v": part(15), "ba": part(18), "bg": part(21), "g": [9.81 * F.col("e")[23], 9.81 * F.col("e")[24], 9.81 * (1 + F.col("e")[25])]}
    out = estimation.observe_poses(df.select("vec_id", cov.alias("cov"), *(F.array(*c).alias(n) for n, c in held.items())), "place", "turn", _SEEN)
    spread = sum((F.col("cov")[18 * k] for k in range(17)), F.lit(0.0))
    return out.select("vec_id", *_even({**{f"p{c}": F.col("p")[k] for k, c in enumerate("xyz")}, **{f"q{c}": F.col("q")[k] for k, c in enumerate("wxyz")}, "gx": F.col("g")[0], "spread": spread}))


# -- the written map ------------------------------------------------------------------------------------------


@query("SELECT x, round(y, 6) AS y, round(z, 6) AS z, r, g, b FROM (SELECT x, y, z, (l_orderkey % 256)::INT AS r, (l_partkey % 256)::INT AS g, (l_suppkey % 256)::INT AS b FROM pts WHERE l_linenumber >= 3)")
def map_file(spark, sf_dir) -> DataFrame:
    """The points seen three times or more, written as point cloud files and read back."""
    df = points(spark, sf_dir)
    colours = {n: (F.col(c) % 256).cast("int") for n, c in (("r", "l_orderkey"), ("g", "l_partkey"), ("b", "l_suppkey"))}
    path = shared_path(spark, "map-file")
    sinks.write_clouds(df.withColumns(colours).filter("l_linenumber >= 3"), path, POINT_KEY)
    found = sinks.read_clouds(spark, path, ["x", "y", "z", "rgb"])
    packed = F.col("rgb").cast("long")
    unpacked = [F.shiftright(packed, 16 - 8 * k).bitwiseAND(F.lit(255)).cast("int").alias(n) for k, n in enumerate("rgb")]
    return found.select("x", "y", "z", *unpacked)
