"""Registered queries of many sweeps: the map as a stream's state, and registration of all sweeps side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registration, voxel
from ..sources.tables import POINT_KEY, micros, points, table, vectors
from ..streaming import align, map_state
from .queries import _CELLS_SQL, _PLANE_SQL, _SPACED, ID, query

#: Steps that the table is streamed in; milliseconds that rows wait for their sweep's end, longer than the table spans.
STEPS, LONGEST_MS = 4, 10**12


@query(f"SELECT kx, ky, kz, {ID}, frame, x, y, z FROM (SELECT *, l_orderkey // 100 AS frame FROM walk JOIN ord USING (kx, ky, kz, k)) WHERE took", _SPACED)
def streamed_map_insert(spark, sf_dir) -> DataFrame:
    """The points that the map takes, sweep by sweep, as a stream whose state is the map's cells."""
    df = points(spark, sf_dir).drop("ts", "l_shipdate").withColumn("frame", F.floor(F.col("l_orderkey") / 100))
    order = ["frame", *(k for k in POINT_KEY if k != "l_shipdate")]
    taken = map_state.run_to_end(map_state.insert_spaced(map_state.as_sweeps(df, "frame", STEPS), 4.0, 20, 0.5, order))
    return taken.select(*voxel.CELL, *POINT_KEY[:4], "frame", "x", "y", "z")


@query("SELECT s.user_id, s.id, s.ts, s.value, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS kind, e.end_ts FROM ev s ASOF JOIN ends e ON s.user_id = e.user_id AND s.ts < e.end_ts WHERE s.event_type <> 'signup'",
"""ev AS (SELECT user_id, event_id AS id, epoch_us(ts) AS ts, value, event_type FROM events),
came AS (SELECT least(max(CASE WHEN event_type IN ('view', 'click') THEN ts END), max(CASE WHEN event_type IN ('purchase', 'error') THEN ts END), max(CASE WHEN event_type = 'signup' THEN ts END)) // 1000 * 1000 AS w FROM ev),
ends AS (SELECT DISTINCT t.user_id, t.ts AS end_ts FROM ev t JOIN (SELECT user_id, min(ts) AS oldest FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY user_id) o ON o.user_id = t.user_id, came WHERE t.event_type = 'signup' AND t.ts > oldest AND t.ts <= w)""")
def streamed_alignment(spark, sf_dir) -> DataFrame:
    """Points (views and clicks) and samples (purchases and errors) of each sweep, from three streams by their least
    watermark; triggers (signups) that come before the user's first sample end no sweep."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), micros("ts").alias("ts"), "value", "event_type")
    parts = [events.filter(F.col("event_type").isin(*k)).drop("event_type") for k in (("view", "click"), ("purchase", "error"), ("signup",))]
    streams = [map_state.as_sweeps(df, "ts", STEPS) for df in parts]
    return map_state.run_to_end(align.align_sweeps(*streams, longest_ms=LONGEST_MS))


# -- registration ---------------------------------------------------------------------------------------------

#: A sweep for each label, and the pose before it.
BEFORE = (0.5, -0.4, 1.5)
OPTIONS = registration.Options(size=0.1, neighbours=5, least_neighbours=5, early_frames=0, rounds=3, small_degrees=0.01)


def _sweeps(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as body points of a sweep for each label, the map of all vectors, and the sweeps' first poses: slow turns
    about z, and shifts."""
    found = vectors(spark, sf_dir)
    a, zero = F.col("sweep") * 0.004, F.lit(0.0)
    rest = [zero] * 9 + [zero, zero, F.lit(9.81)]
    pose = F.array(F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, F.lit(1.0), F.col("sweep") * 0.002, F.col("sweep") * -0.001, F.col("sweep") * 0.0015, *rest)
    cov = F.array(*(F.lit(v) for v in registration.starting_covariance()))
    sweeps = found.select(F.col("label").cast("long").alias("sweep")).distinct().select("sweep", (F.col("sweep") + 30).alias("number"), pose.alias("pose"), cov.alias("cov"), F.array(*(F.lit(v) for v in BEFORE)).alias("last"))
    return found.select(F.col("label").cast("long").alias("sweep"), F.col("vec_id").alias("id"), *"xyz"), found.select(F.col("vec_id").alias("id"), *"xyz"), registration.started(sweeps)


_SWEPT = """wq AS (SELECT vec_id, label::BIGINT AS sweep, x AS bx, y AS by_, z AS bz, cos(label * 0.004) * x - sin(label * 0.004) * y + label * 0.002 AS x, sin(label * 0.004) * x + cos(label * 0.004) * y + label * -0.001 AS y, z + label * 0.0015 AS z FROM vec),
wc AS (SELECT *, trunc(x / 0.1)::INT AS kx, trunc(y / 0.1)::INT AS ky, trunc(z / 0.1)::INT AS kz FROM wq),
near AS (SELECT * FROM (SELECT q.vec_id AS query_id, q.sweep, q.bx, q.by_, q.bz, p.vec_id, p.x AS nx, p.y AS ny, p.z AS nz, q.x, q.y, q.z, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) AS d2,
row_number() OVER (PARTITION BY q.vec_id ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z), p.vec_id)::INT AS rank FROM wc q JOIN c p ON p.kx BETWEEN q.kx - 1 AND q.kx + 1 AND p.ky BETWEEN q.ky - 1 AND q.ky + 1 AND p.kz BETWEEN q.kz - 1 AND q.kz + 1) WHERE rank <= 5)"""
_ROWS = """res AS (SELECT *, a * w AS j0, b * w AS j1, c * w AS j2, (by_ * tz - bz * ty) * w AS j3, (bz * tx - bx * tz) * w AS j4, (bx * ty - by_ * tx) * w AS j5 FROM (SELECT q.sweep, q.bx, q.by_, q.bz, a, b, c, cos(q.sweep * 0.004) * a + sin(q.sweep * 0.004) * b AS tx, cos(q.sweep * 0.004) * b - sin(q.sweep * 0.004) * a AS ty, c AS tz,
a * (q.x - q.nx) + b * (q.y - q.ny) + c * (q.z - q.nz) AS d, 0.9 * a2d * a2d + 0.1 * exp(-sqrt(q.d2) / 1.5) AS w FROM fit f JOIN near q ON q.query_id = f.query_id AND q.rank = 1,
LATERAL (SELECT CASE WHEN normal_x * (0.5 - q.bx) + normal_y * (-0.4 - q.by_) + normal_z * (1.5 - q.bz) < 0 THEN -1 ELSE 1 END AS s), LATERAL (SELECT s * normal_x AS a, s * normal_y AS b, s * normal_z AS c) WHERE f.n >= 5) WHERE d < 0.3)"""
_SUMS = [*(f"h{a}{b}" for a in range(6) for b in range(a, 6)), *(f"g{a}" for a in range(6)), "loss"]


@query("SELECT sweep, count(*) AS n_residuals, " + ", ".join([*(f"round(sum(j{a} * j{b}), 4) + 0.0 AS h{a}{b}" for a in range(6) for b in range(a, 6)), *(f"round(sum(j{a} * d * w), 4) + 0.0 AS g{a}" for a in range(6)), "round(sum(d * d), 4) + 0.0 AS loss"]) + " FROM res GROUP BY sweep", ", ".join((_CELLS_SQL, _SWEPT, _PLANE_SQL, _ROWS)))
def sweep_normal_equations(spark, sf_dir) -> DataFrame:
    """One round's sums of every sweep: neighbours, planes, gate and normal equations at the sweeps' poses."""
    found, target, states = _sweeps(spark, sf_dir)
    sums = registration.sweep_sums(found, states, target, OPTIONS)
    return sums.select("sweep", "n_residuals", *((F.round(c, 4) + 0.0).alias(c) for c in _SUMS))


@query()
def register_sweeps(spark, sf_dir) -> DataFrame:
    """All sweeps registered to the map: status, rounds and pose."""
    found, target, states = _sweeps(spark, sf_dir)
    out = registration.register(found, target, states, OPTIONS)
    return out.select("sweep", "status", "rounds", "n_residuals", F.round("loss", 4).alias("loss"), *(F.round(F.col("pose")[9 + k], 4).alias(f"t{c}") for k, c in enumerate("xyz")))
