"""The registered queries over the driver's tables, each with the same result in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import camera, estimation, filters, folds, temporal, voxel
from ..sources import sinks
from ..sources.tables import POINT_KEY, points, series, table, triggers, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The streams of sources/tables.py, for the SQL side.
STREAMS = """
WITH RECURSIVE pts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_quantity + 0 AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, epoch_us(l_shipdate) AS ts FROM lineitem),
vec AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
ser AS (SELECT event_id, user_id, epoch_us(ts) AS ts, value, event_type FROM events WHERE event_type <> 'signup'),
trg AS (SELECT DISTINCT user_id, epoch_us(ts) AS end_ts FROM events WHERE event_type = 'signup')
"""
ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
ORDER = ", ".join(POINT_KEY)


def query(sql: str | None = None, more: str = ""):
    """Registers a query under its function's name; more: common tables after STREAMS."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = STREAMS + (f", {more}" if more else "") + sql
        return f

    return add


def r6(c) -> F:
    return F.round(c, 6)


# -- sweeps ---------------------------------------------------------------------------------------------------


@query("SELECT s.event_id, s.user_id, s.ts, t.end_ts FROM ser s ASOF LEFT JOIN trg t ON s.user_id = t.user_id AND s.ts < t.end_ts")
def sweep_assign(spark, sf_dir):
    return temporal.assign_sweeps(series(spark, sf_dir), triggers(spark, sf_dir)).select("event_id", "user_id", "ts", "end_ts")


@query("""SELECT user_id, begin_ts, end_ts, rendering FROM (
SELECT user_id, k = n AS rendering, (last + k * 1800000000::BIGINT)::BIGINT AS begin_ts, CASE WHEN k = n THEN end_ts ELSE (last + (k + 1) * 1800000000::BIGINT)::BIGINT END AS end_ts
FROM gap, LATERAL (SELECT unnest(generate_series(0, n)) AS k))""", """gap0 AS (SELECT user_id, end_ts, lag(end_ts) OVER (PARTITION BY user_id ORDER BY end_ts) AS last FROM trg),
gap AS (SELECT *, CASE WHEN (end_ts - last) * 2 > 3 * 1800000000::BIGINT THEN ceil((end_ts - last - 1.5 * 1800000000::BIGINT) / 1800000000::BIGINT)::BIGINT ELSE 0 END AS n FROM gap0 WHERE last IS NOT NULL)""")
def sweep_synthetic_windows(spark, sf_dir):
    return temporal.fill_windows(triggers(spark, sf_dir), 1_800_000_000)


@query("""SELECT event_id, user_id, ts, end_ts, false AS overlap FROM own WHERE end_ts IS NOT NULL
UNION ALL SELECT s.event_id, s.user_id, s.ts, t.end_ts, true FROM trg t ASOF JOIN ser s ON s.user_id = t.user_id AND t.end_ts <= s.ts""",
"own AS (SELECT s.event_id, s.user_id, s.ts, t.end_ts FROM ser s ASOF LEFT JOIN trg t ON s.user_id = t.user_id AND s.ts < t.end_ts)")
def imu_overlap(spark, sf_dir):
    return temporal.with_overlap(series(spark, sf_dir), triggers(spark, sf_dir)).select("event_id", "user_id", "ts", "end_ts", "overlap")


@query("""SELECT t.user_id, t.end_ts AS ts, s.ts AS seg_start, s.seg_end, s.value AS v0, s.v1 FROM trg t
JOIN seg s ON s.user_id = t.user_id AND t.end_ts >= s.ts AND t.end_ts < s.seg_end""",
"seg AS (SELECT user_id, ts, value, lead(ts) OVER w AS seg_end, lead(value) OVER w AS v1 FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY ts))")
def imu_segment_join(spark, sf_dir):
    moments = triggers(spark, sf_dir).distinct().withColumnRenamed("end_ts", "ts")
    return temporal.at_segments(moments, series(spark, sf_dir)).select("user_id", "ts", "seg_start", "seg_end", "v0", "v1")


@query("""SELECT a.user_id, a.end_ts, round(((b.ts - a.end_ts) * a.v0 + (a.end_ts - a.t0) * b.value) / ((a.end_ts - a.t0) + (b.ts - a.end_ts)), 6) AS value
FROM (SELECT t.user_id, t.end_ts, s.ts AS t0, s.value AS v0 FROM trg t ASOF JOIN ser s ON s.user_id = t.user_id AND t.end_ts > s.ts) a
ASOF JOIN ser b ON b.user_id = a.user_id AND a.end_ts <= b.ts""")
def straddle_interp(spark, sf_dir):
    return temporal.straddle(series(spark, sf_dir), triggers(spark, sf_dir)).select("user_id", "end_ts", r6("value").alias("value"))


@query("""SELECT event_id, user_id, round(CASE WHEN a > 1 THEN 1 - 1e-5 ELSE a END, 6) AS alpha, (ts - begin_ts) / 1000 AS relative_ms
FROM (SELECT *, (ts - begin_ts) / (end_ts - begin_ts) AS a FROM both_) WHERE begin_ts IS NOT NULL""",
"""ends AS (SELECT user_id, end_ts, lag(end_ts) OVER (PARTITION BY user_id ORDER BY end_ts) AS begin_ts FROM trg),
both_ AS (SELECT s.event_id, s.user_id, s.ts, t.end_ts, t.begin_ts FROM ser s ASOF JOIN ends t ON s.user_id = t.user_id AND s.ts < t.end_ts)""")
def point_alpha_time(spark, sf_dir):
    ends = triggers(spark, sf_dir).distinct().withColumn("begin_ts", F.lag("end_ts").over(Window.partitionBy("user_id").orderBy("end_ts")))
    met = temporal.asof(series(spark, sf_dir), ends, "user_id", "ts", "end_ts", forward=True, strict=True).filter("begin_ts IS NOT NULL")
    return temporal.with_alpha(met, "begin_ts", "end_ts").select("event_id", "user_id", r6("alpha").alias("alpha"), "relative_ms")


@query("SELECT event_id, user_id, round((value - lag(value) OVER w) / CASE WHEN (ts - lag(ts) OVER w) / 1e6 < 1e-5 THEN 1e-3 ELSE (ts - lag(ts) OVER w) / 1e6 END, 6) + 0.0 AS velocity FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def velocity_lag(spark, sf_dir):
    return temporal.velocity(series(spark, sf_dir), "user_id", "ts", "value").select("event_id", "user_id", (r6("velocity") + 0.0).alias("velocity"))


@query("SELECT event_id, user_id, round(2 * lag(value, 1) OVER w - lag(value, 2) OVER w, 6) AS predicted FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def constant_velocity(spark, sf_dir):
    return temporal.constant_velocity(series(spark, sf_dir), "user_id", "ts", "value").select("event_id", "user_id", r6("predicted").alias("predicted"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ts, last_ts FROM (SELECT *, lag(ts) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS last_ts FROM pts) WHERE ts <= last_ts")
def monotonic_check(spark, sf_dir):
    """Line items that ship no later than the one before them in their order."""
    df = points(spark, sf_dir).withColumn("place", F.struct(*POINT_KEY[1:]))
    return temporal.monotonic_faults(df, "l_orderkey", "place", "ts").select(*POINT_KEY[:4], "ts", "last_ts")


# -- points ---------------------------------------------------------------------------------------------------


@query(f"SELECT {ID}, x, y, z FROM pts WHERE abs(x) <= 1e8 AND abs(y) <= 1e8 AND abs(z) <= 1e8 AND x > 0.7 AND x * x + y * y + z * z > 100 AND sqrt(x * x + y * y + z * z) BETWEEN 0.1 AND 60")
def range_filters(spark, sf_dir):
    from ..sources.tables import valid_point

    kept = points(spark, sf_dir).filter(valid_point() & (F.col("x") > 0.7) & filters.beyond(10.0) & filters.in_depth(F.sqrt(filters.squared_norm()), 0.1, 60.0))
    return kept.select(*POINT_KEY[:4], "x", "y", "z")


@query(f"SELECT {ID}, x, l_suppkey % 16 AS tag FROM pts WHERE NOT (x > 2.0 AND ((l_suppkey % 16) & 3 <> 0 OR (l_suppkey % 16) & 12 <> 0))")
def tag_bitmask(spark, sf_dir):
    return points(spark, sf_dir).withColumn("tag", F.col("l_suppkey") % 16).filter(filters.tag_ok("tag", "x")).select(*POINT_KEY[:4], "x", "tag")


@query(f"""SELECT {ID}, x, y, z FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM pts WINDOW w AS (PARTITION BY l_orderkey ORDER BY {ORDER}))
WHERE abs(x - px) > 1e-7 OR abs(y - py) > 1e-7 OR abs(z - pz) > 1e-7""")
def dedup_consecutive(spark, sf_dir):
    return filters.moved(points(spark, sf_dir), ["l_orderkey"], POINT_KEY).select(*POINT_KEY[:4], "x", "y", "z")


def _decimated(base: int) -> str:
    return f"SELECT {ID} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 + {base} AS k FROM pts) WHERE k % 3 = 0"


@query(_decimated(0))
def decimate_base0(spark, sf_dir):
    return filters.every_nth(points(spark, sf_dir), ["l_orderkey"], POINT_KEY, 3, 0).select(*POINT_KEY[:4])


@query(_decimated(1))
def decimate_base1(spark, sf_dir):
    return filters.every_nth(points(spark, sf_dir), ["l_orderkey"], POINT_KEY, 3, 1).select(*POINT_KEY[:4])


@query("""SELECT s.event_id, s.user_id, s.ts FROM msg s JOIN (SELECT user_id, day, max(e) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
FROM (SELECT user_id, day, max(ts) AS e FROM msg GROUP BY ALL)) m ON s.user_id = m.user_id AND s.day = m.day WHERE before IS NULL OR s.ts > before""",
"msg AS (SELECT *, event_id // 500 AS day FROM ser)")
def late_drop(spark, sf_dir):
    batches = series(spark, sf_dir).withColumn("message", F.floor(F.col("event_id") / 500))
    return filters.not_late(batches, "message", "ts", ["user_id"]).select("event_id", "user_id", "ts")


@query(f"""SELECT {ID}, round(CASE WHEN yaw > yaw0 THEN (yaw0 - yaw + 360) / 3.61 ELSE (yaw0 - yaw) / 3.61 END, 6) AS offset_ms
FROM (SELECT *, first_value(yaw) OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS yaw0 FROM (SELECT *, degrees(atan2(y, x)) AS yaw FROM pts))""")
def yaw_time(spark, sf_dir):
    df = points(spark, sf_dir).withColumn("yaw", geometry.yaw_degrees())
    df = df.withColumn("yaw0", F.first("yaw").over(filters.window_of(["l_orderkey"], POINT_KEY)))
    turn = F.col("yaw0") - F.col("yaw")
    return df.select(*POINT_KEY[:4], r6(F.when(F.col("yaw") > F.col("yaw0"), turn + 360).otherwise(turn) / 3.61).alias("offset_ms"))


_TURN = geometry.exp_matrix(np.array([0.1, -0.2, 0.3]))
_SHIFT = np.array([1.0, -2.0, 0.5])
_AFFINE = [" + ".join(f"({float(_TURN[i, k])!r}::DOUBLE) * {c}" for k, c in enumerate("xyz")) + f" + ({float(_SHIFT[i])!r}::DOUBLE)" for i in range(3)]


@query(f"SELECT {ID}, " + ", ".join(f"round({e}, 4) AS w{c}" for e, c in zip(_AFFINE, "xyz", strict=True)) + " FROM pts")
def affine_transform(spark, sf_dir):
    return points(spark, sf_dir).select(*POINT_KEY[:4], *(F.round(e, 4).alias(f"w{c}") for e, c in zip(geometry.affine(_TURN, _SHIFT), "xyz", strict=True)))


_SWEPT_TURN = np.array([0.02, -0.01, 0.3])
_ANGLE = float(np.linalg.norm(_SWEPT_TURN))
_AXIS = [f"({float(v / _ANGLE)!r}::DOUBLE)" for v in _SWEPT_TURN]
_SLERP = f"""al AS (SELECT *, (l_linenumber - 1) / 6.0::DOUBLE AS alpha FROM pts),
qu AS (SELECT *, cos(alpha * {_ANGLE!r}::DOUBLE / 2) AS w, {_AXIS[0]} * sin(alpha * {_ANGLE!r}::DOUBLE / 2) AS a, {_AXIS[1]} * sin(alpha * {_ANGLE!r}::DOUBLE / 2) AS b, {_AXIS[2]} * sin(alpha * {_ANGLE!r}::DOUBLE / 2) AS c FROM al),
cr AS (SELECT *, b * z - c * y + w * x AS i, c * x - a * z + w * y AS j, a * y - b * x + w * z AS k FROM qu)"""


@query(f"SELECT {ID}, round(x + 2 * (b * k - c * j) + 1.0 * alpha, 6) AS wx, round(y + 2 * (c * i - a * k) - 2.0 * alpha, 6) AS wy, round(z + 2 * (a * j - b * i) + 0.5 * alpha, 6) AS wz, round(degrees(2 * acos(least(1.0::DOUBLE, abs(w)))), 6) AS degrees FROM cr", _SLERP)
def slerp_deskew(spark, sf_dir):
    """Points turned by their place in the sweep between the rotations at its ends (constant motion)."""
    a, b = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)], geometry.exponential([F.lit(v) for v in (0.02, -0.01, 0.3)])
    df = points(spark, sf_dir).withColumn("alpha", (F.col("l_linenumber") - 1) / 6.0)
    q = geometry.slerp(a, b, F.col("alpha"))
    turned = geometry.rotate(q, [F.col(c) for c in "xyz"])
    return df.select(*POINT_KEY[:4], *(F.round(v + s * F.col("alpha"), 6).alias(f"w{c}") for v, s, c in zip(turned, _SHIFT.tolist(), "xyz", strict=True)), r6(geometry.angular_distance(a, q)).alias("degrees"))


# -- voxels and neighbours ------------------------------------------------------------------------------------


@query("SELECT kx, ky, kz, vec_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY vec_id) AS r FROM c) WHERE r = 1",
"c AS (SELECT *, trunc(x / 0.1)::INT AS kx, trunc(y / 0.1)::INT AS ky, trunc(z / 0.1)::INT AS kz FROM vec)")
def voxel_downsample(spark, sf_dir):
    return voxel.downsample(vectors(spark, sf_dir).drop("label"), 0.1, ["vec_id"]).select(*voxel.CELL, "vec_id", "x", "y", "z")


@query("SELECT trunc(x / 2.0)::INT AS kx, trunc(y / 2.0)::INT AS ky, trunc(z / 2.0)::INT AS kz, count(*) AS n_points FROM pts GROUP BY ALL")
def voxel_counts(spark, sf_dir):
    return voxel.counts(points(spark, sf_dir), 2.0)


@query(f"SELECT {ID}, kx, ky, kz FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY {ORDER}) AS r FROM (SELECT *, trunc(x / 2.0)::INT AS kx, trunc(y / 2.0)::INT AS ky, trunc(z / 2.0)::INT AS kz FROM pts)) WHERE r <= 20")
def voxel_bounded_first_n(spark, sf_dir):
    return filters.first_n(voxel.with_cells(points(spark, sf_dir), 2.0), voxel.CELL, POINT_KEY, 20).select(*POINT_KEY[:4], *voxel.CELL)


_SPACED = """cl AS (SELECT *, trunc(x / 4.0)::INT AS kx, trunc(y / 4.0)::INT AS ky, trunc(z / 4.0)::INT AS kz FROM pts),
ord AS (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM cl),
walk AS (SELECT kx, ky, kz, k, [[x, y, z]] AS held, true AS took FROM ord WHERE k = 1 UNION ALL
SELECT o.kx, o.ky, o.kz, o.k, CASE WHEN fits THEN list_append(w.held, [o.x, o.y, o.z]) ELSE w.held END, fits FROM walk w JOIN ord o ON o.kx = w.kx AND o.ky = w.ky AND o.kz = w.kz AND o.k = w.k + 1,
LATERAL (SELECT len(w.held) < 20 AND len(list_filter(w.held, lambda h: (h[1] - o.x) * (h[1] - o.x) + (h[2] - o.y) * (h[2] - o.y) + (h[3] - o.z) * (h[3] - o.z) <= 0.25)) = 0 AS fits))"""


@query(f"SELECT kx, ky, kz, {ID}, x, y, z FROM walk JOIN ord USING (kx, ky, kz, k) WHERE took", _SPACED)
def voxel_min_distance_insert(spark, sf_dir):
    """The points a map takes: 20 a cell, spaced."""
    return voxel.insert_spaced(points(spark, sf_dir).drop("ts", "l_shipdate"), 4.0, 20, 0.5, [k for k in POINT_KEY if k != "l_shipdate"]).select(*voxel.CELL, *POINT_KEY[:4], "x", "y", "z")


_KNN_SQL = """near AS (SELECT * FROM (SELECT q.vec_id AS query_id, p.vec_id, p.x AS nx, p.y AS ny, p.z AS nz, q.x, q.y, q.z, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z) AS d2,
row_number() OVER (PARTITION BY q.vec_id ORDER BY (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z), p.vec_id)::INT AS rank
FROM c q JOIN c p ON p.kx BETWEEN q.kx - 1 AND q.kx + 1 AND p.ky BETWEEN q.ky - 1 AND q.ky + 1 AND p.kz BETWEEN q.kz - 1 AND q.kz + 1) WHERE rank <= 5)"""
_CELLS_SQL = "c AS (SELECT *, trunc(x / 0.1)::INT AS kx, trunc(y / 0.1)::INT AS ky, trunc(z / 0.1)::INT AS kz FROM vec)"


def _near(spark, sf_dir) -> DataFrame:
    df = vectors(spark, sf_dir)
    return voxel.neighbours(df, df, "vec_id", "vec_id", 0.1, 1, 5)


@query("SELECT query_id, rank, vec_id, round(d2, 6) AS d2 FROM near", _CELLS_SQL + ", " + _KNN_SQL)
def knn_voxel(spark, sf_dir):
    return _near(spark, sf_dir).select("query_id", "rank", "vec_id", r6("d2").alias("d2"))


@query("SELECT query_id, count(*) AS n, round(avg(nx), 6) + 0.0 AS mx, round(avg(ny), 6) + 0.0 AS my, round(avg(nz), 6) + 0.0 AS mz, round(sum(nx * nx) - sum(nx) * sum(nx) / count(*), 6) + 0.0 AS cxx, round(sum(nx * ny) - sum(nx) * sum(ny) / count(*), 6) + 0.0 AS cxy, round(sum(nz * nz) - sum(nz) * sum(nz) / count(*), 6) + 0.0 AS czz FROM near GROUP BY query_id", _CELLS_SQL + ", " + _KNN_SQL)
def knn_plane_moments(spark, sf_dir):
    return voxel.moments(_near(spark, sf_dir)).select("query_id", "n", *((r6(c) + 0.0).alias(c) for c in ("mx", "my", "mz", "cxx", "cxy", "czz")))


#: Eigenvalues and normals in closed form, step by step. Fixed value: the share under which eigenvalues count as equal.
_PLANE_SQL = """mom AS (SELECT query_id, n, sx / n AS mx, sy / n AS my, sz / n AS mz, sxx - sx * sx / n AS cxx, sxy - sx * sy / n AS cxy, sxz - sx * sz / n AS cxz, syy - sy * sy / n AS cyy, syz - sy * sz / n AS cyz, szz - sz * sz / n AS czz
FROM (SELECT query_id, count(*) AS n, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz, sum(nx * nx) AS sxx, sum(nx * ny) AS sxy, sum(nx * nz) AS sxz, sum(ny * ny) AS syy, sum(ny * nz) AS syz, sum(nz * nz) AS szz FROM near GROUP BY query_id)),
roots AS (SELECT m.*, l1, l2, l3 FROM mom m, LATERAL (SELECT (cxx + cyy + czz) / 3 AS q), LATERAL (SELECT sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p),
LATERAL (SELECT acos(greatest(-1.0, least(1.0, CASE WHEN p > 0 THEN ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p) ELSE 1.0 END))) / 3 AS phi),
LATERAL (SELECT q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3), LATERAL (SELECT 3 * q - l1 - l3 AS l2)),
cand AS (SELECT r.*, [[cxx - l3, cxy, cxz], [cxy, cyy - l3, cyz], [cxz, cyz, czz - l3]] AS rows_, [[cxy * cyz - cxz * (cyy - l3), cxz * cxy - (cxx - l3) * cyz, (cxx - l3) * (cyy - l3) - cxy * cxy], [cxy * (czz - l3) - cxz * cyz, cxz * cxz - (cxx - l3) * (czz - l3), (cxx - l3) * cyz - cxy * cxz],
  [(cyy - l3) * (czz - l3) - cyz * cyz, cyz * cxz - cxy * (czz - l3), cxy * cyz - (cyy - l3) * cxz]] AS across FROM roots r),
picked AS (SELECT c.*, across[list_position(list_transform(across, lambda v: list_inner_product(v, v)), list_max(list_transform(across, lambda v: list_inner_product(v, v))))] AS w, rows_[list_position(list_transform(rows_, lambda v: list_inner_product(v, v)), list_max(list_transform(rows_, lambda v: list_inner_product(v, v))))] AS ax FROM cand c),
side AS (SELECT p.*, CASE WHEN l1 <= 0 OR l1 - l3 <= 1e-9 * l1 THEN [0.0, 0.0, 1.0]::DOUBLE[] WHEN l2 - l3 > 1e-9 * l1 THEN w WHEN abs(ax[1]) = least(abs(ax[1]), abs(ax[2]), abs(ax[3])) THEN [0.0, ax[3], -ax[2]] WHEN abs(ax[2]) = least(abs(ax[1]), abs(ax[2]), abs(ax[3])) THEN [-ax[3], 0.0, ax[1]] ELSE [ax[2], -ax[1], 0.0] END AS v FROM picked p),
fit AS (SELECT query_id, n, v[1] / len AS normal_x, v[2] / len AS normal_y, v[3] / len AS normal_z, CASE WHEN l1 > 0 THEN (sqrt(abs(l2)) - sqrt(abs(l3))) / sqrt(abs(l1)) ELSE 0 END AS a2d
FROM side, LATERAL (SELECT greatest(abs(v[1]), abs(v[2]), abs(v[3])) AS most), LATERAL (SELECT sqrt(list_inner_product(v, v)) * CASE WHEN (CASE WHEN abs(v[1]) = most THEN v[1] WHEN abs(v[2]) = most THEN v[2] ELSE v[3] END) < 0 THEN -1 ELSE 1 END AS len))"""


@query("SELECT query_id, n, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("normal_x", "normal_y", "normal_z", "a2d")) + " FROM fit", ", ".join((_CELLS_SQL, _KNN_SQL, _PLANE_SQL)))
def plane_fit(spark, sf_dir):
    """Local planes of each vector's neighbours: normal and planarity."""
    return voxel.planes(voxel.moments(_near(spark, sf_dir))).select("query_id", "n", *((F.round(c, 5) + 0.0).alias(c) for c in ("normal_x", "normal_y", "normal_z", "a2d")))


#: Where the pose before was.
LAST_PLACE = (0.5, -0.4, 1.5)


@query("""SELECT query_id, """ + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in ("distance", "weight", "j0", "j1", "j2", "j3", "j4", "j5")) + """ FROM (SELECT *, a * weight AS j0, b * weight AS j1, c * weight AS j2, (y * c - z * b) * weight AS j3, (z * a - x * c) * weight AS j4, (x * b - y * a) * weight AS j5
FROM (SELECT f.query_id, q.x, q.y, q.z, a, b, c, a * (q.x - q.nx) + b * (q.y - q.ny) + c * (q.z - q.nz) AS distance, 0.9 * a2d * a2d + 0.1 * exp(-sqrt(q.d2) / 1.5) AS weight FROM fit f JOIN near q ON q.query_id = f.query_id AND q.rank = 1,
LATERAL (SELECT CASE WHEN normal_x * (0.5 - q.x) + normal_y * (-0.4 - q.y) + normal_z * (1.5 - q.z) < 0 THEN -1 ELSE 1 END AS s), LATERAL (SELECT s * normal_x AS a, s * normal_y AS b, s * normal_z AS c) WHERE f.n >= 5) WHERE distance < 0.3)""", ", ".join((_CELLS_SQL, _KNN_SQL, _PLANE_SQL)))
def plane_residual_rows(spark, sf_dir):
    df, near = vectors(spark, sf_dir), _near(spark, sf_dir)
    rows = voxel.plane_residuals(df, near, voxel.planes(voxel.moments(near)), "vec_id", 0.3, 5, [F.lit(v) for v in LAST_PLACE])
    return rows.select("query_id", *((F.round(c, 5) + 0.0).alias(c) for c in ("distance", "weight", "j0", "j1", "j2", "j3", "j4", "j5")))


_J = ["x", "y", "z", "(y - z)", "(z - x)", "(x - y)"]


@query("SELECT label, " + ", ".join(f"round(sum({_J[a]} * {_J[b]}), 4) AS h{a}{b}" for a in range(6) for b in range(a, 6)) + ", " + ", ".join(f"round(sum({_J[a]} * (x + y)), 4) AS g{a}" for a in range(6)) + ", round(sum((x + y) * (x + y)), 4) AS loss, count(*) AS n_residuals FROM vec GROUP BY label")
def normal_equations(spark, sf_dir):
    df = vectors(spark, sf_dir).select("label", (F.col("x") + F.col("y")).alias("distance"), F.lit(1.0).alias("weight"), *(F.expr(j).alias(f"j{k}") for k, j in enumerate(_J)))
    out = voxel.normal_equations(df, ["label"])
    return out.select("label", "n_residuals", *(F.round(c, 4).alias(c) for c in out.columns if c not in ("label", "n_residuals")))


@query("""SELECT c.kx, c.ky, c.kz, count(*) AS n_points FROM c JOIN f ON c.kx = f.kx AND c.ky = f.ky AND c.kz = f.kz GROUP BY ALL""",
_CELLS_SQL + """, f AS (SELECT kx, ky, kz FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY vec_id) AS r FROM c) WHERE r = 1 AND x * x + y * y + z * z <= 0.04)""")
def evict_far(spark, sf_dir):
    return voxel.evict_far(voxel.with_cells(vectors(spark, sf_dir), 0.1), (0.0, 0.0, 0.0), 0.2, ["vec_id"]).groupBy(*voxel.CELL).agg(F.count("*").alias("n_points"))


# -- folds and votes ------------------------------------------------------------------------------------------

_VOTES = "votes AS (SELECT user_id, (event_id % 5)::INT AS label FROM events)"


def _votes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).cast("int").alias("label"))


@query("SELECT event_id, user_id, n, round(mean, 9) AS mean, round(sum((value - mean) * (value - mean) * (n - 1) / n) OVER w / n, 8) AS variance FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)",
"m AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))")
def running_mean_var(spark, sf_dir):
    return folds.running_noise(series(spark, sf_dir), "user_id", ["ts"], "value").select("event_id", "user_id", "n", F.round("mean", 9).alias("mean"), F.round("variance", 8).alias("variance"))


@query("SELECT user_id, arg_max(label, (c, -label)) AS label, max(c) AS n_votes, sum(c)::BIGINT AS n_semantic FROM (SELECT user_id, label, count(*) AS c FROM votes WHERE label <> 0 GROUP BY ALL) GROUP BY user_id", _VOTES)
def majority_vote(spark, sf_dir):
    return folds.majority(_votes(spark, sf_dir), "user_id", "label")


@query("SELECT user_id, string_agg(label || ':' || c, ',' ORDER BY label) AS histogram FROM (SELECT user_id, label, count(*) AS c FROM votes WHERE label <> 0 GROUP BY ALL) GROUP BY user_id", _VOTES)
def vote_histogram(spark, sf_dir):
    h = folds.histogram(_votes(spark, sf_dir), "user_id", "label")
    return h.select("user_id", F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("histogram"))


_FUSED = """seq AS (SELECT *, l_extendedprice / 1000 AS d, epoch_us(l_shipdate) / 1e6 AS t, (l_quantity * 5) % 256 AS c1, (l_extendedprice / 1000 * 2) % 256 AS c2, (l_discount * 100 * 25) % 256 AS c3, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem),
fold AS (SELECT l_partkey, k, trunc(c1 + 0.5)::INT AS r, trunc(c2 + 0.5)::INT AS g, trunc(c3 + 0.5)::INT AS b, 15.0::DOUBLE AS s, d AS best, t AS last, 1 AS n FROM seq WHERE k = 1 UNION ALL
SELECT q.l_partkey, q.k, CASE WHEN far THEN f.r ELSE trunc(t2 * (f.r / (w * w) + q.c1 / 225.0::DOUBLE))::INT END, CASE WHEN far THEN f.g ELSE trunc(t2 * (f.g / (w * w) + q.c2 / 225.0::DOUBLE))::INT END, CASE WHEN far THEN f.b ELSE trunc(t2 * (f.b / (w * w) + q.c3 / 225.0::DOUBLE))::INT END,
  CASE WHEN far THEN f.s ELSE tight END, CASE WHEN far THEN f.best ELSE least(f.best, q.d) END, CASE WHEN far THEN f.last ELSE q.t END, CASE WHEN far THEN f.n ELSE f.n + 1 END
FROM fold f JOIN seq q ON q.l_partkey = f.l_partkey AND q.k = f.k + 1, LATERAL (SELECT q.d > 1.2::DOUBLE * f.best AS far, f.s + 0.1::DOUBLE * (q.t - f.last) AS w), LATERAL (SELECT 1 / sqrt(1 / (w * w) + 1 / 225.0::DOUBLE) AS tight), LATERAL (SELECT tight * tight AS t2))"""


@query("SELECT l_partkey AS point_id, arg_max(r, k) AS r, arg_max(g, k) AS g, arg_max(b, k) AS b, arg_max(best, k) AS distance, arg_max(n, k) AS n_rgb FROM fold GROUP BY l_partkey", _FUSED)
def color_fold(spark, sf_dir):
    """Colours fused over each part's line items in order of shipping."""
    obs = points(spark, sf_dir).select(F.col("l_partkey").alias("point_id"), (F.col("ts") / 1e6).alias("ts"), F.struct(*(c for c in POINT_KEY if c not in ("l_partkey", "l_shipdate"))).alias("obs_id"), (F.col("x") * 5 % 256).alias("r"), (F.col("y") * 2 % 256).alias("g"), (F.col("z") * 25 % 256).alias("b"), F.col("y").alias("distance"))
    return folds.colour_fold(obs)


@query("SELECT l_partkey, count(*) AS n_rgb, round(min(y), 6) AS best_distance FROM pts GROUP BY l_partkey HAVING count(*) >= 25")
def min_views_filter(spark, sf_dir):
    return points(spark, sf_dir).groupBy("l_partkey").agg(F.count("*").alias("n_rgb"), r6(F.min("y")).alias("best_distance")).filter("n_rgb >= 25")


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM ser GROUP BY user_id")
def upsert_last(spark, sf_dir):
    return folds.upsert(series(spark, sf_dir).select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts"]).select("user_id", "event_id", "value")


@query("SELECT user_id, arg_min(event_id, ts) AS event_id, arg_min(value, ts) AS value FROM ser GROUP BY user_id")
def insert_if_absent(spark, sf_dir):
    return folds.insert_if_absent(series(spark, sf_dir).select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts"]).select("user_id", "event_id", "value")


@query("SELECT s.user_id, s.event_id FROM ser s WHERE NOT EXISTS (SELECT 1 FROM trg t WHERE t.user_id = s.user_id AND t.end_ts // 86400000000 = s.ts // 86400000000)")
def anti_new(spark, sf_dir):
    """Samples of days without a trigger of their user."""
    day = lambda df, ts: df.withColumn("day", F.floor(F.col(ts) / temporal.DAY_US))
    return folds.erase(day(series(spark, sf_dir), "ts"), day(triggers(spark, sf_dir), "end_ts"), ["user_id", "day"]).select("user_id", "event_id")


@query("SELECT s.user_id, s.event_id FROM ser s WHERE EXISTS (SELECT 1 FROM trg t WHERE t.user_id = s.user_id)")
def semi_recent(spark, sf_dir):
    return series(spark, sf_dir).join(triggers(spark, sf_dir).select("user_id").distinct(), "user_id", "left_semi").select("user_id", "event_id")


@query("SELECT event_id, round(CASE WHEN r < 1 THEN 1.0 ELSE (2 * sqrt(r) - 1) / r END, 6) AS weight FROM (SELECT event_id, abs(value) / 50 AS r FROM ser)")
def huber_weights(spark, sf_dir):
    return series(spark, sf_dir).select("event_id", r6(geometry.huber(F.abs("value"), 50.0)).alias("weight"))


# -- camera, rasters and masks --------------------------------------------------------------------------------

_PINHOLE = "pix AS (SELECT *, 400 * x / z + 320 AS u, 400 * y / z + 240 AS v, z AS depth FROM pts WHERE z >= 0.001)"


def _pinhole(spark, sf_dir) -> DataFrame:
    return camera.project(points(spark, sf_dir), 400, 400, 320, 240)


@query(f"SELECT {ID}, round(u, 4) AS u, round(v, 4) AS v FROM pix WHERE u >= 0.005 * 640 + 1 AND ceil(u) < 0.995 * 640 AND v >= 0.005 * 480 + 1 AND ceil(v) < 0.995 * 480", _PINHOLE)
def project_pinhole(spark, sf_dir):
    seen = _pinhole(spark, sf_dir).filter(camera.in_image(F.col("u"), F.col("v"), 640, 480))
    return seen.select(*POINT_KEY[:4], F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


@query(f"SELECT gu, gv, depth, {ID} FROM (SELECT *, row_number() OVER (PARTITION BY gu, gv ORDER BY depth, {ORDER}) AS r FROM (SELECT *, round(u / 10)::INT AS gu, round(v / 10)::INT AS gv FROM pix)) WHERE r = 1", _PINHOLE)
def zbuffer(spark, sf_dir):
    return camera.z_buffer(_pinhole(spark, sf_dir).select(*POINT_KEY, "u", "v", "depth"), 10, POINT_KEY).select("gu", "gv", "depth", *POINT_KEY[:4])


_RASTER = "ras AS (SELECT vec_id AS frame, ((i - 1) // 8)::INT AS row, ((i - 1) % 8)::INT AS col, value FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings))"


def _raster(spark, sf_dir) -> DataFrame:
    """Embeddings as 8 by 8 rasters."""
    return camera.pixels(table(spark, sf_dir, "embeddings").withColumn("image", F.transform("embedding", lambda x: x.cast("double"))), "vec_id", "image", 8)


@query("SELECT vec_id, round(value, 6) AS value FROM place JOIN ras ON ras.frame = place.vec_id AND ras.row = floor(place.v)::INT AND ras.col = floor(place.u)::INT", _RASTER + ", place AS (SELECT vec_id, 3.5 + 2 * x AS u, 3.5 + 2 * y AS v FROM vec)")
def raster_lookup(spark, sf_dir):
    return camera.lookup(_places(spark, sf_dir), _raster(spark, sf_dir)).select("vec_id", r6("value").alias("value"))


def _places(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.col("vec_id").alias("frame"), (3.5 + 2 * F.col("x")).alias("u"), (3.5 + 2 * F.col("y")).alias("v"))


@query("""SELECT vec_id, round(sum(CASE WHEN b = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN a = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * value), 6) AS value
FROM place, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b), ras WHERE ras.frame = vec_id AND ras.row = floor(v)::INT + a AND ras.col = floor(u)::INT + b GROUP BY vec_id HAVING count(*) = 4""", _RASTER + ", place AS (SELECT vec_id, 3.5 + 2 * x AS u, 3.5 + 2 * y AS v FROM vec)")
def bilinear_sample(spark, sf_dir):
    return camera.bilinear(_places(spark, sf_dir), _raster(spark, sf_dir), "vec_id").select("vec_id", r6("value").alias("value"))


_SCHARR = """sch AS (SELECT c.frame, c.row, c.col, sum((n.col - c.col) * CASE WHEN n.row = c.row THEN 10 ELSE 3 END * n.value) AS dx, sum((n.row - c.row) * CASE WHEN n.col = c.col THEN 10 ELSE 3 END * n.value) AS dy, any_value(c.value) AS value
FROM ras c JOIN ras n ON n.frame = c.frame AND abs(n.row - c.row) <= 1 AND abs(n.col - c.col) <= 1 GROUP BY c.frame, c.row, c.col HAVING count(*) = 9)"""


@query("SELECT frame, row, col, round(dx, 6) AS dx, round(dy, 6) AS dy FROM sch", _RASTER + ", " + _SCHARR)
def scharr_gradients(spark, sf_dir):
    return camera.scharr(_raster(spark, sf_dir)).select("frame", "row", "col", r6("dx").alias("dx"), r6("dy").alias("dy"))


@query("SELECT frame, (row // 2)::INT AS row, (col // 2)::INT AS col, round(avg(value), 6) AS value FROM ras GROUP BY ALL", _RASTER)
def pyramid_level(spark, sf_dir):
    return camera.halved(_raster(spark, sf_dir)).select("frame", "row", "col", r6("value").alias("value"))


@query("""SELECT ras.frame, row, col, CASE WHEN total = least_ THEN 0 ELSE round((upto - least_) * 255 / (total - least_)) END::INT AS level FROM q ras JOIN
(SELECT *, min(upto) OVER (PARTITION BY frame) AS least_ FROM (SELECT frame, value, sum(n) OVER (PARTITION BY frame ORDER BY value) AS upto, sum(n) OVER (PARTITION BY frame) AS total FROM (SELECT frame, value, count(*) AS n FROM q GROUP BY ALL))) h
ON h.frame = ras.frame AND h.value = ras.value""", _RASTER + ", q AS (SELECT frame, row, col, floor(128 + 100 * value)::INT AS value FROM ras)")
def histogram_equalise(spark, sf_dir):
    grey = _raster(spark, sf_dir).withColumn("value", F.floor(128 + 100 * F.col("value")).cast("int"))
    return camera.equalised(grey).select("frame", "row", "col", "level")


@query("""SELECT frame, round((b * q - c * p) / (a * c - b * b), 4) AS du, round((b * p - a * q) / (a * c - b * b), 4) AS dv FROM (
SELECT s.frame, sum(dx / 32 * dx / 32) AS a, sum(dx / 32 * dy / 32) AS b, sum(dy / 32 * dy / 32) AS c, sum(dx / 32 * (n.value - s.value)) AS p, sum(dy / 32 * (n.value - s.value)) AS q
FROM sch s JOIN ras n ON n.frame = s.frame + 1 AND n.row = s.row AND n.col = s.col GROUP BY s.frame) WHERE (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 > 1e-4""", _RASTER + ", " + _SCHARR)
def gradient_flow(spark, sf_dir):
    return camera.flow(_raster(spark, sf_dir)).select("frame", F.round("du", 4).alias("du"), F.round("dv", 4).alias("dv"))


@query("SELECT e.event_id, arg_min(m.label, m.ordinal) AS label FROM hit e JOIN m ON m.day = e.day AND m.row = e.row AND m.col = e.col GROUP BY e.event_id",
"""hit AS (SELECT event_id, event_id % 7 AS day, round((event_id % 13) / 2.0)::INT AS row, round((event_id % 11) / 2.0)::INT AS col FROM events),
m AS (SELECT event_id % 7 AS day, (event_id // 7 % 7)::INT AS row, (event_id // 49 % 6)::INT AS col, event_id AS ordinal, (event_id % 5)::INT AS label FROM events WHERE event_type = 'signup')""")
def first_match_mask(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    hits = events.select("event_id", (F.col("event_id") % 7).alias("frame"), ((F.col("event_id") % 13) / 2.0).alias("v"), ((F.col("event_id") % 11) / 2.0).alias("u"))
    whole = lambda c, n: (F.floor(F.col("event_id") / c) % n).cast("int")
    masks = events.filter("event_type = 'signup'").select((F.col("event_id") % 7).alias("frame"), whole(7, 7).alias("row"), whole(49, 6).alias("col"), F.col("event_id").alias("ordinal"), (F.col("event_id") % 5).cast("int").alias("label"))
    first = masks.groupBy("frame", "row", "col").agg(F.min_by("label", "ordinal").alias("label"), F.min("ordinal").alias("ordinal"))
    return camera.first_mask(hits, first, "event_id")


@query("SELECT p_partkey, label, CASE WHEN label > 0 THEN (label - 1) % 150 END::INT AS slot FROM (SELECT p_partkey, p_size - 5 AS label FROM part)")
def palette_join(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 5).alias("label"))
    slots = sinks.palette(spark).select("slot", (F.col("slot") + 1).alias("of"))
    return parts.join(F.broadcast(slots), F.when(F.col("label") > 0, F.pmod(F.col("label") - 1, F.lit(150)) + 1) == F.col("of"), "left").select("p_partkey", "label", "slot")


COLOURS = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(sinks.PALETTE))


@query("SELECT user_id, label, n_votes, n_semantic, coalesce(first_, 255)::INT AS first, coalesce(second_, 255)::INT AS second, coalesce(third_, 255)::INT AS third FROM won LEFT JOIN pal ON pal.slot = (label - 1) % 150 AND label > 0",
_VOTES + f", won AS (SELECT user_id, arg_max(label, (c, -label)) AS label, max(c) AS n_votes, sum(c)::BIGINT AS n_semantic FROM (SELECT user_id, label, count(*) AS c FROM votes WHERE label <> 0 GROUP BY ALL) GROUP BY user_id), pal(slot, first_, second_, third_) AS (VALUES {COLOURS})")
def semantic_colours(spark, sf_dir):
    """Users' majority labels with their palette colours."""
    return sinks.coloured(folds.majority(_votes(spark, sf_dir), "user_id", "label"), "label")


@query("SELECT event_id, (props ->> '$.k')::VARCHAR AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT o_orderkey AS mask_id, row, col FROM (SELECT o_orderkey, unnest(range(6, 6 + (o_orderkey % 9)::INT)) AS i FROM orders), LATERAL (SELECT (i % 5)::INT AS row, (i // 5)::INT AS col) WHERE i < 20")
def rle_decode(spark, sf_dir):
    """A mask for each order, as run-length text, decoded to pixels."""
    n = (F.col("o_orderkey") % 9).cast("int")
    masks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mask_id"), F.lit(5).alias("h"), F.lit(4).alias("w"), F.concat(F.lit("6"), F.chr(F.lit(48) + n)).alias("text"))
    return camera.mask_pixels(masks.withColumn("counts", camera.run_lengths("text")), ["mask_id"])


# -- exports --------------------------------------------------------------------------------------------------


@query(f"SELECT page, count(*) AS n, l_suppkey FROM (SELECT l_suppkey, floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1) / 100)::INT AS page FROM pts) GROUP BY ALL")
def page_export(spark, sf_dir):
    return sinks.with_pages(points(spark, sf_dir), ["l_suppkey"], POINT_KEY, 100).groupBy("l_suppkey", "page").agg(F.count("*").alias("n"))


@query("SELECT event_id, printf('%.6f %.6f %.6f', ts / 1e6, value, value / 3) AS line FROM ser")
def pose_log_format(spark, sf_dir):
    df = series(spark, sf_dir).withColumns({"t": F.col("ts") / 1e6, "third": F.col("value") / 3})
    return df.select("event_id", sinks.fixed_line(["t", "value", "third"]).alias("line"))


@query("SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts)::INT AS place FROM ser) WHERE place % 10 = 0")
def path_every_tenth(spark, sf_dir):
    return sinks.path_poses(series(spark, sf_dir), "user_id", "ts").select("user_id", "event_id", "place")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM ser) WHERE r <= 2")
def frame_retention(spark, sf_dir):
    return filters.first_n(series(spark, sf_dir), ["user_id"], [F.desc("ts")], 2).select("user_id", "event_id", "ts")


# -- estimation -----------------------------------------------------------------------------------------------


def _imu(spark, sf_dir) -> DataFrame:
    """An inertial series of each user: accelerations and turn rates derived from values."""
    e = F.col("event_id")
    return series(spark, sf_dir).select("user_id", (F.col("ts") / 1e12).alias("ts"), (F.col("value") / 1000).alias("ax"), ((e % 7) / 100).alias("ay"), F.lit(estimation.GRAVITY).alias("az"), F.lit(0.0).alias("gx"), F.lit(0.0).alias("gy"), ((e % 11 - 5) / 100).alias("gz"))


def _predicted() -> str:
    """SQL of the filter's steps: place, velocity and rotation, and the covariance F P F' with its noise on the diagonal.

    F by its formulas at zero biases and gravity straight up: the identity but for what is listed.
    """
    f = {(i, i): "1.0" for i in range(17)}
    f |= {(i, 6 + i): "dt" for i in range(3)} | {(3 + i, 12 + i): "-dt" for i in range(3)}
    cross = lambda v: [["0.0", f"-{v}[3]", f"{v}[2]"], [f"{v}[3]", "0.0", f"-{v}[1]"], [f"-{v}[2]", f"{v}[1]", "0.0"]]
    f |= {(3 + i, 3 + j): f"{'1.0' if i == j else '0.0'} - ({cross('m')[i][j]}) * dt" for i in range(3) for j in range(3)}
    f |= {(6 + i, 3 + j): "-(" + " + ".join(f"r[{i + 1}][{k + 1}] * ({cross('c')[k][j]})" for k in range(3)) + ") * dt" for i in range(3) for j in range(3)}
    f |= {(6 + i, 9 + j): f"-r[{i + 1}][{j + 1}] * dt" for i in range(3) for j in range(3)}
    f |= {(6, 16): "-9.81 * dt", (7, 15): "9.81 * dt"}
    rows = ", ".join("[" + ", ".join(f.get((i, j), "0.0") for j in range(17)) + "]" for i in range(17))
    noise = "[" + ", ".join(f"{n} * dt * dt" for n in ["0.0"] * 3 + ["0.1"] * 6 + ["0.0001"] * 6 + ["0.0"] * 2) + "]"
    start = [1.0] * 9 + [1e-3] * 3 + [1e-4] * 3 + [1e-5] * 2
    first = "[" + ", ".join("[" + ", ".join(str(v) if i == j else "0.0" for j in range(17)) + "]" for i, v in enumerate(start)) + "]::DOUBLE[][]"
    turned = ", ".join("[" + ", ".join(e) + "]" for e in (("1 - 2 * (q[3] * q[3] + q[4] * q[4])", "2 * (q[2] * q[3] - q[1] * q[4])", "2 * (q[2] * q[4] + q[1] * q[3])"), ("2 * (q[2] * q[3] + q[1] * q[4])", "1 - 2 * (q[2] * q[2] + q[4] * q[4])", "2 * (q[3] * q[4] - q[1] * q[2])"), ("2 * (q[2] * q[4] - q[1] * q[3])", "2 * (q[3] * q[4] + q[1] * q[2])", "1 - 2 * (q[2] * q[2] + q[3] * q[3])")))
    return f"""smp AS (SELECT user_id, ts / 1e12 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, [value / 1000, (event_id % 7) / 100, 9.81]::DOUBLE[] AS a, [0, 0, (event_id % 11 - 5) / 100]::DOUBLE[] AS w FROM ser),
roll AS (SELECT user_id, k, t, a, w, [0, 0, 0]::DOUBLE[] AS p, [0, 0, 0]::DOUBLE[] AS v, [1, 0, 0, 0]::DOUBLE[] AS q, {first} AS cov FROM smp WHERE k = 1
UNION ALL SELECT s.user_id, s.k, s.t, s.a, s.w, list_transform([1, 2, 3], lambda i: o.p[i] + o.v[i] * dt), list_transform([1, 2, 3], lambda i: o.v[i] + list_inner_product(r[i], c) * dt - CASE WHEN i = 3 THEN 9.81 ELSE 0 END * dt),
[q[1] * d[1] - q[2] * d[2] - q[3] * d[3] - q[4] * d[4], q[1] * d[2] + q[2] * d[1] + q[3] * d[4] - q[4] * d[3], q[1] * d[3] - q[2] * d[4] + q[3] * d[1] + q[4] * d[2], q[1] * d[4] + q[2] * d[3] - q[3] * d[2] + q[4] * d[1]],
list_transform(fp, lambda x, i: list_transform(f, lambda y, j: list_inner_product(x, y) + CASE WHEN i = j THEN noise[i] ELSE 0 END))
FROM roll o JOIN smp s ON s.user_id = o.user_id AND s.k = o.k + 1, LATERAL (SELECT s.t - o.t AS dt), LATERAL (SELECT list_transform([1, 2, 3], lambda i: (o.w[i] + s.w[i]) / 2) AS m, list_transform([1, 2, 3], lambda i: (o.a[i] + s.a[i]) / 2) AS c, [{turned}] AS r),
LATERAL (SELECT sqrt(list_inner_product(m, m)) * dt AS th), LATERAL (SELECT CASE WHEN th < 1e-4 THEN 0.5 ELSE sin(th / 2) / th END * dt AS half), LATERAL (SELECT [CASE WHEN th < 1e-4 THEN 1 ELSE cos(th / 2) END, m[1] * half, m[2] * half, m[3] * half] AS d),
LATERAL (SELECT [{rows}] AS f, {noise} AS noise), LATERAL (SELECT list_transform(f, lambda x: list_transform(o.cov, lambda y: list_inner_product(x, y))) AS fp))"""


@query("SELECT user_id, round(t, 6) AS ts, " + ", ".join(f"round({n}[{k}], 6) + 0.0 AS {n}{c}" for n in "pv" for k, c in enumerate("xyz", 1)) + ", round(list_sum(list_transform(range(1, 18), lambda i: cov[i][i])), 3) AS spread FROM roll", _predicted())
def eskf_trajectory(spark, sf_dir):
    """The inertial filter's prediction along each user's series."""
    out = estimation.trajectory(_imu(spark, sf_dir), "user_id")
    return out.select("user_id", r6("ts").alias("ts"), *((r6(f"{n}{c}") + 0.0).alias(f"{n}{c}") for n in "pv" for c in "xyz"), F.round("spread", 3).alias("spread"))


@query("""SELECT user_id, n, round(bz, 6) + 0.0 AS bz, round(mx * 9.81 / len, 6) + 0.0 AS gx, round(9.81 * 9.81 / len, 6) AS gz FROM (SELECT *, sqrt(mx * mx + my * my + 9.81 * 9.81) AS len FROM (SELECT user_id, count(*) AS n, avg(w) AS bz, avg(a) AS mx, avg(b) AS my, max(ts) / 1e6 - min(ts) / 1e6 AS seconds,
sum((w - mw) * (w - mw) * (k - 1) / k) / count(*) AS vw, sum((a - ma) * (a - ma) * (k - 1) / k) / count(*) AS va, sum((b - mb) * (b - mb) * (k - 1) / k) / count(*) AS vb
FROM (SELECT *, count(*) OVER run AS k, avg(w) OVER run AS mw, avg(a) OVER run AS ma, avg(b) OVER run AS mb FROM (SELECT user_id, ts, value / 1000 AS a, (event_id % 7) / 100 AS b, (event_id % 11 - 5) / 100 AS w FROM ser) WINDOW run AS (PARTITION BY user_id ORDER BY ts, a, b, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY user_id))
WHERE n + 1 > 10 AND seconds > 3 AND vw <= 0.5 AND sqrt(va * va + vb * vb) * (9.81 / len) * (9.81 / len) <= 0.6""")
def imu_init(spark, sf_dir):
    imu = _imu(spark, sf_dir).withColumn("ts", F.col("ts") * 1e6)
    return estimation.initial_bias(imu, "user_id").select("user_id", "n", (r6("bz") + 0.0).alias("bz"), (r6("gx") + 0.0).alias("gx"), r6("gz").alias("gz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, sf_dir):
    """Tumbling windows, an extension."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


from . import filter_queries, frame_queries, image_queries, sweep_queries  # noqa: E402, F401  register their queries here


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples aligned to sweeps, then each sweep's majority label."""
    swept = temporal.assign_sweeps(series(spark, sf_dir), triggers(spark, sf_dir)).filter("end_ts IS NOT NULL")
    votes = swept.select(F.struct("user_id", "end_ts").alias("sweep"), (F.col("event_id") % 5).cast("int").alias("label"))
    return folds.majority(votes, "sweep", "label").select("sweep.*", "label", "n_votes", "n_semantic")
