"""Registered queries on whole sweeps: vendor records, frame building, first guesses, map growth, rendering and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import camera, filters, folds, frames, temporal, voxel
from ..sources import sinks
from ..sources.tables import POINT_KEY, CloudConfig, normalise, points, series, table, triggers, vectors, with_clock_offset
from .queries import COLOURS, ID, ORDER, query, r6

KEY = POINT_KEY[:4]

# -- vendor records -------------------------------------------------------------------------------------------

#: lineitem as messages of a turning sensor: 50 orders each, ten a second.
SCAN = f"""scan AS (SELECT *, (row_number() OVER (PARTITION BY msg_id ORDER BY {ORDER}) - 1)::INT AS idx FROM (SELECT {ORDER}, l_orderkey // 50 AS msg_id, l_orderkey // 50 * 0.1::DOUBLE AS msg_ts,
l_quantity - 25 AS x, l_extendedprice / 1000 - 50 AS y, l_discount * 100 AS z, (l_linenumber - 1) % 4 AS ring, (l_partkey % 130)::DOUBLE AS ms, l_suppkey % 16 AS tag FROM lineitem))"""


def _scan(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("msg_id", F.floor(F.col("l_orderkey") / 50))
    df = df.withColumns({"msg_ts": F.col("msg_id") * 0.1, "x": F.col("l_quantity") - 25, "y": F.col("l_extendedprice") / 1000 - 50, "z": F.col("l_discount") * 100, "ring": (F.col("l_linenumber") - 1) % 4, "ms": (F.col("l_partkey") % 130).cast("double"), "tag": F.col("l_suppkey") % 16})
    return df.withColumn("idx", F.row_number().over(Window.partitionBy("msg_id").orderBy(*POINT_KEY)) - 1)


def _clouds(base: int = 0, late: bool = True, blind: bool = True) -> str:
    """SQL of normalise(): every second point in time order, later than the message before; `blind` ones within 10 go."""
    kept = f"""SELECT msg_id, idx, x, y, z, rel, msg_ts + rel / 1000 AS ts, before_s FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY rel, idx) - 1 + {base} AS k FROM rels)
LEFT JOIN (SELECT msg_id, lag(e) OVER (ORDER BY msg_id) AS before_s FROM (SELECT msg_id, max(msg_ts + rel / 1000) AS e FROM rels GROUP BY msg_id)) USING (msg_id) WHERE k % 2 = 0""" + (" AND x * x + y * y + z * z > 100" if blind else "")
    return f"SELECT msg_id, idx, round(ts, 6) AS ts, round(rel, 6) AS relative_ms FROM ({kept})" + (" WHERE before_s IS NULL OR ts > before_s" if late else "")


_TURNED = """rels AS (SELECT *, CASE WHEN yaw > yaw0 THEN (yaw0 - yaw + 360.0) / 3.61 ELSE (yaw0 - yaw) / 3.61 END AS rel FROM (SELECT *, first_value(yaw) OVER (PARTITION BY msg_id, ring ORDER BY idx) AS yaw0 FROM (SELECT *, degrees(atan2(y, x)) AS yaw FROM scan)))"""


def _normalised(raw: DataFrame, **cfg) -> DataFrame:
    return normalise(raw, CloudConfig(filter_num=2, blind=10.0, **cfg)).select("msg_id", F.col("point_id.idx").alias("idx"), r6("ts").alias("ts"), r6("relative_ms").alias("relative_ms"))


@query(_clouds(), f"{SCAN}, rels AS (SELECT *, ms + 1 AS rel FROM scan)")
def velodyne_timed(spark, sf_dir):
    return _normalised(_scan(spark, sf_dir).withColumn("time", (F.col("ms") + 1) / 1000), lidar_type="velodyne", time_unit="s")


@query(_clouds(blind=False), f"{SCAN}, {_TURNED}")
def ouster_untimed(spark, sf_dir):
    """Records without times: the angle turned gives them."""
    return _normalised(_scan(spark, sf_dir).withColumn("t", F.lit(0)), lidar_type="ouster", time_unit="ns")


@query(_clouds(), f"{SCAN}, rels AS (SELECT *, (msg_ts + (ms + 1) / 1000) * 1e3 - min((msg_ts + (ms + 1) / 1000) * 1e3) OVER (PARTITION BY msg_id) AS rel FROM scan)")
def robosense_absolute(spark, sf_dir):
    """Absolute times, which count from a message's first point."""
    return _normalised(_scan(spark, sf_dir).withColumn("timestamp", F.col("msg_ts") + (F.col("ms") + 1) / 1000), lidar_type="robosense", time_unit="s")


@query(_clouds(1, False), f"""{SCAN}, rels AS (SELECT *, ms AS rel FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM scan WINDOW w AS (PARTITION BY msg_id ORDER BY idx))
WHERE (abs(x - px) > 1e-7 OR abs(y - py) > 1e-7 OR abs(z - pz) > 1e-7) AND abs(y) <= 1e8 AND ring < 3 AND x > 0.7 AND NOT (x > 2.0 AND (tag & 3 <> 0 OR tag & 12 <> 0)))""")
def livox_points(spark, sf_dir):
    raw = _scan(spark, sf_dir).withColumns({"line": F.col("ring"), "offset_time": F.col("ms") * 1e6})
    return _normalised(raw, lidar_type="livox", time_unit="ns", n_scans=3)


@query("SELECT event_id, user_id, ts + CASE WHEN abs(o) > 0.1 THEN round(o * 1e6)::BIGINT ELSE 0 END AS ts FROM (SELECT *, (user_id % 5 - 2) * 0.08 AS o FROM ser)")
def clock_offset(spark, sf_dir):
    moved = with_clock_offset(series(spark, sf_dir), "ts", (F.col("user_id") % 5 - 2) * 0.08)
    return moved.select("event_id", "user_id", "ts")


@query(f"SELECT {ID}, round(x + 0.05, 6) AS bx, round(y + 0.0, 6) AS by, round(z - 0.055, 6) AS bz FROM pts")
def static_frame(spark, sf_dir):
    """Points in the body's frame: one fixed shift, no turn."""
    on_body = frames.applied((frames.constants(*frames.IDENTITY), frames.constants(0.05, 0.0, -0.055)), [F.col(c) for c in "xyz"])
    return points(spark, sf_dir).select(*KEY, *(r6(v).alias(f"b{c}") for c, v in zip("xyz", on_body, strict=True)))


@query("""SELECT t.user_id, t.end_ts FROM trg t JOIN (SELECT user_id, min(ts) AS oldest, max(ts) AS newest FROM ser GROUP BY user_id) s ON s.user_id = t.user_id WHERE t.end_ts > oldest AND t.end_ts < newest""")
def ready_triggers(spark, sf_dir):
    """Triggers that neither come before all samples nor wait for later ones."""
    return temporal.ready(triggers(spark, sf_dir), series(spark, sf_dir)).select("user_id", "end_ts")


# -- frames ---------------------------------------------------------------------------------------------------

MOUNT_TURN, MOUNT_SHIFT = 0.1, (0.3, -0.2, 0.1)
#: A frame's pose, for each frame: turn about z and shift.
TURN, DRIFT = 0.0020113, (0.01007131936241, -0.00503776821337, 0.00135711973541)


def _about_z(angle, shift) -> frames.Pose:
    half = angle / 2
    return [F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)], list(shift)


def _pose_of(number) -> frames.Pose:
    """A frame's pose: a slow turn and drift."""
    return _about_z(number * TURN, [number * d for d in DRIFT])


def _mount() -> frames.Pose:
    return _about_z(F.lit(MOUNT_TURN), frames.constants(*MOUNT_SHIFT))


def _turn_sql(angle: str, x: str, y: str) -> tuple[str, str]:
    return f"(cos({angle}) * ({x}) - sin({angle}) * ({y}))", f"(sin({angle}) * ({x}) + cos({angle}) * ({y}))"


def _apply_sql(angle: str, shift: tuple[str, str, str], p: tuple[str, str, str], names: str) -> str:
    x, y = _turn_sql(angle, p[0], p[1])
    return f"{x} + {shift[0]} AS {names}x, {y} + {shift[1]} AS {names}y, {p[2]} + {shift[2]} AS {names}z"


def _undo_sql(angle: str, shift: tuple[str, str, str], p: tuple[str, str, str], names: str) -> str:
    x, y = _turn_sql(f"-({angle})", f"{p[0]} - {shift[0]}", f"{p[1]} - {shift[1]}")
    return f"{x} AS {names}x, {y} AS {names}y, {p[2]} - {shift[2]} AS {names}z"


_MT, _MS = repr(MOUNT_TURN), tuple(f"({v!r})" for v in MOUNT_SHIFT)
_FRAME, _NEXT, _LATEST = (tuple(f"{n} * ({d!r})::DOUBLE" for d in DRIFT) for n in ("msg_id", "(msg_id + 1)", "f"))
BUILT = f"""{SCAN}, swept AS (SELECT *, msg_ts + ms / 1000 AS t, msg_ts + 0.1 AS end_s, trunc(x / CASE WHEN msg_id <= 2 THEN 1.0 ELSE 4.0 END)::INT AS kx, trunc(y / CASE WHEN msg_id <= 2 THEN 1.0 ELSE 4.0 END)::INT AS ky, trunc(z / CASE WHEN msg_id <= 2 THEN 1.0 ELSE 4.0 END)::INT AS kz FROM scan),
nudged AS (SELECT *, CASE WHEN abs(t - msg_ts) < 1e-6 THEN msg_ts + 1e-6 WHEN abs(t - end_s) < 1e-6 THEN end_s - 1e-6 ELSE t END AS tn FROM swept),
alphas AS (SELECT *, least(1.0, greatest(0.0, (tn - msg_ts) / (end_s - msg_ts))) AS al, CASE WHEN msg_id <= 2 THEN 1.0 WHEN (t - msg_ts) / (end_s - msg_ts) > 1 THEN 1 - 1e-5 ELSE (t - msg_ts) / (end_s - msg_ts) END AS alpha FROM nudged),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, kx, ky, kz ORDER BY md5('0/' || msg_id || '/' || idx), idx) AS place FROM alphas) WHERE place = 1),
mounted AS (SELECT *, {_apply_sql(_MT, _MS, ("x", "y", "z"), "m")} FROM chosen),
laid AS (SELECT *, {_apply_sql(f"(msg_id + al) * {TURN}", tuple(f"((1 - al) * ({a}) + al * ({b}))" for a, b in zip(_FRAME, _NEXT, strict=True)), ("mx", "my", "mz"), "i")} FROM mounted),
body AS (SELECT *, {_undo_sql(f"(msg_id + 1) * {TURN}", _NEXT, ("ix", "iy", "iz"), "o")} FROM laid),
seen AS (SELECT *, {_undo_sql(_MT, _MS, ("ox", "oy", "oz"), "s")} FROM body),
world AS (SELECT *, {_apply_sql("CASE WHEN msg_id <= 2 THEN 0 ELSE msg_id * 0.0020113 END", tuple(f"CASE WHEN msg_id <= 2 THEN 0 ELSE {s} END" for s in _FRAME), ("ox", "oy", "oz"), "w")} FROM seen)"""


@query("SELECT msg_id, idx, " + ", ".join(f"round({s}, 7) + 0.0 AS {n}" for s, n in (("alpha", "alpha"), ("sx", "x"), ("sy", "y"), ("sz", "z"), ("wx", "wx"), ("wy", "wy"), ("wz", "wz"))) + " FROM world", BUILT)
def build_frame(spark, sf_dir):
    """Whole sweeps from raw to world points: stamped, de-skewed, one point per cell, by the frame's state."""
    df = _scan(spark, sf_dir).select("msg_id", "idx", "x", "y", "z", (F.col("msg_ts") + F.col("ms") / 1000).alias("ts"), F.col("msg_ts").alias("begin_ts"), (F.col("msg_ts") + 0.1).alias("end_ts"))
    number = F.col("msg_id")
    early = number <= 2
    out = frames.build_frame(df, "msg_id", ["idx"], _pose_of(number), _pose_of(number + 1), _pose_of(number), _mount(), F.when(early, 1.0).otherwise(4.0), early)
    return out.select("msg_id", "idx", *((F.round(c, 7) + 0.0).alias(c) for c in ("alpha", "x", "y", "z", "wx", "wy", "wz")))


_STATES = """st AS (SELECT user_id, ts, value / 200 AS a, event_id % 13 / 10 AS v, event_id % 7 / 10 AS acc, event_id % 5 / 100 AS w FROM ser),
seg AS (SELECT *, lead(ts) OVER k AS seg_end, lead(acc) OVER k AS acc1, lead(w) OVER k AS w1 FROM st WINDOW k AS (PARTITION BY user_id ORDER BY ts)),
at_ AS (SELECT t.user_id, t.end_ts, s.*, (t.end_ts - s.ts) / 1e10 AS dt FROM (SELECT DISTINCT user_id, end_ts FROM trg) t JOIN seg s ON s.user_id = t.user_id AND t.end_ts >= s.ts AND t.end_ts < s.seg_end)"""


@query("SELECT user_id, end_ts AS ts, round(cos(a + w1 * dt) * 2 - sin(a + w1 * dt) * 3 + v * dt + 0.5 * acc1 * dt * dt, 4) + 0.0 AS wx, round(sin(a + w1 * dt) * 2 + cos(a + w1 * dt) * 3 - v * dt, 4) + 0.0 AS wy, 1.0::DOUBLE AS wz FROM at_", _STATES)
def deskew_inertial(spark, sf_dir):
    """A point at each trigger, laid out by its inertial segment: constant acceleration and turn since its start."""
    e = F.col("event_id")
    states = series(spark, sf_dir).select("user_id", "ts", (F.col("value") / 200).alias("a"), (e % 13 / 10).alias("v"), (e % 7 / 10).alias("acc"), (e % 5 / 100).alias("w"))
    moments = triggers(spark, sf_dir).distinct().withColumnRenamed("end_ts", "ts")
    met = frames.in_segments(moments, states, "user_id").withColumn("dt", (F.col("ts") - F.col("seg_start")) / 1e10)
    zero, v = F.lit(0.0), F.col("state.v")
    met, out = frames.deskewed_inertially(met, frames.constants(2, 3, 1), F.col("dt"), _about_z(F.col("state.a"), [zero] * 3), [v, -v, zero], [F.col("after.acc"), zero, zero], [zero, zero, F.col("after.w")])
    return met.select("user_id", "ts", *((F.round(c, 4) + 0.0).alias(f"w{n}") for n, c in zip("xyz", out, strict=True)))


@query("""SELECT event_id, user_id, round(CASE WHEN k <= 2 THEN 0 WHEN mode = 0 THEN value / 10 WHEN mode = 1 THEN x1 + cos(a1 - a2) * (x1 - x2) - sin(a1 - a2) * (y1 - y2) ELSE x1 END, 6) + 0.0 AS x,
round(CASE WHEN k <= 2 THEN 0 WHEN mode = 0 THEN y WHEN mode = 1 THEN y1 + sin(a1 - a2) * (x1 - x2) + cos(a1 - a2) * (y1 - y2) ELSE y1 END, 6) + 0.0 AS y,
round(sin(CASE WHEN k <= 2 THEN 0 WHEN mode = 0 THEN a WHEN mode = 1 THEN 2 * a1 - a2 ELSE a1 END / 2), 6) + 0.0 AS qz
FROM (SELECT *, row_number() OVER w AS k, user_id % 3 AS mode, lag(a) OVER w AS a1, lag(a, 2) OVER w AS a2, lag(value / 10) OVER w AS x1, lag(value / 10, 2) OVER w AS x2, lag(y) OVER w AS y1, lag(y, 2) OVER w AS y2
FROM (SELECT *, value / 200 AS a, (event_id % 10)::DOUBLE AS y FROM ser) WINDOW w AS (PARTITION BY user_id ORDER BY ts))""")
def initial_state(spark, sf_dir):
    """First guesses of poses by frame number: none, measured, predicted from the last two, or the last one."""
    a = F.col("value") / 200
    poses = series(spark, sf_dir).withColumns({"qw": F.cos(a / 2), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.sin(a / 2), "x": F.col("value") / 10, "y": (F.col("event_id") % 10).cast("double"), "z": F.lit(0.0)})
    parts = ["qw", "qx", "qy", "qz", "x", "y", "z"]
    mode = F.element_at(F.array(F.lit("measured"), F.lit("predicted"), F.lit("last")), (F.col("user_id") % 3 + 1).cast("int"))
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    guess = frames.initial_state(number, mode, parts, parts, "user_id", "ts")
    return poses.withColumns(guess).select("event_id", "user_id", *((r6(f"guess_{c}") + 0.0).alias(c) for c in ("x", "y", "qz")))


@query(f"SELECT msg_id, idx, (place - 1)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY md5('7/' || msg_id || '/' || idx), idx) AS place FROM scan WHERE abs(z - 5) < 4) WHERE (place - 1) % 2 = 0 AND place <= 40", SCAN)
def residual_cap(spark, sf_dir):
    """The first 20 of every second point of each frame's seeded shuffle that pass the gate."""
    near = _scan(spark, sf_dir).filter(F.abs(F.col("z") - 5) < 4)
    return frames.first_residuals(near, "msg_id", ["idx"], 20, 2, 7).select("msg_id", "idx", "place")


@query("SELECT label, count(*) AS n, round(avg(sqrt(x * x + y * y)), 6) AS mean_residual FROM vec GROUP BY label")
def mean_residual(spark, sf_dir):
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(norm)).alias("mean_residual"))


# -- map growth -----------------------------------------------------------------------------------------------

_PCELLS = "pc AS (SELECT *, l_orderkey // 500 AS frame, trunc(x / 2.0)::INT AS kx, trunc(y / 2.0)::INT AS ky, trunc(z / 2.0)::INT AS kz FROM pts)"


def _framed(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).withColumn("frame", F.floor(F.col("l_orderkey") / 500))


@query("""SELECT frame, count(*) AS n_visited, sum(CASE WHEN frame = first_ THEN 1 ELSE 0 END)::BIGINT AS n_new, greatest(0.001, least(5.0 / sum(CASE WHEN frame = first_ THEN 1 ELSE 0 END), 0.01)) AS weight
FROM (SELECT DISTINCT frame, kx, ky, kz, min(frame) OVER (PARTITION BY kx, ky, kz) AS first_ FROM pc) GROUP BY frame HAVING n_new > 0""", _PCELLS)
def new_voxels(spark, sf_dir):
    """Cells that each frame visits and finds, and the camera's measurement weight."""
    return frames.visited(_framed(spark, sf_dir), "frame", 2.0).filter("n_new > 0")


@query(f"SELECT kx, ky, kz, frame, {ID} FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY frame, {ORDER}) AS r FROM pc) WHERE r = 1", _PCELLS)
def sweep_added_points(spark, sf_dir):
    """What each sweep publishes: its points that are the first of their cells."""
    return frames.map_increment(_framed(spark, sf_dir), "frame", POINT_KEY, 2.0).select(*voxel.CELL, "frame", *KEY)


@query(f"SELECT frame, {ID} FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY frame, {ORDER}) AS room FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY {ORDER}) - 1 AS k FROM pc) WHERE k % 4 = 0) WHERE room <= 5", _PCELLS)
def colour_map_points(spark, sf_dir):
    """Every fourth point of a frame, while its cell has room for five."""
    return frames.colour_points(_framed(spark, sf_dir), "frame", POINT_KEY, 2.0, 5, 4).select("frame", *KEY)


_LABELLED = f"""pose AS (SELECT max(l_orderkey // 500) AS f FROM lineitem),
lab AS (SELECT l_partkey, arg_max(lb, (c, -lb)) AS label, sum(c)::BIGINT AS n_semantic FROM (SELECT l_partkey, (l_linenumber % 4)::INT AS lb, count(*) AS c FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY ALL) GROUP BY l_partkey),
cen AS (SELECT l_partkey, count(*) AS n_rgb, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY l_partkey)"""


def _labelled(spark, sf_dir) -> DataFrame:
    """Parts as map points with votes."""
    df = points(spark, sf_dir)
    votes = folds.majority(df.select("l_partkey", (F.col("l_linenumber") % 4).cast("int").alias("label")), "l_partkey", "label")
    centres = df.groupBy("l_partkey").agg(F.count("*").alias("n_rgb"), *(F.avg(c).alias(c) for c in "xyz"))
    return centres.join(votes, "l_partkey").filter("n_rgb >= 20 AND n_semantic > 0")


@query("SELECT l_partkey, label, round(sx, 4) AS x, round(sy, 4) AS y, round(sz, 4) AS z FROM (SELECT *, " + _undo_sql(_MT, _MS, ("ox", "oy", "oz"), "s") + " FROM (SELECT *, " + _undo_sql(f"f * {TURN}", _LATEST, ("x", "y", "z"), "o") + " FROM cen JOIN lab USING (l_partkey), pose WHERE n_rgb >= 20))", _LABELLED)
def labelled_cloud_in_sensor(spark, sf_dir):
    """The labelled map as the sensor of the latest frame sees it. That frame's pose is one row."""
    latest = _framed(spark, sf_dir).agg(F.max("frame").alias("f"))
    cloud = _labelled(spark, sf_dir).join(F.broadcast(latest))
    seen = frames.applied(frames.inverse(_mount()), frames.applied(frames.inverse(_pose_of(F.col("f"))), [F.col(c) for c in "xyz"]))
    return cloud.select("l_partkey", "label", *(F.round(v, 4).alias(c) for c, v in zip("xyz", seen, strict=True)))


@query("SELECT l_partkey, label, n_rgb, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, first_::INT AS first, second_::INT AS second, third_::INT AS third FROM cen JOIN lab USING (l_partkey) JOIN pal ON pal.slot = (label - 1) % 150 WHERE n_rgb >= 20",
_LABELLED + f", pal(slot, first_, second_, third_) AS (VALUES {COLOURS})")
def labelled_cloud(spark, sf_dir):
    """The labelled map in the world, with its labels' colours."""
    cloud = sinks.coloured(_labelled(spark, sf_dir))
    return cloud.select("l_partkey", "label", "n_rgb", *(F.round(c, 4).alias(c) for c in "xyz"), *sinks.CHANNELS)


@query(f"SELECT l_suppkey, page, count(*) AS n FROM (SELECT l_suppkey, floor((row_number() OVER (PARTITION BY l_suppkey ORDER BY {ORDER}) - 1) / floor(4.0::DOUBLE * pow(1.5::DOUBLE, steps)))::INT AS page FROM (SELECT *, greatest(0, floor(ln(count(*) OVER (PARTITION BY l_suppkey) / (4 * 44)) / ln(1.5::DOUBLE) - 1e-9) + 1) AS steps FROM pts)) GROUP BY ALL")
def page_export_grown(spark, sf_dir):
    """Pages of four points, grown until a supplier has fewer than 45."""
    return sinks.with_grown_pages(points(spark, sf_dir), ["l_suppkey"], POINT_KEY, 4).groupBy("l_suppkey", "page").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, ts, hour FROM (SELECT *, lag(hour) OVER (PARTITION BY user_id ORDER BY ts) AS before_ FROM (SELECT *, ts // 3600000000 AS hour FROM ser)) WHERE before_ IS NULL OR before_ <> hour")
def changed_frames(spark, sf_dir):
    """What a change-driven publisher sends: samples whose frame (their hour) is another than the last one's."""
    df = series(spark, sf_dir).withColumn("hour", F.floor(F.col("ts") / 3_600_000_000))
    return frames.changed(df, "user_id", "ts", "hour").select("event_id", "user_id", "ts", "hour")


@query("SELECT msg_id, idx, round(ms / 100, 6) AS alpha, ms AS relative_ms, x, y, z FROM (SELECT *, msg_id * 100000 + (ms * 1000)::BIGINT AS ts FROM scan) WHERE ts BETWEEN msg_id * 100000 AND (msg_id + 1) * 100000", SCAN)
def point_projection(spark, sf_dir):
    """Points of untimed clouds with their place in the sweep; those outside it are left out."""
    df = _scan(spark, sf_dir).withColumns({"ts": F.col("msg_id") * 100_000 + (F.col("ms") * 1000).cast("long"), "begin_ts": F.col("msg_id") * 100_000, "end_ts": (F.col("msg_id") + 1) * 100_000})
    return temporal.with_alpha(df, "begin_ts", "end_ts", clamp=False).select("msg_id", "idx", r6("alpha").alias("alpha"), "relative_ms", "x", "y", "z")


# -- images and masks -----------------------------------------------------------------------------------------

#: Four vectors make a raster of 16 by 16.
_WIDE = "wide AS (SELECT vec_id // 4 AS frame, (vec_id % 4 * 4 + (i - 1) // 16)::INT AS row, ((i - 1) % 16)::INT AS col, value FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings))"


def _wide(spark, sf_dir) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("i", "value"))
    return each.select(F.floor(F.col("vec_id") / 4).alias("frame"), (F.col("vec_id") % 4 * 4 + F.floor(F.col("i") / 16)).cast("int").alias("row"), (F.col("i") % 16).cast("int").alias("col"), "value")


@query("""SELECT vec_id, round(sum(CASE WHEN axis = 'x' THEN s END), 6) + 0.0 AS dx, round(sum(CASE WHEN axis = 'y' THEN s END), 6) + 0.0 AS dy FROM (
SELECT vec_id, axis, sign(k) * sum(CASE WHEN b = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN a = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * value) / 20 AS s
FROM (SELECT vec_id, vec_id // 4 AS frame, axis, k, 7.5 + 2 * x + CASE WHEN axis = 'x' THEN k ELSE 0 END AS u, 7.5 + 2 * y + CASE WHEN axis = 'y' THEN k ELSE 0 END AS v FROM vec, (VALUES ('x'), ('y')) d(axis), (VALUES (-4), (-3), (-2), (-1), (1), (2), (3), (4)) n(k)) q,
(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b), wide WHERE wide.frame = q.frame AND wide.row = floor(v)::INT + a AND wide.col = floor(u)::INT + b GROUP BY vec_id, axis, k HAVING count(*) = 4) GROUP BY vec_id HAVING count(*) = 16""", _WIDE)
def pixel_gradients(spark, sf_dir):
    places = vectors(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 4).alias("frame"), (7.5 + 2 * F.col("x")).alias("u"), (7.5 + 2 * F.col("y")).alias("v"))
    return camera.gradients(places, _wide(spark, sf_dir), "vec_id").select("vec_id", (r6("dx") + 0.0).alias("dx"), (r6("dy") + 0.0).alias("dy"))


@query(f"SELECT {ID}, round(0.299 * (l_partkey % 256) + 0.587 * (l_suppkey % 256) + 0.114 * (l_orderkey % 256))::INT AS grey FROM pts")
def greyscale(spark, sf_dir):
    return points(spark, sf_dir).select(*KEY, camera.grey([F.col(c) % 256 for c in ("l_partkey", "l_suppkey", "l_orderkey")]).alias("grey"))


@query(f"SELECT l_suppkey, count(*) AS n, count_if(l_linenumber % 3 <> 0) AS n_kept, round(sum(CASE WHEN l_linenumber % 3 <> 0 THEN y ELSE 0 END), 4) AS total FROM pts GROUP BY l_suppkey")
def compact_by_status(spark, sf_dir):
    """Values of lists whose status is set, and how many are."""
    lists = points(spark, sf_dir).groupBy("l_suppkey").agg(F.collect_list(F.struct("y", (F.col("l_linenumber") % 3 != 0).alias("status"))).alias("rows"))
    kept = filters.compacted(F.col("rows.y"), F.col("rows.status"))
    return lists.select("l_suppkey", F.size("rows").cast("long").alias("n"), F.size(kept).cast("long").alias("n_kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, y: a + y), 4).alias("total"))


_PLACED = f"""placed AS (SELECT *, l_orderkey // 500 AS frame, 400 * x / z + 320 AS u, 400 * y / z + 240 AS v FROM pts WHERE z >= 0.001),
trk AS (SELECT * FROM placed WHERE l_linenumber = 1), grid AS (SELECT DISTINCT frame, floor(u / 40)::INT AS gu, floor(v / 40)::INT AS gv FROM trk),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, gu, gv ORDER BY {ORDER}) AS r FROM (SELECT *, floor(u / 40)::INT AS gu, floor(v / 40)::INT AS gv FROM placed WHERE l_linenumber <> 1)
  WHERE (frame, gu, gv) NOT IN (SELECT (frame, gu, gv) FROM grid)) WHERE r = 1)"""


@query(f"SELECT frame, {ID} FROM (SELECT f.*, row_number() OVER (PARTITION BY f.frame ORDER BY {ORDER}) + coalesce(h.n, 0) AS place FROM fresh f LEFT JOIN (SELECT frame, count(*) AS n FROM trk GROUP BY frame) h ON h.frame = f.frame) WHERE place <= 300", _PLACED)
def track_candidates(spark, sf_dir):
    """Points to be tracked besides those that are: in cells of pixels without any, up to 300 in a frame."""
    placed = camera.project(_framed(spark, sf_dir), 400, 400, 320, 240)
    tracked, others = placed.filter("l_linenumber = 1"), placed.filter("l_linenumber <> 1").drop("depth")
    return camera.new_tracks(others, tracked, "frame", POINT_KEY, 40.0, 300).select("frame", *KEY)


_MESSAGES = "msk AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS ordinal, o_orderkey FROM orders)"


@query("SELECT o_custkey, ordinal, (o_orderkey % 6 + 1)::INT AS label, o_orderkey AS instance, least(o_orderkey % 9, 14) AS n_pixels FROM msk WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0", _MESSAGES)
def segmentation_source(spark, sf_dir):
    """A message of masks for each customer, as JSON text; masks that are empty or can't be read are skipped."""
    k = F.col("o_orderkey")
    counts = F.concat(F.lit("6"), F.chr(F.lit(48) + (k % 9).cast("int")))
    text = F.when(k % 7 == 0, F.lit("")).when(k % 11 == 0, F.lit('{"size":')).otherwise(F.concat(F.lit('{"size": [5, 4], "counts": "'), counts, F.lit('"}')))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct(k.alias("at"), text.alias("mask"), (k % 6).cast("int").alias("id")).alias("m"))
    messages = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list("m")).alias("m")).select("o_custkey", F.col("m.mask").alias("masks"), F.col("m.id").alias("ids"), F.col("m.at").alias("instances"))
    found = camera.segmentation(messages, ["o_custkey"])
    pixels = camera.mask_pixels(found, ["o_custkey", "ordinal"]).groupBy("o_custkey", "ordinal").agg(F.count("*").alias("n_pixels"))
    return found.join(pixels, ["o_custkey", "ordinal"], "left").select("o_custkey", "ordinal", "label", "instance", F.coalesce("n_pixels", F.lit(0)).cast("long").alias("n_pixels"))


# -- rendering ------------------------------------------------------------------------------------------------

#: Map points (vectors) seen by 12 frames each: a frame's raster is one vector, its mask the pixels over a level.
_SEEN = """obs0 AS (SELECT vec_id, k AS frame, 3.5 + 2 * x + 0.1 * k AS u, 3.5 + 2 * y - 0.05 * k AS v, 2 + z + 0.05 * ((k * 7) % 5) AS distance FROM vec, range(12) n(k)),
obs AS (SELECT o.vec_id, o.frame, any_value(distance) AS distance, sum(CASE WHEN b = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN a = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * (128 + 400 * value)) AS level, any_value(round(u)::INT) AS pc, any_value(round(v)::INT) AS pr
FROM obs0 o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) q(a, b), ras WHERE ras.frame = o.frame AND ras.row = floor(v)::INT + a AND ras.col = floor(u)::INT + b GROUP BY o.vec_id, o.frame HAVING count(*) = 4),
seq AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY frame) AS k FROM obs)"""
_FUSE = """fold AS (SELECT vec_id, k, floor(level + 0.5)::INT AS c, 15.0::DOUBLE AS s, distance AS best, frame::DOUBLE AS last, 1 AS n FROM seq WHERE k = 1 UNION ALL
SELECT q.vec_id, q.k, CASE WHEN far THEN f.c ELSE trunc(t2 * (f.c / (g * g) + q.level / 225.0))::INT END, CASE WHEN far THEN f.s ELSE sqrt(t2) END, CASE WHEN far THEN f.best ELSE least(f.best, q.distance) END, CASE WHEN far THEN f.last ELSE q.frame END, CASE WHEN far THEN f.n ELSE f.n + 1 END
FROM fold f JOIN seq q ON q.vec_id = f.vec_id AND q.k = f.k + 1, LATERAL (SELECT q.distance > 1.2 * f.best AS far, f.s + 0.1 * (q.frame - f.last) AS g), LATERAL (SELECT 1 / (1 / (g * g) + 1 / 225.0) AS t2))"""
_RENDER = """votes AS (SELECT s.vec_id, (m.frame % 3 + 1)::INT AS label FROM seq s JOIN ras m ON m.frame = s.frame AND m.row = s.pr AND m.col = s.pc WHERE m.value > 0)"""


@query("""SELECT f.vec_id, f.c AS colour, f.n AS n_rgb, round(f.best, 6) AS distance, v.label, coalesce(v.n_semantic, 0) AS n_semantic FROM (SELECT vec_id, arg_max(c, k) AS c, arg_max(n, k) AS n, arg_max(best, k) AS best FROM fold GROUP BY vec_id) f
LEFT JOIN (SELECT vec_id, arg_max(label, (c, -label)) AS label, sum(c)::BIGINT AS n_semantic FROM (SELECT vec_id, label, count(*) AS c FROM votes GROUP BY ALL) GROUP BY vec_id) v ON v.vec_id = f.vec_id WHERE f.n >= 3""",
"ras AS (SELECT vec_id AS frame, ((i - 1) // 8)::INT AS row, ((i - 1) % 8)::INT AS col, value FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings)), " + ", ".join((_SEEN, _FUSE, _RENDER)))
def render_points(spark, sf_dir):
    """Map points seen three times or more: colours sampled between pixels and fused in order, labels by masks and votes."""
    seen = vectors(spark, sf_dir).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<long>")))
    k = F.col("frame")
    seen = seen.select("vec_id", "frame", (3.5 + 2 * F.col("x") + 0.1 * k).alias("u"), (3.5 + 2 * F.col("y") - 0.05 * k).alias("v"), (2 + F.col("z") + 0.05 * (k * 7 % 5)).alias("distance"))
    raster = camera.pixels(table(spark, sf_dir, "embeddings").withColumn("image", F.transform("embedding", lambda x: x.cast("double"))), "vec_id", "image", 8)
    masks = raster.filter("value > 0").select("frame", "row", "col", (F.col("frame") % 3 + 1).cast("int").alias("label"))
    out = folds.rendered(seen, raster.withColumn("value", 128 + 400 * F.col("value")), masks, "vec_id")
    return out.filter("n_rgb >= 3").select("vec_id", F.col("r").alias("colour"), "n_rgb", r6("distance").alias("distance"), "label", "n_semantic")


# -- rotations ------------------------------------------------------------------------------------------------

_JAC = {"j00": "a + c * x * x", "j01": "c * x * y - b * z", "j02": "c * x * z + b * y", "j10": "c * x * y + b * z", "j11": "a + c * y * y", "j12": "c * y * z - b * x", "j20": "c * x * z - b * y", "j21": "c * y * z + b * x", "j22": "a + c * z * z"}


@query("SELECT vec_id, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in _JAC.items()) + " FROM (SELECT *, CASE WHEN t < 1e-4 THEN 1 ELSE sin(t) / t END AS a, CASE WHEN t < 1e-4 THEN 0.5 ELSE (1 - cos(t)) / (t * t) END AS b, CASE WHEN t < 1e-4 THEN 0 ELSE (1 - sin(t) / t) / (t * t) END AS c FROM (SELECT *, sqrt(x * x + y * y + z * z) AS t FROM vec))")
def so3_jacobian(spark, sf_dir):
    """The left Jacobian of each rotation vector."""
    parts = geometry.left_jacobian([F.col(c) for c in "xyz"])
    return vectors(spark, sf_dir).select("vec_id", *((r6(p) + 0.0).alias(f"j{k // 3}{k % 3}") for k, p in enumerate(parts)))


_ROT = {"00": "1 - 2 * (qy * qy + qz * qz)", "01": "2 * (qx * qy - qw * qz)", "02": "2 * (qx * qz + qw * qy)", "10": "2 * (qx * qy + qw * qz)", "11": "1 - 2 * (qx * qx + qz * qz)", "12": "2 * (qy * qz - qw * qx)", "20": "2 * (qx * qz - qw * qy)", "21": "2 * (qy * qz + qw * qx)", "22": "1 - 2 * (qx * qx + qy * qy)"}


@query("SELECT vec_id, " + ", ".join(f"round({e}, 6) + 0.0 AS r{n}" for n, e in _ROT.items()) + " FROM (SELECT vec_id, embedding[1] / s AS qw, embedding[2] / s AS qx, embedding[3] / s AS qy, embedding[4] / s AS qz FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding, sqrt(list_sum(list_transform(embedding[1:4]::DOUBLE[], lambda e: e * e))) AS s FROM embeddings) WHERE s > 0)")
def normalised_rotations(spark, sf_dir):
    """Rotation matrices of quaternions that aren't of unit length, from arrays of four."""
    parts = geometry.matrix_columns(geometry.unit(geometry.from_array(F.slice(F.transform("embedding", lambda e: e.cast("double")), 1, 4), 4)))
    df = table(spark, sf_dir, "embeddings").filter(F.exists(F.slice("embedding", 1, 4), lambda e: e != 0))
    return df.select("vec_id", *((r6(p) + 0.0).alias(f"r{k // 3}{k % 3}") for k, p in enumerate(parts)))

