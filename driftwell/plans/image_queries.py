"""Registered queries of the colour map's two grids, points for projection, lenses and tiled equalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import camera, filters, flow, images, mapping, voxel
from ..sources.scratch import shared_path
from ..sources.tables import POINT_KEY, points, series, table, vectors
from .frame_queries import _WIDE, _framed, _wide
from .queries import ID, ORDER, query

KEY = POINT_KEY[:4]

# -- the colour map -------------------------------------------------------------------------------------------

_STORED = f"""nth AS (SELECT * FROM (SELECT *, l_orderkey // 500 AS frame, row_number() OVER (PARTITION BY l_orderkey // 500 ORDER BY {ORDER}) - 1 AS k FROM pts) WHERE k % 4 = 0),
coarse AS (SELECT *, trunc(x / 4.0)::INT AS kx, trunc(y / 4.0)::INT AS ky, trunc(z / 4.0)::INT AS kz, trunc(x / 1.5)::INT AS fx, trunc(y / 1.5)::INT AS fy, trunc(z / 1.5)::INT AS fz FROM nth),
held AS (SELECT *, row_number() OVER (PARTITION BY fx, fy, fz ORDER BY frame, {ORDER}) = 1 AS registered FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY frame, {ORDER}) AS room FROM coarse) WHERE room <= 10)"""


def _stored(spark, sf_dir) -> DataFrame:
    return mapping.stored(_framed(spark, sf_dir), "frame", POINT_KEY, 4.0, 1.5, 10, 4)


@query(f"SELECT frame, {ID}, kx, ky, kz, registered FROM held", _STORED)
def colour_map_registered(spark, sf_dir):
    """What the colour map stores of every fourth point: ten in a coarse cell; the first in a fine cell is registered."""
    return _stored(spark, sf_dir).select("frame", *KEY, *voxel.CELL, "registered")


#: The camera of each frame, slowly moving along the first axis.
_SEEN = f"""vis AS (SELECT DISTINCT kx, ky, kz, frame AS shown FROM coarse),
cand AS (SELECT v.shown, h.*, row_number() OVER (PARTITION BY v.kx, v.ky, v.kz, v.shown ORDER BY h.frame DESC, {", ".join(f"h.{k} DESC" for k in POINT_KEY)}) AS place FROM vis v JOIN held h ON h.kx = v.kx AND h.ky = v.ky AND h.kz = v.kz AND h.frame <= v.shown),
cam AS (SELECT *, x - (20 + 0.01::DOUBLE * shown) AS px, y - 50.0 AS py, z + 4.0 AS pz FROM cand WHERE place = 1),
inside AS (SELECT *, sqrt(px * px + py * py + pz * pz) AS depth, 203.713791::DOUBLE * px / pz + 320 AS u, 198.317923::DOUBLE * py / pz + 240 AS v FROM cam WHERE pz >= 0.001)"""


@query(f"SELECT shown, gu, gv, {ID}, round(u, 3) AS u, round(v, 3) AS v FROM (SELECT *, row_number() OVER (PARTITION BY shown, gu, gv ORDER BY depth, frame, {ORDER}) AS r FROM (SELECT *, round(u / 10)::INT AS gu, round(v / 10)::INT AS gv FROM inside WHERE depth BETWEEN 0.1 AND 30 AND u >= 0.005 * 640 + 1 AND ceil(u) < 0.995 * 640 AND v >= 0.005 * 480 + 1 AND ceil(v) < 0.995 * 480)) WHERE r = 1", _STORED + ", " + _SEEN)
def projection_choice(spark, sf_dir):
    """Of each frame's visited cells the point taken last, and of those the nearest for each ten by ten pixels."""
    found = mapping.latest_of_visited(_framed(spark, sf_dir), _stored(spark, sf_dir), "frame", POINT_KEY, 4.0, 4)
    eye = [20 + 0.01 * F.col("shown"), F.lit(50.0), F.lit(-4.0)]
    world = [F.col(c) - e for c, e in zip("xyz", eye, strict=True)]
    out = mapping.projected(found, ["frame", *POINT_KEY], world, eye, (203.713791, 198.317923, 320.0, 240.0), 640, 480, 10.0, 0.1, 30.0)
    return out.select("shown", "gu", "gv", *KEY, F.round("u", 3).alias("u"), F.round("v", 3).alias("v"))


#: Frames' cameras see eight by eight pixels, the vector of that number in three shades.
_RECENT = f"""chan AS (SELECT vec_id AS frame, ((i - 1) // 8)::INT AS row, ((i - 1) % 8)::INT AS col, 128 + 400 * value AS r, 128 - 400 * value AS g, 128 + 200 * value AS b FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS value FROM embeddings)),
num AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS pid FROM held),
eyed AS (SELECT pid, v.shown, x - (20 + 0.01::DOUBLE * v.shown) AS px, y - 50.0::DOUBLE AS py, z + 4.0::DOUBLE AS pz FROM (SELECT DISTINCT kx, ky, kz, frame AS shown FROM coarse) v JOIN num h ON h.kx = v.kx AND h.ky = v.ky AND h.kz = v.kz AND h.frame <= v.shown),
placed AS (SELECT pid, shown, sqrt(px * px + py * py + pz * pz) AS distance, 2.5 * px / pz + 4 AS u, 2.5 * py / pz + 4 AS v FROM eyed WHERE pz >= 0.001),
taken AS (SELECT p.pid, p.shown, any_value(distance) AS distance, {", ".join(f"sum(CASE WHEN o.y = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * CASE WHEN o.x = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * c.{k}) AS {k}" for k in "rgb")} FROM placed p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(y, x) JOIN chan c ON c.frame = p.shown AND c.row = floor(v)::INT + o.y AND c.col = floor(u)::INT + o.x
WHERE u >= 0.005 * 8 + 1 AND ceil(u) < 0.995 * 8 AND v >= 0.005 * 8 + 1 AND ceil(v) < 0.995 * 8 GROUP BY p.pid, p.shown HAVING count(*) = 4),
turn AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY shown) AS k FROM taken),
blend AS (SELECT pid, k, {", ".join(f"floor({c} + 0.5)::INT AS {c}" for c in "rgb")}, 15.0::DOUBLE AS s, distance AS best, shown::DOUBLE AS last, 1 AS n FROM turn WHERE k = 1 UNION ALL
SELECT q.pid, q.k, {", ".join(f"CASE WHEN far THEN f.{c} ELSE trunc(t2 * (f.{c} / (g_ * g_) + q.{c} / 225.0))::INT END" for c in "rgb")}, CASE WHEN far THEN f.s ELSE sqrt(t2) END, CASE WHEN far THEN f.best ELSE least(f.best, q.distance) END, CASE WHEN far THEN f.last ELSE q.shown END, CASE WHEN far THEN f.n ELSE f.n + 1 END
FROM blend f JOIN turn q ON q.pid = f.pid AND q.k = f.k + 1, LATERAL (SELECT q.distance > 1.2 * f.best AS far, f.s + 0.1 * (q.shown - f.last) AS g_), LATERAL (SELECT 1 / (1 / (g_ * g_) + 1 / 225.0) AS t2))"""


@query(f"SELECT {ID}, e.r, e.g, e.b, e.n AS n_rgb, round(e.best, 6) AS distance FROM num JOIN (SELECT pid, {', '.join(f'arg_max({c}, k) AS {c}' for c in ('r', 'g', 'b', 'n', 'best'))} FROM blend GROUP BY pid) e USING (pid)", _STORED + ", " + _RECENT)
def render_recent_cells(spark, sf_dir):
    """The stored map, coloured by each frame in the cells that it visits; the map is read by regions of four cells."""
    path = shared_path(spark, "map")
    mapping.save_regions(_stored(spark, sf_dir).select("frame", *POINT_KEY, *"xyz", *voxel.CELL), path, 4)
    visits = mapping.visited_cells(_framed(spark, sf_dir), "frame", POINT_KEY, 4.0, 4)
    eye = [20 + 0.01 * F.col("shown"), F.lit(50.0), F.lit(-4.0)]
    world = [F.col(c) - e for c, e in zip("xyz", eye, strict=True)]
    shade = F.col("value")
    raster = camera.pixels(table(spark, sf_dir, "embeddings").withColumn("image", F.transform("embedding", lambda x: x.cast("double"))), "vec_id", "image", 8)
    raster = raster.select("frame", "row", "col", (128 + 400 * shade).alias("r"), (128 - 400 * shade).alias("g"), (128 + 200 * shade).alias("b"))
    held = mapping.regions_of(spark.read.parquet(path), visits, 4)
    out = mapping.rendered_recent(held, visits, raster, "frame", POINT_KEY, world, eye, (2.5, 2.5, 4.0, 4.0), 8, 8)
    return out.select(*KEY, *"rgb", "n_rgb", F.round("distance", 6).alias("distance"))


@query("""SELECT user_id, event_id FROM (SELECT *, min(CASE WHEN e > 2 * 5 OR (e > 5 AND before_ > 5) THEN ts END) OVER (PARTITION BY user_id) AS out_ FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY ts) AS before_ FROM (SELECT *, event_id % 13 AS e FROM ser))) WHERE out_ IS NULL OR ts < out_""")
def tracked_until_strikes(spark, sf_dir):
    """Features (users) until their error is over the limit twice running, or over twice the limit."""
    df = series(spark, sf_dir).withColumn("error", (F.col("event_id") % 13).cast("double"))
    return filters.strikes_below(df, ["user_id"], ["ts"], "error", 5.0).select("user_id", "event_id")


# -- lenses and colours ---------------------------------------------------------------------------------------

LENS = (-0.1, 0.03, 0.002, -0.001, 0.004)


def _distort_sql(x: str, y: str) -> tuple[str, str]:
    k1, k2, p1, p2, k3 = (f"({v!r}::DOUBLE)" for v in LENS)
    r2 = f"({x} * {x} + {y} * {y})"
    radial = f"(1 + {k1} * {r2} + {k2} * {r2} * {r2} + {k3} * {r2} * {r2} * {r2})"
    return f"({x} * {radial} + 2 * {p1} * {x} * {y} + {p2} * ({r2} + 2 * {x} * {x}))", f"({y} * {radial} + {p1} * ({r2} + 2 * {y} * {y}) + 2 * {p2} * {x} * {y})"


_DX, _DY = _distort_sql("tx", "ty")


@query("""SELECT t.frame, t.row, t.col, round(sum(CASE WHEN b = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE WHEN a = 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END * coalesce(w.value, 0)), 6) + 0.0 AS value
FROM taken t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b) LEFT JOIN wide w ON w.frame = t.frame AND w.row = floor(v)::INT + a AND w.col = floor(u)::INT + b GROUP BY t.frame, t.row, t.col""",
_WIDE + f", taken AS (SELECT frame, row, col, 12 * {_DX} + 7.5 AS u, 12 * {_DY} + 7.5 AS v FROM (SELECT frame, row, col, (col - 7.5) / 12 AS tx, (row - 7.5) / 12 AS ty FROM (SELECT DISTINCT frame FROM wide), (SELECT unnest(range(16))::INT AS row), (SELECT unnest(range(16))::INT AS col)))")
def undistorted_rasters(spark, sf_dir):
    """Rasters of four vectors each, as a lens without distortion would see them."""
    out = images.undistorted(_wide(spark, sf_dir), LENS, (12.0, 12.0, 7.5, 7.5), 16, 16)
    return out.select("frame", "row", "col", (F.round("value", 6) + 0.0).alias("value"))


@query("SELECT vec_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM vec")
def lens_round_trip(spark, sf_dir):
    """Places that the lens moved, found again."""
    x, y = images.distorted(F.col("x"), F.col("y"), LENS)
    moved = vectors(spark, sf_dir).select("vec_id", x.alias("x"), y.alias("y"))
    return images.undistorted_places(moved, "x", "y", LENS, 25).select("vec_id", *((F.round(c, 6) + 0.0).alias(c) for c in "xy"))


@query(f"""SELECT {ID}, least(255, greatest(0, l + floor((1403 * (cr - 128) + 500) / 1000)))::INT AS r, least(255, greatest(0, l + floor((-714 * (cr - 128) - 344 * (cb - 128) + 500) / 1000)))::INT AS g, least(255, greatest(0, l + floor((1773 * (cb - 128) + 500) / 1000)))::INT AS b, l::INT AS luma
FROM (SELECT *, floor((713 * (r0 - l) + 500) / 1000) + 128 AS cr, floor((564 * (b0 - l) + 500) / 1000) + 128 AS cb FROM (SELECT *, floor((299 * r0 + 587 * g0 + 114 * b0 + 500) / 1000) AS l FROM (SELECT *, l_partkey % 256 AS r0, l_suppkey * 37 % 256 AS g0, l_orderkey % 256 AS b0 FROM pts)))""")
def colour_round_trip(spark, sf_dir):
    """Colours as luma and colour differences, and back."""
    y, cr, cb = images.luma(*(F.col(c) for c in ("r0", "g0", "b0")))
    df = points(spark, sf_dir).withColumns({"r0": F.col("l_partkey") % 256, "g0": F.col("l_suppkey") * 37 % 256, "b0": F.col("l_orderkey") % 256})
    df = df.withColumn("luma", y).withColumns({"cr": cr, "cb": cb})
    return df.select(*KEY, *(v.alias(n) for v, n in zip(images.channels(F.col("luma"), F.col("cr"), F.col("cb")), "rgb", strict=True)), "luma")


#: 16 by 16 pixels in 3 by 5 tiles: continued to 18 by 20, tiles of 6 by 4.
_TILES = """q AS (SELECT frame, row, col, least(255, greatest(0, floor(128 + 300 * value)))::INT AS value FROM wide),
pad AS (SELECT frame, r // 6 AS ty, c // 4 AS tx, value FROM q, LATERAL (SELECT unnest(CASE WHEN 30 - row BETWEEN 16 AND 17 THEN [row, 30 - row] ELSE [row] END) AS r), LATERAL (SELECT unnest(CASE WHEN 30 - col BETWEEN 16 AND 19 THEN [col, 30 - col] ELSE [col] END) AS c)),
cnt AS (SELECT frame, ty, tx, value, count(*) AS n FROM pad GROUP BY ALL),
lev AS (SELECT t.frame, t.ty, t.tx, v.value, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT frame, ty, tx FROM pad) t CROSS JOIN (SELECT unnest(range(256))::INT AS value) v LEFT JOIN cnt c ON c.frame = t.frame AND c.ty = t.ty AND c.tx = t.tx AND c.value = v.value),
cut AS (SELECT *, sum(greatest(n - 1, 0)) OVER (PARTITION BY frame, ty, tx) AS over_ FROM lev),
lut AS (SELECT frame, ty, tx, value, least(255, (2 * 255 * sum(least(n, 1) + over_ // 256 + CASE WHEN over_ % 256 > 0 AND value % greatest(256 // greatest(over_ % 256, 1), 1) = 0 AND value // greatest(256 // greatest(over_ % 256, 1), 1) < over_ % 256 THEN 1 ELSE 0 END) OVER (PARTITION BY frame, ty, tx ORDER BY value) + 24) // 48) AS m FROM cut)"""


@query("""SELECT q.frame, q.row, q.col, ((2 * sum(a.w * b.w * m) + 96) // 192)::INT AS level FROM q, LATERAL (SELECT floor((2 * row - 6) / 12)::INT AS fy, floor((2 * col - 4) / 8)::INT AS fx), LATERAL (SELECT unnest([{'t': greatest(fy, 0), 'w': 12 - (2 * row - 6 - 12 * fy)}, {'t': least(fy + 1, 2), 'w': 2 * row - 6 - 12 * fy}]) AS a), LATERAL (SELECT unnest([{'t': greatest(fx, 0), 'w': 8 - (2 * col - 4 - 8 * fx)}, {'t': least(fx + 1, 4), 'w': 2 * col - 4 - 8 * fx}]) AS b)
JOIN lut ON lut.frame = q.frame AND lut.ty = a.t AND lut.tx = b.t AND lut.value = q.value GROUP BY q.frame, q.row, q.col""", _WIDE + ", " + _TILES)
def tiled_equalise(spark, sf_dir):
    """Tiled equalisation with a clip, of rasters whose sides the tiles don't divide."""
    grey = _wide(spark, sf_dir).withColumn("value", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 300 * F.col("value")))).cast("int"))
    return images.tiled_equalised(grey, 16, 16, (3, 5), 3.0).select("frame", "row", "col", "level")


# -- flow of features -----------------------------------------------------------------------------------------

#: Windows of five pixels on pictures of 16 by 16 and the level of 8 by 8 above them.
FLOW = flow.Options(window=5, levels=1, steps=3, least_square=0.0025)
_GREY = "least(255, greatest(0, floor(128 + 300 * value)))"


def _mirror_sql(place: str, n: int) -> str:
    return f"({n - 1} - abs({n - 1} - abs({place})))"


def _slopes_sql(level: int, n: int) -> str:
    """Pixels of a level with derivatives, mirrored at the edges."""
    return f"""sl{level} AS MATERIALIZED (SELECT t.frame, t.row, t.col, t.value, sum(o.b * CASE WHEN o.a = 0 THEN 10 ELSE 3 END * w.value) / 32 AS dx, sum(o.a * CASE WHEN o.b = 0 THEN 10 ELSE 3 END * w.value) / 32 AS dy
FROM lv{level} t CROSS JOIN three o JOIN lv{level} w ON w.frame = t.frame AND w.row = {_mirror_sql("t.row + o.a", n)} AND w.col = {_mirror_sql("t.col + o.b", n)} GROUP BY ALL)"""


def _corner_sql(u: str, v: str, more: str, source: str) -> str:
    return f"SELECT *, floor({u} - 2)::INT AS iu, floor({v} - 2)::INT AS iv, {u} - 2 - floor({u} - 2) AS fu, {v} - 2 - floor({v} - 2) AS fv{more} FROM {source}"


_SHARE = "CASE WHEN o.a = 1 THEN fv ELSE 1 - fv END * CASE WHEN o.b = 1 THEN fu ELSE 1 - fu END"


def _level_sql(level: int, n: int, start: str) -> list[str]:
    """A level's windows, sums of products, and steps one after the other; the last table is st{level}_{steps}."""
    row, col = _mirror_sql("f.iv + k + o.a", n), _mirror_sql("f.iu + i + o.b", n)
    reach = f"iu BETWEEN -5 AND {n - 1} AND iv BETWEEN -5 AND {n - 1}"
    lost = "still" if level else "lost"
    out = [
        f"""wi{level} AS MATERIALIZED (SELECT vec_id, k, i, sum({_SHARE} * w.value) AS value, sum({_SHARE} * coalesce(d.dx, 0)) AS gx, sum({_SHARE} * coalesce(d.dy, 0)) AS gy FROM ({_corner_sql(f"u / {2**level}", f"v / {2**level}", "", "feats")}) f CROSS JOIN five CROSS JOIN four o
JOIN sl{level} w ON w.frame = f.frame AND w.row = {row} AND w.col = {col} LEFT JOIN sl{level} d ON d.frame = f.frame AND d.row = f.iv + k + o.a AND d.col = f.iu + i + o.b WHERE {reach} GROUP BY ALL)""",
        f"su{level} AS (SELECT vec_id, sum(gx * gx) AS a, sum(gx * gy) AS b, sum(gy * gy) AS c, sum(value * gx) AS p0, sum(value * gy) AS q0 FROM wi{level} GROUP BY vec_id)",
        f"""st{level}_0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS su, 0.0::DOUBLE AS sv, CASE WHEN eigenvalue >= 1e-4 AND (a * c - b * b) / 1048576 >= power(2, -23) THEN 'moving' ELSE '{lost}' END AS status FROM (SELECT s.*, a, b, c, p0, q0, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 51200 AS eigenvalue FROM ({start}) s LEFT JOIN su{level} USING (vec_id)))""",
    ]
    for k in range(FLOW.steps):
        turning = "abs(du + su) < 0.01 AND abs(dv + sv) < 0.01" if k else "false"
        out += [
            f"at{level}_{k} AS MATERIALIZED (SELECT * EXCLUDE (status), CASE WHEN status = 'moving' AND NOT ({reach}) THEN '{lost}' ELSE status END AS status FROM ({_corner_sql('nu', 'nv', '', f'st{level}_{k}')}))",
            f"""me{level}_{k} AS (SELECT f.vec_id, sum({_SHARE} * w.value * gx) AS p, sum({_SHARE} * w.value * gy) AS q FROM at{level}_{k} f JOIN wi{level} USING (vec_id) CROSS JOIN four o JOIN sl{level} w ON w.frame = f.frame + 1 AND w.row = {row} AND w.col = {col} WHERE status = 'moving' GROUP BY f.vec_id)""",
            f"""st{level}_{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (nu, nv, su, sv, du, dv, short, turning, status, iu, iv, fu, fv), CASE WHEN status = 'moving' THEN nu + share * du ELSE nu END AS nu, CASE WHEN status = 'moving' THEN nv + share * dv ELSE nv END AS nv, du AS su, dv AS sv, CASE WHEN status = 'moving' AND (short OR turning) THEN 'still' ELSE status END AS status
FROM (SELECT *, CASE WHEN NOT short AND turning THEN 0.5 ELSE 1 END AS share FROM (SELECT *, du * du + dv * dv <= 0.0025 AS short, {turning} AS turning FROM (SELECT t.*, (b * (q - q0) - c * (p - p0)) / (a * c - b * b) AS du, (b * (p - p0) - a * (q - q0)) / (a * c - b * b) AS dv FROM at{level}_{k} t LEFT JOIN me{level}_{k} USING (vec_id)))))""".replace("EXCLUDE (nu,", "EXCLUDE (share, nu,"),
        ]
    return out


#: Each picture twice: as it is, and moved by half a pixel to the right and a quarter down.
_FLOW_SQL = ", ".join([
    _WIDE,
    f"gr AS MATERIALIZED (SELECT f.frame, r.row, c.col, coalesce({_GREY}, 0)::INT AS value FROM (SELECT DISTINCT frame FROM wide) f CROSS JOIN (SELECT unnest(range(16))::INT AS row) r CROSS JOIN (SELECT unnest(range(16))::INT AS col) c LEFT JOIN wide w ON w.frame = f.frame AND w.row = r.row AND w.col = c.col)",
    "two AS (SELECT unnest([0, 1]) AS e)",
    "three AS (SELECT unnest([-1, 0, 1]) AS a, b FROM (SELECT unnest([-1, 0, 1]) AS b))",
    "four AS (SELECT x.e AS a, y.e AS b FROM two x, two y)",
    "five AS (SELECT unnest(range(5))::INT AS k, i FROM (SELECT unnest(range(5))::INT AS i))",
    "taps AS (SELECT unnest([{'d': -2, 'w': 1}, {'d': -1, 'w': 4}, {'d': 0, 'w': 6}, {'d': 1, 'w': 4}, {'d': 2, 'w': 1}]) AS t)",
    """lv0 AS MATERIALIZED (SELECT 2 * frame AS frame, row, col, value::DOUBLE AS value FROM gr
UNION ALL SELECT 2 * g.frame + 1, g.row, g.col, (3 * (g.value + l.value) + u.value + x.value + 4) // 8 FROM gr g JOIN gr l ON l.frame = g.frame AND l.row = g.row AND l.col = greatest(g.col - 1, 0) JOIN gr u ON u.frame = g.frame AND u.row = greatest(g.row - 1, 0) AND u.col = g.col JOIN gr x ON x.frame = g.frame AND x.row = greatest(g.row - 1, 0) AND x.col = greatest(g.col - 1, 0))""",
    f"lv1 AS MATERIALIZED (SELECT frame, r AS row, c AS col, floor((sum(a.t.w * b.t.w * value) + 128) / 256) AS value FROM (SELECT unnest(range(8))::INT AS r, c FROM (SELECT unnest(range(8))::INT AS c)) CROSS JOIN taps a CROSS JOIN taps b JOIN lv0 w ON w.row = {_mirror_sql('2 * r + a.t.d', 16)} AND w.col = {_mirror_sql('2 * c + b.t.d', 16)} GROUP BY ALL)",
    _slopes_sql(0, 16), _slopes_sql(1, 8),
    "feats AS MATERIALIZED (SELECT 2 * (vec_id // 4) AS frame, vec_id, 8 + 40 * x AS u, 8 + 40 * y AS v FROM vec)",
    *_level_sql(1, 8, "SELECT frame, vec_id, u / 2 AS nu, v / 2 AS nv FROM feats"),
    *_level_sql(0, 16, f"SELECT frame, vec_id, nu * 2 AS nu, nv * 2 AS nv FROM st1_{FLOW.steps}"),
])


@query(f"SELECT vec_id, round(nu, 4) + 0.0 AS u, round(nv, 4) + 0.0 AS v, status <> 'lost' AS found, round(eigenvalue, 6) AS eigenvalue FROM st0_{FLOW.steps}", _FLOW_SQL)
def feature_flow(spark, sf_dir):
    """Features of each picture, found again on the picture moved by half and a quarter of a pixel, over two levels. What the
    last picture lacks of its four vectors is black."""
    wide = _wide(spark, sf_dir)
    grid = wide.select("frame").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(15))))
    grey = grid.join(wide, ["frame", "row", "col"], "left").withColumn("value", F.when(F.col("value").isNull(), 0).otherwise(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 300 * F.col("value"))))).cast("int"))
    #: A pixel tells itself and those to its right and below; those on the first row and column tell themselves twice.
    told = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in ((0, 0, 3), (0, 1, 3), (1, 0, 1), (1, 1, 1)))))
    to = lambda c, o: F.explode(F.when((F.col(c) == 0) & (o == 1), F.array(F.lit(0), F.lit(1))).when(F.col(c) + o < 16, F.array(F.col(c) + o)))
    parts = grey.withColumn("o", told).withColumn("to_row", to("row", F.col("o.a"))).withColumn("to_col", to("col", F.col("o.b")))
    moved = parts.groupBy("frame", F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.floor((F.sum(F.col("o.w") * F.col("value")) + 4) / 8).alias("value"))
    both = grey.select((2 * F.col("frame")).alias("frame"), "row", "col", F.col("value").cast("double")).unionByName(moved.select((2 * F.col("frame") + 1).alias("frame"), "row", "col", F.col("value").cast("double")))
    at = (2 * F.floor(F.col("vec_id") / 4)).alias("frame")
    features = vectors(spark, sf_dir).select(at, F.col("vec_id").alias("key"), (8 + 40 * F.col("x")).alias("u"), (8 + 40 * F.col("y")).alias("v")).withColumn("to", F.col("frame") + 1)
    out = flow.tracked(features, flow.pyramid(both, 16, 16, FLOW), 16, 16, FLOW)
    return out.select(F.col("key").alias("vec_id"), (F.round("u", 4) + 0.0).alias("u"), (F.round("v", 4) + 0.0).alias("v"), "found", F.round("eigenvalue", 6).alias("eigenvalue"))
