"""Flow of features over a pyramid against a plain loop, and known shifts."""

from __future__ import annotations

import numpy as np
import pytest

from driftwell.operators import flow

ROWS, COLS = 60, 75
OPTIONS = flow.Options(window=9, levels=2, steps=8, least_square=0.0025)


def _texture(du: float, dv: float) -> np.ndarray:
    r, c = np.mgrid[0:ROWS, 0:COLS].astype(float)
    r, c = r - dv, c - du
    waves = 35 * np.sin(c / 5.1 + 0.4) * np.cos(r / 6.3) + 30 * np.sin((r + 0.6 * c) / 9.7) + 20 * np.cos((c - 0.8 * r) / 7.9 + 1)
    out = np.floor(128 + waves + 0.5)
    out[:, 60:] = 90.0  # without texture
    return out


def _pixels(spark, pictures: dict[int, np.ndarray]):
    rows = [(f, r, c, float(v[r, c])) for f, v in pictures.items() for r in range(v.shape[0]) for c in range(v.shape[1])]
    return spark.createDataFrame(rows, "frame long, row int, col int, value double")


def _smaller(img: np.ndarray) -> np.ndarray:
    w = np.array([1, 4, 6, 4, 1.0])
    p = np.pad(img, 2, "reflect")
    full = sum(w[a] * w[b] * p[a : a + img.shape[0], b : b + img.shape[1]] for a in range(5) for b in range(5))
    return np.floor((full[::2, ::2] + 128) / 256)


def _slopes(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, (h, w) = np.pad(img, 1, "reflect"), img.shape
    part = lambda a, b: p[a : a + h, b : b + w]
    side = (3, 10, 3)
    return sum(s * (part(a, 2) - part(a, 0)) for a, s in enumerate(side)) / 32, sum(s * (part(2, b) - part(0, b)) for b, s in enumerate(side)) / 32


def _window(img: np.ndarray, u: float, v: float, n: int, mirror: bool) -> np.ndarray:
    pad = n + 2
    p = np.pad(img, pad, "reflect") if mirror else np.pad(img, pad)
    x, y = u - (n - 1) / 2, v - (n - 1) / 2
    i, j = int(np.floor(y)), int(np.floor(x))
    a, b = y - i, x - j
    q = p[i + pad : i + pad + n + 1, j + pad : j + pad + n + 1]
    return (1 - a) * ((1 - b) * q[:-1, :-1] + b * q[:-1, 1:]) + a * ((1 - b) * q[1:, :-1] + b * q[1:, 1:])


def _plain(one: np.ndarray, two: np.ndarray, u: float, v: float, o: flow.Options) -> tuple[float, float, bool]:
    levels = [(one, two)]
    for _ in range(o.levels):
        levels.append((_smaller(levels[-1][0]), _smaller(levels[-1][1])))
    n = o.window
    x, y = u / 2**o.levels, v / 2**o.levels
    for level in range(o.levels, -1, -1):
        a, b = levels[level]
        near = lambda s, t, a=a: -n <= np.floor(s - (n - 1) / 2) < a.shape[1] and -n <= np.floor(t - (n - 1) / 2) < a.shape[0]
        found = False
        if near(u / 2**level, v / 2**level):
            place = (u / 2**level, v / 2**level, n)
            gx, gy = (_window(g, *place, False) for g in _slopes(a))
            img = _window(a, *place, True)
            m = np.array([[(gx * gx).sum(), (gx * gy).sum()], [(gx * gy).sum(), (gy * gy).sum()]]) / 1024
            if np.linalg.eigvalsh(m)[0] / n / n >= o.least_eigenvalue and np.linalg.det(m) >= 2.0**-23:
                found, before = True, None
                for _ in range(o.steps):
                    if not near(x, y):
                        found = False
                        break
                    d = _window(b, x, y, n, True) - img
                    step = -np.linalg.solve(m, np.array([(d * gx).sum(), (d * gy).sum()]) / 1024)
                    x, y = x + step[0], y + step[1]
                    if step @ step <= o.least_square:
                        break
                    if before is not None and (np.abs(step + before) < 0.01).all():
                        x, y = x - step[0] / 2, y - step[1] / 2
                        break
                    before = step
        if level:
            x, y = 2 * x, 2 * y
    return x, y, found


def test_shifts_of_pixels_are_recovered_as_by_a_plain_loop(spark):
    pictures = {1: _texture(0, 0), 2: _texture(5, -3), 3: _texture(6.5, -3.25)}
    levels = flow.pyramid(_pixels(spark, pictures), ROWS, COLS, OPTIONS)
    places = [(24.0, 20.0), (30.3, 33.8), (41.5, 25.2), (18.7, 44.1), (1.0, 2.0), (70.0, 30.0), (500.0, 20.0), (74.9, 59.9)]
    rows = [(a, a + 1, k, *p) for a in (1, 2) for k, p in enumerate(places)]
    features = spark.createDataFrame([*rows, (1, 2, 90, None, 4.0), (9, 10, 91, 20.0, 20.0), (3, 4, 92, 20.0, 20.0)], "frame long, to long, key int, u double, v double")
    found = {(r["frame"], r.key): r for r in flow.tracked(features, levels, ROWS, COLS, OPTIONS).collect()}
    assert len(found) == len(rows) + 3
    for a, b, k, u, v in rows:
        x, y, kept = _plain(pictures[a], pictures[b], u, v, OPTIONS)
        r = found[a, k]
        assert (r.u, r.v) == (pytest.approx(x, abs=1e-6), pytest.approx(y, abs=1e-6)) and r.found == kept, (a, k)
    for a, shift in ((1, (5, -3)), (2, (1.5, -0.25))):
        for k in range(4):
            r = found[a, k]
            assert r.found and abs(r.u - places[k][0] - shift[0]) < 0.1 and abs(r.v - places[k][1] - shift[1]) < 0.1
        assert not found[a, 5].found and not found[a, 6].found  # no texture, out of reach
        assert found[a, 6].eigenvalue is None
    assert not found[1, 90].found and found[1, 90].u is None
    assert not found[9, 91].found and not found[3, 92].found and found[9, 91].u == 20.0


def test_levels_equal_plain_ones(spark):
    for shape in ((11, 14), (12, 13)):
        img = np.floor(np.random.default_rng(3).random(shape) * 256)
        levels = flow.pyramid(_pixels(spark, {7: img}), *shape, flow.Options(window=5, levels=3))
        assert len(levels) == 2
        want = img
        for level in levels:
            rows = {r["row"]: r for r in level.collect()}
            dx, dy = _slopes(want)
            assert np.array_equal([rows[k].line for k in sorted(rows)], want)
            assert np.allclose([rows[k].dx for k in sorted(rows)], dx) and np.allclose([rows[k].dy for k in sorted(rows)], dy)
            want = _smaller(want)


def test_pictures_must_be_whole_and_larger_than_the_window(spark):
    raster = _pixels(spark, {1: np.ones((8, 9))})
    with pytest.raises(ValueError):
        flow.pyramid(raster, 8, 9, flow.Options(window=9))
    with pytest.raises(Exception, match="missing or repeated pixels"):
        flow.pyramid(raster.filter("NOT (row = 3 AND col = 3)"), 8, 9, flow.Options(window=5))
    with pytest.raises(Exception, match="missing or repeated pixels"):
        flow.pyramid(raster.filter("row <> 7"), 8, 9, flow.Options(window=5))


def test_no_features_and_no_pictures(spark):
    o = flow.Options(window=5, levels=1, steps=2)
    raster = _pixels(spark, {1: np.ones((8, 9))})
    none = spark.createDataFrame([], "frame long, to long, key int, u double, v double")
    assert flow.tracked(none, flow.pyramid(raster, 8, 9, o), 8, 9, o).count() == 0
    one = spark.createDataFrame([(1, 2, 0, 4.0, 4.0)], none.schema)
    assert [r.found for r in flow.tracked(one, flow.pyramid(raster.limit(0), 8, 9, o), 8, 9, o).collect()] == [False]


def test_the_query_completes_its_last_picture(spark, sf_dir, tmp_path):
    import duckdb

    from driftwell.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id < 14) TO '{tmp_path}/embeddings.parquet'")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES["feature_flow"](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL["feature_flow"])
    order = [want.columns.index(c) for c in df.columns]
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(tuple(r[k] for k in order) for r in want.fetchall()) and len(got) == 14
