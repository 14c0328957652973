"""Lenses, tiled equalisation and the colour map against plain loops."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import images, mapping


def _raster(spark, values: np.ndarray, frame: int = 1):
    kind = "int" if values.dtype.kind == "i" else "double"
    return spark.createDataFrame([(frame, r, c, values[r, c].item()) for r in range(values.shape[0]) for c in range(values.shape[1])], f"frame long, row int, col int, value {kind}")


def _plain_tiles(img: np.ndarray, down: int, across: int, clip: float) -> np.ndarray:
    rows, cols = img.shape
    whole = img if rows % down == 0 and cols % across == 0 else np.pad(img, ((0, down - rows % down), (0, across - cols % across)), "reflect")
    h, w = whole.shape[0] // down, whole.shape[1] // across
    total, limit = h * w, max(1, int(clip * h * w / 256))
    lut = np.zeros((down, across, 256), np.int64)
    for i in range(down):
        for j in range(across):
            n = np.bincount(whole[i * h : (i + 1) * h, j * w : (j + 1) * w].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            for k in range(rest):
                n[k * max(256 // rest, 1)] += 1
            lut[i, j] = np.minimum(255, (2 * 255 * np.cumsum(n) + total) // (2 * total))
    out = np.zeros_like(img)
    for r in range(rows):
        for c in range(cols):
            y, x = (2 * r - h) // (2 * h), (2 * c - w) // (2 * w)
            wy, wx = 2 * r - h - 2 * h * y, 2 * c - w - 2 * w * x
            s = sum(a * b * lut[min(max(t, 0), down - 1), min(max(u, 0), across - 1), img[r, c]] for t, a in ((y, 2 * h - wy), (y + 1, wy)) for u, b in ((x, 2 * w - wx), (x + 1, wx)))
            out[r, c] = (2 * s + 4 * total) // (8 * total)
    return out


@pytest.mark.parametrize(("shape", "tiles", "clip"), [((12, 15), (3, 5), 2.0), ((13, 17), (4, 4), 3.0), ((16, 18), (4, 4), 1.0), ((9, 9), (1, 1), 40.0)])
def test_tiled_equalisation(spark, shape, tiles, clip):
    rng = np.random.default_rng(3)
    img = np.clip(rng.normal(120, 20, shape), 0, 255).astype(np.int64)
    img[:4, :4] = 77  # a flat patch, which the clip cuts
    got = np.full(shape, -1)
    for r in images.tiled_equalised(_raster(spark, img), *shape, tiles, clip).collect():
        got[r.row, r.col] = r.level
    assert (got == _plain_tiles(img, *tiles, clip)).all()
    with pytest.raises(ValueError):
        images.tiled_equalised(_raster(spark, img), 2, 2, (9, 9), 1.0)


def test_lens_there_and_back(spark):
    lens = (-0.2, 0.05, 0.003, -0.002, 0.01)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(np.random.default_rng(1).uniform(-0.6, 0.6, (200, 2)))], "id int, x double, y double")
    x, y = images.distorted(F.col("x"), F.col("y"), lens)
    back = images.undistorted_places(df.select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), x.alias("x"), y.alias("y")), "x", "y", lens, 25)
    assert max(max(abs(r.x - r.x0), abs(r.y - r.y0)) for r in back.collect()) < 1e-6


def test_undistorted_raster(spark):
    """Without distortion the raster stays; with it each pixel is the plain blend, where outside counts as 0."""
    rng = np.random.default_rng(2)
    img, at = rng.uniform(0, 255, (10, 12)), (9.0, 9.0, 5.5, 4.5)
    for lens in ((0.0,) * 5, (0.4, 0.1, 0.01, -0.02, 0.0)):
        got = {(r.row, r.col): r.value for r in images.undistorted(_raster(spark, img), lens, at, 10, 12).collect()}
        wide = np.pad(img, 60)
        for r in range(10):
            for c in range(12):
                x, y = (c - 5.5) / 9, (r - 4.5) / 9
                q = x * x + y * y
                k = 1 + lens[0] * q + lens[1] * q * q + lens[4] * q**3
                u, v = 9 * (x * k + 2 * lens[2] * x * y + lens[3] * (q + 2 * x * x)) + 5.5, 9 * (y * k + lens[2] * (q + 2 * y * y) + 2 * lens[3] * x * y) + 4.5
                a, b = int(np.floor(v)) + 60, int(np.floor(u)) + 60
                dv, du = v - np.floor(v), u - np.floor(u)
                assert got[r, c] == pytest.approx((1 - dv) * ((1 - du) * wide[a, b] + du * wide[a, b + 1]) + dv * ((1 - du) * wide[a + 1, b] + du * wide[a + 1, b + 1]), abs=1e-9)
    assert len(got) == 120


def test_colours_come_back(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([tuple(map(int, x)) for x in [*rng.integers(0, 256, (200, 3)), (0, 0, 0), (255, 255, 255), (255, 0, 0)]], "r int, g int, b int")
    y, cr, cb = images.luma(*(F.col(c) for c in "rgb"))
    back = df.withColumns({"y": y}).withColumns({"cr": images.luma(F.col("r"), F.col("g"), F.col("b"))[1], "cb": cb})
    got = back.select("r", "g", "b", *(v.alias(f"{c}1") for c, v in zip("rgb", images.channels(F.col("y"), F.col("cr"), F.col("cb")), strict=True))).collect()
    assert max(abs(r[k] - r[k + 3]) for r in got for k in range(3)) <= 2


def _points(n: int = 600, seed: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(-3, 3, (n, 3))
    xyz[100:300] = rng.uniform(0.1, 0.9, (200, 3))  # a crowded cell
    return [(int(f), k, *map(float, p)) for k, (f, p) in enumerate(zip(np.sort(rng.integers(0, 12, n)), xyz, strict=True))]


def _replay(rows: list[tuple], step: int = 2):
    """Ordered insertion into a coarse and a fine grid; after each frame the last points of the cells it visited."""
    cells, fine, held, shown = {}, set(), [], {}
    for frame in sorted({r[0] for r in rows}):
        visited = {}
        for place, r in enumerate(sorted(x for x in rows if x[0] == frame)):
            if place % step:
                continue
            coarse, small = tuple(int(v / 1.0) for v in r[2:]), tuple(int(v / 0.4) for v in r[2:])
            inside = cells.setdefault(coarse, [])
            if len(inside) < 6:
                inside.append(r)
                held.append((r[1], small not in fine))
                fine.add(small)
            visited[coarse] = True
        shown[frame] = {cells[c][-1] for c in visited}
    return held, shown


def test_colour_map_equals_ordered_insertion(spark):
    rows = _points()
    df = spark.createDataFrame(rows, "frame long, id long, x double, y double, z double").repartition(4)
    held, shown = _replay(rows)
    stored = mapping.stored(df, "frame", ["id"], 1.0, 0.4, 6, 2)
    assert sorted((r.id, r.registered) for r in stored.collect()) == sorted(held)
    found = mapping.latest_of_visited(df, stored, "frame", ["id"], 1.0, 2)
    assert sorted((r.shown, r.id) for r in found.collect()) == sorted((f, r[1]) for f, x in shown.items() for r in x)


def test_projected_points_equal_a_replay(spark):
    """Frame by frame: range of depth, image, and the nearest of each grid cell, ties to the first."""
    rows = [*_points(), (3, 900, 0.5, 0.5, 2.0), (3, 901, 0.5, 0.5, 2.0)]
    df = spark.createDataFrame(rows, "shown long, id long, x double, y double, z double")
    eye = [0.0, 0.0, -4.0]
    got = mapping.projected(df, ["id"], [F.col("x"), F.col("y"), F.col("z") + 4], [F.lit(e) for e in eye], (50.0, 50.0, 40.0, 30.0), 80, 60, 10.0, 0.1, 6.0, 0.01)
    best = {}
    for f, k, x, y, z in sorted(rows, key=lambda r: r[1]):
        depth = float(np.sqrt(x * x + y * y + (z + 4) ** 2))
        if not 0.1 <= depth <= 6 or z + 4 < 1e-3:
            continue
        u, v = 50 * x / (z + 4) + 40, 50 * y / (z + 4) + 30
        if all(p >= 0.01 * n + 1 and np.ceil(p) < 0.99 * n for p, n in ((u, 80), (v, 60))):
            cell = (f, int(np.floor(u / 10 + 0.5)), int(np.floor(v / 10 + 0.5)))
            if cell not in best or depth < best[cell][0]:
                best[cell] = (depth, k)
    assert {(r.shown, r.gu, r.gv): r.id for r in got.collect()} == {c: k for c, (_, k) in best.items()} and len(best) > 50


def test_tiled_equalisation_shuffles_by_frame_alone(spark):
    import re

    grey = spark.range(2 * 36).selectExpr("id div 36 AS frame", "cast(id % 36 div 6 AS int) AS row", "cast(id % 6 AS int) AS col", "cast(id * 7 % 256 AS int) AS value")
    plan = images.tiled_equalised(grey, 6, 6, (2, 2), 2.0)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"frame#\d+L?", k) for k in keys)
