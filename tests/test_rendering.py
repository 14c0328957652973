"""Colours of recently visited cells against a replay frame by frame, and what is read of the stored map."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import mapping

EYE = (0.0, 0.0, -2.0)
LENS = (6.0, 6.0, 5.5, 4.5)
ROWS, COLS = 10, 12


def _points() -> list[tuple]:
    rng = np.random.default_rng(5)
    return [(f, f * 100 + k, *(float(v) for v in rng.uniform((-4, -3, -3), (4, 3, 6)))) for f in range(1, 7) for k in range(40)]


def _between(img: np.ndarray, u: float, v: float) -> np.ndarray:
    i, j = math.floor(v), math.floor(u)
    a, b = v - i, u - j
    return (1 - a) * ((1 - b) * img[i, j] + b * img[i, j + 1]) + a * ((1 - b) * img[i + 1, j] + b * img[i + 1, j + 1])


def _replay(points: list[tuple], pictures: dict[int, np.ndarray], size: float, room: int) -> dict[int, tuple]:
    cells: dict[tuple, list] = {}
    colours: dict[int, tuple] = {}
    for frame in sorted({p[0] for p in points}):
        visited = set()
        for _, key, *xyz in sorted(p for p in points if p[0] == frame):
            cell = tuple(int(c / size) for c in xyz)
            visited.add(cell)
            if len(cells.setdefault(cell, [])) < room:
                cells[cell].append((key, xyz))
        for key, xyz in (p for c in visited for p in cells[c]):
            x, y, z = (c - e for c, e in zip(xyz, EYE, strict=True))
            if z < 1e-3 or frame not in pictures:
                continue
            u, v, far = LENS[0] * x / z + LENS[2], LENS[1] * y / z + LENS[3], math.sqrt(x * x + y * y + z * z)
            inside = all(w >= 0.005 * n + 1 and math.ceil(w) < 0.995 * n for w, n in ((u, COLS), (v, ROWS)))
            if not inside or math.floor(u) + 1 >= COLS or math.floor(v) + 1 >= ROWS:
                continue
            new = _between(pictures[frame], u, v)
            if key not in colours:
                colours[key] = ([int(c + 0.5) for c in new], 15.0, far, frame, 1)
                continue
            old, s, best, last, n = colours[key]
            if far > 1.2 * best:
                continue
            g = s + 0.1 * (frame - last)
            t2 = 1 / (1 / g**2 + 1 / 225)
            colours[key] = ([int(t2 * (o / g**2 + c / 225)) for o, c in zip(old, new, strict=True)], math.sqrt(t2), min(best, far), frame, n + 1)
    return colours


@pytest.fixture(scope="module")
def scene(spark):
    points = _points()
    rng = np.random.default_rng(6)
    pictures = {f: rng.uniform(0, 255, (ROWS, COLS, 3)) for f in (1, 2, 3, 4, 6)}  # frame 5 has no picture
    df = spark.createDataFrame(points, "frame long, id long, x double, y double, z double")
    rows = [(f, r, c, *(float(v) for v in img[r, c])) for f, img in pictures.items() for r in range(ROWS) for c in range(COLS)]
    return points, pictures, df, spark.createDataFrame(rows, "frame long, row int, col int, r double, g double, b double")


def _rendered(held, visits, rasters):
    eye = [F.lit(e) for e in EYE]
    return mapping.rendered_recent(held, visits, rasters, "frame", ["id"], [F.col(c) - e for c, e in zip("xyz", EYE, strict=True)], eye, LENS, COLS, ROWS)


def test_rendering_equals_a_replay(scene):
    points, pictures, df, rasters = scene
    held = mapping.stored(df, "frame", ["id"], 2.0, 0.5, 4)
    found = {r.id: r for r in _rendered(held, mapping.visited_cells(df, "frame", ["id"], 2.0), rasters).collect()}
    want = _replay(points, pictures, 2.0, 4)
    assert set(found) == set(want) and len(want) > 40 and max(w[4] for w in want.values()) > 2
    for key, (colour, _, best, _, n) in want.items():
        r = found[key]
        assert [r.r, r.g, r.b] == colour and r.n_rgb == n and r.distance == pytest.approx(best)


def test_only_regions_of_visited_cells_are_read(spark, scene, tmp_path):
    _, _, df, rasters = scene
    held = mapping.stored(df, "frame", ["id"], 2.0, 0.5, 4)
    mapping.save_regions(held.select("frame", "id", *"xyz", "kx", "ky", "kz"), str(tmp_path / "map"), 2)
    table = spark.read.parquet(str(tmp_path / "map"))
    assert table.count() == held.count()
    visits = mapping.visited_cells(df.filter("frame = 6 AND x > 2"), "frame", ["id"], 2.0)
    kept = mapping.regions_of(table, visits, 2)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [region" in plan
    files = kept.select(F.input_file_name()).distinct().count()
    assert 0 < files < table.select(F.input_file_name()).distinct().count()
    everything = sorted(_rendered(table, visits, rasters).collect())
    assert sorted(_rendered(kept, visits, rasters).collect()) == everything and everything
    assert mapping.regions_of(table, visits, 2, most=0).count() == table.count()  # too many to name: all is read
    assert mapping.regions_of(table, visits.limit(0), 2).count() == 0
