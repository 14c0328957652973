"""Rotation maps at their edges, the filter's corrections against plain ones, and point cloud files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import geometry
from driftwell.operators import estimation
from driftwell.sources import sinks


def _values(df, parts):
    return np.array(df.select(*(c.alias(f"c{k}") for k, c in enumerate(parts))).collect(), float)


def test_maps_near_nothing_and_both_signs(spark):
    rows = [(0.0, 0.0, 0.0), (1e-6, -2e-6, 3e-6), (0.3, -0.2, 0.9), (2.0, 2.0, -1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    v = [F.col(c) for c in "xyz"]
    q = geometry.exponential(v)
    back, other = _values(df, geometry.logarithm(q)), _values(df, geometry.logarithm([-c for c in q]))
    by_matrix = _values(df, geometry.rotation_vector(geometry.matrix_columns(q)))
    assert np.allclose(back, rows, atol=1e-9) and np.allclose(other, rows, atol=1e-9) and np.allclose(by_matrix, rows, atol=1e-7)
    left, inverse = _values(df, geometry.left_jacobian(v)).reshape(-1, 3, 3), _values(df, geometry.inverse_left_jacobian(v)).reshape(-1, 3, 3)
    right, right_inverse = _values(df, geometry.right_jacobian(v)).reshape(-1, 3, 3), _values(df, geometry.inverse_right_jacobian(v)).reshape(-1, 3, 3)
    # under the threshold the Jacobians are first order, so the products are only near the identity
    assert np.allclose(left @ inverse, np.eye(3), atol=1e-9) and np.allclose(right @ right_inverse, np.eye(3), atol=1e-9)


def test_bases_are_across_and_defined_at_the_poles(spark):
    rows = [(0.0, 0.0, 9.81), (0.0, 0.0, -9.81), (1.0, -2.0, 0.5), (3.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    g = np.array(rows)
    for parts in (geometry.sphere_basis, geometry.upright_basis):
        basis = _values(df, parts([F.col(c) for c in "xyz"])).reshape(-1, 3, 2)
        assert np.allclose(np.einsum("nij,nik->njk", basis, basis), np.eye(2), atol=1e-12)
        assert np.allclose(np.einsum("nij,ni->nj", basis, g), 0, atol=1e-12)
    f = estimation.InertialFilter()
    for row, basis in zip(g, _values(df, geometry.sphere_basis([F.col(c) for c in "xyz"])).reshape(-1, 3, 2), strict=True):
        f.g = row
        assert np.allclose(f.tangent(), basis)
    assert np.allclose(estimation._upright(g), _values(df, geometry.upright_basis([F.col(c) for c in "xyz"])).reshape(-1, 3, 2))


def _states(n: int) -> list[dict]:
    rng = np.random.default_rng(5)
    out = []
    for k in range(n):
        q = rng.normal(size=4)
        a = rng.normal(size=(17, 17))
        parts = {c: rng.normal(size=3) for c in ("p", "v", "ba", "bg")}
        turn = rng.normal(size=4)
        out.append({"id": k, "q": q / np.linalg.norm(q), "g": rng.normal(size=3) + [0, 0, 9], "d": rng.normal(size=17) * (0 if k == 0 else 0.3), "cov": (a @ a.T + np.eye(17)).ravel(), "place": rng.normal(size=3), "turn": turn / np.linalg.norm(turn), **parts})
    return out


def _frame(spark, states):
    names = list(states[0])
    rows = [tuple(s[n] if n == "id" else s[n].tolist() for n in names) for s in states]
    return spark.createDataFrame(rows, ", ".join(f"{n} long" if n == "id" else f"{n} array<double>" for n in names))


def test_corrections_equal_the_single_filter(spark):
    states = _states(20)
    got = {r.id: r for r in estimation.corrected(_frame(spark, states), "d").collect()}
    for s in states:
        f = estimation.InertialFilter()
        f.p, f.v, f.ba, f.bg, f.g, f.r = s["p"], s["v"], s["ba"], s["bg"], s["g"], geometry.matrix_of(s["q"])
        f.observe(s["d"])
        row = got[s["id"]]
        for name in ("p", "v", "ba", "bg", "g"):
            assert np.allclose(getattr(f, name), row[name], atol=1e-9)
        assert np.allclose(geometry.matrix_of(np.array(row["q"])), f.r, atol=1e-9)


def test_observed_poses_equal_a_plain_update(spark):
    states = _states(20)
    got = {r.id: r for r in estimation.observe_poses(_frame(spark, states), "place", "turn", (0.1, 0.2)).collect()}
    for s in states:
        r, cov = geometry.matrix_of(s["q"]), s["cov"].reshape(17, 17)
        v = geometry.log_matrix(r)
        t = np.linalg.norm(v)
        u = v / t
        h = np.zeros((6, 17))
        h[:3, :3] = np.eye(3)
        half = t / 2 / np.tan(t / 2)
        h[3:, 3:6] = half * np.eye(3) + (1 - half) * np.outer(u, u) + geometry.skew(v) / 2
        gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + np.diag([0.1] * 3 + [0.2] * 3))
        d = gain @ np.concatenate([s["place"] - s["p"], geometry.log_matrix(r.T @ geometry.matrix_of(s["turn"]))])
        carry = np.eye(17)
        carry[3:6, 3:6] -= geometry.skew(d[3:6]) / 2
        row = got[s["id"]]
        for name, at in (("p", 0), ("v", 6), ("ba", 9), ("bg", 12)):
            assert np.allclose(row[name], s[name] + d[at : at + 3], atol=1e-6)
        assert np.allclose(geometry.matrix_of(np.array(row["q"])), r @ geometry.exp_matrix(d[3:6]), atol=1e-6)
        assert np.allclose(row["g"], s["g"] + estimation._upright(s["g"][None])[0] @ d[15:], atol=1e-6)
        assert np.allclose(np.array(row["cov"]).reshape(17, 17), carry @ (np.eye(17) - gain @ h) @ cov @ carry.T, atol=1e-5)
    assert estimation.observe_poses(_frame(spark, states).limit(0), "place", "turn", (0.1, 0.2)).count() == 0


def test_clouds_are_read_back(spark, tmp_path):
    rows = [(k, k / 4, -k / 2, 0.25, k % 256, 255 - k % 256, 7) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, r int, g int, b int")
    path = f"file://{tmp_path}/map"
    sinks.write_clouds(df, path, ["id"], points_a_file=30)
    files = sorted((tmp_path / "map").glob("file=*/*.txt"))
    assert 1 < len(files) <= 4
    lines = files[0].read_text().splitlines()
    assert lines[0] == "VERSION 0.7" and lines[8] == f"POINTS {len(lines) - 10}" and lines[9] == "DATA ascii"
    found = sinks.read_clouds(spark, path, ["rgb", "x", "y", "z"])
    assert sorted(map(tuple, found.collect())) == sorted((float((r << 16) + (g << 8) + b), x, y, z) for _, x, y, z, r, g, b in rows)
    sinks.write_clouds(df.limit(0), f"file://{tmp_path}/none", ["id"])
    with pytest.raises(Exception, match="lacks a field"):
        sinks.read_clouds(spark, path, ["normal"]).collect()
    files[0].write_text("\n".join(lines[:-1]) + "\n")
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="points and holds"):
        sinks.read_clouds(spark, path, ["x"]).collect()
