"""Registration of many sweeps against known poses."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.functions import geometry as G
from driftwell.operators import estimation, registration, voxel


@pytest.fixture(scope="module")
def walls():
    rng = np.random.default_rng(4)
    return np.concatenate([np.insert(rng.uniform(0, 4, (700, 2)), k, 0.0, axis=1) for k in range(3)]) + rng.normal(0, 1e-3, (2100, 3))


def _frame(spark, rows):
    return spark.createDataFrame(rows, "sweep long, id long, x double, y double, z double")


def test_fifty_sweeps_find_their_poses(spark, walls):
    rng, rows, poses, starts = np.random.default_rng(5), [], [], []
    for s in range(50):
        turn, shift = G.exp_matrix(rng.uniform(-0.02, 0.02, 3)), rng.uniform(-0.05, 0.05, 3)
        picked = walls[rng.choice(len(walls), 3 if s == 49 else 150, replace=False)]
        rows += [(s, k, *map(float, x)) for k, x in enumerate((picked - shift) @ turn)]
        poses.append((turn, shift))
        starts.append((s, s + 10, registration.packed(np.eye(3), np.zeros(3)), registration.starting_covariance(), [2.0, 2.0, 2.0]))
    rows += [(99, 0, 1.0, 1.0, 1.0)]  # of no known sweep
    starts.append((50, 60, registration.packed(np.eye(3), np.zeros(3)), registration.starting_covariance(), [2.0, 2.0, 2.0]))  # without points
    states = registration.started(spark.createDataFrame(starts, "sweep long, number long, pose array<double>, cov array<double>, last array<double>"))
    target = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(walls)], "id long, x double, y double, z double").cache()
    o = registration.Options(size=0.5, neighbours=8, least_neighbours=8, max_distance=0.5, small_shift=1e-4, small_degrees=1e-2, early_frames=20, rounds=8)
    got = {r.sweep: r for r in registration.register(_frame(spark, rows), target, states, o).collect()}
    assert sorted(got) == list(range(51))
    for s in range(49):
        r = got[s]
        assert r.status in ("converged", "stopped") and r.n_residuals >= 100
        assert np.allclose(np.array(r.pose[9:12]), poses[s][1], atol=5e-3) and np.allclose(np.array(r.pose[:9]).reshape(3, 3), poses[s][0], atol=5e-3)
        cov = np.array(r.cov).reshape(17, 17)
        assert np.trace(cov[:6, :6]) < 5e-3 and np.allclose(cov, cov.T, atol=1e-6)
    for s in (49, 50):
        assert got[s].status == "failed" and got[s].pose == starts[s][2] and got[s].rounds == 1
    assert {got[s].status for s in range(49)} == {"converged"}


def test_a_step_is_the_least_squares_step():
    """With a wide prior the step is Gauss and Newton's; with a narrow one the pose stays at the prior."""
    rng = np.random.default_rng(1)
    j, r = rng.standard_normal((40, 6)), rng.standard_normal(40) * 0.01
    pose = np.array(registration.packed(np.eye(3), np.zeros(3)))
    wide = registration.stepped(pose, pose, np.eye(17) * 1e6, j.T @ j, j.T @ r, 1e-3)[1]
    assert np.allclose(wide[:6], -np.linalg.lstsq(j, r, rcond=None)[0], atol=1e-6)
    away = np.array(registration.packed(G.exp_matrix(np.array([0.0, 0.0, 0.01])), np.array([0.1, 0, 0])))
    back = registration.stepped(away, pose, np.eye(17) * 1e-12, j.T @ j, j.T @ r, 1e-3)[0]
    assert np.allclose(back[:12], pose[:12], atol=1e-4)


def test_residuals_are_capped_in_order(spark, walls):
    target = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(walls)], "id long, x double, y double, z double")
    starts = [(s, 30, registration.packed(np.eye(3), np.zeros(3)), registration.starting_covariance(), [2.0, 2.0, 2.0]) for s in range(2)]
    states = registration.started(spark.createDataFrame(starts, "sweep long, number long, pose array<double>, cov array<double>, last array<double>"))
    points = _frame(spark, [(s, k, *map(float, x)) for s in range(2) for k, x in enumerate(walls[::20])])
    o = registration.Options(size=0.5, neighbours=8, least_neighbours=8, max_distance=0.5)
    rows = registration.residual_rows(registration.placed(points, states), target, o)
    every = sorted((r.sweep, r.point.id) for r in rows.collect())
    capped = registration.residual_rows(registration.placed(points, states), target, registration.Options(**(o.__dict__ | {"most_residuals": 7})))
    assert sorted((r.sweep, r.point.id) for r in capped.collect()) == [x for s in range(2) for x in [e for e in every if e[0] == s][:7]]


def test_a_still_start_shrinks_the_covariance(spark):
    cov = np.array(registration.starting_covariance()).reshape(17, 17)
    assert np.diag(cov).tolist() == [1.0] * 9 + [1e-3] * 3 + [1e-4] * 3 + [1e-5] * 2
    imu = spark.createDataFrame([(1, k * 0.5, 0.0, 0.0, 9.7, 0.01, 0.0, 0.0) for k in range(20)], "u long, ts double, ax double, ay double, az double, gx double, gy double, gz double")
    start = estimation.initial_bias(imu, "u").first()
    assert start.gz == pytest.approx(estimation.GRAVITY) and start.bx == pytest.approx(0.01)


def test_crowded_cells_are_split_without_loss(spark):
    rng = np.random.default_rng(8)
    hot = rng.uniform(0.1, 0.9, (700, 3))
    others = rng.uniform(-3, 3, (200, 3))
    where = np.concatenate([hot, others, hot[:5]])  # five places twice: ties go to the smaller id
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(where)], "id long, x double, y double, z double")
    queries = points.filter("id % 9 = 0 OR id < 5")
    plain = voxel.neighbours(queries, points, "id", "id", 1.0, 1, 6, crowd=None)
    split = voxel.neighbours(queries, points, "id", "id", 1.0, 1, 6, crowd=50)
    rows = sorted(split.select("query_id", "rank", "id", "d2").collect())
    assert rows == sorted(plain.select("query_id", "rank", "id", "d2").collect()) and len(rows) > 400
    few = voxel.neighbours(queries, points, "id", "id", 1.0, 1, 6, 8, 50)
    assert sorted(few.select("query_id", "id").collect()) == sorted(voxel.neighbours(queries, points, "id", "id", 1.0, 1, 6, 8, None).select("query_id", "id").collect())
    ids = np.arange(len(where))
    for q in (0, 9, 702):
        near = (np.abs(np.trunc(where).astype(int) - np.trunc(where[q]).astype(int)) <= 1).all(1)
        want = sorted((float(((where[i] - where[q]) ** 2).sum()), int(i)) for i in ids[near])[:6]
        assert [i for _, i in want] == [r.id for r in rows if r.query_id == q]


def test_initialisation_by_running_variances(spark):
    def variance(x):
        mean, var = 0.0, 0.0
        for k, v in enumerate(x, 1):
            mean += (v - mean) / k
            var = var * (k - 1) / k + (v - mean) ** 2 * (k - 1) / k**2
        return var

    rng = np.random.default_rng(2)
    rows, kept = [], set()
    for u in range(40):
        n = 10 + u % 3 - 1
        acc = np.array([0.4, 0.2, 4.9 if u % 2 else 9.8]) + rng.normal(0, 0.25 + u / 80, (n, 3))
        gyr = 0.02 + rng.normal(0, 0.1 + u / 60, (n, 3))
        scale = 9.81 / np.linalg.norm(acc.mean(0))
        noise = [np.linalg.norm([variance(x[:, k]) for k in range(3)]) for x in (gyr, acc)]
        if n >= 10 and noise[0] <= 0.5 and noise[1] * scale**2 <= 0.6:
            kept.add(u)
        rows += [(u, 0.4 * k, *map(float, acc[k]), *map(float, gyr[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "u long, ts double, ax double, ay double, az double, gx double, gy double, gz double")
    found = {r.u: r for r in estimation.initial_bias(df.repartition(5), "u").collect()}
    assert set(found) == kept and 5 < len(kept) < 26
    assert all(np.linalg.norm([r.gx, r.gy, r.gz]) == pytest.approx(9.81) for r in found.values())
    spread = np.diag(estimation.InertialFilter().cov)
    assert spread[0] == spread[8] == 1 and spread[9] == 1e-3 and spread[12] == 1e-4 and spread[16] == 1e-5


def test_copies_and_crowds_make_no_pairs(spark):
    """Neighbours by regions are those of brute force, ties by id; what is kept between regions stays small when points repeat."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.1, (300, 3)), rng.uniform(-3, 3, (150, 3)), np.round(rng.uniform(-1, 1, (150, 3)), 1), np.tile([[0.05, 0.05, 0.05]], (2000, 1))])
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "id long, x double, y double, z double")
    asked = df.filter("id < 600 or id % 500 = 0")
    got = {}
    for r in voxel.neighbours(asked, df, "id", "id", 0.5, 1, 5, crowd=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.d2))
    cells = np.trunc(x / 0.5)
    for q in [r.id for r in asked.select("id").collect()]:
        near = np.flatnonzero((np.abs(cells - cells[q]) <= 1).all(1))
        d2 = ((x[q] - x[near]) ** 2)[:, 0] + ((x[q] - x[near]) ** 2)[:, 1] + ((x[q] - x[near]) ** 2)[:, 2]
        best = np.lexsort((near, d2))[:5]
        assert got[q] == list(zip(near[best].tolist(), d2[best].tolist(), strict=True))
    plan = voxel.neighbours(df, df, "id", "id", 0.5, 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # cells aren't joined any more: that made a pair of each two points near each other
