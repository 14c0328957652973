"""Operators whose results SQL can't say, against plain versions and known truths."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.functions import geometry as G
from driftwell.operators import camera, estimation, filters, folds, temporal, voxel
from driftwell.sources import sinks, tables


@given(st.lists(st.floats(-3, 3), min_size=3, max_size=3))
@settings(max_examples=50, deadline=None)
def test_exponential_and_logarithm(v):
    v = np.array(v)
    if np.linalg.norm(v) < 3.1:
        r = G.exp_matrix(v)
        assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
        assert np.allclose(G.log_matrix(r), v, atol=1e-5)


def test_rotation_columns(spark):
    rng = np.random.default_rng(0)
    rows = [tuple(map(float, (*rng.normal(size=3), *rng.normal(size=3), *rng.normal(size=3) * 0.5))) for _ in range(20)] + [(1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, a double, b double, c double, d double, e double, f double")
    p, v, w = ([F.col(c) for c in s] for s in ("xyz", "abc", "def"))
    q = G.exponential(v)
    both = G.quaternion_product(q, G.exponential(w))
    out = df.select(F.array(*G.rotate(q, p)).alias("turned"), F.array(*G.rotate(both, p)).alias("twice"), F.array(*G.logarithm(q)).alias("log"), F.array(*G.slerp(q, both, F.lit(1.0))).alias("end"), F.array(*both).alias("both"), G.angular_distance(q, both).alias("degrees")).collect()
    for row, r in zip(rows, out, strict=True):
        x, a, b = np.array(row[:3]), np.array(row[3:6]), np.array(row[6:])
        assert np.allclose(r.turned, G.exp_matrix(a) @ x)
        assert np.allclose(r.twice, G.exp_matrix(a) @ G.exp_matrix(b) @ x)
        if np.linalg.norm(a) < 3.1:
            assert np.allclose(r.log, a, atol=1e-6)
        assert np.allclose(np.abs(np.dot(r.end, r.both)), 1)
        assert r.degrees == pytest.approx(np.degrees(np.linalg.norm(b)), abs=1e-3)


def test_asof_meets_a_plain_search(spark):
    rng = np.random.default_rng(1)
    left = [(int(u), int(t), k) for k, (u, t) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 10_000, 300), strict=True))]
    right = sorted({(int(u), int(t)) for u, t in zip(rng.integers(0, 3, 40), rng.integers(0, 10_000, 40), strict=True)})
    a, b = spark.createDataFrame(left, "k long, ts long, id long"), spark.createDataFrame(right, "k long, rt long")
    for forward in (True, False):
        for strict in (True, False):
            got = {r.id: r.rt for r in temporal.asof(a, b, "k", "ts", "rt", forward, strict, bucket_us=1000).collect()}
            for u, t, k in left:
                fits = [x for v, x in right if v == u and ((x > t if strict else x >= t) if forward else (x < t if strict else x <= t))]
                assert got[k] == ((min if forward else max)(fits) if fits else None)


def test_spaced_insert(spark):
    rng = np.random.default_rng(2)
    rows = [(k, *map(float, p)) for k, p in enumerate(rng.uniform(-2, 2, (400, 3)))]
    got = voxel.insert_spaced(spark.createDataFrame(rows, "id long, x double, y double, z double"), 1.0, 8, 0.3, ["id"]).toPandas()
    assert got.groupby(voxel.CELL).size().max() <= 8
    for _, cell in got.groupby(voxel.CELL):
        p = cell[["x", "y", "z"]].to_numpy()
        d = np.linalg.norm(p[:, None] - p[None], axis=2)[np.triu_indices(len(p), 1)]
        assert not len(d) or d.min() > 0.3


def test_spaced_insert_equals_a_plain_ordered_one(spark):
    rng = np.random.default_rng(5)
    rows = [(0, 0.1, 0.1, 0.1), (1, 0.1, 0.59, 0.1), (2, 0.1, 0.8, 0.1)]
    rows += [(k, *map(float, p)) for k, p in enumerate(rng.uniform(-2, 2, (1500, 3)), 3)] + [(k, *map(float, p)) for k, p in enumerate(rng.uniform(2.1, 3.9, (1500, 3)), 2000)]
    taken: dict = {}
    for k, *p in rows:
        held = taken.setdefault(tuple(int(c / 2.0) for c in p), [])
        if len(held) < 20 and all(np.sum((np.array(p) - q) ** 2) > 0.25 for _, q in held):
            held.append((k, np.array(p)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # cells go on over batches
    try:
        got = voxel.insert_spaced(spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(3), 2.0, 20, 0.5, ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {0, 2} <= {r.id for r in got}
    assert sorted((r.id, (r.kx, r.ky, r.kz)) for r in got) == sorted((k, cell) for cell, held in taken.items() for k, _ in held)


def test_neighbours_equal_brute_force_around_zero(spark):
    rows = [(k, float(x) / 2, float(y) / 2, float(z) / 2) for k, (x, y, z) in enumerate((x, y, z) for x in range(-3, 4) for y in range(-3, 4) for z in (-1, 0, 1))]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {}
    for r in voxel.neighbours(df, df, "id", "id", 1.0, 1, 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    p = np.array([r[1:] for r in rows])
    cell = np.trunc(p).astype(int)
    for k in range(len(rows)):
        near = np.flatnonzero((np.abs(cell - cell[k]) <= 1).all(1))
        d = ((p[near] - p[k]) ** 2).sum(1)
        assert [i for _, i in sorted(got[k])] == near[np.lexsort((near, d))][:6].tolist()


def test_planes_of_flat_neighbourhoods(spark):
    rng = np.random.default_rng(3)
    rows = [(0, float(a), float(b), 0.25) for a, b in rng.uniform(-1, 1, (50, 2))]
    near = spark.createDataFrame(rows, "query_id long, nx double, ny double, nz double")
    r = voxel.planes(voxel.moments(near)).first()
    assert abs(r.normal_z) == pytest.approx(1) and r.a2d > 0.8


def test_planes_equal_an_eigensolver(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(200, 3, 3)) * rng.choice([1e-3, 1.0, 50.0], (200, 1, 3))
    sets = [m @ m.T for m in a] + [np.zeros((3, 3)), np.eye(3) * 4, np.diag([2.0, 0, 0]), np.diag([0, 3.0, 3.0]), np.outer([1, 2, 3.0], [1, 2, 3.0])]
    rows = [(k, *(float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))) for k, m in enumerate(sets)]
    got = {r.id: r for r in voxel.planes(spark.createDataFrame(rows, "id long, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")).collect()}
    for k, m in enumerate(sets):
        n, values = np.array([got[k].normal_x, got[k].normal_y, got[k].normal_z]), np.linalg.eigvalsh(m)
        assert np.linalg.norm(n) == pytest.approx(1) and n[np.abs(n).argmax()] > 0
        assert np.linalg.norm(m @ n - values[0] * n) <= 1e-6 * max(values[2], 1e-300)
        s = np.sqrt(np.abs(values))
        assert got[k].a2d == pytest.approx((s[1] - s[0]) / s[2] if s[2] else 0, abs=1e-4)  # eigenvalues under EQUAL of the largest are rounding
    assert [got[201].normal_x, got[201].normal_y, got[201].normal_z] == [0, 0, 1]  # all equal
    assert got[202].normal_x == 0 and got[202].normal_z == 1  # a line along x
    assert got[203].normal_x == pytest.approx(1)  # the two larger ones are equal


def test_a_plane_seen_from_both_sides(spark):
    """The gate is one-sided: a point far above a plane passes from below, and not from above."""
    cloud = spark.createDataFrame([(k, float(k % 5) / 5, float(k // 5) / 5, 0.0) for k in range(25)], "id long, x double, y double, z double")
    point = spark.createDataFrame([(0, 0.5, 0.5, 0.45)], "id long, x double, y double, z double")
    near = voxel.neighbours(point, cloud, "id", "id", 1.0, 1, 8)
    rows = lambda z: voxel.plane_residuals(point, near, voxel.planes(voxel.moments(near)), "id", 0.3, 8, [F.lit(0.0), F.lit(0.0), F.lit(z)]).collect()
    assert rows(5.0) == []
    below = rows(-5.0)
    assert below[0].distance == pytest.approx(-0.45) and below[0].j2 < 0


def test_untimed_clouds_keep_blind_points(spark):
    rows = [(1, 10.0, k, 0.1 if k == 1 else 3.0, 0.1 * k, 0.0, 0, t) for k in range(3) for t in (0,)] + [(2, 20.0, k, 0.1 if k == 1 else 3.0, 0.1 * k, 0.0, 0, 1_000_000 * (k + 1)) for k in range(3)]
    df = spark.createDataFrame(rows, "msg_id long, msg_ts double, idx int, x double, y double, z double, ring int, t long")
    got = tables.normalise(df, tables.CloudConfig("ouster", "ns", blind=1.0)).collect()
    assert sorted((r.msg_id, r.point_id.idx) for r in got) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 2)]


def test_greys_round_halves_up(spark):
    df = spark.createDataFrame([(0, 0, 250), (500, 0, 0), (255, 255, 255), (1, 2, 3)], "a long, b long, c long")
    assert [r[0] for r in df.select(camera.grey([F.col(c) for c in "abc"])).collect()] == [29, 150, 255, 2]


def test_registration_recovers_a_known_pose(spark):
    rng = np.random.default_rng(4)
    walls = [np.insert(rng.uniform(0, 4, (700, 2)), k, 0.0, axis=1) for k in range(3)]
    cloud = np.concatenate(walls) + rng.normal(0, 1e-3, (2100, 3))
    turn, shift = G.exp_matrix(np.array([0.01, -0.015, 0.02])), np.array([0.05, -0.04, 0.03])
    moved = (cloud[::10] - shift) @ turn  # so that turn @ moved + shift is the cloud
    frame = lambda p: spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double, z double")
    state, used = estimation.register(frame(moved), frame(cloud).cache(), 0.5, iterations=6)
    assert used > 100
    assert np.allclose(state.p, shift, atol=5e-3) and np.allclose(state.r, turn, atol=5e-3)


def test_inertial_filter_on_constant_motion(spark):
    rows = [(u, k * 0.01, 0.0, 0.0, estimation.GRAVITY, 0.0, 0.0, 0.0) for u in range(2) for k in range(200)]
    imu = spark.createDataFrame(rows, "u long, ts double, ax double, ay double, az double, gx double, gy double, gz double").repartition(5)
    got = estimation.trajectory(imu, "u").toPandas()
    assert len(got) == 400 and np.abs(got[["px", "vx", "vz"]].to_numpy()).max() < 1e-9
    assert (got.groupby("u")["spread"].last() > got.groupby("u")["spread"].first()).all()
    start = estimation.initial_bias(imu.withColumn("ts", F.col("ts") * 10), "u").first()
    assert start.gz == pytest.approx(estimation.GRAVITY) and start.bx == 0


def test_colours_fuse_by_order_then_line(spark, tmp_path):
    """Lines numbered 10 and up don't pass the next order's, and equal times go by order, then line."""
    from datetime import datetime

    from driftwell.plans import queries

    at = datetime(1995, 1, 1)
    rows = [(2, 1, 7, 1, 10.0, 20_000.0, 0.01, at), (1, 12, 7, 1, 20.0, 25_000.0, 0.02, at), (1, 3, 7, 1, 30.0, 22_000.0, 0.03, at)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert queries.color_fold(spark, str(tmp_path)).select("distance", "n_rgb").collect() == [(20.0, 3)]


def test_colour_fold_is_the_same_however_it_is_dealt(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k % 7), float(k // 7), k, *map(float, rng.uniform(0, 255, 3)), float(rng.uniform(1, 3))) for k in range(140)]
    df = spark.createDataFrame(rows, "point_id long, ts double, obs_id long, r double, g double, b double, distance double")
    got = sorted(map(tuple, folds.colour_fold(df.repartition(1)).collect()))
    assert got == sorted(map(tuple, folds.colour_fold(df.repartition(6)).collect()))
    state = ((0, 0, 0), (0.0,) * 3, 0.0, 0.0, 0)
    for r in df.filter("point_id = 3").orderBy("ts").collect():
        state, value = folds.colour_step(state, r)
    assert got[3] == (3, *value)


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_run_lengths_round_trip(counts):
    import pandas as pd

    assert camera.run_lengths.func(pd.Series([camera.encode_runs(counts)])).iloc[0] == counts


def test_mask_pixels_cut_what_runs_over(spark):
    df = spark.createDataFrame([(1, 2, 3, [1, 2, 1, 99]), (2, 2, 3, [6]), (3, 2, 3, [0, 6]), (4, 2, 3, [])], "id long, h int, w int, counts array<long>")
    got = {}
    for r in camera.mask_pixels(df, ["id"]).collect():
        got.setdefault(r.id, set()).add((r.row, r.col))
    assert got == {1: {(1, 0), (0, 1), (0, 2), (1, 2)}, 3: {(r, c) for r in range(2) for c in range(3)}}


def test_votes_ties_and_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 3), (1, 2), (2, 0), (3, 5), (3, 5), (3, 1)], "k long, label int")
    assert {r.k: (r.label, r.n_votes) for r in folds.majority(df, "k", "label").collect()} == {1: (2, 1), 3: (5, 2)}


def test_keyed_table(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, seq long, v string")
    assert {(r.k, r.v) for r in folds.insert_if_absent(df, ["k"], ["seq"]).collect()} == {(1, "a"), (2, "c")}
    last = folds.upsert(df, ["k"], ["seq"])
    assert {(r.k, r.v) for r in last.collect()} == {(1, "b"), (2, "c")}
    assert {r.k for r in folds.erase(last, df.filter("k = 1"), ["k"]).collect()} == {2}
    assert folds.same_rows(last, last.repartition(3)) and not folds.same_rows(last, df)


def test_livox_records(spark):
    rows = [(1, 10.0, 0, 3.0, 0.0, 0.0, 0, 0, 0), (1, 10.0, 1, 3.0, 0.0, 0.0, 0, 0, 1_000_000), (1, 10.0, 2, 3.5, 0.0, 0.0, 0, 1, 2_000_000), (1, 10.0, 3, 4.0, 0.0, 0.0, 0, 0, 3_000_000), (1, 10.0, 4, 5.0, 1.0, 0.0, 9, 0, 4_000_000), (1, 10.0, 5, 2e8, 1.0, 0.0, 0, 0, 5_000_000)]
    df = spark.createDataFrame(rows, "msg_id long, msg_ts double, idx int, x double, y double, z double, line int, tag int, offset_time long")
    got = tables.normalise(df, tables.CloudConfig.from_mapping({"a": {"lidar_type": "livox", "time_unit": "ns", "unknown": 1}})).collect()
    assert [(r.x, r.ts) for r in got] == [(4.0, 10.003)]


def test_strikes(spark):
    df = spark.createDataFrame([(1, k, e) for k, e in enumerate((0.0, 2.0, 0.0, 2.0, 2.0, 0.0))] + [(2, 0, 0.0), (2, 1, 9.0), (2, 2, 0.0)], "f long, t long, e double")
    got = sorted((r.f, r.t) for r in filters.strikes_below(df, ["f"], ["t"], "e", 1.0).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]


def test_logs_and_maps(spark, tmp_path):
    df = spark.createDataFrame([(1.5, -2.0, 0.25, 1, 2, 3, 2, 1), (0.0, 0.0, 0.0, 0, 0, 0, 1, 0)], "x double, y double, z double, r int, g int, b int, n_rgb int, n_semantic int")
    for _ in range(2):
        sinks.write_log(df.limit(1), ["x", "y", "z"], str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["1.500000 -2.000000 0.250000"] * 2
    sinks.write_map(df, str(tmp_path / "map"), 1, labelled=True)
    assert spark.read.parquet(str(tmp_path / "map")).count() == 1
    assert sinks.pcd_lines(df).first().value == "1.500000 -2.000000 0.250000 66051"
    found = sinks.coloured(spark.createDataFrame([(0,), (1,), (150,), (151,)], "label int")).collect()
    by = {r["label"]: tuple(r[c] for c in sinks.CHANNELS) for r in found}
    assert by == {0: sinks.WHITE, 1: (128, 128, 128), 150: (92, 0, 255), 151: (128, 128, 128)}


def test_run_lengths_of_many_texts_at_once():
    counts = [[5, 3, 2, 900, 1], [], [0, 0, 0, 7], [70_000]]
    texts = [camera.encode_runs(c) for c in counts]
    assert [x.tolist() for x in camera.decoded_runs(texts)] == counts
    # a number that a text breaks off is left out
    assert [x.tolist() for x in camera.decoded_runs([texts[0] + "P", "", texts[2]])] == [counts[0], [], counts[2]]
    assert camera.decoded_runs([]) == []


def test_spaced_insertion_takes_what_a_refused_point_would_hide(spark):
    """Points at 0, 0.45 and 0.55 in this order, at least 0.5 apart: the second is refused, the third is not."""
    rows = [(k, x, y, 0.1) for k, (x, y) in enumerate([(0.1, 0.0), (0.1, 0.45), (0.1, 0.55), (0.1, 1.2), (0.1, 0.58)])]
    found = voxel.insert_spaced(spark.createDataFrame(rows, "id long, x double, y double, z double"), 4.0, 20, 0.5, ["id"])
    assert sorted(r.id for r in found.collect()) == [0, 2, 3]


def test_rotation_columns_undo_each_other(spark):
    import numpy as np

    from driftwell.functions import geometry
    from driftwell.operators import frames

    pose = geometry.exponential(frames.constants(0.3, -0.2, 0.9)), frames.constants(1, 2, 3)
    there = frames.applied(pose, frames.constants(4, 5, 6))
    back = frames.applied(frames.inverse(pose), there)
    left, right = geometry.left_jacobian(frames.constants(0.3, -0.2, 0.9)), geometry.right_jacobian(frames.constants(0.3, -0.2, 0.9))
    got = spark.range(1).select(*(c.alias(f"b{k}") for k, c in enumerate(back)), *(c.alias(f"l{k}") for k, c in enumerate(left)), *(c.alias(f"r{k}") for k, c in enumerate(right))).first()
    assert np.allclose(got[:3], [4, 5, 6])
    # the left one is the right one, turned
    assert np.allclose(np.array(got[3:12]).reshape(3, 3), geometry.exp_matrix(np.array([0.3, -0.2, 0.9])) @ np.array(got[12:]).reshape(3, 3))


def test_arrays_of_another_size_fail(spark):
    from driftwell.functions import geometry

    df = spark.createDataFrame([([1.0, 2.0],)], "a array<double>")
    with pytest.raises(Exception, match="array of 3"):
        df.select(*geometry.from_array(F.col("a"), 3)).collect()


def test_settings_take_known_keys_and_say_what_they_ignore(spark):
    from driftwell.sources import settings

    values = {"common": {"point_filter_num": 4, "image_type": "PNG"}, "lidar_parameter": {"lidar_type": 3, "time_unit": 3, "blind": "4"}, "map_options": {"add_point_step": None}, "other": 1}
    found, ignored = settings.settings(values)
    assert len(found) == 64 and found["common/image_type"] == "RGB8" and found["odometry_options/voxel_size"] == 0.5
    assert ignored == ["common/image_type: PNG is not supported", "map_options/add_point_step: None is no int", "other: not known"]
    assert settings.cloud_config(found) == tables.CloudConfig("ouster", "ns", 16, 4.0, 4, 10.0)
    assert settings.as_frame(spark, found).filter("key = 'common/point_filter_num'").first().value == "4"


def test_sweeps_are_dumped_in_folders(spark, tmp_path):
    sinks.dump_sweeps(spark.range(10).withColumn("frame", F.col("id") % 3), "frame", f"{tmp_path}/sweeps")
    assert sorted(p.name for p in (tmp_path / "sweeps").glob("frame=*")) == ["frame=0", "frame=1", "frame=2"]


def test_trajectories_side_by_side_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for user in range(7):
        state, t = estimation.InertialFilter(), 0.0
        for _ in range(int(rng.integers(1, 25))):
            t += float(rng.uniform(0.001, 0.1))
            acc, gyr = rng.normal(0, 2, 3) + [0, 0, 9.8], rng.normal(0, 1, 3)
            rows.append((user, t, *map(float, acc), *map(float, gyr)))
            state.predict(t, acc, gyr)
            expected[user, t] = [*state.p, *state.v, np.trace(state.cov)]
    df = spark.createDataFrame(rows, "user_id long, ts double, ax double, ay double, az double, gx double, gy double, gz double").repartition(3)
    got = {(r.user_id, r.ts): [r.px, r.py, r.pz, r.vx, r.vy, r.vz, r.spread] for r in estimation.trajectory(df, "user_id").collect()}
    assert got.keys() == expected.keys()
    assert all(np.allclose(got[k], expected[k]) for k in got)
    assert estimation.trajectory(df.limit(0), "user_id").count() == 0
