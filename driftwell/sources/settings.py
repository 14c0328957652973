"""The configuration: nested keys with defaults, as a mapping, a table and the operators' own settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import CloudConfig

#: Every key with its default.
DEFAULTS: dict[str, object] = {
    "common/lidar_topic": "/points_raw",
    "common/imu_topic": "/imu_raw",
    "common/image_topic": "/image_raw",
    "common/segmentation_topic": "/segmentations",
    "common/image_type": "RGB8",
    "common/point_filter_num": 1,
    "common/gravity_acc": [],
    "debug_output": False,
    "output_path": "",
    "lidar_parameter/lidar_type": 1,
    "lidar_parameter/N_SCANS": 16,
    "lidar_parameter/SCAN_RATE": 10,
    "lidar_parameter/time_unit": 2,
    "lidar_parameter/blind": 0.01,
    "lidar_parameter/det_range": 300.0,
    "lidar_parameter/fov_degree": 180.0,
    "imu_parameter/acc_cov": 0.1,
    "imu_parameter/gyr_cov": 0.1,
    "imu_parameter/b_acc_cov": 0.0001,
    "imu_parameter/b_gyr_cov": 0.0001,
    "imu_parameter/time_diff_enable": False,
    "camera_parameter/image_width": 640,
    "camera_parameter/image_height": 480,
    "camera_parameter/camera_intrinsic": [],
    "camera_parameter/camera_dist_coeffs": [],
    "extrinsic_parameter/extrinsic_enable": True,
    "extrinsic_parameter/extrinsic_t_imu_lidar": [],
    "extrinsic_parameter/extrinsic_R_imu_lidar": [],
    "extrinsic_parameter/extrinsic_t_imu_camera": [],
    "extrinsic_parameter/extrinsic_R_imu_camera": [],
    "odometry_options/init_voxel_size": 0.2,
    "odometry_options/init_sample_voxel_size": 1.0,
    "odometry_options/init_num_frames": 20,
    "odometry_options/voxel_size": 0.5,
    "odometry_options/sample_voxel_size": 1.5,
    "odometry_options/max_distance": 100.0,
    "odometry_options/max_num_points_in_voxel": 20,
    "odometry_options/min_distance_points": 0.1,
    "odometry_options/distance_error_threshold": 5.0,
    "odometry_options/motion_compensation": "CONSTANT_VELOCITY",
    "odometry_options/initialization": "INIT_IMU",
    "icp_options/threshold_voxel_occupancy": 1,
    "icp_options/size_voxel_map": 1.0,
    "icp_options/num_iters_icp": 5,
    "icp_options/min_number_neighbors": 20,
    "icp_options/voxel_neighborhood": 1,
    "icp_options/power_planarity": 2.0,
    "icp_options/estimate_normal_from_neighborhood": True,
    "icp_options/max_number_neighbors": 20,
    "icp_options/max_dist_to_plane_icp": 0.3,
    "icp_options/threshold_orientation_norm": 0.0001,
    "icp_options/threshold_translation_norm": 0.001,
    "icp_options/max_num_residuals": -1,
    "icp_options/min_num_residuals": 100,
    "icp_options/num_closest_neighbors": 1,
    "icp_options/weight_alpha": 0.9,
    "icp_options/weight_neighborhood": 0.1,
    "icp_options/debug_print": True,
    "icp_options/debug_viz": False,
    "map_options/size_voxel_map": 0.1,
    "map_options/max_num_points_in_voxel": 20,
    "map_options/min_distance_points": 0.01,
    "map_options/add_point_step": 4,
    "map_options/pub_point_minimum_views": 3,
}
#: Texts that a key may have, and what its numbers stand for.
CHOICES = {
    "common/image_type": ("RGB8", "COMPRESSED", "CUSTOM"),
    "odometry_options/motion_compensation": ("IMU", "CONSTANT_VELOCITY"),
    "odometry_options/initialization": ("INIT_IMU", "INIT_CONSTANT_VELOCITY"),
}
LIDARS = {1: "livox", 2: "velodyne", 3: "ouster", 4: "robosense"}
TIME_UNITS = {0: "s", 1: "ms", 2: "us", 3: "ns"}


def settings(values: dict) -> tuple[dict[str, object], list[str]]:
    """(every key's value, what was ignored) of a nested configuration.

    A value is taken as its default's type. Keys that aren't known, texts that aren't a key's choices and values of
    another type are ignored and said.
    """
    found, ignored = dict(DEFAULTS), []
    stack = [("", values)]
    while stack:
        prefix, part = stack.pop()
        for name, value in part.items():
            key = f"{prefix}{name}"
            if isinstance(value, dict):
                stack.append((f"{key}/", value))
            elif key not in DEFAULTS:
                ignored.append(f"{key}: not known")
            elif value not in CHOICES.get(key, (value,)):
                ignored.append(f"{key}: {value} is not supported")
            else:
                kind = type(DEFAULTS[key])
                try:
                    found[key] = [float(v) for v in value] if kind is list else kind(value)
                except (TypeError, ValueError):
                    ignored.append(f"{key}: {value!r} is no {kind.__name__}")
    return found, sorted(ignored)


def cloud_config(found: dict[str, object]) -> CloudConfig:
    """What settings() say on vendor records."""
    part = lambda name: found[f"lidar_parameter/{name}"]
    return CloudConfig(LIDARS[part("lidar_type")], TIME_UNITS[part("time_unit")], part("N_SCANS"), part("blind"), found["common/point_filter_num"], float(part("SCAN_RATE")))


def as_frame(spark: SparkSession, found: dict[str, object]) -> DataFrame:
    """(key, value) as text, one row for each key."""
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "key string, value string")
