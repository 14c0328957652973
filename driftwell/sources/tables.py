"""The model's streams over the given tables, and readers for vendor point records."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that order lineitem rows totally.
POINT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Whole microseconds of a timestamp without time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as points: its order key, msg (l_orderkey), x, y, z and ts (microseconds)."""
    return table(spark, sf_dir, "lineitem").select(*POINT_KEY, (F.col("l_quantity") + 0).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), micros("l_shipdate").alias("ts"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: vec_id, label and the first three parts as x, y, z."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events but signups as an inertial-like series: event_id, user_id, ts (microseconds), value."""
    return table(spark, sf_dir, "events").filter("event_type <> 'signup'").select("event_id", "user_id", micros("ts").alias("ts"), "value", "event_type")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as camera triggers, which end sweeps: user_id, end_ts (microseconds)."""
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select("user_id", micros("ts").alias("end_ts"))


# -- vendor records -------------------------------------------------------------------------------------------

#: Milliseconds in a unit of time.
UNIT_MS = {"s": 1e3, "ms": 1.0, "us": 1e-3, "ns": 1e-6}
LARGEST_COORDINATE = 1e8


@dataclass(frozen=True)
class CloudConfig:
    """How a vendor's point records are read."""

    lidar_type: str = "livox"
    time_unit: str = "ns"
    n_scans: int = 6
    blind: float = 0.5
    filter_num: int = 1
    rate_hz: float = 10.0

    @classmethod
    def from_mapping(cls, values: dict) -> CloudConfig:
        """Known keys of a nested configuration; others are ignored, absent ones keep their defaults."""
        flat: dict = {}
        stack = [values]
        while stack:
            for k, v in stack.pop().items():
                if isinstance(v, dict):
                    stack.append(v)
                else:
                    flat[k] = v
        return cls(**{f.name: type(f.default)(flat[f.name]) for f in fields(cls) if f.name in flat})

    def as_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.name, str(getattr(self, f.name))) for f in fields(self)], "key string, value string")


def valid_point() -> Column:
    return (F.abs("x") <= LARGEST_COORDINATE) & (F.abs("y") <= LARGEST_COORDINATE) & (F.abs("z") <= LARGEST_COORDINATE)


#: Which field of a vendor's record holds the time within its message.
OFFSETS = {"livox": "offset_time", "velodyne": "time", "ouster": "t", "robosense": "timestamp"}


def with_clock_offset(df: DataFrame, ts: str, offset_s: Column, enabled: bool = True, least_s: float = 0.1) -> DataFrame:
    """Times (microseconds) moved by a clock's offset in seconds, if it is over `least_s` either way and is to be used."""
    moved = F.col(ts) + F.round(offset_s * 1e6).cast("long")
    return df.withColumn(ts, F.when(F.abs(offset_s) > least_s, moved).otherwise(F.col(ts))) if enabled else df


def interval_s(rate_hz: float) -> float:
    """Seconds of a sweep."""
    return 1.0 / rate_hz


def _turned(raw: DataFrame, cfg: CloudConfig, by: list[str]) -> DataFrame:
    """raw with `turn_ms`: the time since a ring's first point, from the angle turned since, at a little over the nominal
    rate."""
    from ..functions import geometry
    from ..operators import filters

    yaw = geometry.yaw_degrees()
    first = F.first(yaw).over(filters.window_of([*by, "ring"], ["idx"]))
    turn = first - yaw
    return raw.withColumn("turn_ms", F.when(yaw > first, turn + 360.0).otherwise(turn) / (0.361 * cfg.rate_hz))


def normalise(raw: DataFrame, cfg: CloudConfig, sensor: str | None = None) -> DataFrame:
    """Points (msg_id, ts, relative_ms, x, y, z, point_id) of vendor records (msg_id, msg_ts in seconds, idx and the vendor's
    fields); with `sensor`, a column of the sensors that messages are told apart by.

    A message of a turning sensor whose last record has no time gets its times from the angles; its blind points stay,
    those of other messages go. Points no later than the end of their sensor's message before are left out, with all of
    that message's records deciding where it ended. Raises KeyError for an unknown lidar_type.
    """
    from ..operators import filters, temporal

    offset, by = F.col(OFFSETS[cfg.lidar_type]).cast("double") * UNIT_MS[cfg.time_unit], [*([sensor] if sensor else []), "msg_id"]
    whole = filters.window_of(by, [])
    if cfg.lidar_type == "livox":
        kept = filters.moved(raw, by, ["idx"]).filter(valid_point() & (F.col("line") < cfg.n_scans) & (F.col("x") > 0.7) & filters.tag_ok("tag", "x"))
        kept = kept.withColumn("relative_ms", offset)
    else:
        timed = F.max_by(offset, "idx").over(whole) > 0
        since = offset - F.min(offset).over(whole) if cfg.lidar_type == "robosense" else offset
        kept = _turned(raw, cfg, by).withColumns({"timed": timed, "given_ms": since})
        kept = kept.withColumn("relative_ms", F.when(F.col("timed"), F.col("given_ms")).otherwise(F.col("turn_ms")))
    ends = kept.groupBy(*by, "msg_ts").agg((F.col("msg_ts") + F.max("relative_ms") / 1000).alias("end_s"))
    kept = filters.every_nth(kept, by, ["relative_ms", "idx"], cfg.filter_num, base=1 if cfg.lidar_type == "livox" else 0)
    seen = filters.beyond(cfg.blind) if cfg.lidar_type == "livox" else filters.beyond(cfg.blind) | ~F.col("timed")
    kept = kept.filter(seen).withColumn("ts", F.col("msg_ts") + F.col("relative_ms") / 1000)
    if cfg.lidar_type != "livox":
        key = sensor or "__sensor"
        at = ends.withColumns({"at": F.round(F.col("msg_ts") * 1e6).cast("long"), **({} if sensor else {key: F.lit(0)})})
        before = temporal.asof(at.select(key, "msg_id", "at"), at.select(key, F.col("at").alias("before_at"), F.col("end_s").alias("before_s")), key, "at", "before_at", forward=False, strict=True)
        kept = kept.join(before.select(*by, "before_s"), by).filter(F.col("before_s").isNull() | (F.col("ts") > F.col("before_s")))
    return kept.select(*by, "ts", "relative_ms", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.struct("msg_id", "idx").alias("point_id"))
