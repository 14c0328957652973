"""Alignment of independent series in event time. Times are whole microseconds.

As-of joins work on time buckets: rows of a key and bucket meet in one window, and what a bucket lacks comes from a
summary of one row per key and bucket. So a key with a third of all rows is still many partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _bucketed(df: DataFrame, ts: str, bucket_us: int) -> DataFrame:
    return df.withColumn("__bucket", F.floor(F.col(ts) / bucket_us).cast("long"))


def asof(left: DataFrame, right: DataFrame, by: str, ts: str, right_ts: str, forward: bool, strict: bool, bucket_us: int = DAY_US) -> DataFrame:
    """left with the columns of the nearest right row of its key: later (`forward`) or earlier, at the same time only if
    not `strict`; nulls where there is none. right has one row per key and time."""
    taken = [c for c in right.columns if c != by]
    r = _bucketed(right, right_ts, bucket_us).select(F.col(by), "__bucket", F.struct(*taken).alias("__r"), F.col(right_ts).alias("__t"))
    # at equal times a right row comes first in the window's direction if it may be matched
    mine = _bucketed(left, ts, bucket_us).select(F.col(by), "__bucket", F.struct(*[c for c in left.columns if c != by]).alias("__l"), F.col(ts).alias("__t"))
    both = mine.withColumn("__side", F.lit(1)).unionByName(r.withColumn("__side", F.lit(2 if strict else 0)), allowMissingColumns=True)
    time = F.col("__t").desc() if forward else F.col("__t").asc()
    w = Window.partitionBy(by, "__bucket").orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1").drop("__side", "__t")
    edge = r.groupBy(by, "__bucket").agg((F.min_by if forward else F.max_by)("__r", "__t").alias("__edge"))
    span = edge.select(by, "__bucket", "__edge").unionByName(mine.select(by, "__bucket").distinct(), allowMissingColumns=True).groupBy(by, "__bucket").agg(F.first("__edge", ignorenulls=True).alias("__edge"))
    other = Window.partitionBy(by).orderBy(F.col("__bucket").desc() if forward else F.col("__bucket").asc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = span.withColumn("__edge", F.last("__edge", ignorenulls=True).over(other))
    out = met.join(beyond, [by, "__bucket"], "left").withColumn("__r", F.coalesce("__r", "__edge"))
    return out.select(by, "__l.*", "__r.*")


def assign_sweeps(points: DataFrame, ends: DataFrame, by: str = "user_id") -> DataFrame:
    """points with end_ts of the first sweep of their key that ends after them; a point at an end belongs to the next."""
    return asof(points, ends.select(by, "end_ts").distinct(), by, "ts", "end_ts", forward=True, strict=True)


def with_overlap(samples: DataFrame, ends: DataFrame, by: str = "user_id") -> DataFrame:
    """Samples of each sweep and, marked overlap, the first at its end or after it, which the next sweep has as well."""
    own = assign_sweeps(samples, ends, by).filter("end_ts IS NOT NULL").withColumn("overlap", F.lit(False))
    after = asof(ends.select(by, "end_ts").distinct(), samples, by, "end_ts", "ts", forward=True, strict=False).filter("ts IS NOT NULL")
    return own.unionByName(after.withColumn("overlap", F.lit(True)))


def at_segments(points: DataFrame, samples: DataFrame, by: str = "user_id") -> DataFrame:
    """points with the segment of samples [seg_start, seg_end) that holds them and the samples' values there; points in
    no segment are left out."""
    nxt = Window.partitionBy(by).orderBy("ts")
    segments = samples.select(by, F.col("ts").alias("seg_start"), F.col("value").alias("v0"), F.lead("ts").over(nxt).alias("seg_end"), F.lead("value").over(nxt).alias("v1"))
    return asof(points, segments, by, "ts", "seg_start", forward=False, strict=False).filter("seg_end IS NOT NULL")


def straddle(samples: DataFrame, ends: DataFrame, by: str = "user_id") -> DataFrame:
    """The series' value at each sweep end, from the samples around it weighted by nearness in time."""
    before = asof(ends.select(by, "end_ts").distinct(), samples.select(by, F.col("ts").alias("t0"), F.col("value").alias("v0")), by, "end_ts", "t0", forward=False, strict=True)
    both = asof(before, samples.select(by, F.col("ts").alias("t1"), F.col("value").alias("v1")), by, "end_ts", "t1", forward=True, strict=False)
    both = both.filter("t0 IS NOT NULL AND t1 IS NOT NULL")
    d0, d1 = F.col("end_ts") - F.col("t0"), F.col("t1") - F.col("end_ts")
    return both.withColumn("value", (d1 * F.col("v0") + d0 * F.col("v1")) / (d0 + d1))


def fill_windows(ends: DataFrame, interval_us: int, by: str = "user_id") -> DataFrame:
    """Sweep windows (begin, end, rendering): each ends at a trigger; a gap of over 1.5 intervals first gets windows of one
    interval each, without rendering, until 1.5 intervals or less are left."""
    w = Window.partitionBy(by).orderBy("end_ts")
    gaps = ends.select(by, "end_ts").distinct().withColumn("last", F.lag("end_ts").over(w)).filter("last IS NOT NULL")
    gap = F.col("end_ts") - F.col("last")
    n = F.when(gap * 2 > 3 * interval_us, F.ceil((gap - 1.5 * interval_us) / interval_us)).otherwise(F.lit(0)).cast("long")
    each = gaps.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    begin = F.col("last") + F.col("k") * interval_us
    real = F.col("k") == F.col("n")
    return each.select(by, begin.alias("begin_ts"), F.when(real, F.col("end_ts")).otherwise(begin + interval_us).alias("end_ts"), real.alias("rendering"))


def with_alpha(df: DataFrame, begin: str, end: str, clamp: bool = True) -> DataFrame:
    """A point's place in its sweep (alpha) and milliseconds from its begin. Timed clouds clamp alpha over 1 just below 1;
    others drop what lies outside the sweep."""
    span = F.col("ts") - F.col(begin)
    alpha = span / (F.col(end) - F.col(begin))
    out = df.withColumns({"alpha": F.when(alpha > 1, 1 - 1e-5).otherwise(alpha) if clamp else alpha, "relative_ms": span / 1000})
    return out if clamp else out.filter(F.col("ts").between(F.col(begin), F.col(end)))


def velocity(df: DataFrame, by: str, order: str, value: str, least_s: float = 1e-5) -> DataFrame:
    """Rate of change to the row before, in units a second; under `least_s` the time counts as 1 ms."""
    w = Window.partitionBy(by).orderBy(order)
    dt = (F.col(order) - F.lag(order).over(w)) / 1e6
    return df.withColumn("velocity", (F.col(value) - F.lag(value).over(w)) / F.when(dt < least_s, F.lit(1e-3)).otherwise(dt))


def constant_velocity(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """What the last two rows predict for this one: the last plus its difference to the one before."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("predicted", 2 * F.lag(value, 1).over(w) - F.lag(value, 2).over(w))


def monotonic_faults(df: DataFrame, by: str, order: str, ts: str) -> DataFrame:
    """Rows that aren't later than the row before them in arrival order."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("last_ts", F.lag(ts).over(w)).filter(F.col(ts) <= F.col("last_ts"))


def ready(ends: DataFrame, samples: DataFrame, by: str = "user_id") -> DataFrame:
    """Triggers that are newer than the oldest sample of their key, and older than its newest: older ones are dropped,
    newer ones wait for more samples. One row of bounds per key is joined."""
    bounds = samples.groupBy(by).agg(F.min("ts").alias("__oldest"), F.max("ts").alias("__newest"))
    return ends.join(bounds, by).filter((F.col("end_ts") > F.col("__oldest")) & (F.col("end_ts") < F.col("__newest"))).drop("__oldest", "__newest")
