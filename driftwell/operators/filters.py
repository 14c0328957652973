"""Point filters and row-order operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_of(by: list[str], order: list) -> Window:
    w = Window.partitionBy(*by)
    return w.orderBy(*order) if order else w


def squared_norm() -> Column:
    return F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")


def beyond(blind: float) -> Column:
    """Outside the blind range."""
    return squared_norm() > blind * blind


def tag_ok(tag: str, x: str, near: float = 2.0) -> Column:
    """Beyond `near` in x, a point whose low tag bits mark noise (spatial or intensity) goes."""
    bits = F.col(tag).cast("int")
    return ~((F.col(x) > near) & ((bits.bitwiseAND(0x03) != 0) | (bits.bitwiseAND(0x0C) != 0)))


def in_depth(depth: Column, least: float = 0.1, most: float = 200.0) -> Column:
    return depth.between(least, most)


def moved(df: DataFrame, by: list[str], order: list, least: float = 1e-7) -> DataFrame:
    """Rows of which some coordinate differs from the row before; the first of a group has none and goes."""
    w = window_of(by, order)
    change = [F.abs(F.col(c) - F.lag(c).over(w)) > least for c in "xyz"]
    return df.withColumn("__moved", change[0] | change[1] | change[2]).filter("__moved").drop("__moved")


def every_nth(df: DataFrame, by: list[str], order: list, n: int, base: int = 0) -> DataFrame:
    """Each n-th row of a group: row numbers from `base` that n divides."""
    if n <= 1:
        return df
    place = F.row_number().over(window_of(by, order)) - 1 + base
    return df.withColumn("__place", place).filter(F.col("__place") % n == 0).drop("__place")


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """At most n rows of a group, in order: the capacity of a map cell."""
    return df.withColumn("__place", F.row_number().over(window_of(by, order))).filter(F.col("__place") <= n).drop("__place")


def not_late(df: DataFrame, message: str, ts: str, by: list[str] | None = None) -> DataFrame:
    """Rows later than all rows of the messages before theirs (in the order of `message`).

    The running maximum is taken over one row per message.
    """
    by = by or []
    ends = df.groupBy(*by, message).agg(F.max(ts).alias("__end"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(message).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__before", F.max("__end").over(earlier)).drop("__end")
    return df.join(ends, [*by, message]).filter(F.col("__before").isNull() | (F.col(ts) > F.col("__before"))).drop("__before")


def strikes_below(df: DataFrame, by: list[str], order: list, error: str, limit: float, allowed: int = 2) -> DataFrame:
    """Observations up to the one at which a feature is dropped: its `allowed`-th strike in a row, or one error twice the
    limit. The dropping observation goes, too."""
    w = window_of(by, order)
    strike = F.col(error) > limit
    run = F.lit(True)
    for k in range(allowed):
        run = run & F.coalesce(F.lag(strike, k).over(w) if k else strike, F.lit(False))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__drop", (run | (F.col(error) > 2 * limit)).cast("int"))
    return out.withColumn("__gone", F.max("__drop").over(upto)).filter("__gone = 0").drop("__drop", "__gone")


def compacted(values: Column, status: Column) -> Column:
    """The entries of a list whose status is set, in order."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), status.alias("s")), lambda x: x["s"]), lambda x: x["v"])
