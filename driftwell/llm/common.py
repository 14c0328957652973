"""Shared helpers of the training-data operators: shared scratch space, skew-safe joins, components, byte hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_KEY = "spark.checkpoint.dir"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the cluster's shared folder. Where none is named, a local folder serves a local master alone."""
    base = spark.conf.get(SCRATCH_KEY, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{SCRATCH_KEY} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-driftwell-")
        spark.conf.set(SCRATCH_KEY, base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cut lineage that outlives executors. codec: the session's, if none is named."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Texts go to Python in batches of so many rows and bytes (or one text), so that a worker and the JVM's buffer hold a few MB of them.
TEXTS_AT_ONCE, TEXT_BYTES_AT_ONCE = 2000, 1 << 21


def in_small_batches(spark: SparkSession) -> None:
    """Sets the session's rows and bytes per Arrow batch for operators whose rows hold whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_AT_ONCE)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES_AT_ONCE)


#: Rows of a few numbers that may be broadcast.
SMALL_SIDE = 1 << 19


def small_side(df: DataFrame) -> DataFrame:
    """A written table of few columns, to be broadcast if it has SMALL_SIDE rows at most; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_SIDE else df


def slices_of(spark: SparkSession) -> int:
    """Partitions that the session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: A key is hot with more than 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
HOT_LEAST = 64


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: str, n_rows: int, how: str = "inner", weight: str = "weight") -> DataFrame:
    """Equi-join of left with right, whose key is unique and whose `weight` says how many left rows have it.

    n_rows: the rows of left. Hot keys (at most HOT_SHARE of them, by the threshold) are broadcast with a salt count; their left rows are
    spread by a hash of `spread` and their right row is repeated once per salt.
    """
    least = max(HOT_LEAST, n_rows // HOT_SHARE)
    salts = F.when(F.col(weight) > least, F.ceil(F.col(weight) / least)).otherwise(F.lit(1)).cast("int")
    hot = right.filter(F.col(weight) > least).select(F.col(key), salts.alias("__salts"))
    left = left.join(F.broadcast(hot), key, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__salts"))).cast("int")).drop("__salts")
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(weight)
    return left.join(right, [key, "__salt"], how).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of `edges` (a, b of one type), by alternating stars.

    Each round relinks the edges to smaller nodes (large star, then small star) and is written to the shared
    folder, so the plan stays short; hub nodes are handled by partial minima and salted joins. Rounds go on until one
    changes nothing; each halves the depth of the trees or so, so there are few.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")
    before, now = None, ()
    while now != before:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
        n_rows = 2 * edges.count()
        low = both.groupBy("n").agg(F.min("o").alias("low"), F.count("*").alias("weight")).withColumn("low", F.least("low", "n"))
        large = skew_join(both.filter("o > n"), low, "n", "o", n_rows).select(F.col("o").alias("u"), F.col("low").alias("v"))
        large = large.filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("weight"))
        small = skew_join(large, small_low, "u", "v", n_rows)
        edges = small.select(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")).unionByName(small_low.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()
        edges = materialise(edges, "edges")
        pair = F.xxhash64("u", "v")
        before, now = now, tuple(edges.agg(F.count("*"), F.sum(pair.cast("decimal(38,0)")), F.bit_xor(pair), F.bit_xor(F.xxhash64("v", "u"))).first())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# -- byte hashing ---------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)


def _grow(n: int) -> None:
    if _powers["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INV)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
        _powers["n"] = size


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over uint64 codes, modulo 2**64; see span_hash."""
    _grow(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes * _powers["up"][: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the codes in [start, end), whatever their place."""
    with np.errstate(over="ignore"):
        return mixed((prefix[end] - prefix[start]) * _powers["down"][start])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
