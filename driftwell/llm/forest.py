"""Approximate nearest neighbours by a hash-prefix forest.

A vector's hash string in a tree lists the axes of the tree's random rotation on which it is largest, with their signs, largest
first; vectors at a small angle share long prefixes. A tree is the sorted array of its strings. A query descends each tree to its
longest matching prefix by binary search; then all trees ascend together, one letter at a time, and what their wider ranges
add become candidates, until there are enough. The root, all rows, ends every ascent. Candidates are scored exactly.

Rows are dealt in blocks by a hash of the id, so copies of one vector are in all blocks; a block's forest is built by one task,
which then streams the queries past it. How many candidates are enough is measured: for a bounded sample of queries all rows
are scored, and the share of a block that was needed for nearly all true neighbours serves for all queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices_of

TOP, QUERY_EACH = 20, 20
#: Trees, letters of a hash string, and axes that a rotation keeps at most.
TREES, LETTERS, AXES = 96, 3, 64
#: Rows of a block at most, or so; there are as many blocks as the session shuffles to, or more.
BLOCK_ROWS = 262_144
#: Queries whose neighbours are found among all rows (of about so many, never twice as many), and the part of their
#: neighbours that the share of candidates must reach.
SAMPLE_QUERIES, REACHED = 128, 0.95
#: Rows or queries that are hashed at a time.
AT_ONCE = 2048


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) without rows whose id is null or whose vector is null, zero, or has null or non-finite parts."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    return df.filter(ok).select("vec_id", "embedding")


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


class Forest:
    """The trees of a block's rows. Rows get one more part that makes them of one length, so that the angle to a query is
    smaller the larger the product is."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, seed: int = 11) -> None:
        self.rows = rows
        norms = np.sqrt((rows * rows).sum(1))
        longest = norms.max(initial=0.0) or 1.0
        wide = np.concatenate([rows / longest, np.sqrt(np.maximum(0.0, 1 - (norms / longest) ** 2))[:, None]], axis=1)
        rng = np.random.default_rng(seed)
        d = wide.shape[1]
        self.axes = [np.linalg.qr(rng.standard_normal((d, d)))[0][:, :AXES].astype(np.float32) for _ in range(trees)]
        self.base = 2 * self.axes[0].shape[1]
        self.letters = min(LETTERS, self.axes[0].shape[1])
        self.sorted, self.order = [], []
        for a in self.axes:
            code = self.strings(wide, a)
            order = np.argsort(code, kind="stable")
            self.order.append(order.astype(np.int32))
            self.sorted.append(code[order])

    def strings(self, x: np.ndarray, axes: np.ndarray) -> np.ndarray:
        """Hash strings as whole numbers, a letter a digit; prefixes are ranges of them."""
        out = np.zeros(len(x), np.int64)
        for lo in range(0, len(x), AT_ONCE):
            y = x[lo : lo + AT_ONCE].astype(np.float32) @ axes
            size, at = np.abs(y), np.arange(len(y))
            code = np.zeros(len(y), np.int64)
            for _ in range(self.letters):
                top = size.argmax(1)
                code = code * self.base + 2 * top + (y[at, top] < 0)
                size[at, top] = -1.0
            out[lo : lo + AT_ONCE] = code
        return out

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of each query's prefix range by letters dropped and tree: at first the full string, at last one letter."""
        wide = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        lo = np.empty((self.letters, len(self.axes), len(queries)), np.int64)
        hi = np.empty_like(lo)
        for t, a in enumerate(self.axes):
            code = self.strings(wide, a)
            for drop in range(self.letters):
                width = self.base**drop
                first = code // width * width
                lo[drop, t], hi[drop, t] = np.searchsorted(self.sorted[t], first), np.searchsorted(self.sorted[t], first + width)
        return lo, hi

    def arrivals(self, lo: np.ndarray, hi: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, how many there were once each was in) of a query with these ranges, in the order of the ascent. A
        prefix's range is taken whole, so equal vectors come together."""
        seen, found, counts, n = np.zeros(len(self.rows), bool), [], [], 0
        for drop in range(self.letters):
            for t in range(len(self.axes)):
                part = self.order[t][lo[drop, t] : hi[drop, t]]
                part = part[~seen[part]]
                if len(part):
                    seen[part] = True
                    n += len(part)
                    found.append(part)
                    counts.append(np.full(len(part), n))
                    if n >= enough:
                        return np.concatenate(found), np.concatenate(counts)
        rest = np.flatnonzero(~seen)
        return np.concatenate([*found, rest]), np.concatenate([*counts, np.full(len(rest), len(seen))])


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in doubles; equal rows have equal ones, wherever they stand."""
    return (rows * query).sum(1)


def best_of(value: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties to smaller ids."""
    if len(value) > k:
        least = np.partition(value, len(value) - k)[len(value) - k]
        near = np.flatnonzero(value >= least)
        return near[np.lexsort((ids[near], -value[near]))][:k]
    return np.lexsort((ids, -value))


FOUND = "query_id long, vec_id long, score double, needed double"


def _searched(k: int, width: int, share: float):
    """Each query's k best of each block, from rows sorted by block, side (rows before queries) and vec_id. needed: the
    share of the block's rows that were candidates once this one was."""

    def answers(forest: Forest, ids: np.ndarray, asking: list) -> pd.DataFrame:
        queries, q = np.array([a[0] for a in asking]), _matrix([a[1] for a in asking], width)
        lo, hi = forest.ranges(q)
        out, n = [], len(ids)
        for j in range(len(q)):
            at, needed = forest.arrivals(lo[:, :, j], hi[:, :, j], max(k + 1, int(np.ceil(share * n))))
            mine = ids[at] != queries[j]
            at, needed = at[mine], needed[mine]
            value = scores(forest.rows[at], q[j])
            best = best_of(value, ids[at], k)
            out.append(pd.DataFrame({"query_id": queries[j], "vec_id": ids[at[best]], "score": value[best], "needed": needed[best] / n}))
        return pd.concat(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, ids, forest, asking = None, [], [], None, []
        for rows in batches:
            for b, side, i, v in zip(rows["block"], rows["side"], rows["vec_id"], rows["embedding"], strict=True):
                if b != block:
                    if asking and forest is not None:
                        yield answers(forest, kept, asking)
                    block, held, ids, forest, asking = b, [], [], None, []
                if side == 0:
                    held.append(v)
                    ids.append(i)
                    continue
                if held:
                    forest, kept, held = Forest(_matrix(held, width)), np.array(ids), []
                asking.append((i, v))
                if len(asking) >= AT_ONCE // 8:
                    if forest is not None:
                        yield answers(forest, kept, asking)
                    asking = []
        if asking and forest is not None:
            yield answers(forest, kept, asking)

    return run


def _met(vectors: DataFrame, queries: DataFrame, k: int, width: int, blocks: int, share: float) -> DataFrame:
    rows = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"))
    asking = queries.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"))
    dealt = rows.unionByName(asking).repartitionById(blocks, "block").sortWithinPartitions("block", "side", "vec_id")
    return dealt.mapInPandas(_searched(k, width, share), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def needed_share(vectors: DataFrame, queries: DataFrame, k: int, width: int, blocks: int) -> float:
    """The share of a block that its candidates must be for REACHED of the true neighbours of a sample of queries."""
    total = queries.count()
    picked = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(max(1, total))) < SAMPLE_QUERIES).limit(2 * SAMPLE_QUERIES)
    true = _ranked(_met(vectors, materialise(picked, "sample-queries"), k, width, blocks, 1.0), k)
    return float(true.agg(F.percentile("needed", F.lit(REACHED))).first()[0] or 1.0)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner products found for each query, its own id left out.

    Both sides are (vec_id, embedding) of usable() rows; shorter vectors count as ended by zeros. Ties go to smaller ids.
    Fewer rows than k give fewer ranks; no rows or no queries give an empty result. Repeated ids are candidates each for
    itself; as queries they share one ranking.
    """
    widest = vectors.agg(F.max(F.size("embedding")), F.count("*")).first()
    if not widest[1] or queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, blocks = widest[0], max(slices_of(vectors.sparkSession), -(-widest[1] // BLOCK_ROWS))
    share = needed_share(vectors, queries, k, width, blocks)
    found = materialise(_met(vectors, queries.dropDuplicates(["vec_id"]), k, width, blocks, share), "found")
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    """The TOP nearest found of every QUERY_EACH-th vector; see usable() and neighbours() for nulls, ties and repeated ids."""
    vectors = materialise(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return neighbours(vectors, vectors.filter(F.col("vec_id") % QUERY_EACH == 0))
