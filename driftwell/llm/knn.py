"""Exact top-k by inner product: a Voronoi join.

Vectors go to the cell of their nearest pivot; a cell's summary is its count and radius. Cells that lie near each other make
a span, a crowded cell is several. A query first meets the span of its best-placed cell, which gives it a floor; then it is
sent once to each other span that has a cell whose bound q.p + |q| r reaches that floor. A task holds a bounded number of a
span's queries with their k best so far, and the span's vectors stream past them in blocks; queries whose floor, which
rises meanwhile, is above the bounds of a block's cells skip that block. Vectors travel as the narrowest whole numbers.
Scores are exact: sums of whole numbers in floats below 2**24, in doubles below 2**53; where lengths allow more, a block is
summed in whole numbers. Bounds leave room for the rounding of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialise, slices_of

#: Least number of pivots, picked by a hash of the id; from its square on, about the square root of the number of vectors
#: (never over twice as many). At most so many vectors and queries meet at a time.
PIVOTS, BLOCK_ROWS, BLOCK_QUERIES = 64, 4096, 1024
#: About so many queries of a span stay in a task. A span has as many vectors as give each of the session's slices a task,
#: within these limits, or about so.
TASK_QUERIES, SPAN_LEAST, SPAN_MOST = 1 << 15, 1 << 13, 1 << 19
#: Numbers in a matrix at a time: wide vectors meet in smaller blocks.
AT_ONCE = 1 << 19
#: A query without a floor yet. Packed vectors' types by their bytes a number.
NO_FLOOR, KINDS = -(1 << 63), {1: "i1", 2: "i2", 4: "i4", 8: "f8"}
QUERY_EACH = 20
TOP = 20
SCALE = 64


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double> of floor(scale * x)); rows without an id or with null or non-finite parts are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)
    return df.filter(ok).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of doubles from lists of numbers or from what _packed() made of them."""
    if len(vectors) and isinstance(vectors[0], bytes):
        return np.frombuffer(b"".join(vectors), f"<{KINDS[len(vectors[0]) // width]}").reshape(len(vectors), width).astype(float)
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _flat(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles from an Arrow array of lists, which shorter ones leave as zeros."""
    ends = np.cumsum(sizes := vectors.value_lengths().to_numpy(zero_copy_only=False))
    out, values = np.zeros((len(vectors), width)), vectors.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(values)) - (ends - sizes)[row]] = values
    return out


def _packed(x: np.ndarray, size: int) -> pa.Array:
    """A binary value of so many bytes a number for each row."""
    data = np.ascontiguousarray(x, f"<{KINDS[size]}")
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * size)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _narrowed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as the narrowest type in which inner products of their rows are exact: floats, doubles or Python's whole numbers."""
    largest = np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))
    if largest < 2.0**24 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 2.0**24:
        return a.astype(np.float32), b.astype(np.float32)
    if largest < 2.0**52:
        return a, b
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return whole(a), whole(b)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact whatever their size."""
    a, b = _narrowed(a, b)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of a row's k best scores, ties to smaller ids; ids ascend."""
    if len(scores) <= k:
        return np.lexsort((ids, -scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= least)
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _leading(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each group's k best by group, score and id, and their ranks from 0; scores are long."""
    order = np.lexsort((ids, ~scores, group))
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return order[rank < k], rank[rank < k]


def _solve(k: int, width: int):
    """Of one block: each query's k best among the block's rows, itself left out, and scores under its floor, if it has one."""

    def run(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        ids, asked = rows["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        floor = queries["floor"].to_numpy(np.int64) if "floor" in queries else np.full(len(queries), NO_FLOOR)
        own, end = np.searchsorted(ids, asked), np.searchsorted(ids, asked, "right")
        q, x = _narrowed(_matrix(queries["v"].tolist(), width), _matrix(rows["v"].tolist(), width))
        found = [(np.zeros(0, np.int64),) * 3]
        for lo in range(0, len(queries), 256):
            scores = q[lo : lo + 256] @ x.T
            least = floor[lo : lo + 256, None]
            may = (scores >= least.astype(scores.dtype)) | (least == NO_FLOOR)
            for n in np.flatnonzero(own[lo : lo + 256] < end[lo : lo + 256]):
                may[n, own[lo + n] : end[lo + n]] = False
            for n in np.flatnonzero(np.count_nonzero(may, axis=1) > (k if scores.dtype == object else 4 * k)):
                at = np.flatnonzero(may[n])
                may[n] = False
                may[n, at[_best(scores[n, at], ids[at], k)]] = True
            n, at = np.divmod(np.flatnonzero(may), len(ids))  # nonzero() of a matrix takes three times as long
            score = scores[n, at].astype(np.int64)
            order, _ = _leading(n, score, ids[at], k)
            found.append((asked[lo + n[order]], ids[at[order]], score[order]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


@dataclass
class _Cells:
    """Cells in the order of their groups; a group is one span, or a cell of several spans."""

    number: np.ndarray  # of each cell
    pivots: np.ndarray
    radius: np.ndarray
    starts: np.ndarray  # each group's first cell
    spans: np.ndarray  # each group's number of spans

    def __post_init__(self):
        self.at = np.full(self.number.max() + 1, -1)  # the place of a cell by its number
        self.at[self.number] = np.arange(len(self.number))
        self.group = np.searchsorted(self.starts, np.arange(len(self.number)), "right") - 1  # of each cell
        self.firsts = np.cumsum(self.spans) - self.spans  # each group's first span
        self.length = np.sqrt((self.pivots**2).sum(1))

    def bounds(self, x: np.ndarray, at=slice(None)) -> np.ndarray:
        """For rows of x and cells, what no score is above."""
        norm = np.sqrt((x * x).sum(1))[:, None]
        return x @ self.pivots[at].T + norm * (self.radius[at] + 1e-12 * (self.length[at] + self.radius[at])) + 1e-6

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell that each row of x is best placed for: its least score there is the highest."""
        return (x @ self.pivots.T - np.sqrt((x * x).sum(1))[:, None] * self.radius).argmax(1)


def _grouped(pivots: np.ndarray, sizes: np.ndarray, most: int) -> tuple[list[np.ndarray], list[int]]:
    """Cells in groups of about `most` vectors, cut along the coordinate in which they differ most, and each group's number of spans."""
    groups, spans, left = [], [], [np.arange(len(sizes))]
    while left:
        cells = left.pop()
        n = max(1, -int(-(sizes[cells].sum() / most - 0.2) // 1))
        if n == 1 or len(cells) == 1:
            groups.append(cells)
            spans.append(n)
            continue
        cells = cells[np.argsort(pivots[cells][:, pivots[cells].var(0).argmax()], kind="stable")]
        cut = np.searchsorted(np.cumsum(sizes[cells]), sizes[cells].sum() * (n // 2) / n, "right")
        cut = min(max(1, int(cut)), len(cells) - 1)
        left += [cells[cut:], cells[:cut]]
    return groups, spans


class _Meeting:
    """A task's queries with the best found for them so far; rows stream past them."""

    def __init__(self, task: int, solve, k: int, width: int, cells: _Cells, at_once: tuple[int, int]):
        self.key, self.solve, self.k, self.width, self.cells, self.at_once = (task,), solve, k, width, cells, at_once
        self.asked, self.held, self.parts = [], [], None

    def take(self, frame: pd.DataFrame) -> None:
        """More of the task's records, queries before rows."""
        is_row = frame["is_row"].to_numpy()
        if not is_row.all():
            self.asked.append(frame.loc[~is_row, ["vec_id", "v", "floor"]])
        if is_row.any() and self.asked:
            self.held.append(frame.loc[is_row, ["vec_id", "v", "cell"]])
            if sum(map(len, self.held)) >= self.at_once[0]:
                self.meet()

    def meet(self, all_rows: bool = False) -> None:
        """The rows that are held meet the queries, in whole blocks."""
        if self.parts is None:
            asked, n = pd.concat(self.asked), self.at_once[1]
            self.parts = [[asked.iloc[lo : lo + n].reset_index(drop=True), (np.zeros(0, np.int64),) * 3] for lo in range(0, len(asked), n)]
        rows, n = pd.concat(self.held), self.at_once[0]
        end = len(rows) if all_rows else len(rows) // n * n
        for lo in range(0, end, n):
            self.meet_block(rows.iloc[lo : min(end, lo + n)])
        self.held = [rows.iloc[end:]]

    def meet_block(self, rows: pd.DataFrame) -> None:
        cells, rows = self.cells.at[rows["cell"].unique()], rows.sort_values("vec_id")
        for part in self.parts:
            asked, best = part
            floor = asked["floor"].to_numpy()
            reach = self.cells.bounds(_matrix(asked["v"].tolist(), self.width), cells).max(1) >= floor
            if not reach.any():
                continue
            found = self.solve(self.key, asked if reach.all() else asked[reach], rows)
            if not len(found):
                continue
            query, vec_id, score = (np.concatenate(x) for x in zip(best, (found[c].to_numpy() for c in ("query_id", "vec_id", "score")), strict=True))
            order, rank = _leading(query, score, vec_id, self.k)
            part[1] = query[order], vec_id[order], score[order]
            full, last = query[order][rank == self.k - 1], score[order][rank == self.k - 1]
            if len(full):
                ids = asked["vec_id"].to_numpy()
                at = np.minimum(np.searchsorted(full, ids), len(full) - 1)
                asked["floor"] = np.where(full[at] == ids, np.maximum(floor, last[at]), floor)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.meet(all_rows=True)
        for _, best in self.parts or []:
            yield pa.record_batch([pa.array(x) for x in best], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all rows but its own id.

    Both sides are (vec_id, v) of whole numbers as doubles; shorter vectors count as ended by zeros. Ties go to smaller
    ids. Fewer rows than k give fewer ranks; no vectors or no queries give an empty result. Repeated ids are
    candidates each for itself; as queries they share one ranking. A score must fit a long.
    """
    spark = vectors.sparkSession
    in_small_batches(spark)
    highest = F.greatest(F.array_max("v"), -F.array_min("v"))
    total, width, largest = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(highest)).first()
    n_queries, widest, beyond = queries.agg(F.count("*"), F.max(F.size("v")), F.max(highest)).first()
    if not total or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, largest = max(1, width, widest), max(largest or 0, beyond or 0)
    kind = 1 if largest < 2**7 else 2 if largest < 2**15 else 4 if largest < 2**31 else 8
    n_pivots = max(PIVOTS, isqrt(total))
    picked = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(total)) < n_pivots).limit(2 * n_pivots).collect() or vectors.limit(1).collect()
    pivots = np.unique(_matrix([r.v for r in picked], width), axis=0)
    square = (pivots * pivots).sum(1)
    step = max(1, AT_ONCE // max(width, len(pivots)))
    most_out, blocks = max(1, AT_ONCE // width), (max(1, min(BLOCK_ROWS, AT_ONCE // width)), max(1, min(BLOCK_QUERIES, AT_ONCE // width)))
    task_queries = max(1, min(TASK_QUERIES, 4 * AT_ONCE // width))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                yield batch.slice(lo, step)

    def pack(with_cells: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in parts(batches):
                x = _flat(rows["v"], width)
                out = [rows["vec_id"], _packed(x, kind), rows["deal"]]
                if with_cells:
                    own = (x * x).sum(1)
                    away = own[:, None] - 2 * (x @ pivots.T) + square
                    cell = away.argmin(1)
                    away = np.maximum(away[np.arange(len(x)), cell], 0) + 1e-12 * (own + square[cell])
                    out += [pa.array(cell.astype(np.int32)), pa.array(away)]
                yield pa.record_batch(out, ["vec_id", "v", "deal", "cell", "away"][: len(out)])

        return run

    #: A row's number for dealing rows out, repeated ids too; it is written, so it stays.
    dealt = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 63) - 1)).alias("deal")
    packed = "vec_id long, v binary, deal long"
    celled = materialise(vectors.select("vec_id", "v", dealt).mapInArrow(pack(True), f"{packed}, cell int, away double"), "cells")
    asking = materialise(queries.select("vec_id", "v", dealt).mapInArrow(pack(False), packed), "asking")
    summary = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).orderBy("cell").collect()
    number, sizes = np.array([r.cell for r in summary]), np.array([r.n for r in summary])
    radius = np.sqrt([r.far for r in summary]) * (1 + 1e-9)
    of_a_slice = total * -(-n_queries // task_queries) // slices_of(spark)
    groups, spans = _grouped(pivots[number], sizes, min(max(SPAN_LEAST, of_a_slice), SPAN_MOST))
    order = np.concatenate(groups)
    cells = _Cells(number[order], pivots[number[order]], radius[order], np.cumsum([0, *map(len, groups[:-1])]), np.array(spans))
    spanned = celled.join(F.broadcast(spark.createDataFrame([(int(c), int(cells.firsts[g]), int(cells.spans[g])) for c, g in zip(cells.number, cells.group, strict=True)], "cell int, first int, spans int")), "cell")
    spanned = spanned.withColumn("span", (F.col("first") + F.pmod("deal", "spans")).cast("int"))

    def asks(part: pa.RecordBatch, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which queries go to which spans, and each query's own cell: first to a span of that cell, then to others that can beat the floor."""
        x, deal = _matrix(part["v"].to_pylist(), width), part["deal"].to_numpy()
        own = cells.own(x)
        group = cells.group[own]
        span = cells.firsts[group] + deal % cells.spans[group]
        if first:
            return np.arange(len(x)), span, own
        use = np.maximum.reduceat(cells.bounds(x), cells.starts, axis=1) >= part["floor"].to_numpy()[:, None]
        use = np.repeat(use, cells.spans, axis=1)
        use[np.arange(len(x)), span] = False
        return *np.nonzero(use), own

    def counted(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches):
                span, n = np.unique(asks(part, first)[1], return_counts=True)
                yield pa.record_batch([pa.array(span.astype(np.int32)), pa.array(n)], ["span", "n"])

        return run

    def sent(first: bool, begins: np.ndarray, tasks: np.ndarray):
        """Queries for tasks: once for each span that they meet. begins: the number of each span's first task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts(batches):
                at, span, own = asks(part, first)
                task = begins[span] + (part["deal"].to_numpy()[at] >> 20) % tasks[span]
                for lo in range(0, len(at), most_out):
                    now = at[lo : lo + most_out]
                    some = part.take(pa.array(now))
                    yield pa.record_batch([pa.array(task[lo : lo + most_out].astype(np.int32)), pa.array(np.zeros(len(now), bool)), some["vec_id"], some["v"], pa.array(cells.number[own[now]].astype(np.int32)), some["floor"]], names)

        return run

    names = ["task", "is_row", "vec_id", "v", "cell", "floor"]
    solve = _solve(k, width)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            task = batch["task"].to_numpy()
            for lo, hi in pairwise([0, *np.flatnonzero(np.diff(task)) + 1, len(task)]):
                if hi > lo:
                    if now is None or now.key[0] != task[lo]:
                        yield from now.found() if now else ()
                        now = _Meeting(task[lo], solve, k, width, cells, blocks)
                    now.take(batch.slice(lo, hi - lo).to_pandas())
        yield from now.found() if now else ()

    def solved(asking: DataFrame, first: bool) -> DataFrame:
        counts = asking.mapInArrow(counted(first), "span int, n long").groupBy("span").agg(F.sum("n").alias("n")).collect()
        tasks = np.zeros(cells.spans.sum(), np.int64)
        for r in counts:
            tasks[r.span] = -(-r.n // task_queries)
        begins = np.cumsum(tasks) - tasks
        if not tasks.any():
            return spark.createDataFrame([], "query_id long, vec_id long, score long")
        ends = F.broadcast(spark.createDataFrame([(s, int(begins[s]), int(begins[s] + n - 1)) for s, n in enumerate(tasks.tolist()) if n], "span int, task int, until int"))
        rows = spanned.join(ends, "span").select(F.explode(F.sequence("task", "until")).alias("task"), F.lit(True).alias("is_row"), "vec_id", "v", "cell", F.lit(0).cast("long").alias("floor"))
        asked = asking.mapInArrow(sent(first, begins, tasks), "task int, is_row boolean, vec_id long, v binary, cell int, floor long")
        together = asked.unionByName(rows).repartitionById(int(tasks.sum()), "task").sortWithinPartitions("task", "is_row", "cell")
        return together.mapInArrow(met, "query_id long, vec_id long, score long")

    none = F.lit(NO_FLOOR).cast("long")
    near = materialise(solved(asking.withColumn("floor", none), True), "near")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floors = near.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("floor"))
    more = asking.join(floors, asking["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "deal", F.coalesce("floor", none).alias("floor"))
    far = solved(materialise(more, "floors"), False)
    ranked = near.unionByName(far).withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    """The TOP best rows of every QUERY_EACH-th vector; see whole_vectors() and top_k() for nulls, ties and repeated ids."""
    vectors = materialise(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_EACH == 0))


OP7_SQL = """
WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM t q JOIN t x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
