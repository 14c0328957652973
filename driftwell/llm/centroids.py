"""Centroid clustering in whole numbers: each round a vantage-point tree over the centroids is built and broadcast.

A vector walks the tree by best first: of the subtrees still open it takes the one whose bound is least, until the least
bound is over its nearest distance so far. Bounds come from the triangle inequality, and a subtree whose bound equals the
nearest distance is still searched, so that ties are seen; the distances of leaves and vantage points are exact whole
numbers, and of equal ones the smaller number wins. All vectors of a batch walk side by side, each by its own order.

A task passes on 64 sums of each centroid, so what a round moves doesn't grow with the vectors' number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Centroids of a leaf.
LEAF = 2
#: Products of parts under this stay exact as doubles; sums of larger ones are Python's whole numbers.
EXACT = 2.0**21
#: Vectors that walk the tree side by side.
AT_ONCE = 4096
#: Sums travel as digits to this base, which a long holds even of many tasks.
DIGIT_BITS, DIGITS = 44, 5


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of whole numbers, exact."""
    d = x - c
    return (d * d).sum(1)


@dataclass
class Node:
    """A vantage point's subtree, or a leaf: its own centroids (one, for a vantage point) and its children with the least and
    largest distance of their members from the vantage point."""

    own: list[int]
    children: list[int] = field(default_factory=list)
    near: list[float] = field(default_factory=list)
    far: list[float] = field(default_factory=list)


class VantageTree:
    """Centroids as rows of whole numbers (doubles, or Python's numbers where those are not exact)."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF) -> None:
        self.centroids, self.nodes = centroids, []
        if len(centroids):
            self._build(list(range(len(centroids))), leaf)

    def _build(self, members: list[int], leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(Node(members))
        if len(members) <= leaf:
            return at
        vantage, rest = members[0], members[1:]
        away = np.sqrt(_distances(self.centroids[rest], self.centroids[[vantage]]).astype(float))
        order = np.argsort(away, kind="stable")
        node = Node([vantage])
        self.nodes[at] = node
        for part in (order[: (len(rest) + 1) // 2], order[(len(rest) + 1) // 2 :]):
            if len(part):
                node.near.append(float(away[part].min()))
                node.far.append(float(away[part].max()))
                node.children.append(self._build(sorted(rest[k] for k in part), leaf))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest centroid, the smallest of equal ones, and its squared distance."""
        n = len(x)
        best, found = np.full(n, np.inf if x.dtype != object else 1 << 1000, dtype=x.dtype), np.zeros(n, np.int64)
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        walking = np.arange(n)
        while len(walking):
            pick = bound[walking].argmin(1)
            least = bound[walking, pick]
            # inclusive, with room for the rounding of roots
            limit = np.sqrt(best[walking].astype(float)) * (1 + 1e-9) + 1e-9
            on = (least <= limit) & np.isfinite(least)
            walking, pick = walking[on], pick[on]
            for number in np.unique(pick):
                node, rows = self.nodes[number], walking[pick == number]
                bound[rows, number], before = np.inf, bound[rows, number]
                for c in node.own:
                    d = _distances(x[rows], self.centroids[[c]])
                    closer = (d < best[rows]) | ((d == best[rows]) & (c < found[rows]))
                    best[rows[closer]], found[rows[closer]] = d[closer], c
                if node.children:
                    away = np.sqrt(d.astype(float))
                    for child, near, far in zip(node.children, node.near, node.far, strict=True):
                        gap = np.maximum(near - away, away - far) * (1 - 1e-9) - 1e-9
                        bound[rows, child] = np.maximum(before, gap)
        return found, best


def kept_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows with exactly WIDTH parts, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.filter(F.col("embedding").isNotNull() & (F.size("embedding") == WIDTH) & F.forall("embedding", finite)).select("vec_id", "embedding")


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's vectors as rows of floor(SCALE * x): doubles, or Python's numbers if squares of some aren't exact."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
    return exact(np.floor(SCALE * flat).reshape(-1, WIDTH))


def _objects(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def exact(x: np.ndarray) -> np.ndarray:
    return x if np.abs(x).max(initial=0) < EXACT else _objects(x)


def _alike(x: np.ndarray, tree: VantageTree) -> tuple[np.ndarray, VantageTree]:
    """Vectors and tree in one kind of number, by the larger of them."""
    if x.dtype == tree.centroids.dtype:
        return x, tree
    return (_objects(x), tree) if tree.centroids.dtype == object else (x, VantageTree(_objects(tree.centroids)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(lo, AT_ONCE)


def digits(n: int) -> list[int]:
    """A whole number as DIGITS digits, of which all but the last are below 2**DIGIT_BITS; their sums add up alike."""
    out = []
    for _ in range(DIGITS - 1):
        out.append(n & ((1 << DIGIT_BITS) - 1))
        n >>= DIGIT_BITS
    return [*out, n]


def undigits(values: list[int]) -> int:
    return sum(int(v) << (DIGIT_BITS * k) for k, v in enumerate(values))


SUMS = ["cluster", "part", "n", *(f"d{k}" for k in range(DIGITS))]


def _summed(tree: VantageTree):
    """A row for each centroid and part that a task has vectors of: (cluster, part, n, digits of the sum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tree.centroids)
        sums, counts = [[0] * WIDTH for _ in range(k)], [0] * k
        for batch in _parts(batches):
            x, mine = _alike(whole(batch), tree)
            found, _ = mine.nearest(x)
            for c in np.unique(found).tolist():
                at = found == c
                counts[c] += int(at.sum())
                sums[c] = [a + int(b) for a, b in zip(sums[c], x[at].sum(0), strict=True)]
        rows = [(c, p, counts[c], *digits(sums[c][p])) for c in range(k) if counts[c] for p in range(WIDTH)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(SUMS))], SUMS)

    return run


def _assigned(tree: VantageTree):
    """(vec_id, cluster, distance) of each vector; a distance that no long holds is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            x, mine = _alike(whole(batch), tree)
            found, best = mine.nearest(x)
            away = pa.array([int(d) if d < 1 << 63 else None for d in best], pa.int64()) if x.dtype == object else pa.array(best.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(found.astype(np.int32)), away], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; rows of one id are ordered by their parts. Those without an id start
    no cluster."""
    place = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id IS NOT NULL").select(place.alias("h"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).orderBy("h", "v").limit(k).collect()
    return exact(np.floor(SCALE * np.array([r.v for r in rows], float).reshape(-1, WIDTH)))


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of kept_vectors(), the final centroids): k centroids at most, after so many rounds.

    Fewer vectors than k give fewer centroids; without any the result is empty, as it is if no vector has an id. Rows that
    share an id are vectors of their own. Centroids are the floors of exact means; one without vectors stays.
    """
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    schema = ", ".join(f"{c} long" for c in SUMS)
    for _ in range(rounds):
        parts = vectors.mapInArrow(_summed(VantageTree(centroids)), schema)
        rows = parts.groupBy("cluster", "part").agg(*(F.sum(c).alias(c) for c in SUMS[2:])).collect()
        new = [[int(v) for v in row] for row in centroids]
        for r in rows:
            new[r.cluster][r.part] = undigits([r[f"d{i}"] for i in range(DIGITS)]) // r.n
        centroids = np.array(new, object)
        centroids = exact(centroids.astype(float)) if max(abs(v) for row in new for v in row) < EXACT else centroids
    return vectors.mapInArrow(_assigned(VantageTree(centroids)), "vec_id long, cluster int, distance long"), centroids


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector; see cluster().

    Sums of distances that no long holds are null, as are those over a distance that is null.
    """
    found, centroids = cluster(vectors, k, rounds)
    found = materialise(found, "clustered")
    hashes = [(c, hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()) for c, row in enumerate(centroids)]
    names = vectors.sparkSession.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    # a row for each of the k centroids at most
    sums = found.groupBy("cluster").agg(total.alias("own")).collect()
    whole_sum = None if any(r.own is None for r in sums) else sum(int(r.own) for r in sums)
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    inertias = vectors.sparkSession.createDataFrame([(r.cluster, fits(r.own), fits(whole_sum)) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return found.join(F.broadcast(inertias.join(names, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster; see kept_vectors() and cluster() for nulls, repeated ids and few vectors."""
    return clustered(kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _op12_sql() -> str:
    """Ten rounds, written one after the other."""
    steps = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row_, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, v AS m FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {CENTROIDS}))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT row_, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT row_, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{k}) GROUP BY row_, vec_id, v)""")
        if k < ROUNDS:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{k} o LEFT JOIN (SELECT c, list(floor_ ORDER BY i) AS m FROM (SELECT c, i, (s - ((s % n) + n) % n) // n AS floor_ FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({WIDTH})) AS i FROM a{k}) GROUP BY c, i)) GROUP BY c) n ON n.c = o.c)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} m ON m.c = a.c
"""


OP12_SQL = _op12_sql()
