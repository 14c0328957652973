"""Source divergence, centroid clustering and approximate neighbours against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from driftwell.llm import centroids, divergence, forest

from .data import words


def _plain_divergence(rows: list[tuple]) -> set[tuple]:
    """(lang, source, part, item, value, rank) by loops over all terms and pairs."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in in_docs.items() if n >= 10)

        def shares(found):
            counts = Counter(t for d in found for t in d[2])
            total = sum(counts[t] for t in kept)
            return counts, {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        of = {s: shares([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        whole = shares(mine)[1]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, (counts, p) in of.items():
            pairs = [(-sum(f(p[t], of[o][1][t]) for t in kept), o.encode(), o) for o in of if o != s]
            terms = [(-f(p[t], whole[t]), t.encode(), t) for t in kept if counts[t] and p[t] > whole[t]]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:10], 1)}
    return out


def _documents(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    common = [words(rng, 1) for _ in range(40)] + ["é", "ÄÖ", "日本", "naïve"]
    rows = [(rng.choice(["en", "en", "en", None, "de"]), rng.choice(["a", "b", "b", "c", "ü", None]), " ".join(rng.choices(common, k=rng.randint(0, 30))) + rng.choice([" X1y2", "", "Z_z", "\x7f\x00q"])) for _ in range(300)]
    rows += [("en", "none", None), ("en", "none", "123 !!"), ("fr", "x", "bonjour"), ("fr", "y", None), ("it", "only", "ciao " * 20)] + [rows[0]] * 5
    return rows


def test_divergence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 60)  # many runs
    monkeypatch.setattr(divergence, "BLOCK", 2)  # several blocks of sources
    rows = _documents(4)
    df = spark.createDataFrame([(k, lang, source, text, 1, 2, "t") for k, (lang, source, text) in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, docs long, term string").repartition(5)
    got = divergence.source_divergence(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _plain_divergence(rows)
    assert ("fr", "x", "pair", "y", 0, 1) in set(found) and not [r for r in found if r[0] == "it" and r[2] == "pair"]


def test_divergence_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert divergence.source_divergence(empty).count() == 0
    long_text = spark.createDataFrame([(k, "en", "ab"[k % 2], "word " * 200_000) for k in range(10)], "doc_id long, lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.source_divergence(long_text).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_runs_are_sorted_and_bounded():
    import pandas as pd

    rows = pd.DataFrame({"lang": ["en"] * 6, "source": ["a"] * 6, "text": ["b a c", "d e f g h", "a a", "i j k l m n o p", "b", None]})
    runs = pd.concat(list(divergence._runs(3, 8)(iter([rows]))))
    assert runs["run"].nunique() > 1 and all(r.terms.split() == sorted(set(r.terms.split())) for r in runs.itertuples())
    merged = pd.concat([divergence._merged(2)((s,), part) for s, part in runs.groupby("shard")])
    assert dict(zip(merged["term"], merged["n"], strict=True)) == {"a": 3, "b": 2} and merged["term_id"].is_unique


# -- centroids ------------------------------------------------------------------------------------------------


def _plain_clusters(ids: list, v: list[list[float]], k: int = 8, rounds: int = 10):
    whole = [[int(np.floor(1024 * x)) for x in row] for row in v]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v[n], n) for n, i in enumerate(ids) if i is not None)
    c = [whole[n] for _, _, n in order[:k]]
    away = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    assign = lambda: [min((away(x, m), j) for j, m in enumerate(c)) for x in whole]
    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [x for x, (_, a) in zip(whole, at, strict=True) if a == j]
            c[j] = [sum(p) // len(mine) for p in zip(*mine, strict=True)] if mine else c[j]
    at = assign()
    sums = [sum(d for d, a in at if a == j) for j in range(len(c))]
    return [(i, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, (d, j) in zip(ids, at, strict=True)]


@pytest.mark.parametrize("large", [1.0, 2e4])
def test_clusters_equal_brute_force(spark, large):
    rng = np.random.default_rng(2)
    v = [[float(np.float32(x)) for x in large * rng.standard_normal(64)] for _ in range(60)]
    v[10:25] = [v[10]] * 15
    ids = [*range(55), 54, 54, None, None, 7]
    bad = [(90, None), (91, [1.0] * 63), (92, [None] * 64), (93, [float("nan")] * 64), (94, [float("inf")] * 64), (95, [])]
    df = spark.createDataFrame([(i, x, 0, "c") for i, x in [*zip(ids, v, strict=True), *bad]], "vec_id long, embedding array<float>, cluster int, distance string").repartition(4)
    got = centroids.clustered(centroids.kept_vectors(df))
    expected = _plain_clusters(ids, v)
    if large > 1:  # distances and their sums are beyond what doubles hold exactly
        assert max(r[2] for r in expected) > 2**53
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.clustered(centroids.kept_vectors(spark.createDataFrame([], schema))).count() == 0
    two = spark.createDataFrame([(1, [0.5] * 64), (2, [-0.5] * 64)], schema)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in centroids.clustered(centroids.kept_vectors(two)).collect()) == [(1, 0, 0), (2, 0, 0)]
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), *((k, [0.0] * 64) for k in range(3, 12))], schema)
    assert centroids.clustered(centroids.kept_vectors(huge)).count() == 11


def test_tree_prunes_and_sees_ties():
    rng = np.random.default_rng(1)
    c = np.floor(np.concatenate([rng.standard_normal((20, 64)) * 5 + k * 400 for k in range(5)]))
    c[30], c[77] = c[3], c[3]
    x = np.concatenate([c[rng.integers(0, 100, 200)] + rng.integers(-3, 4, (200, 64)), (c[[1]] + c[[50]]) / 2 // 1])
    tree, counted = centroids.VantageTree(c), []
    plain = centroids._distances
    try:
        centroids._distances = lambda a, b: (counted.append(len(a)), plain(a, b))[1]
        found, best = tree.nearest(x)
    finally:
        centroids._distances = plain
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    assert (found == d.argmin(1)).all() and (best == d.min(1)).all()
    assert sum(counted) < 0.6 * len(x) * len(c)
    assert [centroids.undigits(centroids.digits(n)) for n in (0, -1, 3**100, -(7**70))] == [0, -1, 3**100, -(7**70)]


# -- neighbours -----------------------------------------------------------------------------------------------


def _recall(spark, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[float, dict]:
    df = spark.createDataFrame([(int(i), [float(x) for x in row], "b", 1) for i, row in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, block string, side int").repartition(3)
    vectors = forest.usable(df)
    got: dict = {}
    for r in forest.neighbours(vectors, vectors.filter("vec_id % 20 = 0"), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = (v * v[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        top = [int(x) for x in ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]]]
        hits, total = hits + len(set(top) & {i for _, i, _ in got[q]}), total + len(top)
        assert sorted(got[q]) == [(n, i, x) for n, (_, i, x) in enumerate(sorted((-x, i, x) for _, i, x in got[q]), 1)]
        assert all(x == s[ids == i][0] for _, i, x in got[q])
    return hits / total, got


def test_forest_finds_neighbours(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    v[200:700] = v[200]  # a third is one vector, of which the smallest ids count
    assert _recall(spark, v, np.arange(1500), 10)[0] >= 0.9
    clustered = (rng.standard_normal((40, 24)) * 3)[rng.integers(0, 40, 1200)] + rng.standard_normal((1200, 24)) * 0.3
    assert _recall(spark, clustered, np.arange(1200) * 5, 10)[0] >= 0.9


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0, 5.0]), (1, [1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf")]), (None, [1.0, 1.0]), (8, [2.0, 2.0]), (8, [2.0, 2.0]), (0, [1.0, 0.0])]
    vectors = forest.usable(spark.createDataFrame(rows, schema))
    got = sorted(tuple(r) for r in forest.neighbours(vectors, vectors.filter("vec_id % 20 = 0"), 20).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, 1, 8, 2.0), (0, 2, 8, 2.0), (0, 3, 1, 1.0), (0, 4, 20, 0.0), (20, 1, 8, 2.0), (20, 2, 8, 2.0), (20, 3, 0, 0.0), (20, 4, 0, 0.0), (20, 5, 1, 0.0)]
    empty = spark.createDataFrame([], schema)
    assert forest.neighbours(empty, vectors).count() == 0 and forest.neighbours(vectors, empty).count() == 0


def test_ascent_takes_longest_prefixes_first():
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((400, 16))
    rows[50:60] = rows[50]
    rows /= np.sqrt((rows * rows).sum(1))[:, None]
    f = forest.Forest(rows, trees=12)
    lo, hi = f.ranges(rows[[50]])
    at, needed = f.arrivals(lo[:, :, 0], hi[:, :, 0], 10**9)
    assert sorted(at) == list(range(400)) and set(range(50, 60)) <= set(at[:25]) and (np.diff(needed) >= 0).all()
    few, _ = f.arrivals(lo[:, :, 0], hi[:, :, 0], 5)
    assert set(range(50, 60)) <= set(few) and len(few) < 400
    assert all((hi[d + 1] - lo[d + 1] >= hi[d] - lo[d]).all() for d in range(f.letters - 1))
