from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import jaccard_join, suffix_dedup
from driftwell.llm.common import materialise
from driftwell.llm.exact_dedup import CuckooIndex, exact_dedup, keep_first, live_groups, update_index
from driftwell.llm.jaccard_join import jaccard_components, keep_one_of_each
from driftwell.llm.suffix_dedup import remove_repeats

from .data import COLUMNS, frame, rows, words


def test_cuckoo_index_inserts_deletes_and_grows():
    index, keys = CuckooIndex(4), [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k, key in enumerate(keys):
        assert index.insert(key, k)[1] == k
    assert len(index) == 3000 and index.mask > 4
    assert all(index.find(key)[1] == k for k, key in enumerate(keys))
    assert index.insert(keys[5], "other")[1] == 5
    for key in keys[::2]:
        assert index.delete(key)
    assert not index.delete(keys[0])
    assert all((index.find(key) is None) == (k % 2 == 0) for k, key in enumerate(keys))


def test_exact_dedup_equals_brute_force(spark):
    found = rows()
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in found:
        groups[norm(t)].append(i)
    expected, seen = [], set()
    for i, t in sorted(found, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = groups[norm(t)]
        least = min((x for x in ids if x is not None), default=None)
        kept = i == least and (i, norm(t)) not in seen
        seen.add((i, norm(t)))
        expected.append((i, least, len(ids), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(frame(spark)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    kept = keep_first(frame(spark))
    assert kept.columns == frame(spark).columns
    assert kept.count() == len(groups)
    assert exact_dedup(spark.createDataFrame([], COLUMNS)).count() == 0


def test_index_follows_insertions_and_deletions(spark):
    key = lambda k: hashlib.sha256(bytes([k])).digest()
    of = lambda pairs: spark.createDataFrame([(bytearray(key(k)), i) for k, i in pairs], "digest binary, doc_id long")
    empty = spark.createDataFrame([], "digest binary, doc_id long, n long")
    one = update_index(empty, of([(1, 5), (1, 4), (2, 9), (4, None), (4, None), (4, 6)]), of([]))
    two = update_index(one, of([(3, 7), (5, 2)]), of([(1, 4), (2, 9), (8, 1), (4, None), (5, 2), (5, 2)]))
    assert {(bytes(r.digest), r.doc_id, r.n) for r in two.collect()} == {(key(1), 5, 1), (key(3), 7, 1), (key(4), None, 1), (key(4), 6, 1)}
    assert {(bytes(r.digest), r.keep_id, r.group_size) for r in live_groups(two).collect()} == {(key(1), 5, 1), (key(3), 7, 1), (key(4), 6, 2)}


def _shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _repeated_ids() -> list[tuple]:
    """Rows whose doc_id has another text, too, or none: every set links with the next, whatever its id."""
    rng, found = random.Random(8), []
    for k in range(20):
        base = words(rng, 100).split()
        for step in range(4):
            found.append(([k, k, None, 1000 + k][step], " ".join(base)))
            base[10 * step] = f"other{step}"
    return found


@pytest.mark.parametrize("seed", [1, 2, None])
def test_jaccard_components_equal_brute_force(spark, seed):
    found = rows(seed) if seed else _repeated_ids()
    sets = [_shingles(t) for _, t in found]
    root = list(range(len(found)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(found)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(found):
        if i is not None:
            least[find(k)].append(i)
    expected = [(i, len(sets[k]), min(least[find(k)], default=None)) for k, (i, _) in enumerate(found)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, found)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_jaccard_link_at_the_edge_of_a_group(spark):
    """A (100 shingles) links with B (104) alone, and shares the least number of rare ones with B's group (103 to 105)."""
    found, groups = [], []
    for k in range(12):
        word = lambda name, n: [f"{name}{k}x{i}" for i in range(n)]  # noqa: B023, E731
        same, tail = word("s", 95), word("t", 13)
        texts = [word("a", 9) + same, same + tail, same[1:] + tail, same + tail + word("d", 1), word("e", 60) + same[:5] + word("f", 60)]
        assert [len(_shingles(" ".join(t))) for t in texts[:4]] == [100, 104, 103, 105]
        found += [(10 * k + i, " ".join(t)) for i, t in enumerate(texts)]
        groups += [(10 * k + i, 10 * k if i < 4 else 10 * k + 4) for i in range(5)]
    got = [(r.doc_id, r.component_id) for r in jaccard_components(frame(spark, found)).collect()]
    assert sorted(got) == groups


def test_bound_of_groups_is_the_least_of_all_sizes(spark):
    def fewest(n, m):
        return max(1, -(-4 * (n + m) // 9) + (-4 * max(n, m) // 5) + 1)

    cases = [(n, low, high) for n in (1, 7, 45, 100, 333) for low in range(-(-4 * n // 5), 5 * n // 4 + 1) for high in range(low, 5 * n // 4 + 1) if n < 300 or low % 7 == 0]
    got = spark.createDataFrame(cases, "n long, low long, high long").select("n", "low", "high", jaccard_join._fewest_within(F.col("n"), F.col("low"), F.col("high")).alias("c")).collect()
    assert all(r.c == min(fewest(r.n, m) for m in range(r.low, r.high + 1)) for r in got)


def test_jaccard_of_nothing_and_what_stays(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert jaccard_components(empty).count() == 0
    kept = keep_one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 7, None}


def _without_repeats(found, length=400):
    raws = [(t or "").encode() for _, t in found]
    starts = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for (i, _), raw in zip(found, raws, strict=True):
        gone = [False] * (len(raw) + 1)
        for k in range(len(raw) - length + 1):
            if starts[raw[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        yield i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept


@pytest.mark.parametrize("seed", [1, 3])
def test_repeats_equal_brute_force(spark, seed):
    found = rows(seed)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(frame(spark, found), with_bytes=True).collect()]
    assert sorted(got, key=repr) == sorted(_without_repeats(found), key=repr)
    assert sum(r[2] for r in got) > 0
    assert remove_repeats(spark.createDataFrame([], COLUMNS)).count() == 0


def test_text_that_stays_after_repeats(spark):
    """The query's text is that of the bytes that stay; characters cut by a run's end go whole and don't join; copies keep their rows."""
    rng = random.Random(8)
    shared, first, second, third, short = words(rng, 150), words(rng, 40), words(rng, 40), words(rng, 40), words(rng, 51)[:390]
    # é is C3 A9, è is C3 A8, © is C2 A9: the first byte is shared by the first two texts, the last one by é and ©.
    found = [(1, first + "é" + shared + "é" + first[::-1]), (2, second + "©" + shared + "è" + second[::-1]), (3, third + short), (4, first[::-1] + short), (5, None), (6, ""), (7, "ä" * 500), (7, "ä" * 500), (None, third + shared)]
    docs = frame(spark, found)
    got = [(r.doc_id, r.n_removed, r.text, r.kept_sha256) for r in remove_repeats(docs).collect()]
    removed = {(i, sha): gone for i, _, gone, _, sha, _ in _without_repeats(found)}
    assert sorted(((i, sha), n) for i, n, _, sha in got if i) == sorted((k, n) for k, n in removed.items() for _ in range(1 + (k[0] == 7)) if k[0])
    text = sorted(((i or 0, t) for i, _, t, _ in got), key=repr)
    assert text == sorted([(0, third), (1, first + first[::-1]), (2, second + second[::-1]), (3, third + short), (4, first[::-1] + short), (5, None), (6, ""), (7, ""), (7, "")], key=repr)
    raw = "aéè".encode()
    assert suffix_dedup.kept_text(raw, np.array([False, False, True, True, False])) == "a"
    assert suffix_dedup.kept_text(raw, np.zeros(5, bool)) == "aéè" and suffix_dedup.kept_text(b"", np.zeros(0, bool)) == ""


def test_lists_dont_grow_with_a_row_repeated_10000_times(spark):
    """A row's copies share a key: they count each, its lists hold a place once, and one that shares its middle loses that."""
    text = " ".join(hashlib.sha256(str(k).encode()).hexdigest()[:9] for k in range(200))
    other = "x" + text[600:1200] + "y"
    copies = spark.range(10_000, numPartitions=8).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = copies.unionByName(spark.createDataFrame([(6, other)], "doc_id long, text string"))
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("key"))
    parse = materialise(keyed.select("key", "text").mapInArrow(suffix_dedup._parse, suffix_dedup.PARSE), "parse")
    marks = suffix_dedup._resolved(parse).collect()
    n_phrases = len(suffix_dedup.phrases(text.encode())[0])
    assert n_phrases > 3 and max(len(r.whole) for r in marks) == n_phrases and max(len(r.open) for r in marks) <= n_phrases
    got = remove_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, got)) == [(5, len(text), len(text), 1, 10_000), (6, 602, 600, 1, 1)]


def test_kept_rows_where_ids_repeat(spark):
    """Rows of one id are told apart by their sets; a null id stays only where no row of the component has an id."""
    base, other, third = ("one two three four five six seven eight nine ten " * 3).strip() + " end", " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    found = [(1, base), (2, base + " x"), (2, other), (None, base), (3, other), (1, base), (None, third), (None, third + " y"), (7, None), (7, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in found], "doc_id long, text string, lang string, keeper string, n long").repartition(3)
    got = jaccard_join.keep_one_of_each(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted((k for k in kept if k[1] in (base, other)), key=repr) == [(1, base), (2, other)]
    assert len([k for k in kept if (k[1] or "").startswith(third)]) == 1
    assert {(7, None), (7, ""), (None, " ")} <= set(kept) and len(kept) == 6
