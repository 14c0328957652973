"""How each source's words differ from its language's, and from each other source's: single-pass in-memory indexing.

1. Scan tasks count terms in memory, block by block: postings of (term, lang, source), with count and documents. A full block
   is passed on as a run in the order of shards and terms, so memory holds one block whatever the input.
2. Shards are by a hash of the term, and their number follows that of the documents. A shard's task merges its runs with a
   heap into frequencies; a term has a posting for each source and run at most, however frequent it is. Terms in few
   documents of a language go here.
3. With each group's total, frequencies give probabilities in whole billionths.
4. A pair of sources differs by what two sources without any of the words would, times the number of terms, plus a correction
   for each term that either has. Corrections are streamed term by term into one block of the matrix of pairs: blocks are of
   BLOCK by BLOCK sources and terms are dealt in chunks, so neither many sources nor a common language is one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_small_batches, materialise, slices_of, small_side

#: A term is kept with so many documents of its language; ranks of the parts `term`.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Postings that a scan task holds before it passes them on, and the documents whose postings a shard merges or so.
BLOCK_POSTINGS, SHARD_DOCS = 250_000, 5_000
#: Sources of a side of a block of pairs, and kept postings of a chunk of terms or so.
BLOCK, CHUNK_POSTINGS = 256, 200_000
#: The whole that probabilities are parts of, and what a byte of a term counts as: A to Z in lower case, other
#: letters and bytes over 127 as they are, all else a space. Bytes over 127 are those of UTF-8's other characters.
WHOLE = 1_000_000_000
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))

KEPT = "lang string, source string, term string, term_id long, n long, in_lang long"
RUN = "shard int, run long, langs array<string>, sources array<string>, terms binary, sizes binary, at binary, n binary, docs binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def _runs(shards: int, most: int):
    """Runs of rows (lang, source, text): each block of a task, of `most` postings or so, sorted by shard, term and group. A row
    is a shard's part of a run: its terms, how many postings each has, and the postings' groups and numbers."""

    def passed_on(block: dict, run: int) -> Iterator[pd.DataFrame]:
        groups, terms = list(block), []
        parts: list[tuple[np.ndarray, ...]] = []
        for g, (n, docs) in enumerate(block.values()):
            terms += n
            parts.append((np.full(len(n), g), np.fromiter(n.values(), np.int64, len(n)), np.fromiter(map(docs.__getitem__, n), np.int64, len(n))))
        if not terms:
            return
        distinct = sorted(set(terms))
        rank = {t: k for k, t in enumerate(distinct)}
        term = np.fromiter(map(rank.__getitem__, terms), np.int64, len(terms))
        group, n, docs = (np.concatenate(p) for p in zip(*parts, strict=True))
        shard = np.fromiter((zlib.crc32(t) % shards for t in distinct), np.int64, len(distinct))[term]
        order = np.lexsort((group, term, shard))
        group, n, docs, term, shard = group[order], n[order], docs[order], term[order], shard[order]
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        rows = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            mine, sizes = np.unique(term[lo:hi], return_counts=True)
            used, at = np.unique(group[lo:hi], return_inverse=True)
            names = [groups[g] for g in used]
            rows.append((int(shard[lo]), run, [x[0] for x in names], [x[1] for x in names], b" ".join(distinct[t] for t in mine), *(x.tobytes() for x in (sizes.astype("<i4"), at.astype("<i4"), n[lo:hi].astype("<i8"), docs[lo:hi].astype("<i8")))))
        yield pd.DataFrame(rows, columns=["shard", "run", "langs", "sources", "terms", "sizes", "at", "n", "docs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, done = {}, 0, 0
        for rows in batches:
            for lang, source, text in zip(rows["lang"], rows["source"], rows["text"], strict=True):
                n, docs = block.setdefault((lang, source), (Counter(), Counter()))
                before, terms = len(n), terms_of(text)
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
                if held >= most:
                    yield from passed_on(block, done)
                    block, held, done = {}, 0, done + 1
        yield from passed_on(block, done)

    return run


def _merged(least: int):
    """A shard's runs, merged by a heap in the order of terms: (lang, source, term, term_id, n, in_lang) of terms that are in
    `least` documents of the language; in_lang: how often that has the term. Shards are by term, so all of it is here."""

    def run(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        groups: dict[tuple, int] = {}
        terms = [r.terms.split(b" ") for r in runs.itertuples(index=False)]
        placed = [np.empty(len(t), np.int64) for t in terms]
        distinct: list[bytes] = []
        for term, k, at in heapq.merge(*(zip(t, repeat(k), range(len(t))) for k, t in enumerate(terms))):
            if not distinct or term != distinct[-1]:
                distinct.append(term)
            placed[k][at] = len(distinct) - 1
        term, group, n, docs = [], [], [], []
        for p, r in zip(placed, runs.itertuples(index=False), strict=True):
            number = np.array([groups.setdefault(g, len(groups)) for g in zip(r.langs, r.sources, strict=True)], np.int64)
            term.append(np.repeat(p, np.frombuffer(r.sizes, "<i4")))
            group.append(number[np.frombuffer(r.at, "<i4")])
            n.append(np.frombuffer(r.n, "<i8"))
            docs.append(np.frombuffer(r.docs, "<i8"))
        term, group, n, docs = (np.concatenate(x) for x in (term, group, n, docs))
        names = list(groups)
        langs = sorted({g[0] for g in names})
        lang_of = np.array([langs.index(g[0]) for g in names])

        def added(by: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
            keys, at = np.unique(by, return_inverse=True)
            sums = [np.zeros(len(keys), np.int64) for _ in values]
            for s, v in zip(sums, values, strict=True):
                np.add.at(s, at, v)
            return keys, *sums

        posting, n, docs = added(term * len(names) + group, n, docs)
        term, group = posting // len(names), posting % len(names)
        in_lang, at = np.unique(term * len(langs) + lang_of[group], return_inverse=True)
        every, of = (np.zeros(len(in_lang), np.int64) for _ in range(2))
        np.add.at(every, at, n)
        np.add.at(of, at, docs)
        stay = np.flatnonzero(of[at] >= least)
        return pd.DataFrame({"lang": [names[g][0] for g in group[stay]], "source": [names[g][1] for g in group[stay]], "term": [distinct[t].decode("utf-8", "replace") for t in term[stay]], "term_id": (term[stay] << 24) + key[0], "n": n[stay], "in_lang": every[at][stay]})

    return run


def kept_frequencies(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, term_id, n, in_lang): how often each group has each of its terms, of those that `least` documents
    of the language have, and how often the language has it."""
    spark = docs.sparkSession
    in_small_batches(spark)
    shards = min(1 << 24, max(slices_of(spark), docs.count() // SHARD_DOCS))
    runs = docs.select("lang", "source", "text").mapInPandas(_runs(shards, BLOCK_POSTINGS), RUN)
    return runs.repartition(shards, "shard").groupBy("shard").applyInPandas(_merged(least), KEPT)


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(WHOLE * (n + 2) / (total + 2 kept)) in whole numbers; null without kept terms."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * CAST({WHOLE} AS DECIMAL(10, 0))) DIV CAST({total} + 2 * {kept} AS DECIMAL(20, 0)) END")


#: differences() as a Column, of shares p and q.
DIFFERENCE = "((p - q) * (p - q)) DIV (p + q)"


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of whole positive numbers up to WHOLE + 1, exactly."""
    return (p - q) ** 2 // (p + q)


#: Numbers of a block of terms by pairs of sources that are worked out at a time.
AT_ONCE = 1 << 20


class PairBlock:
    """The sums of a block of pairs of sources: what terms add to the difference of two sources without any of them."""

    def __init__(self, base_a: np.ndarray, base_b: np.ndarray) -> None:
        self.a, self.b = base_a, base_b
        self.base = differences(base_a[:, None], base_b[None, :])
        self.total = np.zeros_like(self.base)

    def add_sparse(self, at_a: np.ndarray, p_a: np.ndarray, at_b: np.ndarray, p_b: np.ndarray) -> None:
        """One term that few sources have: only their rows and columns change."""
        columns = self.b.copy()
        columns[at_b] = p_b
        self.total[at_a] += differences(p_a[:, None], columns[None, :]) - self.base[at_a]
        absent = np.ones(len(self.a), bool)
        absent[at_a] = False
        rest = np.flatnonzero(absent)
        if len(rest) and len(at_b):
            self.total[np.ix_(rest, at_b)] += differences(self.a[rest][:, None], p_b[None, :]) - self.base[np.ix_(rest, at_b)]

    def add_dense(self, n_terms: int, term: np.ndarray, side: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
        """Postings of terms 0, 1, ... in order, many terms at a time."""
        step = max(1, AT_ONCE // self.base.size)
        left, right = side != 1, side != 0
        for lo in range(0, n_terms, step):
            n = min(step, n_terms - lo)
            rows, columns = np.tile(self.a, (n, 1)), np.tile(self.b, (n, 1))
            for grid, mine in ((rows, left), (columns, right)):
                here = np.flatnonzero(mine & (term >= lo) & (term < lo + n))
                grid[term[here] - lo, at[here]] = p[here]
            self.total += differences(rows[:, :, None], columns[:, None, :]).sum(0) - n * self.base


def _corrections(size: int):
    """(lang, a, b, value): what terms add to pairs of sources, in blocks of size by size. Rows are sorted by lang, block row,
    block column and chunk; a header comes first (side 3), with the shares of words that the sources of both sides don't have,
    then postings by term."""

    def given(key: tuple, block: PairBlock) -> pd.DataFrame:
        lang, i, j = key
        a, b = np.nonzero(np.triu(block.total) if i == j else block.total)
        return pd.DataFrame({"lang": lang, "a": a + i * size, "b": b + j * size, "value": block.total[a, b]})

    def add(block: PairBlock, term: np.ndarray, side: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
        if not len(term):
            return
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        sizes = np.diff(np.append(starts, len(term)))
        many = 4 * sizes >= len(block.a)
        number = np.cumsum(many) - 1
        dense = np.repeat(many, sizes)
        block.add_dense(int(many.sum()), np.repeat(number, sizes)[dense], side[dense], at[dense], p[dense])
        for s, n in zip(starts[~many], sizes[~many], strict=True):
            left, right = side[s : s + n] != 1, side[s : s + n] != 0
            block.add_sparse(at[s : s + n][left], p[s : s + n][left], at[s : s + n][right], p[s : s + n][right])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block, waiting = None, None, None  # waiting: the postings of the term that may go on in the next batch
        for rows in batches:
            side = rows["side"].to_numpy()
            heads = [*np.flatnonzero(side == 3).tolist(), len(rows)]
            columns = [rows[c].fillna(0).to_numpy().astype(np.int64) for c in ("term_id", "side", "at", "p")]
            for lo, hi in zip([0, *heads[:-1]], heads, strict=True):
                if lo in heads[:-1]:
                    if block is not None:
                        add(block, *waiting)
                        yield given(key, block)
                    r = rows.iloc[lo]
                    key, block = (r.lang, int(r.i), int(r.j)), PairBlock(np.array(r.base_a, np.int64), np.array(r.base_b, np.int64))
                    waiting, lo = [c[:0] for c in columns], lo + 1
                if lo < hi:
                    part = [np.concatenate([w, c[lo:hi]]) for w, c in zip(waiting, columns, strict=True)]
                    last = np.searchsorted(part[0], part[0][-1])  # terms ascend
                    add(block, *(c[:last] for c in part))
                    waiting = [c[last:] for c in part]
        if block is not None:
            add(block, *waiting)
            yield given(key, block)

    return run


def pair_differences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed differences of each two sources of a language.

    kept: (lang, source, term_id, p) of the terms that a group has; groups: (lang, source, n_terms, p0), p0 the share of a term
    that it doesn't have, null without terms.
    """
    spark = kept.sparkSession
    placed = materialise(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    sides = placed.select("lang", "source", "at", F.floor(F.col("at") / BLOCK).cast("int").alias("block"), F.max(F.floor(F.col("at") / BLOCK)).over(Window.partitionBy("lang")).cast("int").alias("last"))
    chunks = max(slices_of(spark), kept.count() // CHUNK_POSTINGS)
    posted = kept.join(small_side(sides), ["lang", "source"]).withColumns({"chunk": F.pmod(F.xxhash64("term_id"), F.lit(chunks)).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("last")))})
    # of two blocks the smaller is the row; within one block a posting stands for both sides
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    posted = posted.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "chunk", "term_id", side.alias("side"), (F.col("at") % BLOCK).cast("int").alias("at"), "p")
    bases = placed.filter("n_terms > 0").groupBy("lang", F.floor(F.col("at") / BLOCK).cast("int").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "p0"))), lambda x: x["p0"]).alias("base"))
    other = bases.select("lang", F.col("block").alias("j"), F.col("base").alias("base_b"))
    heads = bases.select("lang", F.col("block").alias("i"), F.col("base").alias("base_a")).join(other, "lang").filter("i <= j")
    heads = heads.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("side", F.lit(3))
    rows = posted.unionByName(heads, allowMissingColumns=True)
    by = ["lang", "i", "j", "chunk"]
    streamed = rows.repartition(chunks, *by).sortWithinPartitions(*by, F.col("side") != 3, "term_id")
    found = streamed.mapInPandas(_corrections(BLOCK), "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    mine = placed.select("lang", "source", F.col("at").alias("a"), "n_terms", F.col("p0").alias("p"))
    theirs = placed.select("lang", F.col("source").alias("item"), F.col("at").alias("b"), F.col("p0").alias("q"))
    directed = found.filter("a < b").unionByName(found.filter("a < b").select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    base = F.expr(f"CASE WHEN n_terms > 0 THEN n_terms * ({DIFFERENCE}) ELSE 0 END")
    pairs = mine.join(theirs, "lang").filter("a <> b").join(directed, ["lang", "a", "b"], "left")
    return pairs.select("lang", "source", "item", (base + F.coalesce("value", F.lit(0))).cast("long").alias("value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text).

    Part `pair`: each other source of the language by how much the two differ, over all kept terms. Part `term`: the
    TOP_TERMS kept terms that a source has more of than its language. Null text, lang and source count as ''. A source
    without any kept term still has pairs; a language without kept terms gives pairs of value 0; a language with one source
    gives none. Repeated rows are documents of their own. Other columns aren't read; an empty table gives an empty result.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = materialise(kept_frequencies(docs), "kept")
    totals = kept.groupBy("lang", "term_id").agg(F.first("in_lang").alias("in_lang")).groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("in_lang").alias("lang_total"))
    counted = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(counted, ["lang", "source"], "left").join(totals, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n_terms", "lang_total")))
    groups = materialise(groups.withColumn("p0", _share("0", "total", "n_terms")), "sources")
    of_group = groups.select("lang", "source", "total", "n_terms", "lang_total")
    shared = kept.join(small_side(of_group), ["lang", "source"]).select("lang", "source", "term", "term_id", _share("n", "total", "n_terms").alias("p"), _share("in_lang", "lang_total", "n_terms").alias("q"))
    shared = materialise(shared, "shares")
    more = shared.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(DIFFERENCE).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP_TERMS)
    pairs = pair_differences(shared.drop("q", "term"), groups.select("lang", "source", "n_terms", "p0")).withColumn("rank", F.row_number().over(by))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(out).unionByName(terms.withColumn("part", F.lit("term")).select(out))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents; see source_divergence() for nulls, empty texts and languages without kept terms."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT row_, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row_) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
t AS (SELECT c.lang, c.source, sum(c.n) AS total FROM c JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM cell a JOIN cell b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM cell WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
