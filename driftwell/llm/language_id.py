"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword; for each bit a linear classifier of hashed n-gram frequencies tells the languages with 1
from those with -1. A text gets the language whose codeword has the least loss against the bits' margins, each bit
weighted by how well it knew that language in training; a narrow win is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

BUCKET_BITS = 14
ORDERS = (1, 2, 3)
#: Bounds of what is fitted on: documents of each language, fewer if SAMPLE_ROWS don't suffice for all languages but never
#: under LEAST_DOCS, picked by a hash of doc_id; of a longer text CHARS_PER_DOC characters in a row from a hashed place.
DOCS_PER_LANG, SAMPLE_ROWS, LEAST_DOCS, CHARS_PER_DOC = 400, 20_000, 20, 20_000
#: Up to this many languages every split of them has a bit.
EXHAUSTIVE_UP_TO = 6
STEPS, ROWS_AT_ONCE, RATE, DECAY, SCALE = 80, 512, 0.15, 1e-4, 12.0
#: A text is ambiguous if the two best languages' losses differ by less.
NARROW = 0.25
CHARS_AT_ONCE = 300_000
UNKNOWN = "und"

_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_ASCII[0] = 0


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1: all splits for few languages, else random columns that are far apart."""
    if k <= EXHAUSTIVE_UP_TO:
        return np.array([[1 if i == 0 or not (j + 1) >> (i - 1) & 1 else -1 for j in range(2 ** (k - 1) - 1)] for i in range(k)], np.float32).reshape(k, -1)
    rng, best = np.random.default_rng(7), None
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(200 if k < 100 else 20):
        code = rng.choice(np.array([-1, 1], np.float32), (k, n))
        apart = (n - (code @ code.T - 2 * n * np.eye(k, dtype=np.float32)).max()) / 2
        if (np.abs(code.sum(0)) < k).all() and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


def _segments(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of some texts or parts of long ones at a time, with where each part starts, its number of places and whose it
    is. After each part stand the two codes that its last n-grams run into: the text's next ones, or zeros."""
    parts, starts, sizes, owner, n = [], [], [], [], 0
    for k, text in enumerate(texts):
        codes = np.frombuffer((text.lower() + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        for lo in range(0, len(codes) - 2, CHARS_AT_ONCE):
            part = codes[lo : lo + CHARS_AT_ONCE + 2]
            parts.append(part)
            starts.append(n)
            sizes.append(len(part) - 2)
            owner.append(k)
            n += len(part)
            if n >= CHARS_AT_ONCE:
                yield np.concatenate(parts), np.array(starts), np.array(sizes), np.array(owner)
                parts, starts, sizes, owner, n = [], [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(starts), np.array(sizes), np.array(owner)


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    codes = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], codes)
    with np.errstate(over="ignore"):
        h = codes * _PRIMES[0] + np.uint32(order * 0x27D4EB2F)
        for k in range(1, order):
            h[:-k] = (h[:-k] ^ (h[:-k] >> np.uint32(15))) * _PRIMES[1] + codes[k:] * _PRIMES[2]
            h[-k:] = 0
        return (h * _PRIMES[0]) >> np.uint32(32 - BUCKET_BITS)


class Counts:
    """Frequencies of the n-gram buckets of texts, those that occur alone."""

    def __init__(self, texts: list[str]) -> None:
        self.buckets, self.shares = [], []
        for lo in range(0, len(texts), 64):
            part = texts[lo : lo + 64]
            found: list[list[np.ndarray]] = [[] for _ in part]
            for codes, starts, sizes, owner in _segments(part):
                for order in ORDERS:
                    buckets = _buckets(codes, order).astype(np.uint16)
                    for k, s, n in zip(owner, starts, sizes, strict=True):
                        found[k].append(buckets[s : s + n])
            for mine in found:
                at, n = np.unique(np.concatenate(mine), return_counts=True) if mine else (np.zeros(0, np.uint16), np.zeros(0))
                self.buckets.append(at)
                self.shares.append((n / max(n.sum(), 1)).astype(np.float32))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), 1 << BUCKET_BITS), np.float32)
        for k, row in enumerate(rows):
            out[k, self.buckets[row]] = self.shares[row]
        return out


def margins_of(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Each text's mean n-gram weight, per bit."""
    sums, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for codes, starts, sizes, owner in _segments(texts):
        beyond = np.concatenate([starts + sizes, starts + sizes + 1])
        for order in ORDERS:
            met = weights[_buckets(codes, order)]
            met[beyond] = 0
            np.add.at(sums, owner, np.add.reduceat(met, starts, axis=0))
        np.add.at(n, owner, len(ORDERS) * sizes)
    return sums / np.maximum(n, 1)[:, None]


@dataclass
class CodedClassifier:
    langs: list[str]
    code: np.ndarray  # languages x bits
    trust: np.ndarray  # languages x bits, rows sum to 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> CodedClassifier:
        names = sorted(set(langs))
        code = codewords(len(names)) if names else np.zeros((0, 0), np.float32)
        bits = code.shape[1]
        w, b = np.zeros((1 << BUCKET_BITS, bits), np.float32), np.zeros(bits, np.float32)
        if not bits:
            return cls(names, code, np.ones_like(code), w, b)
        counts, at = Counts(texts), np.array([names.index(v) for v in langs])
        share = np.bincount(at, minlength=len(names))
        of_row = (len(at) / share[at] / len(names)).astype(np.float32)[:, None]
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
        rng, step, parts = np.random.default_rng(3), 0, max(1, len(at) // ROWS_AT_ONCE)
        for _ in range(max(STEPS // parts, 4)):
            for rows in np.array_split(rng.permutation(len(at)), parts):
                step += 1
                x, y = counts.dense(rows) * np.float32(SCALE), code[at[rows]]
                p = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * of_row[rows] / len(rows)
                for (v, m, s), g in zip(((w, 0, 1), (b, 2, 3)), (x.T @ p + DECAY * w, p.sum(0)), strict=True):
                    moments[m] += 0.1 * (g - moments[m])
                    moments[s] += 0.01 * (g * g - moments[s])
                    v -= RATE * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[s] / (1 - 0.99**step)) + 1e-8)
        right = np.zeros((len(names), bits))
        for rows in np.array_split(np.arange(len(at)), parts):
            np.add.at(right, at[rows], np.sign(counts.dense(rows) @ w * SCALE + b) == code[at[rows]])
        trust = right / share[:, None] + 1e-3
        return cls(names, code, trust / trust.sum(1, keepdims=True), w * np.float32(SCALE), b)

    def losses(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the logistic loss of each codeword against the bits' margins, weighted by trust."""
        margins = margins_of(texts, self.weights) + self.bias
        ones, others = self.trust * (self.code > 0), self.trust * (self.code < 0)
        return np.logaddexp(0, -margins) @ ones.T + np.logaddexp(0, margins) @ others.T

    def decode(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of texts; UNKNOWN with score 0 where there is no letter or nothing learned."""
        with_letters = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))] if self.langs else []
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        if not with_letters:
            return out
        if len(self.langs) == 1:
            return [(self.langs[0], 1.0, False) if k in set(with_letters) else x for k, x in enumerate(out)]
        loss = self.losses([texts[k] for k in with_letters])
        order = np.argsort(loss, axis=1, kind="stable")
        best, second = np.take_along_axis(loss, order[:, :2], 1).T
        for row, k in enumerate(with_letters):
            out[k] = (self.langs[order[row, 0]], float(np.exp(-best[row])), bool(second[row] - best[row] < NARROW))
        return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> CodedClassifier:
    """Fits on about DOCS_PER_LANG documents of each language of `lang`, none of them held out; see the bounds above."""
    seen = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in seen.groupBy("lang").count().collect()}
    if not sizes:
        return CodedClassifier.fit([], [])
    each = max(LEAST_DOCS, min(DOCS_PER_LANG, SAMPLE_ROWS // len(sizes)))
    # from an Arrow table, since a list of rows starts Python workers of another kind, which then stay beside the others
    size = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"lang": list(sizes), "size": list(sizes.values())})))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - CHARS_PER_DOC, F.lit(0)) + 1) + 1
    picked = seen.join(size, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.col("size")) < each)
    rows = picked.select(F.substring("text", start.cast("int"), F.lit(CHARS_PER_DOC)).alias("text"), "lang").limit(2 * each * len(sizes)).collect()
    rows.sort(key=lambda r: (r.lang, r.text))
    return CodedClassifier.fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: CodedClassifier | None = None) -> DataFrame:
    """docs with lang_pred, lang_score and lang_ambiguous, which replace columns of those names.

    A null text or one without a letter gets UNKNOWN, score 0 and ambiguous; every other text a learned language. The
    score is exp(-loss) of that language's codeword, whatever the number of languages: about 1 for a sure text, a half
    for one of which no bit knows anything, less for one that fits no codeword.
    Only text is an input of a prediction. Without labelled rows every text gets UNKNOWN; an empty table gives none.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    in_small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            texts = batch.column(at).to_pylist()
            for lo in range(0, len(texts), 256):
                found += shared.value.decode([t or "" for t in texts[lo : lo + 256]])
            cols = [list(c) for c in zip(*found, strict=True)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], [*batch.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(False).alias("lang_ambiguous")).schema
    for name in ("lang_pred", "lang_score", "lang_ambiguous"):
        schema[name].nullable = True
    return docs.mapInArrow(run, schema)


def op1_language(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from rows that aren't held out; see identify() for nulls and odd texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
