"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins an embedding of the word and one of its character n-grams, both hashed. Every text is cut in
overlapping windows of words; a text's score is that of its worst window. A word that is too long goes on as overlapping
pieces, so a text without spaces is read to its end. Training takes, in each step, the window of
a document that scores highest now (so a clean document's best window must be clean, too).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

#: Windows of LENGTH words, a new one each STRIDE words.
LENGTH, STRIDE = 48, 32
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
WORD_BITS, CHAR_BITS, CHAR_ORDERS = 14, 15, (3, 4, 5)
#: The bound of what is fitted on: about so many documents of each class, picked by a hash of doc_id, none of them longer.
DOCS_PER_CLASS, CHARS_PER_DOC = 1000, 8000
#: Passes over the sample: EPOCHS, and as many more as a small one needs for LEAST_STEPS steps.
EPOCHS, LEAST_STEPS, DOCS_AT_ONCE, RATE = 12, 150, 64, 0.03
#: Characters of a word; a longer one is cut in pieces that overlap by the longest n-gram less one.
WORD_CHARS = 64
#: Documents that must share a word or n-gram before its log-odds count half.
DOUBT = 8
#: Folds of the sample, each trained on with the log-odds of the others.
FOLDS = 5
#: Steps of the embeddings against those of the network: large ones learn single documents by heart.
TABLE_RATE = 0.05
MEMO_WORDS, WINDOWS_AT_ONCE, WORDS_AT_ONCE = 300_000, 2048, 100_000
FLAG_FROM = 0.3
EDGES = ".,!?;:\"'()[]{}*&$#%|-"

_MIX = np.uint32(0x9E3779B1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket per word, n-gram buckets of all words, which word each of them belongs to)."""
    plain = ["\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in plain])
    owner = np.repeat(np.arange(len(plain)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = (np.arange(len(codes)) - starts[owner]).astype(np.uint32)
    with np.errstate(over="ignore"):
        spread = (codes + np.uint32(1)) * (_MIX + place * np.uint32(0x85EBCA76))
        spread ^= spread >> np.uint32(15)
        whole = np.add.reduceat(spread * np.uint32(0xC2B2AE3D), starts, dtype=np.uint32) * _MIX >> np.uint32(32 - WORD_BITS)
        grams, whose, h = [], [], (codes + np.uint32(1)) * _MIX
        for order in range(2, CHAR_ORDERS[-1] + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[order - 1 :] * np.uint32(0xC2B2AE3D)
            if order in CHAR_ORDERS:
                own = owner[: len(h)] == owner[order - 1 :]
                grams.append((h[own] * _MIX) >> np.uint32(32 - CHAR_BITS))
                whose.append(owner[: len(h)][own])
    return whole.astype(np.int64), np.concatenate(grams).astype(np.int64), np.concatenate(whose)


def words_of(text: str) -> list[str]:
    """Lower-cased words without their EDGES; longer ones than WORD_CHARS as their pieces."""
    out, overlap = [], CHAR_ORDERS[-1] - 1
    for w in text.lower().split():
        w = w.strip(EDGES) or w
        if len(w) <= WORD_CHARS:
            out.append(w)
        else:
            out += [w[k : k + WORD_CHARS] for k in range(0, len(w) - overlap, WORD_CHARS - overlap)]
    return out


def windows(n: int) -> np.ndarray:
    """Where the windows of a text of n words start; the last one reaches its end."""
    return np.arange(max(1, -(-(n - LENGTH) // STRIDE) + 1)) * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters and passes. Word number 0 is padding, which leaves the state as it is."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        dim, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {
            "words": draw(1 << WORD_BITS, WORD_DIM) * np.float32(0.1), "chars": draw(1 << CHAR_BITS, CHAR_DIM) * np.float32(0.1),
            "inputs": draw(2, dim, 3 * h), "offset": np.zeros((2, 1, 3 * h), np.float32), "state": draw(2, h, 3 * h),
            "look": draw(2 * h), "out": draw(2 * h), "bias": np.array([-1.0], np.float32),
        }

    def start_from(self, features: list[tuple], toxic: np.ndarray, fold: np.ndarray) -> dict[str, np.ndarray]:
        """The first word and n-gram inputs start as log-odds of documents that have them.

        What is returned has those of all documents but a fold's, a row for each fold: a document whose own words made its
        inputs would teach the network to trust them.
        """
        others = {}
        for name, pick in (("words", 0), ("chars", 1)):
            seen = np.zeros((FOLDS, 2, len(self.p[name])))
            for f, y, k in zip(features, toxic, fold, strict=True):
                seen[k, int(y), np.unique(f[pick])] += 1
            sizes = np.array([[(1 - toxic[fold == k]).sum(), toxic[fold == k].sum()] for k in range(FOLDS)])
            odds = [self._odds(seen.sum(0), sizes.sum(0)), *(self._odds(seen.sum(0) - seen[k], sizes.sum(0) - sizes[k]) for k in range(FOLDS))]
            self.p[name][:, 0] = odds[0]
            others[name] = np.stack(odds[1:]) - odds[0]
        return others

    @staticmethod
    def _odds(seen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        clean, bad = np.log((seen + 0.5) / (sizes[:, None] + 1))
        n = seen.sum(0)
        return np.where(n >= 2, np.clip(bad - clean, -2, 4) * n / (n + DOUBT) * 0.5, 0).astype(np.float32)

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        whole, grams, whose = word_features(words)
        chars = np.zeros((len(words), CHAR_DIM), np.float32)
        n = np.bincount(whose, minlength=len(words)).astype(np.float32)
        starts = None
        order = np.argsort(whose, kind="stable")
        starts = np.flatnonzero(np.diff(whose[order], prepend=-1))
        chars[whose[order][starts]] = np.add.reduceat(self.p["chars"][grams[order]], starts, axis=0)
        scale = 1 / np.sqrt(np.maximum(n, 1))
        return np.concatenate([self.p["words"][whole], chars * scale[:, None]], axis=1), (whole, grams, whose, scale)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """(2, words, 3 * HIDDEN): a word's part of the gates, each way."""
        return (vectors @ self.p["inputs"] + self.p["offset"]).astype(np.float32)

    def forward(self, gates: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows of word numbers (n, LENGTH); with `keep`, all that backward() needs."""
        n, length = ids.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states, kept = np.empty((length, 2, n, HIDDEN), np.float32), []
        both = np.stack([ids, ids[:, ::-1]])
        mask = (both > 0).astype(np.float32)[..., None]
        u = self.p["state"]
        for t in range(length):
            x = np.stack([gates[0].take(both[0, :, t], 0), gates[1].take(both[1, :, t], 0)])
            hu = h @ u
            zr = x[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN]
            np.negative(zr, zr)
            np.exp(np.minimum(zr, 30, out=zr), zr)
            zr += 1
            np.reciprocal(zr, zr)
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            new = np.tanh(x[..., 2 * HIDDEN :] + r * hu[..., 2 * HIDDEN :])
            m = mask[:, :, t] * (1 - z)
            if keep:
                kept.append((h, z, r, new, hu[..., 2 * HIDDEN :]))
            h = h + m * (new - h)
            states[t] = h
        seen = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # time, window, 2 * HIDDEN
        look = seen @ self.p["look"] + np.where(ids.T > 0, np.float32(0), np.float32(-1e9))
        share = np.exp(look - look.max(0))
        share /= share.sum(0)
        pooled = (share[..., None] * seen).sum(0)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return (logits, (both, mask, kept, seen, share, pooled)) if keep else logits

    def backward(self, kept: tuple, d: np.ndarray, n_words: int) -> tuple[dict, np.ndarray]:
        """Gradients for d = d loss / d logits, and those of the gates of each word."""
        both, mask, steps, seen, share, pooled = kept
        g = {k: np.zeros_like(self.p[k]) for k in ("state", "look", "out", "bias")}
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * self.p["out"]
        d_share = (seen * d_pooled).sum(2)
        d_look = share * (d_share - (share * d_share).sum(0))
        g["look"] = np.einsum("tn,tnh->h", d_look, seen)
        d_seen = share[..., None] * d_pooled + d_look[..., None] * self.p["look"]
        d_states = np.stack([d_seen[..., :HIDDEN], d_seen[::-1, :, HIDDEN:]], axis=1)
        d_gates = np.zeros((2, n_words, 3 * HIDDEN), np.float32)
        dh = np.zeros_like(d_states[0])
        for t in range(len(steps) - 1, -1, -1):
            h, z, r, new, hu_new = steps[t]
            dh = dh + d_states[t]
            m = mask[:, :, t]
            d_new = dh * m * (1 - z) * (1 - new * new)
            d_z = dh * m * (h - new) * z * (1 - z)
            d_r = d_new * hu_new * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_new], axis=2)
            d_hu = np.concatenate([d_z, d_r, d_new * r], axis=2)
            g["state"] += np.matmul(h.transpose(0, 2, 1), d_hu)
            for way in (0, 1):
                np.add.at(d_gates[way], both[way, :, t], d_x[way])
            dh = dh * (1 - m * (1 - z)) + d_hu @ self.p["state"].transpose(0, 2, 1)
        return g, d_gates

    def fit(self, texts: list[str], toxic: list[int], prior: float) -> Network:
        """Trains on whole texts; prior: the share of toxic ones where they come from."""
        y = np.array(toxic, np.float32)
        if not len(y) or y.min() == y.max():
            self.p["out"][:] = 0
            self.p["bias"][:] = np.log((y.mean() if len(y) else 0.05) * 0.98 + 0.01) - np.log(1 - (y.mean() if len(y) else 0.05) * 0.98 - 0.01)
            return self
        docs = [words_of(t) for t in texts]
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for d in docs for w in d), 1)}
        names = ["\x00", *vocabulary]
        whole, grams, whose = word_features(names)
        by_word = np.split(grams[np.argsort(whose, kind="stable")], np.cumsum(np.bincount(whose, minlength=len(names)))[:-1])
        ids = [np.array([vocabulary[w] for w in d], np.int64) for d in docs]
        rng, moments, step = np.random.default_rng(5), {}, 0
        fold = rng.permutation(len(docs)) % FOLDS
        others = self.start_from([(whole[i], np.concatenate([by_word[k] for k in np.unique(i)] or [np.zeros(0, np.int64)])) for i in ids], y, fold)
        weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean())).astype(np.float32)
        weight = np.sqrt(weight / weight.mean())
        epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(docs) // DOCS_AT_ONCE)))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            for part, left_out in self._batches(rng, fold):
                for name, change in others.items():
                    self.p[name][:, 0] += change[left_out]
                cut = [self._cut(ids[k]) for k in part]
                used, local = np.unique(np.concatenate([c.ravel() for c in cut] + [np.zeros(1, np.int64)]), return_inverse=True)
                vectors, (w_at, c_at, c_of, scale) = self.vectors([names[k] for k in used])
                gates = self.projected(vectors)
                local, owner = local[:-1].reshape(-1, LENGTH), np.repeat(np.arange(len(part)), [len(c) for c in cut])
                logits = np.concatenate([self.forward(gates, local[lo : lo + WINDOWS_AT_ONCE]) for lo in range(0, len(local), WINDOWS_AT_ONCE)])
                order = np.lexsort((-logits, owner))
                best = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
                logits, kept = self.forward(gates, local[best], keep=True)
                d = ((_sigmoid(logits) - y[part]) * weight[part] / len(part)).astype(np.float32)
                g, d_gates = self.backward(kept, d, len(used))
                g["inputs"], g["offset"] = np.matmul(vectors.T, d_gates), d_gates.sum(1, keepdims=True)
                d_vectors = (d_gates @ self.p["inputs"].transpose(0, 2, 1)).sum(0)
                rows = {"words": (w_at, d_vectors[:, :WORD_DIM]), "chars": (c_at, (d_vectors[:, WORD_DIM:] * scale[:, None])[c_of])}
                for name, (at, dx) in rows.items():
                    touched, inverse = np.unique(at, return_inverse=True)
                    total = np.zeros((len(touched), dx.shape[1]), np.float32)
                    np.add.at(total, inverse, dx)
                    self.p[name][touched] -= rate * TABLE_RATE * np.sign(total) * np.minimum(np.abs(total) * 200, 1) + 1e-5 * self.p[name][touched]
                for name, change in others.items():
                    self.p[name][:, 0] -= change[left_out]
                step += 1
                for name, dx in g.items():
                    m, v = moments.setdefault(name, [np.zeros_like(dx), np.zeros_like(dx)])
                    m += 0.1 * (dx - m)
                    v += 0.01 * (dx * dx - v)
                    self.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    @staticmethod
    def _batches(rng: np.random.Generator, fold: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Batches of documents of one fold each, in random order."""
        parts = []
        for k in range(FOLDS):
            mine = rng.permutation(np.flatnonzero(fold == k))
            parts += [(part, k) for part in np.array_split(mine, max(1, len(mine) // DOCS_AT_ONCE)) if len(part)]
        return [parts[k] for k in rng.permutation(len(parts))]

    @staticmethod
    def _cut(ids: np.ndarray) -> np.ndarray:
        """Windows of one text, padded with 0."""
        at = windows(len(ids))
        padded = np.zeros(at[-1] + LENGTH, np.int64)
        padded[: len(ids)] = ids
        return padded[at[:, None] + np.arange(LENGTH)]


class Scorer:
    """A network with a memo of the gates of words seen so far in this process."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.gates = np.zeros((2, 4096, 3 * HIDDEN), np.float32)

    def _learn(self, words: list[str]) -> None:
        first = len(self.memo) + 1
        if first + len(words) > self.gates.shape[1]:
            more = np.zeros((2, max(2 * self.gates.shape[1], first + len(words)), 3 * HIDDEN), np.float32)
            more[:, :first] = self.gates[:, :first]
            self.gates = more
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            self.gates[:, first + lo : first + lo + len(part)] = self.network.projected(self.network.vectors(part)[0])
        self.memo.update(zip(words, range(first, first + len(words)), strict=True))

    def _parts(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """Runs of words of whole texts; long texts give several, which overlap as windows do."""
        step = WORDS_AT_ONCE // STRIDE * STRIDE
        for k, text in enumerate(texts):
            words = words_of(text)
            for lo in range(0, max(1, len(words) - LENGTH + STRIDE), step):
                yield k, words[lo : lo + step + LENGTH - STRIDE]

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        owners, parts, n = [], [], 0
        for k, words in self._parts(texts):
            owners.append(k)
            parts.append(words)
            n += len(words)
            if n >= WORDS_AT_ONCE:
                self._score(owners, parts, out)
                owners, parts, n = [], [], 0
        if parts:
            self._score(owners, parts, out)
        return _sigmoid(out)

    def _score(self, owners: list[int], parts: list[list[str]], out: np.ndarray) -> None:
        seen: set[str] = set()
        for words in parts:
            seen.update(words)
        if len(self.memo) + len(seen) > MEMO_WORDS:
            self._clear()
        if new := sorted(seen.difference(self.memo)):
            self._learn(new)
        get = self.memo.__getitem__
        cut = [Network._cut(np.fromiter(map(get, words), np.int64, len(words))) for words in parts]
        owner, ids = np.repeat(owners, [len(c) for c in cut]), np.concatenate(cut)
        logits = np.concatenate([self.network.forward(self.gates, ids[lo : lo + WINDOWS_AT_ONCE]) for lo in range(0, len(ids), WINDOWS_AT_ONCE)])
        np.maximum.at(out, owner, logits)


_scorers: dict[int, Scorer] = {}


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """Fits on about DOCS_PER_CLASS labelled documents of each class, none of them held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes:
        return Network().fit([], [], 0.05)
    size = F.when(F.col("toxic") == 1, F.lit(sizes.get(1, 1))).otherwise(F.lit(sizes.get(0, 1)))
    bound = 4 * DOCS_PER_CLASS
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), size) < DOCS_PER_CLASS).limit(bound).distinct()
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= CHARS_PER_DOC).join(F.broadcast(picked), "doc_id").select("text", "toxic").limit(bound).collect()
    rows.sort(key=lambda r: (r.toxic, r.text or ""))
    return Network().fit([r.text or "" for r in rows], [r.toxic for r in rows], sizes.get(1, 0) / sum(sizes.values()))


def toxicity(docs: DataFrame, model: Network, flag_from: float = FLAG_FROM) -> DataFrame:
    """docs with toxic_score and toxic_pred (int), which replace columns of those names.

    A null text counts as empty; a text without words is scored as a window without words. Only text is an input.
    """
    docs = docs.drop("toxic_score", "toxic_pred")
    in_small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        if id(network) not in _scorers:
            _scorers.clear()
            _scorers[id(network)] = Scorer(network)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = np.concatenate([_scorers[id(network)].score(texts[lo : lo + 512]) for lo in range(0, len(texts), 512)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array((found >= flag_from).astype(np.int32))], [*batch.schema.names, "toxic_score", "toxic_pred"])

    schema = docs.select("*", F.lit(0.0).alias("toxic_score"), F.lit(0).alias("toxic_pred")).schema
    for name in ("toxic_score", "toxic_pred"):
        schema[name].nullable = True
    return docs.mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text's score, learned from labels that aren't held out; see toxicity() for nulls and empty texts."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted"))
