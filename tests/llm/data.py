"""Small documents with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, kept string, n string, sid string, score string, digest string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base, passage = words(rng, 120).split(), words(rng, 110)
    texts: list[str | None] = [None, "", "  \t ", "one", "one two", "One  TWO", "é ü 😀 words of a kind", "!!! ??? 123"]
    texts += [" ".join(base), " ".join(base), "  ".join(base)]
    for k in range(6):
        near = list(base)
        for _ in range(k % 3 + 1):
            near[rng.randrange(len(near))] = "changed" + str(k)
        texts.append(" ".join(near))
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 20) for _ in range(3)]
    texts += ["x" * 1500, "ab" * 700, words(rng, 4000), "ä" * 450, "ä" * 450 + "b"]
    texts += [words(rng, rng.randint(1, 80)) for _ in range(12)]
    out = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    out += [out[8], out[-1], (None, "no id"), (None, " ".join(base))]
    rng.shuffle(out)
    return out


def frame(spark, found: list[tuple] | None = None):
    found = rows() if found is None else found
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "de", "s", len(t or ""), "a", "b", "c", "d", "e", "f") for i, t in found], COLUMNS).repartition(3)
