from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from driftwell.llm.common import TEXT_BYTES_AT_ONCE, in_small_batches

from .data import frame


def test_stages_keep_the_columns_and_what_is_clean(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "pii", "packing"]
    docs = frame(spark)
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3]
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def _least_of_groups(texts: dict[int, str]) -> set[int]:
    """Of each group of near-duplicates the smallest id, by comparing all pairs."""

    def shingles(text):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(texts):
        for b in sorted(texts):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k for k in texts if find(k) == k}


def test_run_equals_plain_stages(spark, tmp_path):
    """Documents of two languages with copies, near copies, a phone number and no letters, against plain Python."""
    rng, rows_ = random.Random(12), []
    letters = {"en": "abcdefgh", "de": "klmnopqr"}
    for k in range(60):
        lang = "en" if k % 2 else "de"
        rows_.append((k, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 90))), lang))
    for k in range(12):
        base = rows_[k][1].split()
        rows_.append((100 + k, "  ".join(base), rows_[k][2]))
        base[3] = "changed"
        rows_.append((200 + k, " ".join(base), rows_[k][2]))
    rows_ += [(300, "call +1 (212) 555-0100 abc def gab", "en"), (301, "12 34 !!", None), (302, None, None), (303, "", "en")]
    docs = spark.createDataFrame([(i, t, v, "s", len(t or "")) for i, t, v in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = {i: t for i, t, _ in rows_}

    model = corpus_pipeline.learn(docs)
    said = dict(zip(text, model.decode([t or "" for t in text.values()]), strict=True))
    left = {i: t for i, t in text.items() if said[i][0] != "und" and said[i][1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert {301, 302, 303}.isdisjoint(left) and len(left) > 60
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i in _least_of_groups(left)}
    left = {i: t.replace("+1 (212) 555-0100", "<PHONE>") for i, t in left.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in left.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            expected.append((i, piece, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)


def test_stages_on_nothing(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """40 texts of 250 KB, as a group of long near copies has them: one batch of 10 MB by the number of rows alone."""
    in_small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("word "), 50_000).alias("text"))
    found = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 40
    assert max(r.bytes for r in found) <= TEXT_BYTES_AT_ONCE + 260_000
