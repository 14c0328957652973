"""Removal of repeated byte strings over a whole corpus, by prefix-free parsing.

Rolling-hash triggers (the least hash among the k-grams of each LENGTH-byte string) cut the documents into phrases: one
for each run of string starts that share a trigger, holding all bytes of those strings. Equal strings have their
trigger at the same place, so they lie in phrases with the same trigger. The dictionary is the distinct phrases with
their counts, the parse is each document's sequence of them. A phrase that occurs twice repeats in all its suffixes of
LENGTH bytes and needs no further look, which covers highly repetitive text. Only where phrases share a trigger but
differ (the ends of repeated passages) are phrases cut again, in blocks of BLOCK string starts placed by the trigger:
a block whose strings' common bytes occur once is unique, one that occurs twice as a whole repeats, and only the
suffixes of the other blocks are compared one by one. It matters only whether two suffixes share their first LENGTH
bytes, so equal ones meet by a 128-bit hash of those bytes instead of standing side by side in a suffix array: counts
combine before the shuffle, while a sorted array holds all suffixes of a passage that a third of the documents share in
one range. Phrases and blocks are compared by 128-bit hashes, too; a trigger's 64 bits only say what is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, in_small_batches, materialise, prefix_hashes, skew_join, span_hash

LENGTH, GRAM, BLOCK = 400, 48, 16
#: String starts handled at once; places take the low bits of a trigger's rank.
STARTS_AT_ONCE, PLACE_BITS = 1 << 22, 24


_ODD = np.uint64(0x9E3779B97F4A7C15)
PARSE = "key long, first int, last int, place int, trigger long, phrase binary"


def _digests(raw: bytes, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> list[bytes]:
    """128 bits for the bytes of the strings that start in [first, last], and for where the trigger stands in them."""
    view, digest = memoryview(raw), xxhash.xxh3_128_digest
    return [digest(view[lo : hi + LENGTH], seed=at) for lo, hi, at in zip(first.tolist(), last.tolist(), (place - first).tolist(), strict=True)]


def phrases(raw: bytes) -> tuple[np.ndarray, ...]:
    """(first start, last start, place of the trigger, its hash) of a document's phrases; none under LENGTH bytes."""
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    codes, out = np.frombuffer(raw, np.uint8), []
    for lo in range(0, len(raw) - LENGTH + 1, STARTS_AT_ONCE):
        part = codes[lo : lo + STARTS_AT_ONCE + LENGTH - 1]
        prefix = prefix_hashes(BYTE_CODES[part])
        at = np.arange(len(part) - GRAM + 1)
        grams = span_hash(prefix, at, at + GRAM)
        rank = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
        width = LENGTH - GRAM + 1
        n = len(part) - LENGTH + 1
        padded = np.full(-(-len(rank) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(rank)] = rank
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:] - 1, n - 1)
        trigger = place[first]
        out.append((first + lo, last + lo, trigger + lo, grams[trigger]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARSE rows of the phrases of each document."""
    for batch in batches:
        keys, found, held = [], [], 0
        texts, ids = batch.column("text").to_pylist(), batch.column("key").to_pylist()
        for key, text in zip(ids, texts, strict=True):
            raw = _encoded(text)
            cut = phrases(raw)
            if len(cut[0]):
                keys.append(np.full(len(cut[0]), key))
                found.append((*cut, _digests(raw, *cut[:3])))
                held += len(cut[0])
            if held > 100_000:
                yield _parse_rows(keys, found)
                keys, found, held = [], [], 0
        if found:
            yield _parse_rows(keys, found)


def _parse_rows(keys: list, found: list) -> pa.RecordBatch:
    *places, trigger, whole = zip(*found, strict=True)
    phrase = pa.array([x for part in whole for x in part], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(np.concatenate(x).astype(np.int32)) for x in places), pa.array(np.concatenate(trigger).view(np.int64)), phrase], ["key", "first", "last", "place", "trigger", "phrase"])


def _opened(batch: pa.RecordBatch, at_once: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, bytes, first, last, place) of a document's open rows, some at a time."""
    for key, text, rows in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("open").to_pylist(), strict=True):
        raw = _encoded(text)
        for lo in range(0, len(rows), at_once):
            yield (key, raw, *(np.array([r[c] for r in rows[lo : lo + at_once]], np.int64) for c in ("first", "last", "place")))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges [lo, hi], and the number of the range of each."""
    sizes = hi - lo + 1
    of = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + lo[of], of


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARSE rows of the blocks of open phrases: the trigger is the bytes that all the block's strings have."""
    for batch in batches:
        last_raw, prefix = None, None
        for key, raw, first, last, place in _opened(batch, 1000):
            if raw is not last_raw:
                last_raw, prefix = raw, prefix_hashes(BYTE_CODES[np.frombuffer(raw, np.uint8)])
            block, of = _ranges((place - last) // BLOCK, (place - first) // BLOCK)
            near = place[of] - BLOCK * block
            low, high = np.maximum(first[of], near - BLOCK + 1), np.minimum(last[of], near)
            with np.errstate(over="ignore"):
                trigger = span_hash(prefix, near, near - BLOCK + 1 + LENGTH) + block.astype(np.uint64) * _ODD
            yield _parse_rows([np.full(len(block), key)], [(low, high, place[of], trigger, _digests(raw, low, high, place[of]))])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(suffix hash, key, start) of every string start in the open blocks of documents."""
    for batch in batches:
        for key, raw, first, last, _ in _opened(batch, 4000):
            at, _ = _ranges(first, last)
            yield pa.RecordBatch.from_arrays([pa.array(_digests(raw, at, at, at), pa.binary()), pa.array(np.full(len(at), key)), pa.array(at.astype(np.int32))], ["suffix", "key", "at"])


def removed_bytes(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each of n bytes, whether it goes when the strings that start in [first, last] go."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + LENGTH, -1)
    return np.cumsum(edges[:-1]) > 0


def kept_text(raw: bytes, gone: np.ndarray) -> str:
    """What stays as text: a character goes whole if a byte of it goes, and bytes of two of them never make a third."""
    at = np.flatnonzero(np.diff(gone, prepend=True, append=True)).tolist()
    return "".join(raw[lo:hi].decode("utf-8", "ignore") for lo, hi in zip(at[::2], at[1::2], strict=True))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, kept binary, copies long"


def _remove(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, whole, starts in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "starts")), strict=True):
                raw, starts = _encoded(text), np.array(starts or [], np.int64)
                first = np.concatenate([np.array([r["first"] for r in whole or []], np.int64), starts])
                last = np.concatenate([np.array([r["last"] for r in whole or []], np.int64), starts])
                gone = removed_bytes(len(raw), first, last)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                left = kept_text(raw, gone) if len(kept) < len(raw) else text
                rows.append((len(raw), int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum()), hashlib.sha256(kept).hexdigest(), left, kept if with_bytes else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            found = [pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found, batch.column("copies")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "kept", "copies"])

    return run


def _resolved(parse: DataFrame) -> DataFrame:
    """(key, whole, open) of the documents with rows whose trigger occurs twice: rows that repeat as a whole, and rows
    to be looked at. Of equal rows that repeat beside others with their trigger, one is looked at for all. Rows of repeated
    documents share a key and count each, but a key's lists hold a place once."""
    n_rows = parse.count()
    dictionary = materialise(parse.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("model")), "dictionary")
    triggers = dictionary.groupBy("trigger").agg(F.count("*").alias("weight"), F.sum("n").alias("total")).filter("total > 1").withColumn("kinds", F.col("weight"))
    known = skew_join(dictionary, triggers, "trigger", "phrase", n_rows).select("phrase", "model", (F.col("n") > 1).alias("repeats"), (F.col("kinds") > 1).alias("mixed"), F.col("n").alias("weight"))
    marked = skew_join(parse.select("key", "first", "last", "place", "phrase"), materialise(known, "known"), "phrase", "key", n_rows)
    is_model = (F.col("key") == F.col("model.key")) & (F.col("first") == F.col("model.first"))
    row = F.struct("first", "last", "place")
    return marked.groupBy("key").agg(F.collect_set(F.when(F.col("repeats"), row)).alias("whole"), F.collect_set(F.when(F.col("mixed") & (~F.col("repeats") | is_model), row)).alias("open"))


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (and kept, the bytes, if asked for).

    A byte goes if a string of LENGTH bytes that covers it starts at another place, too, in any row; matches never
    cross rows. `text` is what stays, without characters of which a byte went; kept_sha256 is that of the bytes. A null
    text counts as empty and stays null; texts under LENGTH bytes stay whole. Repeated rows repeat each other. Only
    doc_id and text are read; an empty table gives an empty result. Texts move to their marks once, with their rows'
    number, and rows without marks are given out from there.
    """
    in_small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    parse = materialise(keyed.select("key", "text").mapInArrow(_parse, PARSE), "parse")
    distinct = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("copies"))
    marked = materialise(distinct.join(_resolved(parse), "key", "left"), "marks", "zstd")
    marks = marked.filter("open IS NOT NULL")
    blocks = materialise(marks.filter(F.size("open") > 0).select("key", "text", "open").mapInArrow(_blocks, PARSE), "blocks")
    inner = materialise(_resolved(blocks), "inner")
    texts = marks.select("key", "text")
    suffixes = materialise(texts.join(inner.filter(F.size("open") > 0).select("key", "open"), "key").mapInArrow(_suffixes, "suffix binary, key long, at int"), "suffixes")
    repeated = materialise(suffixes.groupBy("suffix").agg(F.count("*").alias("weight")).filter("weight > 1"), "repeated")
    starts = skew_join(suffixes, repeated, "suffix", "key", suffixes.count()).groupBy("key").agg(F.collect_list("at").alias("starts"))
    more = inner.select("key", F.col("whole").alias("blocks")).join(starts, "key", "left")
    found = marks.join(more, "key", "left").withColumn("whole", F.concat("whole", F.coalesce("blocks", F.array().cast("array<struct<first:int,last:int,place:int>>"))))
    removed = materialise(found.select("doc_id", "text", "whole", "starts", "copies").mapInArrow(_remove(with_bytes), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}"), "removed", "zstd")

    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    same = marked.filter("open IS NULL").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), "text", F.encode(text, "UTF-8").alias("kept"), "copies")
    out = removed.unionByName(same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *(["kept"] if with_bytes else []))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document; see remove_repeats() for nulls, short texts and repeated rows."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
