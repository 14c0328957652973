"""Hierarchical residual packing: documents to sequences of a fixed number of tokens.

Each scan task tokenizes its documents and packs their pieces best-fit, longest first. Nearly full bins are done. What
is underfull becomes an item of the next round, in groups of FAN_IN nodes, up to a single root. Two bins of at most
half the capacity always fit together, so a node keeps one such bin at most and a merge above it needs another's: it
is enough that each node passes on its smaller bin and the FAN_IN emptiest others, and the root gives as few sequences as
if all were passed on (a test compares both trees). Rounds handle (bin, load) alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, materialise
from .tokens import WordTokens

CAPACITY = 4096
END_ID = 1
FAN_IN = 16
#: A bin with this share of the capacity is done.
NEARLY_FULL = 0.99


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item and each bin's load: longest first, each to the fullest bin that has room."""
    bins, loads = [0] * len(lengths), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(loads), capacity
            loads.append(0)
        bins[k] = b
        loads[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, loads


def offsets_of(bins: list[int], lengths: list[int]) -> list[int]:
    """The place of each item in its bin, gapless and in the order of the items."""
    at: dict[int, int] = {}
    out = []
    for b, n in zip(bins, lengths, strict=True):
        out.append(at.get(b, 0))
        at[b] = out[-1] + n
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, node long, load long, offset long"


def _tokenize_and_pack(tokenizer: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        tokens, rows = WordTokens.of(tokenizer), []
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                for doc, ids in zip(some.column("doc_id").to_pylist(), tokens.ids(some.column("text").to_pylist()), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        lengths = [r[3] for r in rows]
        bins, loads = best_fit(lengths, capacity)
        offsets = offsets_of(bins, lengths)
        for lo in range(0, len(rows), 50_000):
            part = slice(lo, lo + 50_000)
            cols = list(zip(*rows[part], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in (*cols[2:], [(node << 32) + b for b in bins[part]], [node] * len(cols[0]), [loads[b] for b in bins[part]], offsets[part]))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "node", "load", "offset"],
            )

    return run


def _carried(bins: DataFrame, capacity: int) -> DataFrame:
    """Of each node's bins (bin, node, load): those that a round above can still use."""
    from pyspark.sql import Window

    open_ = bins.filter(F.col("load") < int(NEARLY_FULL * capacity))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("load", "bin"))
    return open_.withColumn("rank", rank).filter(F.col("rank") <= FAN_IN + 1).drop("rank")


def _merge(capacity: int):
    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        loads = bins["load"].tolist()
        merged, sums = best_fit(loads, capacity)
        heads: dict[int, int] = {}
        for b, m in zip(bins["bin"], merged, strict=True):
            heads.setdefault(m, b)
        return pd.DataFrame({"bin": bins["bin"], "to": [heads[m] for m in merged], "shift": offsets_of(merged, loads), "node": int(key[0]), "load": [sums[m] for m in merged]})

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's and then END_ID, so a null or empty text gives one piece of one id. Documents
    longer than `capacity` are cut in pieces of that length; the last may be shorter. Repeated rows are packed each for
    itself. Only doc_id (may be null) and text are read, so extra columns may have any name; an empty table gives none.
    """
    in_small_batches(docs.sparkSession)
    pieces = materialise(docs.select("doc_id", "text").mapInArrow(_tokenize_and_pack(tokenizer, capacity), PIECES), "pieces")
    bins = pieces.filter(F.col("offset") == 0).select("bin", "node", "load")
    nodes = (bins.agg(F.max("node")).first()[0] or 0) + 1
    moves = None
    while nodes > 1:
        up = _carried(bins, capacity).withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        level = materialise(up.groupBy("node").applyInPandas(_merge(capacity), "bin long, to long, shift long, node long, load long"), "merges")
        bins = level.filter(F.col("shift") == 0).select(F.col("to").alias("bin"), "node", "load").distinct()
        step = level.select("bin", "to", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("to"), F.col("to").alias("to2"), F.col("shift").alias("shift2"))
            moved = moves.join(later, "to", "left").select("bin", F.coalesce("to2", "to").alias("to"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
            moves = materialise(moved, "moves")
        nodes = -(-nodes // FAN_IN)
    if moves is None:
        placed = pieces.withColumn("sequence_id", F.col("bin"))
    else:
        placed = pieces.join(moves, "bin", "left").withColumn("sequence_id", F.coalesce("to", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_pack(spark, sf_dir: str) -> DataFrame:
    """All documents packed; see pack() for nulls, empty and long texts and repeated rows."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
