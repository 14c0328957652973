"""Exact dedup through a sharded cuckoo-filter index over text digests.

Each text is normalised and hashed in the JVM. Scan tasks fold their own copies in a local index, then one row per
(task, digest) is shuffled to a digest's shard, whose index decides. A filter hit is verified against the full digest
kept beside the bucket; an insertion that finds no room doubles the table from the stored keys. The index deletes
too, so live digests can be kept across batches (`update_index`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join, slices_of, small_side

SLOTS = 4
MAX_KICKS = 200
SPACE = r"[\x20\x09-\x0D]+"


class CuckooIndex:
    """A cuckoo filter whose slots point to stored entries: insert, find, delete, resize from the stored keys."""

    def __init__(self, buckets: int = 256) -> None:
        self.entries: dict[int, list] = {}  # entry number -> [key, value]
        self._next = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = [0] * (buckets * SLOTS)
        self.held = [-1] * (buckets * SLOTS)

    @staticmethod
    def _parts(key: bytes) -> tuple[int, int]:
        h = int.from_bytes(key[:8], "little") if len(key) == 32 else int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little")
        return h >> 16, (h & 0xFFFF) or 1

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        place, mark = self._parts(key)
        bucket = place & self.mask
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.marks[slot] == mark and self.entries[self.held[slot]][0] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> list | None:
        """The stored entry of a key: a mark that hits is verified against the stored key."""
        slot = self._slot(key)
        return None if slot < 0 else self.entries[self.held[slot]]

    def insert(self, key: bytes, value) -> list:
        """The entry of the key; a new one with this value if there was none."""
        if entry := self.find(key):
            return entry
        number, self._next = self._next, self._next + 1
        self.entries[number] = entry = [key, value]
        if not self._place(key, number):
            self._resize()
        return entry

    def _place(self, key: bytes, number: int) -> bool:
        place, mark = self._parts(key)
        bucket = place & self.mask
        for b in (bucket, self._other(bucket, mark)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.held[slot] < 0:
                    self.marks[slot], self.held[slot] = mark, number
                    return True
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (number + kick) % SLOTS
            self.marks[slot], mark = mark, self.marks[slot]
            self.held[slot], number = number, self.held[slot]
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.held[slot] < 0:
                    self.marks[slot], self.held[slot] = mark, number
                    return True
        return False

    def _resize(self) -> None:
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._place(entry[0], number) for number, entry in self.entries.items()):
                return
            buckets *= 2

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        del self.entries[self.held[slot]]
        self.marks[slot], self.held[slot] = 0, -1
        return True

    def __len__(self) -> int:
        return len(self.entries)


def normalised(text: str = "text"):
    """The text with each run of white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


#: Digests that one index holds before a scan task passes on what it has folded, and that a shard gets or so.
HELD = 250_000


def _folded(index: CuckooIndex) -> Iterator[pd.DataFrame]:
    found = list(index.entries.values())
    for lo in range(0, len(found), 50_000):
        part = found[lo : lo + 50_000]
        yield pd.DataFrame({"digest": [k for k, _ in part], "first": pd.array([v[0] for _, v in part], "Int64"), "n": [v[1] for _, v in part]})


def _fold(local: bool):
    """Rows (digest, first, n) folded to one row per digest by a cuckoo index. A local one is passed on when it is full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()
        for rows in batches:
            for digest, first, n in zip(rows["digest"], rows["first"], rows["n"], strict=True):
                first = None if pd.isna(first) else int(first)
                entry = index.insert(digest, [None, 0])[1]
                entry[1] += n
                if first is not None and (entry[0] is None or first < entry[0]):
                    entry[0] = first
            if local and len(index) > HELD:
                yield from _folded(index)
                index = CuckooIndex()
        yield from _folded(index)

    return run


FOLDED = "digest binary, first long, n long"


def _shards(spark, n_rows: int) -> int:
    return max(slices_of(spark), n_rows // HELD)


def digest_groups(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of rows (doc_id, digest): local indexes first, then one index per shard."""
    rows = digests.select("digest", F.col("doc_id").alias("first"), F.lit(1).cast("long").alias("n"))
    local = rows.mapInPandas(_fold(True), FOLDED)
    shards = local.repartition(_shards(digests.sparkSession, digests.count()), "digest").mapInPandas(_fold(False), FOLDED)
    return shards.select("digest", F.col("first").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; texts are equal when they are the same after each run of white space is made one
    space. The smallest doc_id stays; of repeated rows with that very id, one. A null doc_id never wins over an id;
    a group with only null ids keeps one of them with a null keep_id. Only doc_id and text are read, so extra columns
    may have any name. An empty table gives an empty result.
    """
    digests = materialise(docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest")), "digests")
    n_rows = digests.count()
    groups = materialise(digest_groups(digests), "digest-groups")
    joined = skew_join(digests.groupBy("doc_id", "digest").agg(F.count("*").alias("m")), groups.withColumn("weight", F.col("group_size")), "digest", "doc_id", n_rows)
    rows = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    return rows.select("doc_id", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns; repeated rows of one id and text leave one.

    Only (doc_id, digest) rows are shuffled. Docs are joined with the ids of what goes; those without an id, or whose id
    has several rows, are told apart by their digests.
    """
    marks = materialise(exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "marks")
    of_id = marks.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept")).filter("rows > 1 OR NOT kept OR doc_id IS NULL")
    of_id = materialise(of_id.select(F.col("doc_id").alias("__id"), (F.col("rows") > 1).alias("__several")), "decided")
    known = small_side(of_id.filter("__id IS NOT NULL"))
    marked = docs.join(known, docs["doc_id"] == F.col("__id"), "left")
    plain = marked.filter("doc_id IS NOT NULL AND __id IS NULL").select(docs.columns)
    if of_id.filter("__several OR __id IS NULL").isEmpty():
        return plain
    odd = marked.filter("doc_id IS NULL OR __several").withColumns({"__id": F.col("doc_id"), "__digest": F.sha2(normalised(), 256)})
    kept = marks.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_digest"))
    same = F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__digest") == F.col("__kept_digest"))
    odd = odd.join(kept, same, "left_semi").dropDuplicates(["__id", "__digest"])
    return plain.unionByName(odd.select(docs.columns))


def update_index(live: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live copies (digest, doc_id, n) after a batch of insertions and then deletions of (digest, doc_id).

    One entry of an index is one document's copies of a text, so a text with very many copies is many entries, dealt over
    the shards. An entry leaves the index when its last copy is deleted; deleting more than there is, or what isn't
    there, does nothing more. live_groups() gives the texts.
    """
    of = lambda df, step: df.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).withColumn("step", F.lit(step))
    rows = live.select("digest", "doc_id", "n", F.lit(0).alias("step")).unionByName(of(inserted, 1)).unionByName(of(deleted, 2))
    schema = "digest binary, doc_id long, n long"

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = CuckooIndex()
        for rows in batches:
            for digest, doc_id, n, step in zip(rows["digest"], rows["doc_id"].astype("Int64"), rows["n"], rows["step"], strict=True):
                doc = None if pd.isna(doc_id) else int(doc_id)
                key = digest + (b"" if doc is None else doc.to_bytes(9, "big", signed=True))
                if step < 2:
                    index.insert(key, [digest, doc, 0])[1][2] += n
                elif entry := index.find(key):
                    entry[1][2] -= n
                    if entry[1][2] <= 0:
                        index.delete(key)
        found = [value for _, value in index.entries.values()]
        yield pd.DataFrame({"digest": [v[0] for v in found], "doc_id": pd.array([v[1] for v in found], "Int64"), "n": pd.array([v[2] for v in found], "Int64")})

    shards = rows.repartition(_shards(live.sparkSession, live.count()), "digest", "doc_id").sortWithinPartitions("step")
    return shards.mapInPandas(apply, schema)


def live_groups(live: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the live copies."""
    return live.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Who stays of every group of equal texts; see exact_dedup() for nulls and repeated rows."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
