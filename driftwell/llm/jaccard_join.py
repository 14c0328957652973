"""N-gram Jaccard join by a token-group matrix.

1. Each text becomes its set of word shingles; texts with one set are one node from then on.
2. A count sketch of all shingles orders them, rarest first. Two linked sets share a shingle among the rarest
   n - ceil(0.8 n) + 1 of each, so only those are matched, and only those that occur in two sets.
3. Sets are put in groups of similar ones: each set is compared with one leader, the most central set among those of its
   rare shingles; what links gets one label, and labels are cut in blocks, the groups. The matrix says which rare shingles
   occur in which label and which group.
4. A set meets the other labels, then the groups of those that can hold a link: how many rare shingles it shares bounds
   its overlap with any member. A group that passes is given the set's text; its token union bounds the overlap again,
   and only then is it opened and its members compared exactly.
Components then come from the links, as distributed jobs. Texts are moved only for sets that are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, in_small_batches, materialise, skew_join, slices_of, small_side
from .shingles import common, linked, set_id, shingle_sets

#: Counters of the sketch (16 bits each in a task, 32 in the sum) and the parts in which it is summed.
SKETCH_BITS, SKETCH_PARTS = 21, 16
#: A group has about so many sets and shingles at most, a single larger set aside.
GROUP_SETS, GROUP_SHINGLES = 32, 200_000
#: A rare shingle is hot with more than this share of all sets, by the sketch; its rows are dealt out by so many salts.
HOT_SHINGLE, SALTS = 1000, 64
#: Sets that one copy of a group is compared with.
ASKERS = 256
#: Bits of the filter of sets that are to be compared: 8 for each of them, but no more than 2**MOST_BITS (32 MB).
LEAST_BITS, MOST_BITS, FILTER_PARTS = 20, 28, 16

SID = pa.binary(16)


def _sketched(sketch: np.ndarray, sets: list[np.ndarray]) -> None:
    np.add.at(sketch, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, sid) of each row; at the end the task's part of the sketch (part, counts)."""
    sketch, schema = np.zeros(1 << SKETCH_BITS, np.uint32), pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        sizes, ids, waiting, held = [], [], [], 0
        for s in shingle_sets(batch.column("text").to_pylist()):
            sizes.append(len(s))
            ids.append(set_id(s) if len(s) else None)
            waiting.append(s)
            held += len(s)
            if held > 1 << 18:
                _sketched(sketch, waiting)
                waiting, held = [], 0
        if waiting:
            _sketched(sketch, waiting)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], schema=schema)
    parts = np.minimum(sketch, 0xFFFF).astype("<u2").reshape(SKETCH_PARTS, -1)
    packed = [zlib.compress(p.tobytes(), 1) for p in parts]
    none = pa.nulls(SKETCH_PARTS, pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.nulls(SKETCH_PARTS, pa.binary()), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary())], schema=schema)


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.uint32)
    for raw in rows["counts"]:
        total += np.frombuffer(zlib.decompress(raw), "<u2")
    return pd.DataFrame({"part": [key[0]], "counts": [total.tobytes()]})


def _least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any set it links with, at least."""
    return -(-80 * n // 100)


def _id_column(raw: bytes, n: int) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(SID, n, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _rare(sketch, hot_from: int):
    """(token, sid, hot) of each set's rarest shingles, once per set and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zlib.decompress(sketch.value), "<u4")
        for batch in batches:
            tokens, sids, hot, done = [], [], [], set()
            for s in shingle_sets(batch.column("text").to_pylist()):
                if not len(s) or (sid := set_id(s)) in done:
                    continue
                done.add(sid)
                keep = len(s) - _least_overlap(len(s)) + 1
                weight = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((s, weight))[:keep]
                tokens.append(s[order].view(np.int64))
                sids.append(sid * keep)
                hot.append(weight[order] > hot_from)
            if tokens:
                token = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays([pa.array(token), _id_column(b"".join(sids), len(token)), pa.array(np.concatenate(hot))], ["token", "sid", "hot"])

    return run


def _shared(sketch, noise: int):
    """(token, sid, weight) of rows (token, sid, hot) in that order: those whose token is hot or has another sid, each once.

    weight is how often the token occurs, by the sketch less its noise; it only serves to choose leaders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zlib.decompress(sketch.value), "<u4")
        held = None  # the last row so far, whose token may go on in the next batch, and whether it was given
        for batch in batches:
            token, hot = batch.column("token").to_numpy(), batch.column("hot").to_numpy(zero_copy_only=False)
            fixed = batch.column("sid").cast(SID)
            raw = np.frombuffer(fixed.buffers()[1], "<u8")[2 * fixed.offset : 2 * (fixed.offset + len(fixed))].reshape(-1, 2)
            if held is not None:
                token, raw, hot = np.append(held[0], token), np.concatenate([held[1], raw]), np.append(held[2], hot)
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            other = (raw[1:] != raw[:-1]).any(1)
            fresh = np.append(True, ~same | other)
            first = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(token)), 0))
            several = np.zeros(len(token), bool)
            several[first[1:][same & other]] = True
            give = fresh & (several[first] | hot)
            if held is not None and held[3]:
                give |= fresh & (first == 0)
                give[0] = False
            # the last row stays held: if it was not given, a later row of its token will show that it is shared
            given = bool(give[first[-1] :].any() or (first[-1] == 0 and held is not None and held[3]))
            held = token[-1:], raw[-1:], hot[-1:], given
            weight = np.maximum(counts[(token.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64) - noise, 1)
            yield pa.RecordBatch.from_arrays([pa.array(token[give]), _id_column(np.ascontiguousarray(raw[give]).tobytes(), int(give.sum())), pa.array(weight[give])], ["token", "sid", "weight"])

    return run


def _filter_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of bit numbers within one part of the filter: the part, packed."""
    flags = np.zeros(int(rows["width"].iloc[0]), np.uint8)
    flags[rows["bit"].to_numpy()] = 1
    return pd.DataFrame({"part": [key[0]], "flags": [np.packbits(flags).tobytes()]})


def _picked(flags, bits: int):
    """(sid, text) of the rows (bit, text) that pass the filter, once per set and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.frombuffer(flags.value, np.uint8)
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            passed = np.flatnonzero(packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1)
            texts = batch.column("text").take(pa.array(passed)).to_pylist()
            found = {set_id(s): t for s, t in zip(shingle_sets(texts), texts, strict=True) if len(s)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.string())], ["sid", "text"])

    return run


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text) of the sets in `wanted` (sid, owner), and of some more; a set may come more than once.

    The filter of their owners' ids is all that is broadcast; its size is bounded, and with too many owners it only
    lets more rows pass.
    """
    spark = docs.sparkSession
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (8 * wanted.count()).bit_length()))
    width = bits // FILTER_PARTS
    place = F.pmod(F.xxhash64("owner"), F.lit(bits))
    rows = wanted.select(F.floor(place / width).cast("int").alias("part"), (place % width).cast("int").alias("bit"), F.lit(width).alias("width")).distinct()
    parts = {r.part: bytes(r.flags) for r in rows.groupBy("part").applyInPandas(_filter_part, "part int, flags binary").collect()}
    flags = spark.sparkContext.broadcast(b"".join(parts.get(k, bytes(width // 8)) for k in range(FILTER_PARTS)))
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("bit"), "text").mapInArrow(_picked(flags, bits), "sid binary, text string")


def _open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (group, block, salt, kind, sid, text) in that order: of a group the members (kind 0) come
    first, then the sets that ask. A group is opened if its union can hold enough of the set."""
    last, members, union = None, {}, None
    for batch in batches:
        found_a, found_b = [], []
        sets = shingle_sets(batch.column("text").to_pylist())
        for group, block, salt, kind, sid, shingles in zip(*(batch.column(c).to_pylist() for c in ("group", "block", "salt", "kind", "sid")), sets, strict=True):
            if (group, block, salt) != last:
                last, members, union = (group, block, salt), {}, None
            if kind == 0:
                members[sid] = shingles
                continue
            if union is None:
                union = np.unique(np.concatenate(list(members.values()))) if members else np.zeros(0, np.uint64)
            if common(shingles, union) < _least_overlap(len(shingles)):
                continue
            for other, s in members.items():
                if other != sid and linked(shingles, s):
                    found_a.append(sid)
                    found_b.append(other)
                    break  # members of a group are of one component: one link is enough
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], ["a", "b"])


def _verified(docs: DataFrame, active: DataFrame, asked: DataFrame, members: DataFrame, tag: str) -> DataFrame:
    """Links (a, b) of `asked` (a, group, block), with `members` (sid, group, block) of all groups.

    A group that many ask is repeated once for each ASKERS of them or so; texts go only where they are asked for, and are
    smaller than their shingles.
    """
    weights = materialise(asked.groupBy("group", "block").agg(F.count("*").alias("weight")).select(F.struct("group", "block").alias("at"), "weight", F.ceil(F.col("weight") / ASKERS).cast("int").alias("salts")), f"{tag}-weights")
    of_group = members.select("sid", F.struct("group", "block").alias("at")).join(weights, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "sid")
    asking = skew_join(asked.select("a", F.struct("group", "block").alias("at")), weights, "at", "a", asked.count())
    asking = asking.select("at", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("a").alias("sid"))
    uses = materialise(of_group.unionByName(asking), f"{tag}-uses")
    wanted = materialise(uses.select("sid").distinct().join(active, "sid"), f"{tag}-wanted")
    placed = _texts(docs, wanted).join(small_side(uses), "sid").select("at.group", "at.block", "salt", "kind", "sid", "text")
    dealt = placed.repartition(slices_of(docs.sparkSession), "group", "block", "salt").sortWithinPartitions("group", "block", "salt", "kind")
    return materialise(dealt.mapInArrow(_open_groups, "a binary, b binary"), f"{tag}-links")


def _fewest_shared(n, m):
    """Rare shingles that linked sets of n and m share at least, n no more than 1.25 m or less than 0.8 m."""
    overlap = F.ceil(80 * (n + m) / 180)
    return F.greatest(overlap - F.ceil(0.8 * F.greatest(n, m) - 1e-9) + 1, F.lit(1))


def _fewest_within(n, low, high):
    """The least of _fewest_shared over all sizes from low to high.

    Up to m = n it never falls. Above, its ceilings make it step back by one while it falls by 16/45 a size, so its least
    is among the last three sizes.
    """
    return F.least(_fewest_shared(n, low), *(_fewest_shared(n, F.greatest(high - k, low)) for k in range(3)))


def _size_of(sid: str):
    """The number of shingles, which a sid starts with."""
    return F.conv(F.hex(F.substring(sid, 1, 4)), 16, 10).cast("int")


def _lead(matched: DataFrame, n_rows: int) -> DataFrame:
    """(a, group, block 0): each set with the leader to compare it with, if there is one.

    Of the sets with a rare shingle the one leads whose shingles have the most sets; a set takes the leader with which it
    shares the most. In a group of near copies that is the one in the middle. Leaders save comparisons and decide nothing.
    """
    score = F.sum("weight").over(Window.partitionBy("sid"))
    posted = materialise(matched.select("token", "sid", score.alias("score")), "posted")
    lead = posted.groupBy("token").agg(F.max(F.struct("score", "sid")).alias("lead"), F.count("*").alias("weight"))
    met = skew_join(posted.drop("score"), lead, "token", "sid", n_rows).select("sid", F.col("lead.sid").alias("lead")).filter("sid <> lead")
    counted = met.groupBy("sid", "lead").agg(F.count("*").alias("c")).withColumns({"n": _size_of("sid"), "m": _size_of("lead")})
    near = (F.least("n", "m") * 100 >= F.greatest("n", "m") * 80) & (4 * F.col("c") >= _fewest_shared(F.col("n"), F.col("m")))
    best = counted.filter(near).groupBy("sid").agg(F.max(F.struct("c", "lead")).alias("best"))
    return materialise(best.select(F.col("sid").alias("a"), F.col("best.lead").alias("group"), F.lit(0).alias("block")), "pairs")


def _labelled(active: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, label, size, block): the components so far, with their numbers of sets, cut in blocks."""
    roots = components(links)
    labels = active.select("sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("label"))
    labels = materialise(labels, "labels")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.sum(_size_of("sid").cast("long")).alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / GROUP_SETS), F.ceil(F.col("shingles") / GROUP_SHINGLES)).alias("blocks")
    sized = skew_join(labels, sizes.select("label", "size", blocks, F.col("size").alias("weight")), "label", "sid", labels.count())
    return materialise(sized.select("sid", "label", "size", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block")), "groups")


def _asked(matched: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """(a, group, block): the groups of other labels that can hold a link, by the rare shingles that they share."""
    posted = matched.drop("weight").join(small_side(groups), "sid")
    several = posted.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("weight")).filter("low <> high").select("token", "weight")
    posted = materialise(skew_join(posted, several, "token", "sid", n_rows).withColumn("n", _size_of("sid")), "mixed")
    span = (F.min("n").alias("lo"), F.max("n").alias("hi"))
    n = F.col("n")
    in_reach = (100 * F.col("hi") >= 80 * n) & (80 * F.col("lo") <= 100 * n)
    # of two labels the sets of the smaller one meet those of the larger
    smaller = F.struct("size", "label") < F.struct(F.col("others").alias("size"), F.col("of").alias("label"))

    def reached(met: DataFrame, *at: str) -> DataFrame:
        spans = met.groupBy("a", "n", *at).agg(F.count("*").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        low, high = F.greatest("lo", F.ceil(0.8 * n - 1e-9)), F.least("hi", F.floor(1.25 * n + 1e-9))
        return spans.filter((low <= high) & (F.col("c") >= _fewest_within(n, low, high)))

    asking = posted.select("token", F.col("sid").alias("a"), "n", "label", "size")
    by_label = posted.groupBy("token", F.col("label").alias("of"), F.col("size").alias("others")).agg(*span)
    near = materialise(reached(asking.join(by_label, "token").filter(smaller & in_reach), "of").select("a", "of"), "near-labels")
    by_group = posted.groupBy("token", F.col("label").alias("of"), "block").agg(*span)
    met = near.join(asking.select("a", "token", "n"), "a").join(by_group, ["token", "of"]).filter(in_reach)
    return materialise(reached(met, "of", "block").select("a", F.col("of").alias("group"), "block"), "asked")


def set_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of each row, and links (a, b) between sets that connect every pair of linked sets."""
    spark = docs.sparkSession
    in_small_batches(spark)
    docs = docs.select("doc_id", "text")
    found = materialise(docs.mapInArrow(_sets, "doc_id long, n long, sid binary, part int, counts binary"), "shingle-sets")
    rows = found.filter("part IS NULL").select("doc_id", "n", "sid")
    parts = {r.part: bytes(r.counts) for r in found.filter("part IS NOT NULL").groupBy("part").applyInPandas(_summed, "part int, counts binary").collect()}
    nothing = bytes((4 << SKETCH_BITS) // SKETCH_PARTS)
    packed = b"".join(parts.get(k, nothing) for k in range(SKETCH_PARTS))
    sketch, noise = spark.sparkContext.broadcast(zlib.compress(packed, 1)), int(np.frombuffer(packed, "<u4").mean())

    rare = docs.mapInArrow(_rare(sketch, 2 * noise + 64 + rows.count() // HOT_SHINGLE), "token long, sid binary, hot boolean")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("sid"), F.lit(SALTS)))
    matched = rare.repartition(slices_of(spark), "token", salt).sortWithinPartitions("token", "sid").mapInArrow(_shared(sketch, noise), "token long, sid binary, weight long")
    matched = materialise(matched, "matched")
    n_rows = matched.count()
    owners = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("owner"))
    active = materialise(owners.join(matched.select("sid").distinct(), "sid"), "active")

    pairs = _lead(matched, n_rows)
    leaders = pairs.select(F.col("group").alias("sid"), "group", "block").distinct()
    links = _verified(docs, active, pairs, leaders, "lead")
    groups = _labelled(active, links)
    asked = _asked(matched, groups, n_rows)
    more = _verified(docs, active, asked, groups.select("sid", F.col("label").alias("group"), "block"), "group")
    return rows, links.unionByName(more)


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, sid, component_id, keeper, n_connecting) of each row of docs; keeper: the component's smallest doc_id
    is of this set, the smallest one where several sets have it."""
    rows, links = set_links(docs)
    n_rows = rows.count()
    roots = components(links)
    sets = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    rooted = sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "sid")).alias("first")
    firsts = rooted.groupBy("root").agg(first, F.count("*").alias("weight"))
    rooted = skew_join(rooted, firsts, "root", "sid", n_rows)
    degree = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_connecting"))
    by_set = rooted.join(degree, "sid", "left").select("sid", F.col("first.least").alias("component_id"), (F.col("sid") == F.col("first.sid")).alias("keeper"), F.coalesce("n_connecting", F.lit(0)).alias("n_connecting"), F.col("copies").alias("weight"))
    return skew_join(rows, materialise(by_set, "components"), "sid", "doc_id", n_rows, "left")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_connecting) of each row of docs.

    A row whose text is null or has no word has an empty set, links with nothing and is its own component. Rows with
    the same set are linked. Rows that share a doc_id are told apart by their sets. A null doc_id is never a component's
    id: such a row gets its set's, or null if it has none. Only doc_id and text are read; an empty table gives an empty
    result. n_connecting counts the links of the document's set that the join needed to connect its component; pairs
    that these already connect aren't counted.
    """
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return _placed(docs).select("doc_id", F.col("n").alias("n_shingles"), component, F.coalesce("n_connecting", F.lit(0)).cast("long").alias("n_connecting"))


@F.pandas_udf(T.BinaryType())
def _set_ids(text: pd.Series) -> pd.Series:
    """The sid of each text, null without words."""
    return pd.Series([set_id(s) if len(s) else None for s in shingle_sets([None if pd.isna(t) else t for t in text])], dtype=object)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: of each component the one with the smallest doc_id.

    Rows without words stay. Rows that share a doc_id, or have none, are told apart by their sets: of a component's rows
    with the smallest doc_id the one with the smallest set id stays, of several rows with that very id and set one. A null
    doc_id stays only in a component without any id.
    """
    stays = (F.col("n") == 0) | (F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    marks = materialise(_placed(docs).select("doc_id", "sid", stays.alias("stays")), "marks")
    of_id = marks.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("stays").alias("stays")).filter("rows > 1 OR NOT stays OR doc_id IS NULL")
    of_id = materialise(of_id.select(F.col("doc_id").alias("__id"), (F.col("rows") > 1).alias("__several")), "decided")
    marked = docs.join(small_side(of_id.filter("__id IS NOT NULL")), docs["doc_id"] == F.col("__id"), "left")
    plain = marked.filter("doc_id IS NOT NULL AND __id IS NULL").select(docs.columns)
    if of_id.filter("__several OR __id IS NULL").isEmpty():
        return plain
    odd = materialise(marked.filter("doc_id IS NULL OR __several").withColumns({"__id": F.col("doc_id"), "__sid": _set_ids("text")}), "repeated-ids")
    kept = marks.filter("stays AND sid IS NOT NULL").select(F.col("doc_id").alias("__kept_id"), F.col("sid").alias("__kept_sid")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__sid") == F.col("__kept_sid"))
    chosen = odd.filter("__sid IS NOT NULL").join(kept, same, "left_semi").dropDuplicates(["__id", "__sid"])
    return plain.unionByName(odd.filter("__sid IS NULL").select(docs.columns)).unionByName(chosen.select(docs.columns))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents; see jaccard_components for nulls, empty texts and repeated rows."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_connecting")


OP3_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.root = l.a)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""
