"""SentencePiece encoding by a streaming Viterbi search over a public model's pieces and scores, and decoding.

The best segmentation is the one with the highest sum of piece scores. Scores are kept for as many last positions as
the longest piece has characters; ids are committed as soon as the paths to all open positions share a boundary. The
model escapes spaces, and where no piece holds an escaped space past its start, every word start is such a boundary:
what lies between two of them is searched once and remembered.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model format: kinds of pieces, and the escaped space.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
SPACE = "▁"
#: What an unknown character costs besides the lowest score of a piece.
UNKNOWN_COSTS = 10.0
MEMO_SEGMENTS, MEMO_CHARS = 1_000_000, 48
SEGMENT = re.compile(" +[^ ]*")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at : at + n]
            at += n


class Pieces:
    """A model file's pieces: streaming encoder and decoder."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        found = [dict(_fields(value)) for number, value in _fields(raw) if number == 1]
        names = [x[1].decode() for x in found]
        scores = [struct.unpack("<f", x[2])[0] if 2 in x else 0.0 for x in found]
        kinds = [x.get(3, NORMAL) for x in found]
        self.prefix = next((dict(_fields(v)).get(3, 1) for n, v in _fields(raw) if n == 3), 1)
        self.scores = {p: (s, k) for k, (p, s, t) in enumerate(zip(names, scores, kinds, strict=True)) if t in (NORMAL, USER_DEFINED)}
        self.tree: dict = {}  # character -> [score, id, deeper tree]; a score of None is no piece
        for piece, (score, number) in self.scores.items():
            at = self.tree
            for c in piece[:-1]:
                at = at.setdefault(c, [None, -1, {}])[2]
            at.setdefault(piece[-1], [None, -1, {}])[:2] = [score, number]
        self.longest = max(map(len, self.scores))
        self.byte_ids = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(names, kinds, strict=True)) if t == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.unknown_score = min(s for s, _ in self.scores.values()) - UNKNOWN_COSTS
        self.bytes_of = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(names, kinds, strict=True)]
        self.words_converge = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.memo: dict[str, bytes] = {}

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of escaped text that comes in parts of any size, in runs that no later text can change.

        Of equal sums the segmentation whose last piece is longest wins, and so on backwards.
        """
        text, base, at = "", 0, 0  # text[k] stands at place base + k; places below `at` are expanded
        best: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int]] = {}  # place -> (where its last piece starts, id)
        committed, source = 0, iter(chars)
        more = True
        while True:
            while more and len(text) - (at - base) < self.longest:
                part = next(source, None)
                if part is None:
                    more = False
                else:
                    text += part
            k = at - base
            if k >= len(text):
                break
            score = best.pop(at)
            tree, place, single = self.tree, at, False
            for c in text[k : k + self.longest]:
                node = tree.get(c)
                if node is None:
                    break
                place += 1
                if node[0] is not None:
                    single = single or place == at + 1
                    total = score + node[0]
                    if place not in best or total > best[place]:
                        best[place], back[place] = total, (at, node[1])
                tree = node[2]
            if not single and (at + 1 not in best or score + self.unknown_score > best[at + 1]):
                best[at + 1], back[at + 1] = score + self.unknown_score, (at, -1 - ord(text[k]))
            at += 1
            if at - committed >= self.longest and (len(best) == 1 or (at - committed) % (4 * self.longest) == 0):
                meet = self._meeting(best, back, committed)
                if meet > committed:
                    yield self._ids(back, committed, meet)
                    committed = meet
                if at - base > 4096:
                    text, base = text[at - base :], at
        if at > committed:
            yield self._ids(back, committed, at)

    @staticmethod
    def _meeting(best: dict[int, float], back: dict, committed: int) -> int:
        """The last boundary that the paths to all open places share."""
        open_ = set(best)
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            open_.add(back[last][0] if last > committed else committed)
        return open_.pop()

    def _ids(self, back: dict, start: int, end: int) -> list[int]:
        out: list[int] = []
        at = end
        while at > start:
            before, piece = back.pop(at)
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids.get(b, self.unknown) for b in reversed(chr(-1 - piece).encode("utf-8", "surrogatepass")))
            at = before
        for place in [p for p in back if start < p < end]:
            del back[place]
        return out[::-1]

    def _search(self, segment: str) -> bytes:
        return np.array([i for run in self.stream([segment.replace(" ", SPACE)]) for i in run], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit values; a null or empty text has none."""
        if not text:
            return b""
        text = " " + text if self.prefix else text
        if not self.words_converge or text[0] != " ":
            return self._search(text)
        memo, out = self.memo, []
        for segment in SEGMENT.findall(text):
            ids = memo.get(segment)
            if ids is None:
                ids = self._search(segment)
                if len(segment) <= MEMO_CHARS:
                    if len(memo) >= MEMO_SEGMENTS:
                        memo.clear()
                    memo[segment] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; escaped spaces become spaces, so a text that held the escape character comes back with spaces."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_open: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """One per process and file."""
    if path not in _open:
        _open[path] = Pieces(path)
    return _open[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, n_ids, ids_crc32, round_trip) of each row's whole text.

    A null or empty text has no ids. round_trip says whether decoding gives the text back (a null counts as empty).
    Rows keep their doc_id, null or repeated; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            docs_, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for lo in range(0, len(texts), 1024):
                part = texts[lo : lo + 1024]
                raw = [pieces.encode(t) for t in part]
                ids = [np.frombuffer(r, "<u4").astype(np.int32) for r in raw]
                same = [pieces.decode(i.tolist()) == (t or "") for i, t in zip(ids, part, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [docs_.slice(lo, len(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(same, pa.bool_())],
                    ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and whether they decode to its text; see encode() for nulls and odd texts."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
