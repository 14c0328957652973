"""Sets of word shingles of whole texts, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import BYTE_CODES, mixed, prefix_hashes, span_hash

WORDS = 5
BYTES_AT_ONCE = 1 << 17
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = BYTE_CODES[_LOWER]
_PLACE = np.random.default_rng(31).integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)


def runs(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, encoded texts) of a bounded size."""
    part, size, first = [], 0, 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        part.append(raw)
        size += len(raw)
        if size >= BYTES_AT_ONCE:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes (uint64).

    Words are runs of bytes other than white space, A-Z in lower case; fewer than WORDS words make one shingle, and
    a null text or one without words has an empty set.
    """
    for _, part in runs(texts):
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        prefix = prefix_hashes(_CODES[raw])
        space = _IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edge[0::2], edge[1::2]
        words = span_hash(prefix, starts, ends)
        bounds = np.cumsum([0, *(len(p) + 1 for p in part)])
        of_doc = np.searchsorted(starts, bounds)
        with np.errstate(over="ignore"):
            n = max(0, len(words) - WORDS + 1)
            full = np.zeros(n, np.uint64)
            for k in range(WORDS):
                full += words[k : k + n] * _PLACE[k]
            full = mixed(full)
            for lo, hi in zip(of_doc[:-1], of_doc[1:], strict=True):
                if hi - lo >= WORDS:
                    yield np.unique(full[lo : hi - WORDS + 1])
                elif hi > lo:
                    yield mixed((words[lo:hi] * _PLACE[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo) * _PLACE[WORDS])
                else:
                    yield np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> bytes:
    """16 bytes for a set: its size, big-endian, then 96 bits of a hash of its shingles."""
    return len(shingles).to_bytes(4, "big") + xxhash.xxh3_128_digest(shingles.tobytes())[:12]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union, of non-empty sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= 80 * (len(a) + len(b) - both)
