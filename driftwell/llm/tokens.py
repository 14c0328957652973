"""Word-level memo of a public word tokenizer: ids of whole texts, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import os
import re
from contextlib import suppress
from itertools import islice
from operator import add
from string import punctuation

import numpy as np

#: Words kept, at about 210 bytes each. When the memo is full, those that came first stay, since frequent words come early.
#: Longer words are never kept.
MEMO_WORDS, STAYING_WORDS, MEMO_CHARS = 400_000, 200_000, 48
#: A special token that stands between the words of one call.
BETWEEN = "<|startoftext|>"
#: What tokens that end a run of letters end with, in vocabularies that mark them.
END_OF_WORD = "</w>"
#: Words or runs of letters encoded in one call.
AT_ONCE = 500
#: str.split() takes these for white space; the tokenizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")

_open: dict[str, WordTokens] = {}


class WordTokens:
    """Ids of texts by a tokenizer file that drops white space and never joins across it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max([*vocabulary.values(), 0]) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith(END_OF_WORD)]] = True
        self.memo: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """One per process and file."""
        if path not in _open:
            _open[path] = cls(path)
        return _open[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        self.memo.update(zip(words, [raw[s:e] for s, e in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)], strict=True))

    def _learn_letters(self, words: list[str]) -> None:
        """Runs of letters, each of which ends with the one token that says so."""
        ids = self._encoded(" ".join(words))
        ends = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            self._learn_any(words)
        else:
            self._keep(words, ids, np.append(0, ends[:-1]), ends)

    def _learn_any(self, words: list[str]) -> None:
        ids = self._encoded(BETWEEN.join(words))
        cuts = np.flatnonzero(ids == self.between)
        self._keep(words, ids, np.append(0, cuts + 1), np.append(cuts, len(ids)))

    def _learn(self, words: set[str]) -> None:
        """Of words that aren't in the memo. The ids of letters that end in punctuation are those of both, which the
        tokenizer never joins."""
        letters, other, whole, cores, tails = [], [], [], [], []
        for w in words:
            if w.isalpha():
                letters.append(w)
                continue
            core = w.rstrip(punctuation)
            if core.isalpha():
                whole.append(w)
                cores.append(core)
                tails.append(w[len(core) :])
            else:
                other.append(w)
        letters += {*cores}.difference(self.memo, words)
        other += {*tails}.difference(self.memo, words)
        plain = [w for w in other if "<|" not in w]
        for lo in range(0, len(letters), AT_ONCE):
            self._learn_letters(letters[lo : lo + AT_ONCE])
        for lo in range(0, len(plain), AT_ONCE):
            self._learn_any(plain[lo : lo + AT_ONCE])
        for w in other:
            if "<|" in w:
                self.memo[w] = self.whole(w)
        get = self.memo.__getitem__
        self.memo.update(zip(whole, map(add, map(get, cores), map(get, tails)), strict=True))

    @staticmethod
    def _words(text: str) -> list[str] | None:
        """Words of a text; None if only the tokenizer can tell them. Where lower case is sure to be the tokenizer's, it is
        taken at once."""
        if ODD_SPACE.search(text):
            return None
        if "<|" not in text:
            with suppress(UnicodeEncodeError):
                text.encode("latin-1")
                return text.lower().split()
        return text.split()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Of a batch of texts; null counts as empty."""
        get, found, holes, missing = self.memo.get, [], [], set()
        for text in texts:
            words = self._words(text or "")
            ids = None if words is None else list(map(get, words))
            at = [] if ids is None else [k for k, x in enumerate(ids) if x is None]
            missing.update([words[k] for k in at])
            found.append(ids)
            holes.append([(k, words[k]) for k in at])
        if len(self.memo) + len(missing) > MEMO_WORDS:
            self.memo = dict(islice(self.memo.items(), STAYING_WORDS))
            get = self.memo.get
        long = {w: self.whole(w) for w in missing if len(w) > MEMO_CHARS}
        self._learn(missing.difference(long))
        for ids, mine in zip(found, holes, strict=True):
            for k, w in mine:
                ids[k] = long[w] if w in long else get(w)
        return [self.whole(texts[k] or "") if ids is None else b"".join(ids) for k, ids in enumerate(found)]
