"""Token ids of text columns: a public tokenizer behind a cache of words.

A tokenizer that drops white space, never joins two words and parts letters from punctuation can be asked once per
different word. Most words of a corpus repeat, so they are looked up by hash in NumPy tables; only new ones reach the
tokenizer.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from corvane.llm.common import _ranges, text_bytes, word_hashes, word_spans

#: The cache is emptied at so many words; it bounds memory only.
MOST_WORDS = 1_200_000
#: Words of more bytes are looked up by their bytes, not by a hash, and are not kept.
LONG = 128
#: Text bytes that are looked up together.
STEP_BYTES = 8 << 20
#: New words sent to the tokenizer as one text, and characters of one id that may stand between them.
TOGETHER, BETWEEN = 4000, "•¶§†¤"
_KEPT: dict[str, WordIds] = {}


class WordIds:
    """Ids of words under one tokenizer file; entry 0 is the end id."""

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        one = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in BETWEEN}
        self.folds = self.tokenizer.encode("AB aB").ids == self.tokenizer.encode("ab ab").ids
        self.between = next(((c, ids[0]) for c, ids in one.items() if len(ids) == 1), None)
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids, self.used = np.full(1 << 16, self.end, np.uint32), 1
        self.start, self.length, self.entries = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64), 1

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        if self.between and len(words) > 1:
            mark, mark_id = self.between
            joined = f" {mark} ".join(words)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == mark_id)
            # A word that holds the mark itself shows as one cut too many.
            if len(cuts) == len(words) - 1:
                return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def learn(self, words: list[str]) -> np.ndarray:
        """New entries for the words: their numbers."""
        first = self.entries
        for at in range(0, len(words), TOGETHER):
            flat, sizes = self._ids(words[at : at + TOGETHER])
            n, used = self.entries, self.used
            self.ids = _grown(self.ids, used + len(flat))
            self.start, self.length = _grown(self.start, n + len(sizes)), _grown(self.length, n + len(sizes))
            self.ids[used : used + len(flat)] = flat
            self.start[n : n + len(sizes)] = used + np.cumsum(sizes) - sizes
            self.length[n : n + len(sizes)] = sizes
            self.used, self.entries = used + len(flat), n + len(sizes)
        return np.arange(first, self.entries)

    def numbers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each word."""
        if self.entries > MOST_WORDS:
            self.clear()
        hashes = word_hashes(raw, starts, ends, lower=self.folds)
        if self.folds and (tags := np.flatnonzero(raw == ord("<"))).size:
            # Special tokens are told apart by case.
            own = np.unique(np.searchsorted(starts, tags, "right") - 1)
            hashes[own] = ~word_hashes(raw, starts[own], ends[own], lower=False)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = keys.tolist()
        at = np.fromiter(map(self.index.get, known, repeat(-1)), np.int64, len(known))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = self.learn([raw[starts[w] : ends[w]].tobytes().decode() for w in where[new].tolist()])
            at[new] = fresh
            short = ends[where[new]] - starts[where[new]] <= LONG
            self.index.update(zip(keys[new[short]].tolist(), fresh[short].tolist()))
        out = at[back]
        for w in np.flatnonzero(ends - starts > LONG).tolist():
            out[w] = self.learn([raw[starts[w] : ends[w]].tobytes().decode()])[0]
        return out


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def word_ids(path: str, end: int) -> WordIds:
    """The cache of this Python worker."""
    if path not in _KEPT or _KEPT[path].end != end:
        _KEPT[path] = WordIds(path, end)
    return _KEPT[path]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _stops_apart(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A full stop or comma after a letter becomes a word of its own, as it does in the tokenizer; so words repeat
    more often."""
    last = raw[ends - 1]
    cut = np.flatnonzero(((last == ord(".")) | (last == ord(","))) & _LETTER[raw[np.maximum(ends - 2, 0)]] & (ends - starts > 1))
    shift = np.searchsorted(cut, first)
    return np.insert(starts, cut + 1, ends[cut] - 1), np.insert(ends, cut, ends[cut] - 1), first + shift


def encode(cache: WordIds, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the end id, and the offsets of the texts. Null is empty."""
    raw, offsets = text_bytes(column)
    starts, ends, first = _stops_apart(raw, *word_spans(raw, offsets))
    at = np.insert(cache.numbers(raw, starts, ends), first[1:], 0)
    sizes = cache.length[at]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return cache.ids[_ranges(cache.start[at], sizes)], upto[first + np.arange(len(first))]
