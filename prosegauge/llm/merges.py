"""BPE over many words at once: what the tokenizers library does to one word, as array steps over all of them."""

from __future__ import annotations

import numpy as np

#: Bytes of the longest word; bits of a place within a word; a rank above all.
LONGEST, _BITS, _NONE = 64, 6, 1 << 24


class Merges:
    """The merges of a byte-level BPE vocabulary whose words end in a suffix.

    In every step each word merges its pair of the lowest rank, the leftmost of
    equal ones, until no pair of it has a rank.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], letters: list[str], suffix: str):
        self.size = max(vocab.values()) + 1
        self.first = np.array([[vocab[x], vocab[x + suffix]] for x in letters], np.int32)  # of a byte: within a word, at its end
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.ranks = np.argsort(pairs, kind="stable").astype(np.int32)
        self.pairs = pairs[self.ranks]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        every = self.first.T.ravel()
        self.opening = self._rank(np.repeat(self.first[:, 0], 512), np.tile(every, 256))  # of a byte and the next one, which may be the last

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)

    def encode(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) of words of 1 to LONGEST bytes, given all their bytes one after the other."""
        if not len(lengths):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        last = np.zeros(len(data), np.int64)
        last[ends - 1] = 1
        sym = self.first[data, last]
        place = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.int32)
        key = np.full(len(data), _NONE << _BITS, np.int32)
        key[:-1] = (self.opening[data[:-1].astype(np.int64) * 512 + last[1:] * 256 + data[1:]] << _BITS) | place[:-1]
        key[ends - 1] = _NONE << _BITS
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)  # signs that are still there
        after[ends - 1] = len(data)
        before[starts] = -1
        while True:
            best = np.minimum.reduceat(key, starts)
            live = np.flatnonzero(best < _NONE << _BITS)
            if not len(live):
                break
            best = best[live]
            i = starts[live] + (best & ((1 << _BITS) - 1))
            j = after[i]
            sym[i] = self.made[best >> _BITS]
            sym[j] = -1
            key[j] = key[i] = _NONE << _BITS
            nxt = after[j]
            after[i] = nxt
            right, own = nxt[nxt < len(data)], i[nxt < len(data)]
            before[right] = own
            key[own] = (self._rank(sym[own], sym[right]) << _BITS) | place[own]
            left, own = before[i][before[i] >= 0], i[before[i] >= 0]
            key[left] = (self._rank(sym[left], sym[own]) << _BITS) | place[left]
        kept = sym >= 0
        return sym[kept], np.add.reduceat(kept, starts, dtype=np.int64)
