"""A compressed FM-index over word sequences: wavelet matrix, backward search, and the least owner of each match.

The sequences of a shard are one text of symbols, each sequence followed by symbol 0. Suffixes are sorted by their first
``order`` symbols, which is enough for patterns of up to ``order`` symbols (a step of the search needs only that the
suffixes with the pattern so far are neighbours). The Burrows-Wheeler text is kept as a wavelet matrix: one bit vector
for each bit of a symbol, packed in 64-bit words with a count before each word. Neither the text nor the suffix array is
kept: the owners of the suffixes, in their order, are all that a search needs beside it. Patterns are streamed through
the index in runs of ``RUN``: a step of the search is a few gathers for all of a run.
"""

from __future__ import annotations

import numpy as np

#: The bits of a word below each place in it.
_BELOW = np.array([(1 << k) - 1 for k in range(64)], dtype=np.uint64)
#: Patterns that are searched side by side: what a step holds of them stays in the processor's cache.
RUN = 1 << 15


class WaveletMatrix:
    """Ranks of symbols in a text of small integers."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[np.int32] = []
        now = text.astype(np.uint32)
        size = len(text) // 64 + 1
        for level in range(self.levels - 1, -1, -1):
            one = (now >> np.uint32(level) & np.uint32(1)).astype(bool)
            padded = np.zeros(size * 64, dtype=bool)
            padded[: len(one)] = one
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(np.int32(len(one) - np.count_nonzero(one)))
            now = np.concatenate([now[~one], now[one]])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place on a level."""
        word = at >> 6
        below = _BELOW.take(at & 63)
        below &= self.bits[k].take(word)
        return self.before[k].take(word) + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places (a row of begins, a row of ends) among the symbols equal to each symbol, counted from the bottom level's start."""
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            ones = self._ones(k, places)
            places = np.where(one, ones + self.zeros[k], places - ones)
        return places


def _classes(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.zeros(len(keys), dtype=np.int64)
    fresh[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


def suffix_order(text: np.ndarray, symbols: int, order: int) -> np.ndarray:
    """The places of a text by the first ``order`` symbols from there (0 behind the end), equal ones in their order."""
    n, rank, known, done = len(text), text.astype(np.int64), symbols, 1
    while done < order:
        # As many ranks, each of the next ``done`` symbols, as a key holds; the last may overlap the one before.
        width = max(int(known).bit_length(), 1)
        parts = min(63 // width, -(-order // done))
        key = np.zeros(n, dtype=np.int64)
        for j in range(parts):
            shift = min(j * done, order - done)
            part = np.zeros(n, dtype=np.int64)
            part[: max(n - shift, 0)] = rank[shift:] + 1
            key = key << width | part
        done = min(parts * done, order)
        rank = _classes(key)
        known = int(rank.max()) + 2
    return np.argsort(rank, kind="stable")


class FmIndex:
    """The index of a shard of sequences (arrays of positive symbols below ``symbols``), with an owner for each place of the text."""

    def __init__(self, text: np.ndarray, symbols: int, order: int, owner: np.ndarray):
        suffixes = suffix_order(text, symbols, order)
        self.owner = np.append(owner[suffixes], np.iinfo(owner.dtype).max)
        self.wavelet = WaveletMatrix(text[suffixes - 1], symbols)  # place -1 is the last symbol, which is 0
        # Where the suffixes of a symbol begin, less where its ranks begin: one search step adds it.
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int32)
        every = np.arange(symbols, dtype=np.int32)
        self.shift = self.first[:-1] - self.wavelet.rank(every, np.zeros(symbols, dtype=np.int32))

    def search(self, stream: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with the ``length`` symbols of the stream before each place ``ends``."""
        out = np.empty((2, len(ends)), dtype=np.int32)
        for at in range(0, len(ends), RUN):
            own = ends[at : at + RUN]
            symbol = stream.take(own - 1)
            places = np.stack([self.first.take(symbol), self.first.take(symbol + 1)])
            for back in range(2, length + 1):
                symbol = stream.take(own - back)
                places = self.wavelet.rank(symbol, places) + self.shift.take(symbol)
            out[:, at : at + RUN] = places
        return out[0], out[1]

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least owner over each interval (none is empty); equal lengths: intervals are apart or equal."""
        if not len(begin):
            return np.zeros(0, dtype=self.owner.dtype)
        starts, where = np.unique(begin, return_inverse=True)
        stops = np.zeros(len(starts), dtype=np.int64)
        stops[where] = end
        cuts = np.column_stack([starts, stops]).reshape(-1)
        return np.minimum.reduceat(self.owner, cuts)[::2][where]
