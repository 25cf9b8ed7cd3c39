"""A compressed FM-index over word numbers: wavelet matrix, ranks, backward search."""

from __future__ import annotations

import numpy as np

#: Suffixes are sorted by their first 16 symbols, which is all that patterns up to that length need.
ORDER = 16


class Bits:
    """A bit vector with a count of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        pad = -len(bits) % 64 + 64
        packed = np.packbits(np.concatenate([bits, np.zeros(pad, bits.dtype)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FMIndex:
    """Over symbols 0 .. sigma - 1; 0 parts the texts and is in no pattern."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < ORDER:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            fresh = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            width *= 2
        self.places = order
        last = text[order - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.matrix = []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level & 1).astype(np.uint8)
            self.matrix.append(Bits(bit))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        # Where each symbol's stretch starts on the last level.
        here, base = np.arange(sigma), np.zeros(sigma, np.int64)
        for level, bits in zip(range(self.levels - 1, -1, -1), self.matrix):
            one = bits.rank1(base)
            base = np.where(here >> level & 1, bits.zeros + one, base - one)
        self.base = base

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first ``at`` places of the transform."""
        place = at
        for level, bits in zip(range(self.levels - 1, -1, -1), self.matrix):
            one = bits.rank1(place)
            place = np.where(symbol >> level & 1, bits.zeros + one, place - one)
        return place - self.base[symbol]

    def search(self, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns text[at : at + length], extended backwards together.

        A pattern whose range has come down to one suffix (its own place) is not extended further.
        """
        symbol = text[at + length - 1]
        low, high = self.starts[symbol].copy(), self.starts[symbol + 1].copy()
        live = np.flatnonzero(high - low > 1)
        for step in range(length - 2, -1, -1):
            if not len(live):
                break
            symbol = text[at[live] + step]
            both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            first = self.starts[symbol]
            low[live], high[live] = first + both[: len(live)], first + both[len(live) :]
            live = live[high[live] - low[live] > 1]
        return low, high
