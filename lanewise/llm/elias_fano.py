"""Elias-Fano coded monotone sequences with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

_WORD = np.uint64(64)


class EliasFano:
    """A sorted sequence: low bytes as they are, high parts as unary counts with a directory.

    `high` holds, for each high part in turn, a one per value and a closing zero. The number
    of low bits is the classic log2(universe / n), rounded up to whole bytes.
    """

    def __init__(self, n: int, low_bytes: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bytes, self.low, self.high = n, low_bytes, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.cumsum(ones)  # the directory: set bits up to the end of each word
        self.zeros = np.arange(1, len(high) + 1) * 64 - self.ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bytes = min(7, (max(0, (top // max(1, n)).bit_length() - 1) + 7) // 8)
        shift = np.uint64(8 * low_bytes)
        low = values.view(np.uint8).reshape(n, 8)[:, :low_bytes].copy()
        parts = (values >> shift).astype(np.int64)
        size = n + (int(parts[-1]) if n else 0) + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[parts + np.arange(n)] = 1
        return cls(n, low_bytes, low, np.packbits(bits, bitorder="little").view(np.uint64))

    def __len__(self) -> int:
        return self.n

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th set (or unset) bit, counted from 0."""
        directory = self.ones if ones else self.zeros
        word = np.searchsorted(directory, k, side="right")
        rank = k - np.where(word > 0, directory[word - 1], 0)
        bits = self.high[word] if ones else ~self.high[word]
        place = np.zeros(len(k), np.uint64)
        for step in (32, 16, 8, 4, 2, 1):
            width = np.uint64(step)
            lower = bits & np.uint64((1 << step) - 1)
            count = np.bitwise_count(lower).astype(np.int64)
            up = rank >= count
            rank = np.where(up, rank - count, rank)
            bits = np.where(up, bits >> width, lower)
            place += np.where(up, width, np.uint64(0))
        return word * 64 + place.astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.low_bytes):
            out |= self.low[i, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(8 * self.low_bytes) | self._lows(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below each x; n if there is none."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        part = x >> np.uint64(8 * self.low_bytes)
        last = np.uint64(self.zeros[-1] - 1)
        inside = part <= last
        part = np.minimum(part, last).astype(np.int64)
        start = np.where(part > 0, self._select(np.maximum(part - 1, 0), False) - (part - 1), 0)
        end = np.minimum(self._select(part, False) - part, self.n)
        start, stop = np.where(inside, np.minimum(start, end), self.n), np.where(inside, end, self.n)
        low = x & np.uint64((1 << 8 * self.low_bytes) - 1)
        # Within one high part the low bytes are sorted: halve until nothing is open.
        while (open_ := np.flatnonzero(start < stop)).size:
            middle = (start[open_] + stop[open_]) // 2
            below = self._lows(middle) < low[open_]
            start[open_] = np.where(below, middle + 1, start[open_])
            stop[open_] = np.where(below, stop[open_], middle)
        return start

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it is not in the sequence."""
        x = np.asarray(x, np.uint64)
        at = self.successor(x)
        found = at < self.n
        found[found] = self[at[found]] == x[found]
        return np.where(found, at, -1)

    def arrays(self) -> list[np.ndarray]:
        return [self.low.reshape(-1), self.high.view(np.uint8)]
