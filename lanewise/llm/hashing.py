"""Vectorised hashing of the words of many texts at a time."""

from __future__ import annotations

import numpy as np

from lanewise.llm.common import splitmix

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Class of each byte when words are runs without blanks.
WORD_CLASS = np.ones(256, np.uint8)
WORD_CLASS[list(BLANKS)] = 0


def token_hashes(values: list[bytes], classes: np.ndarray = WORD_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens in order, and the number of tokens of each text.

    A token is a maximal run of bytes of one class; class 0 separates. The hash sums a random
    number per byte value times one per place in the token, and mixes the sum.
    """
    data = np.frombuffer(b"\n".join(values) + b"\n", np.uint8)
    kind = classes[data]
    change = np.empty(len(kind), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    runs = np.flatnonzero(change)
    # A line break between texts ends every run, whatever the classes are.
    ends = np.cumsum([len(v) + 1 for v in values])
    starts = runs[kind[runs] > 0]
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    lengths = np.diff(np.append(runs, len(kind)))[kind[runs] > 0]
    inside = kind > 0
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = _BYTE[data[inside]] * _PLACE[place & 1023]
    if place.max() > 1023:
        terms *= (place >> 10).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return splitmix(sums + lengths.astype(np.uint64)), counts
