"""Encoding by segments: parts of a text that a tokenizer never merges across.

Natural text repeats its words, so a worker encodes each distinct segment once, in
batches, and remembers a bounded number of results as packed 32-bit ids.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterable

import numpy as np

#: Distinct segments that a worker remembers before it starts afresh.
REMEMBERED = 400_000


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Memo:
    """Packed ids of segments; ``encode`` gives the ids of each of a list of segments."""

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], limit: int = REMEMBERED):
        self.encode, self.limit, self.known = encode, limit, {}

    def learn(self, parts: Iterable[list[str]]) -> None:
        """Make sure that every segment of the lists is known."""
        new = set().union(*parts)
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
        new = [s for s in new if s not in self.known]
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            for s, ids in zip(part, self.encode(part), strict=True):
                self.known[s] = packed(ids)

    def packed(self, segments: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, segments))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] of them, for each i."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)
