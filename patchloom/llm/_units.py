"""Encoding by units: a text is cut where no token can cross, and each distinct unit is encoded once for a block.

A bounded store in the worker keeps the ids of units seen before. It only saves time: it is emptied when full, and results
don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans of flat, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


class UnitEncoder:
    def __init__(self, split: Callable[[str], Sequence[str]], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 150_000):
        self.split, self.encode, self.most = split, encode, most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def add(self, units: list[str]) -> None:
        ids, lengths = self.encode(units)
        n = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while n + len(units) > len(self.starts):
            self.starts, self.lengths = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.lengths, np.zeros_like(self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n : n + len(units)] = lengths
        self.starts[n : n + len(units)] = self.used + np.cumsum(lengths) - lengths
        self.known.update(zip(units, range(n, n + len(units)), strict=True))
        self.used += len(ids)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each text has."""
        if len(self.known) > self.most or self.used > 1 << 22:
            self.clear()
        units: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = self.split(text)
            sizes[i] = len(own)
            units += own
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        if len(new := np.flatnonzero(at < 0)):
            self.add(list(dict.fromkeys(units[i] for i in new)))
            at[new] = np.fromiter((self.known[units[i]] for i in new), np.int64, len(new))
        lengths = self.lengths[at]
        ends = np.zeros(len(units) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        edge = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=edge[1:])
        return gather(self.ids, self.starts[at], lengths), np.diff(ends[edge])
