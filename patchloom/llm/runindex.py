"""A run-length index: the Burrows-Wheeler transform of a set of byte strings, kept as runs with sampled run ends.

`RunIndex.stream` gives matching statistics: for each position of each pattern how long the longest string is that starts
there and occurs in the index, and the row of the sorted suffixes where an occurrence stands. Patterns are read from their
ends, all of them in step. A character that the current row's run doesn't hold leads to the nearest run of it above or below,
whichever continues the match longer, as the text positions sampled at run ends tell.
"""

from __future__ import annotations

import numpy as np

#: Symbols in a first sorting key: 7 of 9 bits. A byte b is the symbol b + 1, the end of a string 0.
FIRST = 7


def suffixes(text: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by doubling, where later rounds only sort what is still tied, and the ranks of all suffixes by their
    first `keep` symbols; keep is FIRST times a power of two."""
    n = len(text)
    wide = np.zeros(n + FIRST, np.int64)
    wide[:n] = text
    key = np.zeros(n, np.int64)
    for j in range(FIRST):
        key = key << 9 | wide[j : j + n]
    order = np.argsort(key).astype(np.int32)
    ordered = key[order]
    lead = np.ones(n + 1, bool)
    lead[1:n] = ordered[1:] != ordered[:-1]
    del key, ordered, wide
    slot = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(lead[:n], slot, 0))
    depth, kept = FIRST, None
    while True:
        if depth == keep:
            kept = rank.copy()
        tied = np.flatnonzero(~(lead[:n] & lead[1:]))
        if not len(tied):
            return order, rank if kept is None else kept
        at = order[tied]
        after = at.astype(np.int64) + depth
        both = rank[at].astype(np.int64) << 32
        both[after < n] += rank[after[after < n]].astype(np.int64) + 1
        fresh = np.argsort(both)
        at, both = at[fresh], both[fresh]
        order[tied] = at
        new = np.append(True, both[1:] != both[:-1])
        lead[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        depth *= 2


class RunIndex:
    def __init__(self, data: np.ndarray, edge: np.ndarray, owner: np.ndarray, length: int):
        """Strings data[edge[i]:edge[i + 1]], each with an owner; for every string of `length` bytes in the index the least owner is known."""
        sizes = np.diff(edge)
        n = len(data) + len(sizes)
        text = np.zeros(n, np.int16)
        self.begin = edge[:-1] + np.arange(len(sizes))
        inner = np.ones(n, bool)
        inner[edge[1:] + np.arange(len(sizes))] = False
        text[inner] = data
        text[inner] += 1
        keep = FIRST
        while 2 * keep <= length:
            keep *= 2
        order, ranks = suffixes(text, keep)
        last = text[order - 1]  # the transform; before the first suffix comes the end of the last string
        cut = np.append(True, last[1:] != last[:-1])
        self.starts = np.flatnonzero(cut)
        self.chars = last[self.starts]
        ends = np.append(self.starts[1:], n)
        self.top, self.bottom = order[self.starts], order[ends - 1]
        long = ends - self.starts
        by_char = np.argsort(self.chars, kind="stable")
        total = np.cumsum(long[by_char])
        # the row to which the first row of a run leads: all smaller symbols, and the same one in earlier runs
        self.to = np.empty(len(long), np.int64)
        self.to[by_char] = total - long[by_char]
        self.by_char = by_char
        self.char_at = np.searchsorted(self.chars[by_char], np.arange(258))
        self.text, self.n = text, n
        # rows whose suffixes share their first `length` symbols: equal ranks by `keep` symbols here and length - keep further on
        step = np.minimum(order.astype(np.int64) + length - keep, n - 1)
        same = (ranks[order[1:]] == ranks[order[:-1]]) & (ranks[step[1:]] == ranks[step[:-1]])
        lead = np.flatnonzero(np.append(True, ~same))
        holder = np.repeat(owner, sizes + 1)
        # the least owner by groups of such rows; it is only looked up where a match is long enough
        self.lead, self.least = lead, np.minimum.reduceat(holder[order], lead)
        # from row to run by a table; an index is one partition's, so it is small, and a look-up is one read
        self.run = np.repeat(np.arange(len(long), dtype=np.int32), long)
        self.shift = (self.to - self.starts).astype(np.int32)

    def common(self, at: np.ndarray, pattern: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix, up to `most`, of the index's text from `at` and the pattern's from `start`."""
        out = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            j = out[live]
            x, y = at[live] + j, start[live] + j
            ok = (x < self.n) & (self.text[np.minimum(x, self.n - 1)] == pattern[y])
            live = live[ok]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def stream(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: for every position of the patterns the match's length, and a row with an occurrence."""
        pattern = data.astype(np.int16) + 1
        length, row = np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
        sizes = np.diff(edge)
        by_size = np.argsort(-sizes, kind="stable")
        ends, active = edge[1:][by_size], np.searchsorted(-sizes[by_size], -np.arange(1, (sizes.max() if len(sizes) else 0) + 1), side="right")
        q, m = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
        pos = np.full(len(sizes), self.top[0], np.int32)
        for t, k in enumerate(active.tolist()):
            here = ends[:k] - 1 - t
            c = pattern[here]
            q, pos, m = q[:k], pos[:k], m[:k]
            run = self.run[q]
            off = np.flatnonzero(self.chars[run] != c)
            if len(off):
                lo, hi = self.char_at[c[off]], self.char_at[c[off] + 1]
                key = c[off].astype(np.int64) * len(self.starts) + run[off]
                below = np.searchsorted(self.order_keys, key)  # first run of the character after this run
                up, down = np.maximum(below - 1, 0), np.minimum(below, len(self.by_char) - 1)
                has_up, has_down = below > lo, below < hi
                up_run, down_run = self.by_char[up], self.by_char[down]
                here_off, most = here[off] + 1, m[off]
                a = np.where(has_up, self.common(self.bottom[up_run].astype(np.int64), pattern, here_off, np.where(has_up, most, 0)), -1)
                b = np.where(has_down, self.common(self.top[down_run].astype(np.int64), pattern, here_off, np.where(has_down, most, 0)), -1)
                go_up, none = a >= b, ~(has_up | has_down)
                new_run = np.where(go_up, up_run, down_run)
                run[off] = new_run
                q[off] = np.where(go_up, np.append(self.starts[1:], self.n)[new_run] - 1, self.starts[new_run])
                pos[off] = np.where(go_up, self.bottom[new_run], self.top[new_run])
                m[off] = np.maximum(np.maximum(a, b), 0)
                if none.any():  # a character that the index doesn't have: the match starts anew
                    gone = off[none]
                    m[gone] = -1
            q = q + self.shift[run]
            pos = pos - 1
            m = m + 1
            fresh = m == 0
            if fresh.any():
                q[fresh], pos[fresh] = 0, self.top[0]
            length[here], row[here] = m, q
        return length, row

    @property
    def order_keys(self) -> np.ndarray:
        """Runs by character and place, as one ascending key."""
        if not hasattr(self, "_keys"):
            self._keys = self.chars[self.by_char].astype(np.int64) * len(self.starts) + self.by_char
        return self._keys

    def least_owner(self, row: np.ndarray) -> np.ndarray:
        """The least owner of the strings that hold the `length` symbols with which the suffix of a row begins."""
        return self.least[np.searchsorted(self.lead, row, side="right") - 1]
