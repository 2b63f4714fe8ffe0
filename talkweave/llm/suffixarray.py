"""A sparse suffix array over prefix polynomial hashes.

Suffixes are compared by their longest common extension, found by binary search
on prefix hashes, in log(limit) steps, and by the byte after it. Sorting is a
bottom-up mergesort, done for all groups of suffixes at once with NumPy. What
hashes call equal is verified byte by byte.
"""

from __future__ import annotations

import numpy as np

from talkweave.llm import bytetext

VERIFY_BYTES = 8 << 20


class HashedText:
    """Bytes with prefix hashes; suffixes are compared on their first `limit` bytes."""

    def __init__(self, data: np.ndarray, limit: int) -> None:
        self.data, self.limit = data, limit
        self.prefix = bytetext.prefix_hashes(data)
        self.up, _ = bytetext.POWERS.get(len(data) + 1)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the suffixes at i and j, limit at most."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.limit, np.int64)
        up_i, up_j, start_i, start_j = self.up[i], self.up[j], self.prefix[i], self.prefix[j]
        for _ in range(self.limit.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[i + mid] - start_i) * up_j == (self.prefix[j + mid] - start_j) * up_i
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Is the suffix at i less than (where or_equal: at most) that at j?"""
        n = self.extension(i, j)
        full = n >= self.limit
        n = np.minimum(n, self.limit - 1)
        return np.where(full, or_equal, self.data[i + n] < self.data[j + n])

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal in the first `limit` bytes: by hash, then byte by byte."""
        out = (self.prefix[i + self.limit] - self.prefix[i]) * self.up[j] == (self.prefix[j + self.limit] - self.prefix[j]) * self.up[i]
        at, step = np.flatnonzero(out), max(1, VERIFY_BYTES // self.limit)
        span = np.arange(self.limit)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            out[part] = (self.data[i[part][:, None] + span] == self.data[j[part][:, None] + span]).all(axis=1)
        return out


def merge_sorted(text: HashedText, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes (positions) within their groups; group ids stand together. Stable."""
    order = np.arange(len(suffix))
    if not len(suffix):
        return order
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, len(group)))
    run = 1
    while run < size.max():
        wide = size > run
        slots = np.concatenate([np.arange(0)]) if not wide.any() else np.repeat(begin[wide] - np.cumsum(size[wide]) + size[wide], size[wide]) + np.arange(int(size[wide].sum()))
        first, end = np.repeat(begin[wide], size[wide]), np.repeat(begin[wide] + size[wide], size[wide])
        pair = first + (slots - first) // (2 * run) * (2 * run)
        middle = np.minimum(pair + run, end)
        last = np.minimum(pair + 2 * run, end)
        left = slots < middle
        low, high = np.where(left, middle, pair), np.where(left, last, middle)
        base = low.copy()
        own = suffix[order[slots]]
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            other = suffix[order[mid]]
            # a left item counts right ones below it, a right item counts left ones up to it
            below = text.less(other, own[live], ~left[live])
            low[live] = np.where(below, mid + 1, low[live])
            high[live] = np.where(below, high[live], mid)
            live = live[low[live] < high[live]]
        place = slots - np.where(left, 0, middle - pair) + (low - base)
        moved = order.copy()
        moved[place] = order[slots]
        order = moved
        run *= 2
    return order
