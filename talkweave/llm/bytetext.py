"""Vectorised work on batches of texts as one byte buffer.

Spark hands Python a column of texts as an Arrow array, which is already one
buffer of UTF-8 bytes with offsets. Words, lines and their hashes are found on
that buffer with NumPy, in slices of about a megabyte, so that memory stays
bounded whatever the batch holds (a slice is never smaller than one text).

Hashes modulo 2^64 are quick, but texts can be made that share them; they only say what is to be compared
byte by byte (`identities`, `equal_spans`). Where names travel without their bytes (words of
shingles), `names_of` takes polynomial hashes modulo the prime 2^31 - 1 under two independent bases, 62 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1 << 60, (1 << 61) - 1)) * 8 + 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of BASE and its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = n + n // 8  # workers live long and keep this
            for name, b in (("up", BASE), ("down", BASE_INVERSE)):
                p = np.full(m, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up, self.down


POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: out[i] covers data[:i]."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free, mixed hashes of data[start:end] from prefix hashes."""
    _, down = POWERS.get(len(prefix))
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


PRIME = (1 << 31) - 1
_P, _31 = np.uint64(PRIME), np.uint64(31)
BASES = [int(b) for b in _RNG.integers(1 << 29, PRIME, 2)]
VALUES = _RNG.integers(1, PRIME, (2, 256), dtype=np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2^62."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


class _PrimePowers:
    """Powers of BASES modulo PRIME, grown on demand."""

    def __init__(self) -> None:
        self.tables = [np.ones(1, np.uint32) for _ in BASES]

    def get(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            m = len(self.tables[0])
            self.tables = [np.concatenate([t, _reduced(t[: n - m] * np.uint64(pow(b, m, PRIME))).astype(np.uint32)]) for t, b in zip(self.tables, BASES, strict=True)]
        return self.tables


PRIME_POWERS = _PrimePowers()


def names_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of data[start:end], alike wherever equal bytes stand: 62 bits of two prime moduli and the length, mixed. Powers go by the place in the span."""
    n = ends - starts
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n > 0)
    if len(some):
        begin = np.cumsum(n[some]) - n[some]
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n[some])
        byte = data[place + np.repeat(starts[some], n[some])]
        for values, up in zip(VALUES, PRIME_POWERS.get(int(n.max())), strict=True):
            terms = values[byte] * up[place]
            out[some] = (out[some] << _31) + _reduced(np.add.reduceat((terms & _P) + (terms >> _31), begin))  # terms below 2^32: no overflow below 4 GB
    return mix(out + mix(n.astype(np.uint64)))


def wide(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1)).view("<u8")[:, 0] if len(data) else np.zeros(1, np.uint64)


def equal_spans(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Are the n bytes from a on in `left` and those from b on in `right` equal? left and right are wide()."""
    unused = (8 * np.clip(8 - n, 0, 8)).astype(np.uint64)
    unused[n == 0] = 63  # shifts of 64 are undefined
    out = ((left[a] ^ right[b]) << unused == 0) | (n == 0)
    live, done = np.flatnonzero(out & (n > 8)), 8
    while len(live):
        rest = n[live] - done
        differing = left[a[live] + done] ^ right[b[live] + done]
        unused = (8 * np.maximum(8 - rest, 0)).astype(np.uint64)
        out[live[(differing << unused) != 0]] = False
        live = live[(rest > 8) & out[live]]
        done += 8
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place where each occurs, and which one each value is (np.unique without its slower stable sort)."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the spans, equal exactly where their bytes are: told by a quick hash, compared byte by byte."""
    names = span_hashes(prefix_hashes(data), starts, ends)
    _, first, which = distinct(names)
    example, view = first[which], wide(data)
    size = ends - starts
    same = size == size[example]
    same[same] = equal_spans(view, starts[same], view, starts[example[same]], size[same])
    if not same.all():
        known: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            which[k] = known.setdefault(data[starts[k] : ends[k]].tobytes(), len(first) + len(known))
    return which


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = texts.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about `limit` bytes."""
    data, offsets = buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that cross no text: starts, ends, runs before each text."""
    if not len(member):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    full = offsets[:-1] < offsets[1:]
    lo, hi = offsets[:-1][full], offsets[1:][full] - 1
    first[lo] = member[lo]
    last[hi] = member[hi]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: starts, ends, words before each text."""
    return runs(~IS_SPACE[data], offsets)


def row_of(before: np.ndarray) -> np.ndarray:
    """Text index of each item, from the items before each text."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def sums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of the values of each text; 0 for texts without any."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[before[1:]] - total[before[:-1]]
