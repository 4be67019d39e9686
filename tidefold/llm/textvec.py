"""Vectorised text primitives on Arrow string buffers: words, word hashes and window hashes.

A batch of texts is one UTF-8 byte buffer with offsets, so numpy handles a slice of many texts at
once and no Python object is made per word. Slices hold about a megabyte; a longer text is a slice
of its own and is hashed block by block, so that scratch memory follows the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, BLOCK + 1)
        factors = np.full(size, np.uint64(base))
        factors[0] = 1
        got = _powers[base] = np.multiply.accumulate(factors)
        if size > 8 * BLOCK:  # a giant word: do not keep its table
            del _powers[base]
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Texts first..last of a batch; bounds are byte offsets of texts within `data`."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return self.last - self.first


def slices(column: pa.Array, block: int = BLOCK) -> Iterator[Slice]:
    """The texts of an Arrow string column in slices of about `block` bytes; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(off, off[i] + block, "right")) - 1
        j = min(max(j, i + 1), len(column))
        yield Slice(i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


@dataclass
class Words:
    """starts, ends: bytes of each word; first: index of the first word of each text (n + 1)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(s: Slice, is_word: np.ndarray = IS_WORD) -> Words:
    w = is_word[s.data]
    begin, end = w.copy(), w.copy()
    if len(w):
        begin[1:] &= ~w[:-1]
        end[:-1] &= ~w[1:]
        edge = np.unique(s.bounds)
        at = edge[edge < len(w)]
        begin[at] |= w[at]
        at = edge[edge > 0] - 1
        end[at] |= w[at]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(starts, s.bounds))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (sorted, disjoint): equal bytes, equal hash."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK, "right")), i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        n = hi - lo
        run = np.zeros(n + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _power_table(_P, n), out=run[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (run[b] - run[a]) * _power_table(_PINV, n)[a]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that lie within one text, and each window's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for i in range(k):
        factor = factor * 0xC2B2AE3D27D4EB4F & _MASK | 1
        out += h[i : i + n] * np.uint64(factor)
    ok = np.zeros(len(h) + k, bool)
    lengths = np.diff(first)
    inside = first[:-1][lengths >= k]
    until = first[1:][lengths >= k] - k + 1
    step = np.zeros(len(h) + 1, np.int32)
    np.add.at(step, inside, 1)
    np.add.at(step, until, -1)
    ok = np.cumsum(step[:n]) > 0
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def range_sums(values: np.ndarray, first: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:until[i]]."""
    run = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, dtype=np.float64, out=run[1:])
    first = np.minimum(first, len(values))
    until = np.maximum(first, np.minimum(until, len(values)))
    return run[until] - run[first]
