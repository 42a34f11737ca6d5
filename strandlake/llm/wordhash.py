"""Words of whole Arrow batches as numpy arrays: places, documents and 64-bit hashes.

A word's hash is a polynomial over random 64-bit values of its bytes, read from
prefix sums, then mixed. All bytes of a slice are handled at once; slices are
cut at document boundaries and hold about SLICE bytes (more only when a single
document is longer), so memory is bounded by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_class(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: The separators of the words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
SPACES = b" \t\n\v\f\r"
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Hasher:
    """separators: bytes between words; lower: take A-Z as a-z."""

    def __init__(self, separators: bytes = SPACES, lower: bool = False):
        self.word = word_class(separators)
        with np.errstate(over="ignore"):
            self.value = mix(np.arange(1, 257, dtype=_U) * _U(_P))
        if lower:
            self.value[65:91] = self.value[97:123]
        self.power = self.inverse = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, SLICE + 1)
            with np.errstate(over="ignore"):
                p, q = np.full(n, _P, _U), np.full(n, pow(_P, -1, 1 << 64), _U)
                p[0] = q[0] = 1
                self.power, self.inverse = np.cumprod(p, dtype=_U), np.cumprod(q, dtype=_U)

    def words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of documents data[cuts[i]:cuts[i+1]]: the words' starts, ends and hashes."""
        n = len(data)
        if not n:
            e = np.empty(0, np.int64)
            return e, e, e.astype(_U)
        self._powers(n + 1)
        inside = self.word[data]
        first = np.zeros(n + 1, bool)
        first[cuts] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | first[:n]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, _U)
            np.cumsum(self.value[data] * self.power[:n], out=sums[1:], dtype=_U)
            h = (sums[ends] - sums[starts]) * self.inverse[starts]
            h = mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
        return starts, ends, h


class Slice(NamedTuple):
    rows: slice  #: rows of the batch
    data: np.ndarray  #: their bytes
    cuts: np.ndarray  #: where each document starts, and the end
    starts: np.ndarray  #: words' first bytes
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  #: each document's first word, and the number of words


def slices(column: pa.Array, hasher: Hasher, size: int = SLICE) -> Iterator[Slice]:
    """A batch's texts (null: empty), some at a time."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        cuts = offsets[at : to + 1] - offsets[at]
        part = data[offsets[at] : offsets[to]]
        starts, ends, h = hasher.words(part, cuts)
        yield Slice(slice(at, to), part, cuts, starts, ends, h, np.searchsorted(starts, cuts))
        at = to
