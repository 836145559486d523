"""NumPy kernels over Arrow text columns: words, hashes and windows without a Python loop over words.

Texts are taken in pieces of whole documents of about ``PIECE`` bytes, so that memory stays bounded
whatever the size of an Arrow batch; a longer document makes up a piece of its own, and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: Bytes of words: ASCII letters and digits, and all bytes of other characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n or more, kept between calls."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size > 4 * PIECE:
            return out  # a single very long document; not kept
        _powers[base] = out
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Piece:
    """Some whole documents of a batch: rows first to first + n, their bytes, and where each begins."""

    first: int
    data: np.ndarray
    starts: np.ndarray  # n + 1 offsets into data

    @property
    def n(self) -> int:
        return len(self.starts) - 1


@dataclass
class Words:
    """Words of a piece: byte spans, and the index of each document's first word (n + 1 values)."""

    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def pieces(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = PIECE) -> Iterator[Piece]:
    """Whole documents of a text column, as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield Piece(at, data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def words(p: Piece, table: np.ndarray = WORD_BYTE) -> Words:
    """Maximal runs of bytes in ``table``; a run never crosses documents."""
    inside = table[p.data]
    edge = np.zeros(len(p.data) + 1, bool)
    edge[p.starts] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(begin, end, np.searchsorted(begin, p.starts))


class SpanHash:
    """Hashes of spans of bytes: a polynomial from prefix sums, then mixed."""

    def __init__(self, data: np.ndarray) -> None:
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, len(data) + 1)[: len(data)], out=self.total[1:])
        self.inverse = _power_table(INVERSE, len(data) + 1)

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[begin]) * self.inverse[begin])


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return SpanHash(data)(begin, end)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, and the index of each document's first one (n + 1 values).

    A document of fewer words, but at least one, has one shingle of all its words.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(count)])
    m = len(hashes)
    if m >= width:
        full = np.zeros(m - width + 1, np.uint64)
        for k in range(width):
            full += hashes[k : m - width + 1 + k] * np.uint64(pow(BASE, k + 1, 1 << 64))
    else:
        full = np.zeros(0, np.uint64)
    out = np.empty(out_first[-1], np.uint64)
    long_docs = n >= width
    at = np.repeat(first[:-1][long_docs] - out_first[:-1][long_docs], count[long_docs])
    which = np.flatnonzero(np.repeat(long_docs, count))
    out[which] = full[at + which]
    for d in np.flatnonzero(~long_docs & (n > 0)):
        own = hashes[first[d] : first[d + 1]]
        k = np.array([pow(BASE, i + 1, 1 << 64) for i in range(len(own))], np.uint64)
        out[out_first[d]] = (own * k).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), out_first


def owners(first: np.ndarray) -> np.ndarray:
    """The document index of each item, from the index of each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def as_signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return h.view(np.int64)
