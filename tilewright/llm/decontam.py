"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textkernels as tk

#: Benchmark text of up to so many bytes makes up one index on each worker; a larger benchmark is taken in
#: parts of about this size, each of which meets all documents.
PART_BYTES = 16 << 20


@dataclass(frozen=True)
class Settings:
    """Parameters of the search. A fingerprint has 64 bits in four blocks."""

    width: int = 5  # words of a shingle
    similarity: float = 0.8  # weighted Jaccard similarity of shingles from which a document is contaminated
    radius: int = 7  # bits in which the fingerprints of a window and of an item's may differ
    growth: float = 1.1  # between two sizes of windows


BLOCKS, BLOCK_BITS = 4, 16


@dataclass
class Index:
    """The windows of items of one size, and their fingerprints by block."""

    size: int
    need: int  # word pairs of the benchmark that a window of this size has at least, if its span is similar enough
    fingerprints: np.ndarray
    item: np.ndarray  # index into items
    offset: np.ndarray  # of the window in its item, in words
    order: list[np.ndarray]  # by block: windows sorted by their key
    keys: list[np.ndarray]  # by block: their keys, sorted
    flags: np.ndarray  # (blocks, 65536): some fingerprint's block is within reach of this key


def fingerprints(features: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every ``n`` consecutive features, 64-bit hashes.

    Each bit of a fingerprint tells whether most features of the window have it. The counts are sums
    modulo 256 in bytes, of which differences are exact below 256; larger windows take 16 bits.
    """
    if len(features) < n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1)
    kind = np.uint8 if n < 256 else np.uint16
    total = np.zeros((len(features) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=total[1:])
    most = (total[n:] - total[:-n]) > n // 2
    return np.packbits(most, axis=1).view(np.uint64).ravel()


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one."""
    return tk.mix(hashes[:-1] * np.uint64(tk.BASE) + hashes[1:])


def _flips(radius: int) -> np.ndarray:
    """What a block's key may be changed by: of fingerprints that differ in ``radius`` bits at most, one
    block of the four differs in a fourth of them at most."""
    ones = [0]
    for _ in range(radius // BLOCKS):
        ones = sorted({x ^ (1 << b) for x in ones for b in range(BLOCK_BITS)} | set(ones))
    return np.array(ones, np.int64)


def _keys(h: np.ndarray, block: int) -> np.ndarray:
    return ((h >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def window_words(n: int, s: Settings) -> int:
    """Words of the windows of an item of ``n`` words: as many as the least span has that can be similar
    enough to the item, or the next smaller size of a series that grows by ``growth``."""
    most = n if n <= s.width else max(int(np.ceil(s.similarity * (n - s.width + 1) - 1e-9)) + s.width - 1, 1)
    size = 1
    while (next_ := max(size + 1, int(size * s.growth))) <= most:
        size = next_
    return size


class Matcher:
    """Finds the items that a document holds. Built from the texts of items on each worker.

    An item's windows are sized by the item (see ``window_words``): a span that is similar enough holds a whole
    one, and where the copy differs from the item in a word at an end, one that doesn't reach it.
    """

    def __init__(self, texts: pa.Array, s: Settings) -> None:
        self.s, self.flips = s, _flips(s.radius)
        self.rows: list[int] = []  # of each item: its row in texts
        self.hashes: list[np.ndarray] = []
        for p in tk.pieces(texts, lower=True):
            w = tk.words(p)
            h = tk.span_hashes(p.data, w.begin, w.end)
            for d in range(p.n):
                if w.first[d + 1] > w.first[d]:
                    self.rows.append(p.first + d)
                    self.hashes.append(h[w.first[d] : w.first[d + 1]])
        self.shingles = [np.unique(self._shingles(h), return_counts=True) for h in self.hashes]
        by_size: dict[int, list[int]] = {}
        for i, h in enumerate(self.hashes):
            by_size.setdefault(window_words(len(h), s), []).append(i)
        self.indexes = [self._index(n, items) for n, items in sorted(by_size.items())]
        self.total = np.array([n.sum() for _, n in self.shingles], np.int64)
        self.words = np.array([len(h) for h in self.hashes], np.int64)
        self.pairs = self._table([_pairs(h) for h in self.hashes])
        self.known_shingles = self._table([x for x, _ in self.shingles])

    @staticmethod
    def _table(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.uint64]:
        """Flags by the first bits of some hashes, sixteen or more for each, and the shift that leaves these bits."""
        all_ = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        shift = np.uint64(64 - min(max(int(len(all_) * 16).bit_length(), 16), 26))
        flags = np.zeros(1 << (64 - int(shift)), bool)
        flags[(all_ >> shift).astype(np.int64)] = True
        return flags, shift

    @staticmethod
    def _sums(table: tuple[np.ndarray, np.uint64], hashes: np.ndarray, n: int) -> np.ndarray:
        """How many of the first k hashes are in a table, for k of 0 to ``n``."""
        out = np.zeros(n + 1, np.int32)
        np.cumsum(table[0][(hashes >> table[1]).astype(np.int64)], out=out[1 : len(hashes) + 1])
        out[len(hashes) + 1 :] = out[len(hashes)]
        return out

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        return tk.shingles(h, np.array([0, len(h)]), self.s.width)[0]

    def _index(self, size: int, items: list[int]) -> Index:
        prints = [fingerprints(self.hashes[i], size) for i in items]
        whole = np.concatenate(prints)
        # A span that is similar enough shares so many shingles with its item, each of which begins with a
        # pair of words of the item; the words of the span that the window leaves out can begin as many.
        least = [int(np.ceil(self.s.similarity * max(len(self.hashes[i]) - self.s.width + 1, 1) - 1e-9)) - (len(self.hashes[i]) - size) for i in items]
        need = 0 if size < 2 or min(len(self.hashes[i]) for i in items) < 2 else max(min(least), 0)
        flags = np.zeros((BLOCKS, 1 << BLOCK_BITS), bool)
        order, keys = [], []
        for k in range(BLOCKS):
            own = _keys(whole, k)
            order.append(np.argsort(own, kind="stable"))
            keys.append(own[order[-1]])
            flags[k, (own[:, None] ^ self.flips[None]).ravel()] = True
        item = np.repeat(items, [len(x) for x in prints])
        return Index(size, min(need, size - 1), whole, item, np.concatenate([np.arange(len(x)) for x in prints]), order, keys, flags)

    def _near(self, h: np.ndarray, ix: Index) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (fingerprint of h, window of the index) that differ in ``radius`` bits at most."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(BLOCKS):
            own = _keys(h, k)
            at = np.flatnonzero(ix.flags[k, own])
            for flip in self.flips if len(at) else ():
                lo, hi = np.searchsorted(ix.keys[k], own[at] ^ flip, "left"), np.searchsorted(ix.keys[k], own[at] ^ flip, "right")
                n = hi - lo
                i = np.repeat(at, n)
                j = ix.order[k][np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                close = np.bitwise_count(h[i] ^ ix.fingerprints[j]) <= self.s.radius
                left.append(i[close])
                right.append(j[close])
        return np.concatenate(left), np.concatenate(right)

    def similarity(self, item: int, span: np.ndarray) -> float:
        """Weighted Jaccard similarity: shingles count as often as they occur."""
        own, n = self.shingles[item]
        other, m = np.unique(self._shingles(span), return_counts=True)
        _, a, b = np.intersect1d(own, other, assume_unique=True, return_indices=True)
        both = int(np.minimum(n[a], m[b]).sum())
        return both / (int(n.sum()) + int(m.sum()) - both)

    def search(self, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """(document, item) -> (similarity, first word of the span) of the best span, where that is similar enough.

        ``h`` are the word hashes of some documents, ``first`` the index of each document's first word. Windows
        with too few pairs of words that any item has are passed over: their spans can't be similar enough.
        """
        best: dict[tuple[int, int], tuple[float, int]] = {}
        if not len(h) or not self.indexes:
            return best
        known = self._sums(self.pairs, _pairs(h), len(h))
        width, shared = self.s.width, None
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(np.int32)
        tried: set[tuple[int, int, int]] = set()
        for ix in self.indexes:
            if len(h) < ix.size:
                continue
            last = len(h) - ix.size + 1
            some = doc_of[:last] == doc_of[ix.size - 1 :]
            if ix.need:
                some &= known[ix.size - 1 : ix.size - 1 + last] - known[:last] >= ix.need
            at = np.flatnonzero(some)
            for run in np.split(at, np.flatnonzero(np.diff(at) > ix.size) + 1):  # places near each other share their sums
                if not len(run):
                    continue
                prints = fingerprints(h[run[0] : run[-1] + ix.size], ix.size)[run - run[0]]
                i, j = self._near(prints, ix)
                i = run[i]
                item, begin = ix.item[j], i - ix.offset[j]
                lo, hi = np.maximum(begin, first[doc_of[i]]), np.minimum(begin + self.words[item], first[doc_of[i] + 1])
                if shared is None:
                    shared = self._sums(self.known_shingles, self._shingles(h) if len(h) >= width else np.zeros(0, np.uint64), len(h))
                # A span can't have more in common with its item than it has shingles that any item has.
                most = shared[np.maximum(hi - width + 1, lo)] - shared[lo]
                likely = (hi - lo < width) | (most >= self.s.similarity * self.total[item] - 1e-9)
                for d, start, item, lo, hi in zip(*(x[likely].tolist() for x in (doc_of[i], begin, item, lo, hi)), strict=True):
                    if (d, item, start) in tried:
                        continue
                    tried.add((d, item, start))
                    x = self.similarity(item, h[lo:hi]) if hi > lo else 0.0
                    old = best.get((d, item), (0.0, 0))
                    if x >= self.s.similarity - 1e-12 and (x, -(lo - int(first[d]))) > (old[0], -old[1]):
                        best[d, item] = (x, lo - int(first[d]))
        return best


def _parts(benchmark: DataFrame) -> Iterator[pa.Table]:
    """(item_id, text): the benchmark's items in parts of bounded size; one part is on the driver at a time."""
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-max(size, 1) // PART_BYTES)
    for k in range(n):
        yield items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()


def _searched(column: pa.Array, m: Matcher) -> Iterator[tuple[int, int, float, int]]:
    """(row of the column, row of the benchmark, similarity, first word) of all that is found."""
    for p in tk.pieces(column, lower=True, size=tk.PIECE // 2):
        w = tk.words(p)
        for (d, item), (x, k) in m.search(tk.span_hashes(p.data, w.begin, w.end), w.first).items():
            yield p.first + d, m.rows[item], x, k


def find_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, item_id, similarity, word_at) of each document and benchmark item that it holds.

    Words are runs of letters and digits, lower-cased. A document holds an item if a span of as many
    words as the item has (fewer at the ends of the document) has a weighted Jaccard similarity of
    ``settings.similarity`` or more in shingles of ``settings.width`` words, and a window of that span and of
    the item at the same place differ in ``settings.radius`` bits of their SimHash at most. word_at is the
    number of words before the best span (the first one of equals). Items with fewer words than a shingle
    are one shingle. Null or empty texts and items hold nothing. Rows that repeat an id give one row an
    item, the best; so do items that repeat an id. Ids may have any type. Other columns are ignored.
    Without items or documents there are no rows.
    """
    spark = docs.sparkSession
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("word_at", T.LongType())])

    def search(part: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(part.combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            m = Matcher(items.column("text").combine_chunks(), settings)
            for b in batches:
                found = list(zip(*_searched(b.column("text"), m), strict=True)) or [(), (), (), ()]
                ids = b.column("doc_id").take(pa.array(found[0], pa.int64()))
                of = items.column("item_id").combine_chunks().take(pa.array(found[1], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, of, pa.array(found[2], pa.float64()), pa.array(found[3], pa.int64())], ["doc_id", "item_id", "similarity", "word_at"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    found = functools.reduce(DataFrame.unionByName, map(search, _parts(benchmark)))
    best = F.max(F.struct("similarity", (-F.col("word_at")).alias("back"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.round("best.similarity", 9).alias("similarity"), (-F.col("best.back")).alias("word_at"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows of ``docs`` of which the text holds no benchmark item, as ``find_contaminated`` tells.

    Each row is judged by its own text and nothing is shuffled, so null ids and rows that repeat an id are
    rows like all others.
    """
    spark = docs.sparkSession

    def clean(rest: DataFrame, part: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(part.column("text").combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value, settings)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in _searched(b.column(text_col), m)]] = False
                yield b.filter(pa.array(keep))

        return rest.mapInArrow(run, rest.schema)

    return functools.reduce(clean, _parts(benchmark), docs)
