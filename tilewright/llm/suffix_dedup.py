"""Suffix-array dedup: remove every byte of a 100-byte string that also starts earlier in the corpus.

The difference-cover algorithm sorts the suffixes at sampled places by a fixed number of characters,
names them, and places the remaining suffixes by the names next to them. Here the cover has a period of
57 instead of 3: of any two places, some shift below 57 leads both to sampled ones, so two equal strings
of 100 bytes have equal tuples of 44 bytes at such a pair. As only prefixes of 100 bytes are compared,
one round of names is enough:

1. The tuples at sampled places are named by a hash and sorted by name; names that occur once go.
2. The surroundings of the other sampled places, all that the 100-byte strings around them hold, are
   sorted; where an equal one starts earlier, all those strings do.
3. The remaining suffixes within reach of a repeated name are sorted by their 100-byte prefix, and
   neighbours compared.

What is shuffled are blocks of packed hashes, dealt out by hash; no task gets more than its range of them,
and a task sends each of its own repeated hashes once. A unit of text writes ``SINGLE`` blocks at most. A corpus
that needs more ranges than that is dealt in two rounds, of ``COARSE`` ranges first: the blocks of a coarse range and of a bounded number of units
meet first, tell what repeats among them, and go on as larger blocks of fine ranges; so a string that all
units hold goes on once for each such meeting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import textkernels as tk
from tilewright.session import checkpointed

PERIOD = 57
# A perfect difference set modulo 57.
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
OTHER_BASE = 0xD1342543DE82EF95
UNIT = 4 << 20
BUCKET_ENTRIES = 500_000
#: Up to so many ranges, entries are dealt in one round: a unit's rows then still hold some forty entries each.
SINGLE = 1 << 14
#: Beyond, a first round has so many ranges.
COARSE = 512
MEETING_BYTES = 64 << 20

ENTRY = "bucket int, unit bigint, docs binary, keys binary, at binary"
KEY = np.dtype([("a", "<u8"), ("b", "<u4")])
AT = np.dtype([("doc", "<u2"), ("at", "<u4")])
DOC = np.dtype([("id", "<i8"), ("t1", "<i8")])
#: Entries of fine ranges, as they are sent in the second round.
NAMED = np.dtype([("key", "<u4"), ("unit", "<i8"), ("at", AT)])
STRING = np.dtype([("key", KEY), ("unit", "<i8"), ("at", AT), ("row", DOC)])


def pack(at: np.ndarray) -> bytes:
    """Sorted places as compressed differences, byte by byte."""
    x = np.sort((at["doc"].astype(np.uint64) << np.uint64(32)) | at["at"])
    planes = np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(at).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    x = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
    out = np.empty(n, AT)
    out["doc"], out["at"] = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    return out


@dataclass(frozen=True)
class Deal:
    """How entries are dealt out by hash: coarse ranges, fine ones of each, and the meetings of units of a coarse one."""

    coarse: int
    fine: int = 1
    meetings: int = 1

    @classmethod
    def of(cls, entries: int) -> Deal:
        buckets = max(4, entries // BUCKET_ENTRIES)
        if buckets <= SINGLE:
            return cls(buckets)
        return cls(COARSE, -(-buckets // COARSE), -(-entries * (KEY.itemsize + AT.itemsize) // (COARSE * MEETING_BYTES)))


class Prefix:
    """Hashes of spans of one piece's bytes, from prefix sums of two polynomials."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = []
        wide = data.astype(np.uint64) + np.uint64(1)
        for base in (tk.BASE, OTHER_BASE):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(wide * tk._power_table(base, len(data) + 1)[: len(data)], out=total[1:])
            self.sums.append((total, tk._power_table(pow(base, -1, 1 << 64), len(data) + 1)))

    def first(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        total, inverse = self.sums[0]
        return tk.mix((total[end] - total[begin]) * inverse[begin])

    def keys(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), KEY)
        out["a"] = self.first(begin, end)
        total, inverse = self.sums[1]
        out["b"] = (tk.mix((total[end] - total[begin]) * inverse[begin]) >> np.uint64(32)).astype(np.uint32)
        return out


def sampled(p: tk.Piece, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, offset) of the sampled places of documents of ``length`` bytes or more that hold a whole tuple."""
    n = np.diff(p.starts)
    last = max(int(n.max(initial=0)) - tuple_bytes(length), -1)
    pattern = (np.arange(last // PERIOD + 2)[:, None] * PERIOD + np.array(COVER)).ravel()
    count = np.where(n >= length, np.searchsorted(pattern, n - tuple_bytes(length), "right"), 0)
    doc = np.repeat(np.arange(p.n), count)
    return doc, pattern[np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)]


def tuple_bytes(length: int) -> int:
    return length - PERIOD + 1


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tk.Piece]]]:
    """Rows in units of about ``UNIT`` bytes of text, each with its pieces."""
    for b in batches:
        for p in tk.pieces(b.column("text"), size=UNIT):
            for lo in range(p.first, p.first + p.n, 60_000):
                rows = b.slice(lo, min(60_000, p.first + p.n - lo))
                yield rows, list(tk.pieces(rows.column("text")))


def _docs(rows: pa.RecordBatch) -> np.ndarray:
    out = np.empty(rows.num_rows, DOC)
    out["id"], out["t1"] = rows.column("doc_id").to_numpy(zero_copy_only=False), rows.column("t1").to_numpy(zero_copy_only=False)
    return out


def _before(docs: np.ndarray, at: np.ndarray) -> tuple:
    """Keys of np.lexsort for the order of the corpus, the last one first."""
    return at["at"], docs["t1"][at["doc"]], docs["id"][at["doc"]]


def _send(docs: np.ndarray, keys: np.ndarray, at: np.ndarray, deal: Deal, ordered: bool) -> Iterator[tuple]:
    """Rows of entries by bucket, of one unit. A hash that the unit has twice is sent once. What the unit
    alone tells comes in a row of negative bucket, with its documents: of repeated hashes all places or,
    if ``ordered``, all but the first in the order of the corpus."""
    unit = int.from_bytes(hashlib.blake2b(docs.tobytes(), digest_size=8).digest(), "little", signed=True)
    lead = keys["a"] if keys.dtype == KEY else keys
    order = np.argsort(lead, kind="stable")
    same = (keys[order][1:] == keys[order][:-1]) if keys.dtype != KEY else (keys["a"][order][1:] == keys["a"][order][:-1]) & (keys["b"][order][1:] == keys["b"][order][:-1])
    again = np.concatenate([[False], same])[: len(order)]
    if ordered and again.any():
        group = np.cumsum(~again)
        order = order[np.lexsort((*_before(docs, at[order]), group))]
    several = again | np.concatenate([again[1:], [False]])[: len(again)]
    known = order[again] if ordered else order[several]
    sent = np.sort(order[~again])
    buckets = deal.coarse
    told = -1 - unit % buckets
    yield told, unit, docs.tobytes(), b"", pack(at[known])
    bucket = ((lead[sent] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for k in range(buckets):
        own = sent[by[edges[k] : edges[k + 1]]]
        if not len(own):
            continue
        places, table = at[own], b""
        if ordered:
            used, places["doc"] = np.unique(places["doc"], return_inverse=True)
            table = used.astype("<u2").tobytes() + docs[used].tobytes()
        packed = keys[own].tobytes() if keys.dtype == KEY or deal.fine > 1 else keys[own].astype("<u4").tobytes()
        yield k, unit, table, packed, pack(places)


def _table(rows: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "unit", "docs", "keys", "at"])


def _entries(t: pa.Table, ordered: bool, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Keys of packed rows, the unit of each, its place with the document's index in its unit, and if ``ordered`` its document."""
    raw = b"".join(t.column("keys").to_pylist())
    places = [unpack(x) for x in t.column("at").to_pylist()]
    n = [len(x) for x in places]
    at, unit = np.concatenate(places), np.repeat(t.column("unit").to_numpy(), n)
    if not ordered:
        return np.frombuffer(raw, "<u8" if wide else "<u4"), unit, at, None
    docs, own = [], []
    for table in t.column("docs").to_pylist():
        k = len(table) // (2 + DOC.itemsize)
        own.append(np.frombuffer(table, "<u2", k))
        docs.append(np.frombuffer(table, DOC, k, 2 * k))
    index = at["doc"].astype(np.int64) + np.repeat(np.cumsum([0, *map(len, docs)])[:-1], n)
    at["doc"] = np.concatenate(own)[index]
    return np.frombuffer(raw, KEY), unit, at, np.concatenate(docs)[index]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which names are there more than once, and which are the first of their kind.

    Within a bucket 32 bits of a name tell it from the others, as its size is bounded: the few that are
    shared by chance only cost work."""
    order = np.argsort(keys, kind="stable")
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1], [False]])
    several, first = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    several[order], first[order] = same[:-1] | same[1:], ~same[:-1]
    return several, first


def _later(keys: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which strings also start earlier, in the order of the corpus, and which don't."""
    order = np.argsort(keys["a"], kind="stable")
    same = (keys["a"][order][1:] == keys["a"][order][:-1]) & (keys["b"][order][1:] == keys["b"][order][:-1])
    same = np.concatenate([[False], same, [False]])
    some = order[same[:-1] | same[1:]]
    some = some[np.lexsort((at["at"][some], doc["t1"][some], doc["id"][some], keys["b"][some], keys["a"][some]))]
    again = np.concatenate([[False], (keys["a"][some][1:] == keys["a"][some][:-1]) & (keys["b"][some][1:] == keys["b"][some][:-1])])[: len(some)]
    flagged = np.zeros(len(keys), bool)
    flagged[some[again]] = True
    return flagged, ~flagged


def _by_unit(unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Units, and the packed places of each."""
    order = np.argsort(unit, kind="stable")
    first = np.flatnonzero(np.diff(unit[order], prepend=unit[order][:1] - 1)) if len(order) else np.zeros(0, np.int64)
    return unit[order][first], [pack(x) for x in np.split(at[order], first[1:])] if len(first) else []


def _told(t: pa.Table, ordered: bool, raw: bool) -> pa.Table:
    """(unit, docs, at) of what a bucket tells; ``raw`` entries are those of a second round."""
    if t.column("bucket")[0].as_py() < 0:
        return t.select(["unit", "docs", "at"])
    if raw:
        x = np.frombuffer(b"".join(t.column("keys").to_pylist()), STRING if ordered else NAMED)
        keys, unit, at, doc = x["key"], x["unit"], x["at"], x["row"] if ordered else None
    else:
        keys, unit, at, doc = _entries(t, ordered, wide=False)
    flagged, _ = _later(keys, at, doc) if ordered else _repeated(keys)
    units, places = _by_unit(unit[flagged], at[flagged])
    return pa.table({"unit": pa.array(units, pa.int64()), "docs": pa.array([b""] * len(units), pa.binary()), "at": pa.array(places, pa.binary())})


def _meet(t: pa.Table, ordered: bool, deal: Deal) -> pa.Table:
    """The entries of a coarse range and some units, as rows by fine range; what they tell of each other comes in rows of negative bucket."""
    bucket = t.column("bucket")[0].as_py()
    if bucket < 0:
        return t.select(["bucket", "unit", "docs", "keys", "at"])
    keys, unit, at, doc = _entries(t, ordered, wide=True)
    flagged, on = _later(keys, at, doc) if ordered else _repeated(keys)
    units, places = _by_unit(unit[flagged], at[flagged])
    lead = keys["a"] if ordered else keys
    fine = ((lead >> np.uint64(33)) % np.uint64(deal.coarse * deal.fine)).astype(np.int64)
    on = np.flatnonzero(on)
    on = on[np.argsort(fine[on], kind="stable")]
    out = np.empty(len(on), STRING if ordered else NAMED)
    out["unit"], out["at"] = unit[on], at[on]
    out["key"] = keys[on] if ordered else keys[on].astype("<u4")
    if ordered:
        out["row"] = doc[on]
    first = np.flatnonzero(np.diff(fine[on], prepend=-1))
    rows = [x.tobytes() for x in np.split(out, first[1:])] if len(first) else []
    n, m = len(units), len(rows)
    return pa.table({
        "bucket": pa.array([*(-1 - int(u) % deal.coarse for u in units), *fine[on][first].tolist()], pa.int32()),
        "unit": pa.array([*units.tolist(), *[0] * m], pa.int64()),
        "docs": pa.array([b""] * (n + m), pa.binary()),
        "keys": pa.array([*[b""] * n, *rows], pa.binary()),
        "at": pa.array([*places, *[b""] * m], pa.binary()),
    })


def _by_document(t: pa.Table) -> pa.Table:
    """The flagged places of one unit, by document. A name that a unit has twice, and others have too, tells its first place
    twice, which has to stay one place: a second one would count as a later string."""
    table = np.frombuffer(next(x for x in t.column("docs").to_pylist() if x), DOC)
    places = np.concatenate([unpack(x) for x in t.column("at").to_pylist()])
    places = places[np.lexsort((places["at"], places["doc"]))]
    places = places[np.concatenate([[True], (places["at"][1:] != places["at"][:-1]) | (places["doc"][1:] != places["doc"][:-1])])[: len(places)]]
    used, first = np.unique(places["doc"], return_index=True)
    parts = [x["at"].tobytes() for x in np.split(places, first[1:])] if len(used) else []
    return pa.table({"doc_id": pa.array(table["id"][used], pa.int64()), "t1": pa.array(table["t1"][used], pa.int64()), "places": pa.array(parts, pa.binary())})


def _resolve(entries: DataFrame, deal: Deal, ordered: bool) -> DataFrame:
    """(doc_id, t1, places): the flagged places of each document that has one, as packed 32-bit offsets."""
    two = deal.fine > 1
    if two:
        entries = entries.withColumn("meeting", F.pmod("unit", F.lit(deal.meetings))).groupBy("bucket", "meeting").applyInArrow(lambda t: _meet(t, ordered, deal), ENTRY)
    found = entries.groupBy("bucket").applyInArrow(lambda t: _told(t, ordered, two), "unit bigint, docs binary, at binary")
    flagged = found.groupBy("unit").applyInArrow(_by_document, "doc_id bigint, t1 bigint, places binary")
    return checkpointed(flagged)


def _spread(places: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of a document's strings (by start) are within reach of the sampled ``places``."""
    depth = np.zeros(n + 2, np.int32)
    np.add.at(depth, np.maximum(places - (PERIOD - 1), 0), 1)
    np.add.at(depth, places + 1, -1)
    return np.cumsum(depth)[: max(n - length + 1, 0)] > 0


def _u32(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x, "<u4").astype(np.int64) if x else np.zeros(0, np.int64)


def _step(docs: DataFrame, make: Callable[[tk.Piece, list[list[bytes | None]]], tuple[np.ndarray, np.ndarray, np.ndarray]], columns: list[str], deal: Deal, ordered: bool) -> DataFrame:
    """Entries of all documents. ``make`` gives (keys, document, place) of a piece and its rows of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, pieces in _units(batches):
            keys, at = [], []
            for p in pieces:
                more = [rows.column(c).slice(p.first, p.n).to_pylist() for c in columns]
                k, d, o = make(p, more)
                place = np.empty(len(k), AT)
                place["doc"], place["at"] = d + p.first, o
                keys.append(k)
                at.append(place)
            if sum(map(len, keys)):
                yield _table(_send(_docs(rows), np.concatenate(keys), np.concatenate(at), deal, ordered))

    return docs.mapInArrow(run, ENTRY)


def _names(length: int) -> Callable:
    def make(p: tk.Piece, _: list) -> tuple:
        doc, offset = sampled(p, length)
        begin = p.starts[doc] + offset
        name = Prefix(p.data).first(begin, begin + tuple_bytes(length))
        return name, doc, offset

    return make


def _surroundings(length: int) -> Callable:
    def make(p: tk.Piece, more: list) -> tuple:
        places = [_u32(x) for x in more[0]]
        doc = np.repeat(np.arange(p.n), [len(x) for x in places])
        offset = np.concatenate(places)
        begin = p.starts[doc] + np.maximum(offset - (PERIOD - 1), 0)
        end = np.minimum(p.starts[doc] + offset + length, p.starts[doc + 1])
        keys = Prefix(p.data).keys(begin, end)
        keys["a"] ^= tk.mix(((p.starts[doc] + offset - begin) * 1024 + (end - begin)).astype(np.uint64))
        return keys, doc, offset

    return make


def _suffixes(length: int) -> Callable:
    def make(p: tk.Piece, more: list) -> tuple:
        doc, offset = [], []
        for d, (near, settled) in enumerate(zip(*more, strict=True)):
            n = int(p.starts[d + 1] - p.starts[d])
            own = np.flatnonzero(_spread(_u32(near), n, length) & ~_spread(_u32(settled), n, length))
            doc.append(np.full(len(own), d))
            offset.append(own)
        doc, offset = np.concatenate(doc), np.concatenate(offset)
        begin = p.starts[doc] + offset
        return Prefix(p.data).keys(begin, begin + length), doc, offset

    return make


def _cut(length: int, spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without the bytes of flagged strings. A text of which nothing is known repeats an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            rows = zip(*(b.column(c).to_pylist() for c in ("text", "first", "settled", "later")), strict=True)
            for text, first, settled, later in rows:
                data = np.frombuffer((text or "").encode(), np.uint8)
                n = len(data)
                starts = np.zeros(max(n - length + 1, 0), bool)
                if not first:
                    starts[:] = True
                else:
                    starts |= _spread(_u32(settled), n, length)
                    starts[_u32(later)] = True
                depth = np.zeros(n + 1, np.int32)
                depth[: len(starts)] += starts
                depth[length : length + len(starts)] -= starts
                gone = np.cumsum(depth)[:n] > 0
                out["n_bytes"].append(n)
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum()))
                out["kept"].append(data[~gone].tobytes())
            digest = [hashlib.sha256(x).hexdigest() for x in out["kept"]]
            columns = [b.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(out["kept"], pa.binary())] * spans, names + ["kept"] * spans)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``, with the
    remaining bytes as ``kept`` if asked for.

    Texts are bytes in UTF-8; null is empty. A byte goes if a string of ``length`` bytes that covers it
    also starts earlier: in a document of smaller doc_id, or earlier in the same. Strings are within
    documents and judged on the input. n_spans counts maximal runs of removed bytes. Rows that repeat
    an id and its text are one document; texts of one id are ordered by a hash; a null id is before all others.
    doc_id is taken as bigint. Other columns are ignored. An empty table gives no rows.

    A text that equals a whole earlier one has all its strings there; it goes without further search.
    Strings are compared by 96 bits of two hashes. ``length`` must be over 64, for tuples of 8 bytes at least.
    """
    if tuple_bytes(length) < 8:
        raise ValueError(f"length must be {PERIOD + 7} at least")
    null_id = -(1 << 63)
    base = docs.select(F.col("doc_id").cast("bigint").alias("orig"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(null_id)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")})
    firsts = checkpointed(base.where(F.octet_length("text") >= length).groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).alias("n")).select("doc_id", "t1", "n"))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    deal = Deal.of(total * len(COVER) // PERIOD)
    key = ["doc_id", "t1"]
    texts = base.select("doc_id", "t1", "text")
    unique = texts.join(firsts.select(*key), key).dropDuplicates(key)
    named = _resolve(_step(unique, _names(length), [], deal, ordered=False), deal, ordered=False)
    near = texts.join(named.withColumnRenamed("places", "near"), key).dropDuplicates(key)
    settled = _resolve(_step(near, _surroundings(length), ["near"], deal, ordered=True), deal, ordered=True)
    open_ = near.join(settled.withColumnRenamed("places", "settled"), key, "left")
    later = _resolve(_step(open_, _suffixes(length), ["near", "settled"], deal, ordered=True), deal, ordered=True)
    marks = firsts.select(*key, F.lit(True).alias("first")).join(settled.withColumnRenamed("places", "settled"), key, "left").join(later.withColumnRenamed("places", "later"), key, "left")
    whole = base.select("orig", *key, "text").join(marks, key, "left").select(F.col("orig").alias("doc_id"), "text", "first", "settled", "later")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    return whole.mapInArrow(_cut(length, keep_bytes), schema)
