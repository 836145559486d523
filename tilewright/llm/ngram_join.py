"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, exact check on full n-gram sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textkernels as tk
from tilewright.operators.components import connected_components
from tilewright.session import checkpointed


@dataclass(frozen=True)
class Settings:
    """Parameters of the join."""

    width: int = 5  # words of an n-gram
    similarity: float = 0.8  # Jaccard similarity of n-gram sets from which two texts are linked
    recall: float = 0.9999  # of pairs at just that similarity, by which bands and rows are chosen
    hashes: int = 128  # at most, over all bands
    block: int = 512  # texts of one side of a block that is compared at once
    part_bytes: int = 16 << 20  # text of one side of a task at most, about; smaller groups share a task
    part_texts: int = 1 << 14  # texts of one side of a task at most, about


def choose_bands(similarity: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest chance candidates, that reach the recall."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    return hashes, 1


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = tk.mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seed[:n] >> np.uint64(32)).astype(np.uint32), (seed[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(column: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: the number of its words, a 128-bit hash of its words in order (two columns), and a hash for each band."""
    bands, rows = choose_bands(s.similarity, s.recall, s.hashes)
    xors, factors = _constants(bands * rows)
    n_words, t1, t2 = np.zeros(len(column), np.int64), np.zeros(len(column), np.uint64), np.zeros(len(column), np.uint64)
    out = np.zeros((len(column), bands), np.uint64)
    for p in tk.pieces(column, lower=True, size=tk.PIECE // 2):
        w = tk.words(p)
        h = tk.span_hashes(p.data, w.begin, w.end)
        n = np.diff(w.first)
        at = slice(p.first, p.first + p.n)
        n_words[at] = n
        has = np.flatnonzero(n)
        if not len(has):
            continue
        place = np.arange(len(h)) - np.repeat(w.first[:-1], n)
        for t, salt in ((t1, 1), (t2, 2)):
            t[p.first + has] = np.add.reduceat(tk.mix(h + tk.mix(place.astype(np.uint64) * np.uint64(4) + np.uint64(salt))), w.first[:-1][has])
        grams, first = tk.shingles(h, w.first, s.width)
        low = (grams >> np.uint64(32)).astype(np.uint32)
        for b in range(bands):
            band = np.zeros(len(has), np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                band = tk.mix(band ^ np.minimum.reduceat((low ^ xors[k]) * factors[k], first[:-1][has]).astype(np.uint64)) + np.uint64(b)
            out[p.first + has, b] = band
    return n_words, t1, t2, out


def text_key() -> Column:
    """A hash of the raw text, which tells rows of one doc_id apart; null is empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, th, t1, t2, size, bands) of all rows with a word; ``size`` is the text's in bytes."""
    schema = T.StructType([docs.schema["doc_id"]])
    for name in ("th", "t1", "t2", "size"):
        schema = schema.add(name, "long")
    schema = schema.add("bands", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, t1, t2, bands = signatures(b.column("text"), s)
            has = np.flatnonzero(n)
            at = pa.array(has)
            rows = bands[has]
            offsets = np.arange(len(has) + 1, dtype=np.int32) * rows.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tk.as_signed(rows.ravel())))
            size = pc.binary_length(b.column("text").take(at)).cast(pa.int64())
            columns = [b.column("doc_id").take(at), b.column("th").take(at), pa.array(tk.as_signed(t1[has])), pa.array(tk.as_signed(t2[has])), size, lists]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", "text", text_key().alias("th")).mapInArrow(run, schema)


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text, and where each text's begin."""
    out, n = [], []
    for p in tk.pieces(texts, lower=True):
        w = tk.words(p)
        grams, first = tk.shingles(tk.span_hashes(p.data, w.begin, w.end), w.first, width)
        for d in range(p.n):
            own = np.unique(grams[first[d] : first[d + 1]])
            out.append(own)
            n.append(len(own))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def intersections(rows: tuple[np.ndarray, np.ndarray], grams: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many n-grams each text of one side has in common with each of the other.

    ``rows`` and ``grams`` are, for both sides, the text of each n-gram, and the n-grams in order. One that few texts
    have is counted pair by pair, others by products of 0/1 matrices: whichever is less work.
    """
    inter = np.zeros(shape, np.float32)
    common = np.intersect1d(*grams)
    if not len(common):
        return inter
    lo = [np.searchsorted(g, common, "left") for g in grams]
    n = [np.searchsorted(g, common, "right") - x for g, x in zip(grams, lo, strict=True)]
    rare = n[0] * n[1] * 128 < shape[0] * shape[1]
    if rare.any():
        times, width = n[0][rare] * n[1][rare], n[1][rare]
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        width = np.repeat(width, times)
        i, j = rows[0][np.repeat(lo[0][rare], times) + k // width], rows[1][np.repeat(lo[1][rare], times) + k % width]
        inter += np.bincount(i * shape[1] + j, minlength=shape[0] * shape[1]).reshape(shape)
    often = np.flatnonzero(~rare)
    for at in range(0, len(often), 4096):
        part = often[at : at + 4096]
        sides = []
        for side in (0, 1):
            x = np.zeros((shape[side], len(part)), np.float32)
            count = n[side][part]
            place = np.repeat(lo[side][part] - np.cumsum(count) + count, count) + np.arange(count.sum())
            x[rows[side][place], np.repeat(np.arange(len(part)), count)] = 1
            sides.append(x)
        inter += sides[0] @ sides[1].T
    return inter


class _Forest:
    """Sets of texts that links join."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            above = self.up[x]
            if (above == x).all():
                return x
            self.up[x] = self.up[above]
            x = self.up[x]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            self.up[a] = b  # of several the last one holds; the others are joined in the next turn


def _check(s: Settings) -> Callable[[pa.Table], pa.Table]:
    """Of a task's texts (unit, side, uid, text): numbers of links, and a text that each is joined to.

    Texts of side 0 and those of side 1 of a unit are compared; if there is no side 1, those of side 0 with each other.
    """

    def run(t: pa.Table) -> pa.Table:
        unit, side, uid = (t.column(c).to_numpy() for c in ("unit", "side", "uid"))
        order = np.lexsort((uid, side, unit))
        if len(order):  # rows that repeat an id and its text
            order = order[np.concatenate([[True], (np.diff(unit[order]) != 0) | (np.diff(side[order]) != 0) | (np.diff(uid[order]) != 0)])]
        grams, first = _sets(t.column("text"), s.width)
        sizes = np.diff(first)
        links, forest = np.zeros(len(t), np.int64), _Forest(len(t))

        def entries(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = np.repeat(np.arange(len(some)), sizes[some])
            own = np.concatenate([grams[first[i] : first[i + 1]] for i in some])
            by = np.argsort(own, kind="stable")
            return row[by], own[by]

        for group in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            both = [group[side[group] == k] for k in (0, 1)]
            within = not len(both[1])
            # By size, so that blocks of which the sizes can't be similar enough are passed over.
            left, right = (x[np.argsort(sizes[x], kind="stable")] for x in (both[0], both[0] if within else both[1]))
            if not len(left) or not len(right):
                continue
            cache = {}
            for a in range(0, len(left), s.block):
                p = left[a : a + s.block]
                mine = entries(p)
                for b in range(a if within else 0, len(right), s.block):
                    q = right[b : b + s.block]
                    if sizes[q[0]] * s.similarity > sizes[p[-1]] + 1e-6 or sizes[p[0]] * s.similarity > sizes[q[-1]] + 1e-6:
                        continue
                    if b not in cache:
                        cache[b] = entries(q)
                    inter = intersections((mine[0], cache[b][0]), (mine[1], cache[b][1]), (len(p), len(q)))
                    union = sizes[p][:, None] + sizes[q][None, :] - inter
                    near = inter >= s.similarity * union - 1e-6
                    if within and a == b:
                        np.fill_diagonal(near, False)
                    links[p] += near.sum(axis=1)
                    if not within or a != b:
                        links[q] += near.sum(axis=0)
                    i, j = np.nonzero(near)
                    forest.join(p[i], q[j])
        root = forest.root(np.arange(len(t)))
        some = order[links[order] > 0]
        return pa.table({"uid": uid[some], "links": links[some], "other": uid[root[some]]})

    return run


def _classes(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, t1, t2) of all rows with a word, and of each text (t1, t2) its smallest doc_id ``rep``, n_copies,
    n_links and, of the texts that links lead to, the first row's id ``class_id`` and text ``class_th``."""
    rows = checkpointed(sketch(docs, s))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")
    own = rows.groupBy("t1", "t2").agg(F.min(first).alias("row"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # Numbers of texts: unlike doc_ids they are unique, and unlike hashes they never collide.
    texts = checkpointed(own.withColumn("uid", F.monotonically_increasing_id()))
    bands = texts.select("uid", F.explode(F.array_distinct("bands")).alias("band"))
    # Written before the join: what a join reads straight from a shuffle is split where a band is hot.
    hubs = checkpointed(bands.groupBy("band").agg(F.min("uid").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))
    ties = bands.join(hubs, "band").where("uid <> hub").select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct()
    comps = connected_components(ties).select(F.col("node").alias("uid"), F.col("label").alias("comp"))

    known = comps.join(texts.select("uid", "size", F.col("row.doc_id").alias("doc_id"), F.col("row.th").alias("th")), "uid")
    at = checkpointed(known)
    size, k = F.sum("size"), F.count(F.lit(1))
    sizes = at.groupBy("comp").agg(F.greatest(F.ceil(size / s.part_bytes), F.ceil(k / s.part_texts)).cast("int").alias("parts"))
    at = at.join(checkpointed(sizes), "comp").withColumn("part", F.expr("cast(pmod(xxhash64(uid), parts) as int)"))
    bins = at.agg(F.greatest(F.coalesce(size, F.lit(0)) / s.part_bytes, k / s.part_texts)).first()[0] // 1 + 1
    # A pair of parts (i, j) of a large component is a task of its own; small components share one.
    pairs = F.expr("transform(sequence(0, parts - 1), k -> named_struct('i', least(k, part), 'j', greatest(k, part)))")
    dealt = at.withColumn("pair", F.explode(pairs)).select(
        "doc_id", "th", "uid",
        F.when(F.col("parts") > 1, F.xxhash64("comp", "pair.i", "pair.j")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(int(bins)))).alias("task"),
        F.when(F.col("parts") > 1, F.xxhash64("comp", "pair.i", "pair.j")).otherwise(F.col("comp")).alias("unit"),
        F.when(F.col("part") == F.col("pair.i"), 0).otherwise(1).alias("side"),
    )
    whole = docs.select("doc_id", text_key().alias("th"), "text").alias("w")
    dealt = dealt.alias("d").join(whole, F.expr("d.doc_id <=> w.doc_id AND d.th = w.th")).select("task", "unit", "side", "uid", "text")
    links = checkpointed(dealt.groupBy("task").applyInArrow(_check(s), "uid bigint, links bigint, other bigint"))
    labels = connected_components(links.where("uid <> other").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    joined = checkpointed(labels.join(texts.select(F.col("uid").alias("node"), "row"), "node"))
    heads = checkpointed(joined.groupBy("label").agg(F.min("row").alias("head")))
    classed = joined.join(heads, "label").select(F.col("node").alias("uid"), "head")
    counts = links.groupBy("uid").agg(F.sum("links").alias("n_links"))
    out = texts.join(counts, "uid", "left").join(classed, "uid", "left").withColumn("head", F.coalesce("head", "row"))
    known = out.select("t1", "t2", F.col("row.doc_id").alias("rep"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("head.doc_id").alias("class_id"), F.col("head.th").alias("class_th"))
    return rows.select("doc_id", "th", "t1", "t2"), checkpointed(known)


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, rep_id, class_id, n_copies, n_links), one row for each row of ``docs``.

    Words are runs of letters and digits, lower-cased. Rows with the same words are copies: rep_id is the
    smallest doc_id among them, and n_copies counts them. Two texts are linked if the Jaccard similarity of
    their sets of n-grams is ``settings.similarity`` or more; a text of fewer words than an n-gram is one
    n-gram. n_links counts the different texts linked to a document's own; class_id is the smallest doc_id
    that links lead to. A text without a word, null too, has no link and no copy. doc_id may have any type
    that has an order, may repeat (texts of one id are told apart by themselves), and null ids come after all others, so
    rep_id and class_id are null only where no row of the text, or of the class, has an id. Other columns are ignored.

    Bands find candidates: each text is tied to the first one of every band it shares, so a band that many
    share costs as many rows, not pairs. Full sets are then compared exactly within the components of these
    ties: a component of over ``settings.part_bytes`` of text, or ``part_texts`` texts, is cut in parts of about
    that size, and each pair of parts is a task, in which texts meet in blocks. So a text is sent as often as its
    component has parts, and one of 50,000 texts of 2 KB has seven; only counts and a spanning forest leave a task.
    """
    docs = docs.select("doc_id", "text")
    rows, texts = _classes(docs, settings)
    found = rows.join(texts, ["t1", "t2"]).select("doc_id", F.col("rep").alias("rep_id"), "class_id", "n_copies", "n_links")
    bare = ~F.coalesce(F.lower("text"), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    alone = docs.where(bare).select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def drop_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The rows of ``docs``, of each class of ``near_duplicates`` one: that of the smallest doc_id (null ids come
    last), of texts of that id the one of the smallest hash, and of rows with that id and text the smallest one.

    Texts without a word have no copies: their rows all stay. All columns must have an order.
    """
    rows, texts = _classes(docs.select("doc_id", "text"), settings)
    fate = rows.join(texts, ["t1", "t2"]).withColumn("head", F.expr("doc_id <=> class_id AND th = class_th"))
    fate = checkpointed(fate.groupBy("doc_id", "th").agg(F.bool_or("head").alias("head"), F.count(F.lit(1)).alias("k")).where("NOT head OR k > 1"))
    at = F.expr("w.doc_id <=> f.doc_id AND w.th = f.th")
    whole = docs.select("doc_id", text_key().alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("w")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    once = whole.join(fate.alias("f"), at, "left_anti").select(*own)
    again = fate.where("head")
    if not again.limit(1).count():
        return once
    several = whole.join(again.alias("f"), at).groupBy("f.doc_id", "f.th").agg(F.min("row").alias("row")).select(*own)
    return once.unionByName(several)
