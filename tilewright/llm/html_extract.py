"""HTML extraction: suffix arrays find runs of words, which are counted over a whole host; what its pages share goes."""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textkernels as tk
from tilewright.session import checkpointed

RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|select|xmp"
MARKUP = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(?P<raw>{RAW})\b.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*(?:>|$)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp rtc s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Elements that are no part of an article, whatever their names.
ASIDE = frozenset("nav header footer aside form button dialog menu head title fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class and id names of parts that are no part of an article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments reply replies respond disqus share sharing social "
    "related recommended recommendations popup modal overlay pagination pager login signup register search copyright disclaimer skip".split()
)
KEPT_TAGS = frozenset(("html", "body", "main", "article"))

ARTICLE, OPEN, FRAME = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """Parameters. A run of ``shared`` words is boilerplate if ``share`` of the pages of its host have it,
    but not under ``least`` pages and not over ``enough``; within articles, if ``enough`` pages and over
    half of all have it. Pages of which the SimHashes differ in ``near`` bits at most count as one."""

    shared: int = 8  # a power of two
    pages: int = 1024  # of one suffix array, 32,768 at most
    link_share: float = 0.6
    alone: int = 2
    share: float = 0.1
    least: int = 3
    enough: int = 10
    near: int = 6
    listed: int = 1 << 22  # runs that go to each worker at once


def _traits(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is apart from the article, and whether it holds the article."""
    apart, holds = tag in ASIDE, tag in ("article", "main")
    if attrs and not attrs.isspace():
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                words = {w.lower() for w in PARTS.findall(value)}
                found = words & NAMES
                if tag in ("article", "main"):
                    found &= {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"}
                apart |= bool(found) and tag not in ("html", "body")
            elif name == "role":
                apart |= value.lower() in ROLES and tag not in KEPT_TAGS
                holds |= value.lower() in ("main", "article")
            elif name == "itemprop":
                holds |= value == "articleBody"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                apart |= tag not in KEPT_TAGS
    return apart, holds and not apart


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order: ARTICLE inside an article or main element, FRAME inside
    menus, headers, footers and the like, OPEN elsewhere. Scripts, styles and comments are no text.

    Blocks of links only, outside articles, count as FRAME. Character references are decoded, white
    space becomes one space, empty blocks are left out.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []
    apart = holding = links = 0
    pieces: list[str] = []
    linked = total = at = 0
    zone = OPEN

    def flush() -> None:
        nonlocal pieces, linked, total
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                own = FRAME if zone == OPEN and total and linked > Settings.link_share * total else zone
                out.append((own, text))
            pieces = []
        linked = total = 0

    def pop_to(k: int) -> None:
        nonlocal apart, holding, links
        while len(stack) > k:
            tag, a, h = stack.pop()
            apart -= a
            holding -= h
            links -= tag == "a"

    def say(raw: str) -> None:
        nonlocal linked, total
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        n = len(text.strip())
        total += n
        linked += n if links > 0 else 0

    for m in MARKUP.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br" or tag in VOID:
            pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
        if m["close"]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                pop_to(k)
        else:
            if tag not in INLINE:
                # A block ends an open paragraph, and an item or cell its predecessor.
                for i in range(len(stack) - 1, -1, -1):
                    name = stack[i][0]
                    if name == "p" or name == tag and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
                        pop_to(i)
                        break
                    if name not in INLINE:
                        break
                if tag == "body":
                    pop_to(next((i for i, x in enumerate(stack) if x[0] == "head"), len(stack)))
            a, h = _traits(tag, m["attrs"] or "")
            if not (m["attrs"] or "").endswith("/") or tag not in ("svg", "path"):
                stack.append((tag, a, h))
                apart += a
                holding += h
                links += tag == "a"
        zone = FRAME if apart else ARTICLE if holding else OPEN
    if at < len(page):
        say(page[at:])
    flush()
    return out


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the different ones, and a place of each of those."""
    order = np.argsort(key)
    fresh = np.diff(key[order], prepend=key[order[:1]] - 1) != 0
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, order[fresh]


def run_ranks(rank: np.ndarray, page: np.ndarray, k: int) -> np.ndarray:
    """A suffix array's ranks at depth ``k``: equal for equal runs of ``k`` words.

    ``page`` is the page of each word; runs do not cross pages, and one that would is unlike all others.
    Ranks of suffixes double their depth until ``k`` words tell them apart.
    """
    n = len(rank)
    depth = 1
    while depth < k:
        pair = np.full(n, -1, np.int64)
        inside = page[depth:] == page[:-depth]
        pair[:-depth][inside] = rank[depth:][inside]
        pair[pair < 0] = -1 - np.flatnonzero(pair < 0)  # a suffix that ends is unlike all others
        rank, _ = _ranked(rank * (2 * n) + (pair + n))
        depth *= 2
    return rank


def _covered(starts: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of ``n`` words are in a run of ``k`` from one of ``starts``."""
    depth_of = np.zeros(n + 1, np.int64)
    np.add.at(depth_of, starts, 1)
    np.add.at(depth_of, np.minimum(starts + k, n), -1)
    return np.cumsum(depth_of[:-1]) > 0


def shared_words(words: list[str], page: np.ndarray, k: int) -> np.ndarray:
    """Which words are in a run of ``k`` that another page has as well, by a suffix array of depth ``k``."""
    n = len(words)
    if n < k:
        return np.zeros(n, bool)
    _, rank = np.unique(np.array(words, object).astype(str), return_inverse=True)
    rank = run_ranks(rank, page, k)
    order = np.lexsort((page, rank))
    first = np.concatenate([[True], np.diff(rank[order]) != 0])
    group = np.cumsum(first) - 1
    low, high = np.minimum.reduceat(page[order], np.flatnonzero(first)), np.maximum.reduceat(page[order], np.flatnonzero(first))
    return _covered(order[(low != high)[group]], n, k)


class Runs:
    """The words of some pages, and their runs of ``k`` by one suffix array.

    ``which`` and ``page`` tell the distinct run (index into ``names``) and the page from word ``start``
    on; ``names`` are 48-bit hashes of a host and a run, the same in all arrays.
    """

    def __init__(self, pages: list[list[tuple[int, str]]], host: np.ndarray, k: int) -> None:
        self.words: list[str] = []
        self.spans: list[tuple[int, int, int, int]] = []  # page, block, first and last word
        zones, part = [], []
        for i, blocks in enumerate(pages):
            for j, (zone, text) in enumerate(blocks):
                own = text.split()
                self.spans.append((i, j, len(self.words), len(self.words) + len(own)))
                self.words += own
                zones += [zone] * len(own)
                part += [i] * len(own)
        n = len(self.words)
        self.zone, self.owner = np.array(zones, np.int8), np.array(part, np.int64)
        self.start = self.which = self.page = np.zeros(0, np.int64)
        self.names = self.hashes = np.zeros(0, np.uint64)
        if not n:
            return
        coded = pa.array(self.words, pa.large_string()).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        (entries,) = tk.pieces(coded.dictionary, size=1 << 62)
        self.hashes = tk.span_hashes(entries.data, entries.starts[:-1], entries.starts[1:])[code]
        if n < k:
            return
        rank = run_ranks(code, self.owner, k)
        self.start = np.flatnonzero(self.owner[k - 1 :] == self.owner[: n - k + 1])
        self.page = self.owner[self.start]
        hosts, index = np.unique(host, return_inverse=True)
        self.which, first = _ranked(rank[self.start] * len(hosts) + index[self.page])
        at = self.start[first]
        name = np.zeros(len(at), np.uint64)
        for j in range(k):
            name += self.hashes[at + j] * np.uint64(pow(tk.BASE, j + 1, 1 << 64))
        self.names = tk.mix(name ^ tk.mix(host[self.page[first]].view(np.uint64))) >> np.uint64(16)

    def sketches(self, n: int) -> np.ndarray:
        """A 64-bit SimHash of the pairs of neighbouring words outside frames of each of the ``n`` pages."""
        out = np.zeros(n, np.uint64)
        shown = self.zone != FRAME
        owner, h = self.owner[shown], self.hashes[shown]
        if not len(h):
            return out
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(first, append=len(h))
        before = np.concatenate([[np.uint64(0)], h[:-1]])
        before[first] = 0
        pair = tk.mix(before * np.uint64(tk.BASE) + h)
        # The bits of 255 words at most are added up in the bytes of a number, eight bits of a hash at a time.
        chunk = np.flatnonzero((np.arange(len(h)) - np.repeat(first, count)) % 255 == 0)
        of_page = np.searchsorted(chunk, first)
        for bit in range(8):
            lanes = np.add.reduceat((pair >> np.uint64(bit)) & np.uint64(0x0101010101010101), chunk)
            total = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), of_page, axis=0, dtype=np.int64)
            most = (2 * total > count[:, None]).astype(np.uint64)
            for byte in range(8):
                out[owner[first]] |= most[:, byte] << np.uint64(8 * byte + bit)
        return out


def sketches(pages: list[list[tuple[int, str]]]) -> np.ndarray:
    """A 64-bit SimHash of each page's pairs of neighbouring words outside frames."""
    return Runs(pages, np.zeros(len(pages), np.int64), 1 << 30).sketches(len(pages))


def distinct_pages(sketch: np.ndarray, near: int, enough: int) -> int:
    """How many of the pages are unlike each other, counted up to ``enough``."""
    n = 0
    while len(sketch) and n < enough:
        sketch = sketch[np.bitwise_count(sketch ^ sketch[0]) > near]
        n += 1
    return n


def _listed(names: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``names`` are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(names), bool)
    return among[np.minimum(np.searchsorted(among, names), len(among) - 1)] == names


def _clean(pages: list[list[tuple[int, str]]], host: np.ndarray, often: np.ndarray, mostly: np.ndarray, s: Settings) -> list[str]:
    """Main texts of pages: blocks outside frames, in order, without the runs of ``often``, or in articles
    those of ``mostly`` (names of runs, sorted). A run that only reaches into a block, by fewer words
    than it needs and less than half of the block, takes nothing from it, and from an article's block
    no run takes more than half of the article."""
    out: list[dict[int, str]] = [{j: text for j, (zone, text) in enumerate(blocks) if zone != FRAME} for blocks in pages]
    judged = [i for i, blocks in enumerate(pages) if len(mostly) or any(zone == OPEN for zone, _ in blocks)]
    if not judged or not len(often):
        return ["\n".join(x.values()) for x in out]
    r = Runs([pages[i] for i in judged], host[judged], s.shared)
    n = len(r.words)
    covered = _covered(r.start[_listed(r.names, often)[r.which]], n, s.shared) & (r.zone == OPEN)
    inside = _covered(r.start[_listed(r.names, mostly)[r.which]], n, s.shared) & (r.zone == ARTICLE)
    article = np.bincount(r.owner[r.zone == ARTICLE], minlength=len(judged))
    lost = np.bincount(r.owner[inside], minlength=len(judged))
    covered |= inside & (2 * lost <= article)[r.owner]
    for i, j, a, b in r.spans:
        own = covered[a:b].copy()
        if not own.any() or r.zone[a] == FRAME:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        for p, q in zip(edges[::2], edges[1::2], strict=True):
            if q - p < s.shared and 2 * (q - p) < b - a:  # the end of a run that belongs to another block
                own[p:q] = False
        runs = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]]).astype(np.int8)))
        alone = [r.words[a + p : a + q] for p, q in zip(runs[::2], runs[1::2], strict=True) if q - p >= s.alone or q - p == b - a or r.zone[a] == ARTICLE]
        if alone:
            out[judged[i]][j] = " ".join(w for run in alone for w in run)
        else:
            del out[judged[i]][j]
    return ["\n".join(x.values()) for x in out]


def _main_texts(pages: list[list[tuple[int, str]]], s: Settings) -> list[str]:
    """Main texts of pages of one host, which are all that there are of it."""
    host, rows = np.zeros(len(pages), np.int64), np.full(len(pages), len(set(map(tuple, pages))))
    found = _count(_pack(pages, host, rows, s), s)
    often, mostly = np.sort(found["name"]), np.sort(found["name"][found["mostly"]])
    return _clean(pages, host, often, mostly, s)


#: A run of a page as it is shuffled: its name, and twice an index into the pages of its row, plus 1 if it is outside articles.
RUN = np.dtype([("low", "<u4"), ("high", "<u2"), ("page", "<u2")])
PAGE = np.dtype([("host", "<i8"), ("rows", "<i8"), ("sketch", "<u8")])


def _pack(
    pages: list[list[tuple[int, str]]], host: np.ndarray, rows: np.ndarray, s: Settings, buckets: int = 1, copies: np.ndarray | None = None, among: np.ndarray | None = None
) -> list[tuple[int, bytes, bytes]]:
    """(bucket, pages, runs): the distinct runs of each page, or those of them that are ``among`` some names.

    With ``copies``, the number of rows of each page's host as ``rows`` is that of its different pages, runs of
    articles that few of these pages have are left out: those on ``n * rows / (4 * copies)`` at most, of a host's
    ``n`` pages here. Over all arrays the ``n`` add up to ``copies``, so a run never loses more than ``rows / 4``.
    """
    r = Runs(pages, host, s.shared)
    if not len(r.start):
        return []
    sketch = r.sketches(len(pages))
    _, first, index = np.unique(np.stack([host.view(np.uint64), sketch], 1), axis=0, return_index=True, return_inverse=True)
    alike = first[index.ravel()]  # pages that count as one wherever they are counted
    article = np.concatenate([[0], np.cumsum(r.zone == ARTICLE)])
    bound = article[r.start + s.shared] != article[r.start]
    pair = np.unique((r.which * len(pages) + alike[r.page]) * 2 + bound)
    pair = pair[np.diff(pair >> 1, prepend=-1) != 0]
    which, page, free = pair // (2 * len(pages)), (pair >> 1) % len(pages), pair % 2 == 0
    if among is not None:
        keep = _listed(r.names, among)[which]
    elif copies is not None:
        _, index, here = np.unique(host, return_inverse=True, return_counts=True)
        inside = np.bincount(which[~free], minlength=len(r.names))[which]
        keep = free | (rows >= s.enough)[page] & (4 * inside * copies[page] > (here[index] * rows)[page])
    else:
        keep = np.ones(len(pair), bool)
    name, page, free = r.names[which[keep]], page[keep], free[keep]
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out = []
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if not len(part):
            continue
        used, index = np.unique(page[part], return_inverse=True)
        head, runs = np.empty(len(used), PAGE), np.empty(len(part), RUN)
        head["host"], head["rows"], head["sketch"] = host[used], rows[used], sketch[used]
        runs["low"], runs["high"], runs["page"] = name[part] & np.uint64(0xFFFFFFFF), name[part] >> np.uint64(32), 2 * index + free[part]
        out.append((int(bucket[part[0]]), head.tobytes(), runs.tobytes()))
    return out


def _count(packed: list[tuple[int, bytes, bytes]], s: Settings, whole: bool = True) -> dict[str, np.ndarray]:
    """The runs that are boilerplate: host, name, and whether they are so by the pages that have them outside
    articles, or by all. If not ``whole``, runs of articles may have lost a fourth of the host's pages, and
    ``mostly`` are all that can be on over half of them."""
    heads, runs = [np.frombuffer(h, PAGE) for _, h, _ in packed], [np.frombuffer(x, RUN) for _, _, x in packed]
    empty = {"host": np.zeros(0, np.int64), "name": np.zeros(0, np.uint64), "often": np.zeros(0, bool), "mostly": np.zeros(0, bool)}
    if not runs:
        return empty
    head = np.concatenate([h[x["page"] >> 1] for h, x in zip(heads, runs, strict=True)])
    run = np.concatenate(runs)
    name = run["low"].astype(np.uint64) | run["high"].astype(np.uint64) << np.uint64(32)
    order = np.lexsort((head["sketch"], name))
    name, head = name[order], head[order]
    fresh = np.flatnonzero(np.concatenate([[True], (np.diff(name) != 0) | (np.diff(head["sketch"]) != 0)]))
    free = np.maximum.reduceat(run["page"][order] & 1, fresh) > 0
    name, head = name[fresh], head[fresh]
    first = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1])
    pages, rows = np.diff(first, append=len(name)), head["rows"][first]
    need = np.clip(np.ceil(s.share * rows - 1e-9), s.least, s.enough).astype(np.int64)
    often, mostly = np.add.reduceat(free, first, dtype=np.int64) >= need, (rows >= s.enough) & ((2 if whole else 4) * pages > rows)
    for g in np.flatnonzero(often):
        at = slice(first[g], first[g] + pages[g])
        often[g] = distinct_pages(head["sketch"][at][free[at]], s.near, s.enough) >= need[g]
    for g in np.flatnonzero(mostly) if whole else ():
        mostly[g] = distinct_pages(head["sketch"][first[g] : first[g] + pages[g]], s.near, s.enough) >= s.enough
    found = often | mostly
    return {"host": head["host"][first[found]], "name": name[first[found]], "often": often[found], "mostly": mostly[found]}


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(page_id, url, text, n_chars), one row for each row of ``pages``.

    text is the page's main text: its blocks, joined by newlines; '' if there is none. n_chars counts
    its code points. Null html is empty. Pages without a url, or one without a host, share the host ''.
    Other columns are ignored, and repeated rows each give a row, but don't count as distinct pages.

    Suffix arrays of ``settings.pages`` pages name the runs of words; the names are counted over whole
    hosts, however the pages of a host are dealt, and what is boilerplate goes to all arrays. Runs of
    articles are counted twice: without those that few pages of an array have, which leaves each run that
    over half of all pages of a host have on over a fourth of them (see ``_pack``), and in whole where that is so.
    """
    s = settings
    name = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    src = pages.select("page_id", "url", "html", F.xxhash64(name).alias("host"))
    sizes = src.groupBy("host").agg(F.count_distinct(F.xxhash64(F.coalesce("html", F.lit("")))).alias("rows"), F.count("*").alias("copies"))
    total = max(src.count(), 1)
    # Hosts are few; their number is checked before they are broadcast, and more are joined by a shuffle.
    known = src.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "host")
    spark = pages.sparkSession
    kept = [f for f in pages.select("page_id", "url").schema.fields]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, s.pages):
                b = whole.slice(at, s.pages)
                yield b, [blocks_of(x or "") for x in b.column("html").to_pylist()], b.column("host").to_numpy()

    def counted(some: DataFrame, among: np.ndarray | None = None) -> DataFrame:
        """(host, name, often, mostly) of the boilerplate of ``some`` pages: of all runs, with those that may be
        ``mostly``, or of those ``among`` some, in whole."""
        buckets, whole = max(32, total // 16_000), among is not None
        shared = spark.sparkContext.broadcast(among)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, parsed, host in slices(batches):
                rows = _pack(parsed, host, b.column("rows").to_numpy(), s, buckets, b.column("copies").to_numpy(), shared.value)
                yield pa.record_batch({"bucket": pa.array([x[0] for x in rows], pa.int64()), "pages": pa.array([x[1] for x in rows], pa.binary()), "runs": pa.array([x[2] for x in rows], pa.binary())})

        def reduce(t: pa.Table) -> pa.Table:
            got = _count(list(zip(*(t.column(c).to_pylist() for c in ("bucket", "pages", "runs")), strict=True)), s, whole)
            return pa.table(got | {"name": got["name"].view(np.int64)})

        packed = some.select("html", "host", "rows", "copies").mapInArrow(emit, "bucket long, pages binary, runs binary")
        return packed.groupBy("bucket").applyInArrow(reduce, "host long, name long, often boolean, mostly boolean")

    def in_parts(found: DataFrame, use: Callable[[pa.Table, DataFrame], DataFrame], of: DataFrame) -> DataFrame:
        """``use`` of a list of runs and the pages of its hosts: at once, or by parts of the hosts if the list is long."""
        listed = checkpointed(found)
        n = -(-max(listed.count(), 1) // s.listed)
        at = [F.pmod("host", F.lit(n)) == k for k in range(n)]
        return functools.reduce(DataFrame.unionByName, [use(listed.where(x).select("name", "mostly").toArrow(), of.where(x) if n > 1 else of) for x in at])

    def names(t: pa.Table) -> np.ndarray:
        return np.sort(t.column("name").to_numpy().view(np.uint64))

    first = checkpointed(counted(known))
    found, likely = first.where("often").withColumn("mostly", F.lit(False)), first.where("mostly")
    if not likely.isEmpty():
        found = found.unionByName(in_parts(likely, lambda t, some: counted(some, names(t)), known).where("mostly"))

    def cleaned(t: pa.Table, some: DataFrame) -> DataFrame:
        lists = spark.sparkContext.broadcast((names(t), names(t.filter(t.column("mostly")))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often, mostly = lists.value
            for b, parsed, host in slices(batches):
                texts = _clean(parsed, host, often, mostly, s)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return some.mapInArrow(run, schema)

    return in_parts(found, cleaned, src)
