"""The operators over documents against brute force, with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tilewright.llm import chat_format, decontam, langid, line_dedup, mixing, ngram_join, quality, queries, suffix_dedup, textkernels, toxicity
from tilewright.operators import components
from tilewright.session import table

LONG = "The quick brown fox jumps over the lazy dog while seven wizards brew potent coffee beside an old stone bridge near the quiet river bank at dawn. "
ODD = [
    (1, LONG * 2, "en"), (2, LONG * 2, "en"), (2, LONG * 2, "en"), (3, "x" + LONG + "tail", "en"), (4, None, None), (5, "", "de"), (6, "a", "de"), (7, "Ünïcödé ß " * 30, "de"),
    (None, LONG, "fr"), (9, "ab" * 400, None), (10, "line\n\n  LINE \nother", "en"), (11, "\n" * 5, "en"), (12, "漢字 " * 60, "zh"), (13, LONG.upper(), "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every awkward value, and columns of the names that operators use within."""
    rows = [(*r, "s", 1, 2.5, "row", 7) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, doc string, block long")


def empty(df):
    return df.where("false")


def test_words_and_hashes_keep_to_their_documents():
    texts = ["Über  uns, OK?", None, "", "x", "über uns ok"]
    (p,) = textkernels.pieces(pa.array(texts), lower=True)
    w = textkernels.words(p)
    h = textkernels.span_hashes(p.data, w.begin, w.end)
    assert np.diff(w.first).tolist() == [3, 0, 0, 1, 3]
    assert h[:3].tolist() == h[4:].tolist()
    grams, first = textkernels.shingles(h, w.first, 2)
    assert np.diff(first).tolist() == [2, 0, 0, 1, 2] and grams[:2].tolist() == grams[3:].tolist()
    small = [q.n for q in textkernels.pieces(pa.array(texts), size=4)]
    assert sum(small) == len(texts)


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted({(d if d is not None else -(1 << 63), t or "") for d, t in rows}, key=lambda r: r[0]):
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_difference_cover_reaches_every_pair():
    cover = set(suffix_dedup.COVER)
    v = suffix_dedup.PERIOD
    assert all(any((i + s) % v in cover and (j + s) % v in cover for s in range(v)) for i in range(v) for j in range(v))


@pytest.mark.parametrize("rounds", [1, 2])
def test_suffix_dedup(spark, sf_dir, odd, rounds, monkeypatch):
    if rounds == 2:  # ranges and meetings so small that entries are dealt twice
        for name, value in (("BUCKET_ENTRIES", 1000), ("SINGLE", 4), ("COARSE", 3), ("MEETING_BYTES", 20_000), ("UNIT", 1 << 15)):
            monkeypatch.setattr(suffix_dedup, name, value)
        assert suffix_dedup.Deal.of(60_000).fine > 1 and suffix_dedup.Deal.of(60_000).meetings > 1
    for docs in (odd, table(spark, sf_dir, "documents")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = brute_repeats(rows)
        got = suffix_dedup.remove_repeats(docs, keep_bytes=True).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id if r.doc_id is not None else -(1 << 63)]
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    assert suffix_dedup.remove_repeats(empty(odd)).count() == 0


def test_suffix_dedup_tells_a_place_once():
    """A name that a unit of text has twice, and another unit as well: the unit and the name's range both tell of its first place."""
    deal, told = suffix_dedup.Deal(1), []
    for k, names in ((1, [9, 9, 5]), (2, [9, 7])):
        docs, at = np.array([(k, k)], suffix_dedup.DOC), np.zeros(len(names), suffix_dedup.AT)
        at["at"] = 10 * np.arange(len(names))
        told += suffix_dedup._send(docs, np.array(names, np.uint64), at, deal, ordered=False)
    found = pa.concat_tables([suffix_dedup._told(pa.Table.from_batches([suffix_dedup._table([r for r in told if (r[0] < 0) == alone])]), False, False) for alone in (True, False)])
    for k, want in ((1, [0, 10]), (2, [0])):
        unit = next(r[1] for r in told if r[0] < 0 and np.frombuffer(r[2], suffix_dedup.DOC)["id"][0] == k)
        (row,) = suffix_dedup._by_document(found.filter(pc.equal(found.column("unit"), unit))).to_pylist()
        assert row["doc_id"] == k and np.frombuffer(row["places"], "<u4").tolist() == want


def brute_classes(rows):
    """Of each row: (rep_id, class_id, n_copies, n_links, class), with a class of its own for a text without a word."""
    texts = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        w = tuple(re.findall(r"[^\W_]+", (t or "").lower()))
        texts[w or k].append(d)
    sets = {w: frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) for w in texts if isinstance(w, tuple)}
    links, root = Counter(), {w: w for w in texts}
    least = lambda ds: min((d for d in ds if d is not None), default=None)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    members = defaultdict(list)
    for w, ds in texts.items():
        members[find(w)] += ds
    out = []
    for k, (_, t) in enumerate(rows):
        w = tuple(re.findall(r"[^\W_]+", (t or "").lower())) or k
        out.append((least(texts[w]), least(members[find(w)]), len(texts[w]), links[w], find(w)))
    return out


def test_ngram_join(spark, sf_dir, odd):
    near = [(100 + k, (LONG * 3).replace("seven", f"w{k}", 1), "en", "s", 1, 0.0, "", 0) for k in range(40)]
    # Ids that repeat with other texts, near copies of both, and near copies without an id.
    near += [(60, LONG * 2 + "one", "en", "s", 1, 0.0, "", 0), (60, own_words(1), "en", "s", 1, 0.0, "", 0), (61, LONG * 2 + "two", "en", "s", 1, 0.0, "", 0), (62, own_words(1) + " x", "en", "s", 1, 0.0, "", 0)]
    near += [(None, own_words(1) + " y", "en", "s", 1, 0.0, "", 0), (None, own_words(2), "en", "s", 1, 0.0, "", 0), (None, own_words(2) + " z", "en", "s", 1, 0.0, "", 0), (63, own_words(3), "en", "s", 1, 0.0, "", 0), (63, own_words(3), "en", "t", 1, 0.0, "", 0)]
    for docs, settings in (
        (odd.union(spark.createDataFrame(near, odd.schema)), ngram_join.Settings(block=8, part_bytes=2000)),
        (table(spark, sf_dir, "documents"), ngram_join.Settings()),
        (table(spark, sf_dir, "documents").selectExpr("cast(doc_id as string) doc_id", "text"), ngram_join.Settings(block=2, part_bytes=1000)),
    ):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = brute_classes(rows)
        got = ngram_join.near_duplicates(docs, settings).collect()
        key = lambda x: tuple((v is None, str(v)) for v in x)
        assert sorted(map(key, ((d, *w[:4]) for (d, _), w in zip(rows, want, strict=True)))) == sorted(map(key, ((r.doc_id, r.rep_id, r.class_id, r.n_copies, r.n_links) for r in got)))
        kept = ngram_join.drop_duplicates(docs, settings)
        assert kept.columns == docs.columns
        left = [(r.doc_id, r.text) for r in kept.collect()]
        class_of = {(d, t): w[4] for (d, t), w in zip(rows, want, strict=True) if isinstance(w[4], tuple)}
        assert Counter(class_of[x] for x in left if x in class_of) == Counter(dict.fromkeys(class_of.values(), 1))
        assert Counter(x for x in left if x not in class_of) == Counter(x for x in rows if x not in class_of)
        head = {w[4]: w[1] for w in want}
        assert all(d == head[class_of[d, t]] for d, t in left if (d, t) in class_of)
    assert ngram_join.near_duplicates(empty(odd)).count() == 0 and ngram_join.drop_duplicates(empty(odd)).count() == 0


def own_words(k, n=60):
    return " ".join(f"o{k}x{i}" for i in range(n))


def test_intersections_against_sets():
    rng = np.random.default_rng(2)
    for n, m, words in ((3, 5, 10), (40, 60, 2000), (64, 64, 50)):
        a, b = ([np.unique(rng.integers(0, words, 30)) for _ in range(k)] for k in (n, m))
        flat = lambda x: (np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x))
        rows, grams = zip(*((r[o], g[o]) for r, g in map(flat, (a, b)) for o in [np.argsort(g, kind="stable")]), strict=True)
        got = ngram_join.intersections(rows, grams, (n, m))
        assert (got == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_bands_reach_the_recall():
    for similarity in (0.5, 0.8, 0.95):
        bands, rows = ngram_join.choose_bands(similarity, 0.999, 128)
        assert bands * rows <= 128 and 1 - (1 - similarity**rows) ** bands >= 0.999


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    for small in (0, 1000):
        got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(edges, "a int, b int"), small).collect()}
        assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 102: 100}
        named = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "a string, b string").selectExpr("struct(1 as k, a) as a", "struct(1 as k, b) as b")
        assert {(r.node.a, r.label.a) for r in components.connected_components(named, small).collect()} == {(f"n{a:03}", f"n{b:03}") for a, b in got.items()}


def brute_lines(rows, least):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\v\f\r").translate(fold)
    seen = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(d)
    gone = {k for k, v in seen.items() if k and len(v) >= least}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup(spark, sf_dir, odd, least):
    many = "\n".join(f"only {i}\n shared {i % 7}" for i in range(200))
    more = spark.createDataFrame([(200 + k, f"shared {k}\n Shared {k} \nmine {k}\n" + (many if k < 2 else ""), "en", "s", 1, 0.0, "", 0) for k in range(12)], odd.schema)
    for docs in (odd.union(more), table(spark, sf_dir, "documents")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, least).collect()]
        assert Counter(got) == Counter(brute_lines(rows, least))
        assert line_dedup.dedup_lines(docs, least).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(empty(odd)).count() == 0


def test_quality(spark, sf_dir, odd):
    docs = odd.union(spark.createDataFrame([(300, "the of and " * 40, "en", "s", 1, 0.0, "", 0), (301, " ".join(f"w{i} #{i}" for i in range(60)) + "\n\n \nx\nx", "en", "s", 1, 0.0, "", 0)], odd.schema))
    got = quality.apply_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        body = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        tri = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeat = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in body.split("\n") if x.strip(" \t\n\v\f\r")]
        failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in body), len(lines) - len(set(lines)), len(repeat), failed,
        )
        assert not (failed and r.kept)
    assert quality.apply_rules(empty(odd)).count() == 0
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    hits = [r.kept == (labels[r.doc_id] == 1) for r in quality.apply_rules(table(spark, sf_dir, "documents")).collect() if r.doc_id in labels and r.n_words >= 50]
    assert sum(hits) / len(hits) > 0.95


def test_language_id(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    own = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert sum(own) / len(own) > 0.97
    m = langid.fit(docs)
    large = [f for f in m.families if len(f) > 1]
    assert sorted(sum(m.families, [])) == ["de", "en", "es", "fr"] and len(m.families) > 1 and large
    assert set(m.within) == {p for f in m.families for p in itertools.combinations(f, 2)} and set(m.between) == set(itertools.combinations(range(len(m.families)), 2))
    # Both levels decide: with a level's machines turned round, other languages come out.
    held_docs = docs.where("crc32(encode(cast(doc_id as string), 'UTF-8')) % 4 = 2")
    for level in ("between", "within"):
        wrong = langid.Model(m.families, m.between, m.within)
        setattr(wrong, level, {k: -w for k, w in getattr(m, level).items()})
        hits = [truth[r.doc_id] == r.lang_pred for r in langid.predict(held_docs, wrong).collect() if level == "between" or truth[r.doc_id] in large[0]]
        assert len(hits) > 50 and sum(hits) < 0.03 * len(hits)
    for r in langid.predict(odd, m).collect():
        bare = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == bare
    none = langid.predict(odd, langid.fit(empty(docs))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert langid.predict(empty(odd), m).count() == 0


def test_families():
    point = lambda *x: np.array(x, float)
    assert langid.group_families({}) == [] and langid.group_families({"a": point(1, 0)}) == [["a"]] and langid.group_families({"b": point(1, 0), "a": point(0, 1)}) == [["a", "b"]]
    four = {"a": point(1, 0, 0.1), "b": point(0, 1, 0), "c": point(1, 0.1, 0), "d": point(0.1, 1, 0.1), "e": point(0, 0, 1)}
    assert langid.group_families(four) == [["a", "c"], ["b", "d"], ["e"]]
    same = {k: point(1, 1) for k in "abc"}
    assert sorted(sum(langid.group_families(same), [])) == ["a", "b", "c"]


def test_a_very_long_text_has_a_language(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    m = langid.fit(docs)
    row = docs.where("lang = 'fr'").orderBy("doc_id").first()
    long = spark.createDataFrame([(1, row.text * (3_000_000 // len(row.text)))], "doc_id long, text string")
    assert langid.predict(long, m).first().lang_pred == "fr"


def test_a_language_of_many_copies_is_learned(spark):
    rows = [(f"{w} {w}{k % 3}", lang) for lang, w in (("a", "abab"), ("b", "cdcd"), ("c", "efef"), ("d", "ghgh")) for k in range(3000)]
    m = langid.fit(spark.createDataFrame(rows, "text string, lang string"), langid.Settings(sample=40))
    assert sorted(x for f in m.families for x in f) == ["a", "b", "c", "d"]


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.normal(-0.1, 1, rng.integers(0, 14)).astype(np.float32)

        def split(lo, hi, x=x):
            """The defining recursion: the best segment, then what is left and right of it."""
            best = max(((float(x[a:b].sum(dtype=np.float64)), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, lo, lo))
            return [] if best[0] <= 0 else [*split(lo, best[1]), (best[1], best[2]), *split(best[2], hi)]

        assert [(a, b) for a, b, _ in toxicity.maximal_segments(x)] == split(0, len(x))


def test_toxicity(spark, odd):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in got.items())
    own = [(labels[k], r.predicted) for k, r in got.items() if r.held_out and k in labels]
    found = sum(p for y, p in own if y) / sum(y for y, _ in own)
    false = sum(p for y, p in own if not y) / sum(1 - y for y, _ in own)
    assert found > 0.85 and false < 0.02
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    m = toxicity.fit(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    out = toxicity.score(odd, m, passages=True).collect()
    assert len(out) == len(ODD) and len({r.score for r in out if not r.text}) == 1
    assert all(0 <= p.begin < p.end <= len(r.text.encode()) for r in out for p in r.passages)
    for labels_ in (empty(table(spark, "/root/testdata/sf0.01", "labels")), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")):
        assert {r.predicted for r in toxicity.score(odd, toxicity.fit(odd, labels_)).collect()} == {0}
    assert toxicity.score(empty(odd), m).count() == 0


def brute_contaminated(docs, bench):
    """{(row, item): best similarity, first word} over all spans, and with each item's other lengths at a document's ends."""
    gram = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    out = {}
    for row, text in enumerate(docs):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        own = set(gram(w)) if w else set()
        for item, n, grams in bench:
            if n >= 5 and not own & set(grams):  # without a common shingle the similarity of every span is 0
                continue
            for at in range(-n + 1, len(w)):
                other = gram(w[max(at, 0) : at + n])
                both = sum((grams & other).values())
                x = both / (grams.total() + other.total() - both)
                if x >= 0.8 - 1e-12 and x > out.get((row, item), (0, 0))[0]:
                    out[row, item] = (x, max(at, 0))
    return out


def bench_items(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        out.append((i, len(w), Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))))
    return out


def test_decontamination(spark, sf_dir, odd):
    bench = table(spark, sf_dir, "benchmark")
    rows = bench.collect()
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = list(texts)
    want = {(ids[d], i): x for (d, i), x in brute_contaminated(texts.values(), bench_items([(r.item_id, r.text) for r in rows])).items()}
    got = {(r.doc_id, r.item_id): (r.similarity, r.word_at) for r in decontam.find_contaminated(docs, bench).collect()}
    assert set(got) == set(want) and want
    assert all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(ids) - {d for d, _ in want}
    item = max((re.findall(r"[^\W_]+", r.text.lower()) for r in rows), key=len)
    changed = [*item[:25], "zzz", *item[26:]] if len(item) >= 49 else item
    plant = spark.createDataFrame([(900, "pre words " + " ".join(changed) + " post words"), (901, " ".join(item)), (901, " ".join(item)), (None, " ".join(item)), (902, None), (903, "")], "doc_id long, text string")
    got = {(r.doc_id, round(r.similarity, 3) == 1, r.word_at) for r in decontam.find_contaminated(plant, bench).collect()}
    assert (901, True, 0) in got and (None, True, 0) in got and any(d == 900 and at == 2 for d, _, at in got)
    assert sorted(str(r.doc_id) for r in decontam.drop_contaminated(plant, bench).collect()) == ["902", "903"]
    assert decontam.find_contaminated(odd, empty(bench)).count() == 0 and decontam.find_contaminated(empty(odd), bench).count() == 0
    assert decontam.drop_contaminated(odd, empty(bench)).count() == len(ODD)
    nulls = spark.createDataFrame([(None, "a b c"), (1, None), (2, "")], "item_id long, text string")
    assert decontam.find_contaminated(odd, nulls).count() == 0


def test_items_with_ids_of_any_type_and_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    for kind, one in (("string", "a"), ("int", 1), ("smallint", 1), ("double", 0.5)):
        bench = spark.createDataFrame([(one, text, 7, "x")], f"item_id {kind}, text string, similarity int, doc_id string")
        docs = spark.createDataFrame([("d", f"pre {text}", 1, 2)], "doc_id string, text string, item_id int, word_at int")
        assert [(r.doc_id, r.item_id, r.similarity, r.word_at) for r in decontam.find_contaminated(docs, bench).collect()] == [("d", one, 1.0, 1)]
        assert decontam.drop_contaminated(docs, bench).count() == 0


def test_edited_items_are_found(spark):
    """Copies with spread edits, of a similarity of 0.8 and more, of items of 15 to 600 words, in long texts."""
    rng = np.random.default_rng(11)
    word = lambda: f"v{int(rng.zipf(1.3)) % 5000}"
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([15, 17, 20, 25, 30, 40, 50, 60, 90, 150, 300, 600] * 6)]
    grams = {i: g for i, _, g in bench_items([(i, " ".join(w)) for i, w in items])}
    docs, want = [], set()
    for i, w in items:
        for e in range(4):
            c = list(w)
            for _ in range(1 + int(len(w) * 0.02)):
                at = int(rng.integers(0, len(c))) if len(w) >= 50 else int(rng.choice([0, len(c) - 1]))
                if e % 3 == 0:
                    c[at] = "zz"
                elif e % 3 == 1:
                    del c[at]
                else:
                    c.insert(at, "zz")
            doc = [word() for _ in range(200)] + c + [word() for _ in range(200 * (e % 2))]
            docs.append((len(docs), " ".join(doc)))
            spans = (Counter(tuple(s[k : k + 5]) for k in range(len(s) - 4)) for s in (doc[200 + d : 200 + d + len(w)] for d in range(-3, 4)))
            best = max(sum((grams[i] & s).values()) / (grams[i].total() + s.total() - sum((grams[i] & s).values())) for s in spans)
            if best >= 0.8:
                want.add((len(docs) - 1, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(want) > 150 and len(got & want) >= 0.99 * len(want) and all(d // 4 == i for d, i in got)


def test_items_of_sixteen_words_with_an_end_changed(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(16))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(2 * k + e, "pre " + (f"zz {t.split(' ', 1)[1]}" if e else f"{t.rsplit(' ', 1)[0]} zz") + " post") for k, t in items for e in (0, 1)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_contaminated(docs, bench).collect()}
    assert got == {(2 * k + e, k) for k in range(40) for e in (0, 1)}


def test_hamming_blocks_are_exact():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    for radius in (3, 7):
        m = decontam.Matcher(pa.array([" ".join(words[:20])]), decontam.Settings(radius=radius))
        ix = m.indexes[0]
        h = np.concatenate([ix.fingerprints[:1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(11) for _ in range(50)])
        i, j = m._near(h, ix)
        want = {(a, b) for a in range(len(h)) for b in range(len(ix.fingerprints)) if bin(int(h[a]) ^ int(ix.fingerprints[b])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_mixing(spark, odd):
    rows = [(k, "w " * (k % 9 + 1), "hot" if k % 3 else f"s{k % 5}") for k in range(3000)] + [(9000, "w w", None), (9001, None, "hot"), (9002, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    for target in (mixing.Target(entropy=0.97, repeats=None), mixing.Target(entropy=0.999, repeats=1.5), mixing.Target(entropy=None, repeats=4.0, budget=2000)):
        got = mixing.mixture(docs, target).collect()
        total = sum(tokens.values())
        budget = target.budget or total
        weight = {r.source: r.weight for r in got}
        used, epochs = Counter(), defaultdict(Counter)
        for r in got:
            used[r.source] += r.n_tokens
            epochs[r.source][r.epoch] += r.n_tokens
        h = -sum(w * np.log(w) for w in weight.values())
        assert abs(sum(weight.values()) - 1) < 1e-6 or target.budget
        times = max(w * budget / tokens[s] for s, w in weight.items())
        if target.entropy and target.repeats is None:
            assert abs(h / np.log(len(weight)) - target.entropy) < 1e-4
        if target.repeats:
            assert times <= target.repeats + 1e-4
        for s, w in weight.items():
            assert w * budget - 9 <= used[s] <= w * budget + 1e-3
            full = int(w * budget // tokens[s])
            assert all(epochs[s][e] == tokens[s] for e in range(1, full + 1))
        order = [(r.source, r.epoch, r.block_key, r.block) for r in got]
        assert len({(s, e, k) for s, e, k, _ in order}) == len(set(order))
    assert mixing.mixture(empty(odd)).count() == 0
    assert {c for c in mixing.mixture(odd).columns} >= set(odd.columns)


def brute_mixture(spark, docs, target):
    """{(doc_id, epoch): rows} by bisecting the exponent and going through the last epoch document by document."""
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.h) for r in docs.selectExpr("*", f"xxhash64({target.seed}, doc_id) as h").collect()]
    tokens = Counter()
    for _, source, n, _ in rows:
        tokens[source] += n
    tokens = {s: n for s, n in tokens.items() if n}
    total = sum(tokens.values())
    budget = target.budget if target.budget is not None else total

    def weights(a):
        raw = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    entropy = lambda a: -sum(w * np.log(w) for w in weights(a).values())
    often = lambda a: max(w * budget / tokens[s] for s, w in weights(a).items())

    def bisect(good_low):
        low, high = 0.0, 1.0
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if good_low(mid) else (low, mid)
        return low

    a = 1.0
    if target.entropy is not None and entropy(1.0) < target.entropy * np.log(len(tokens)):
        a = bisect(lambda x: entropy(x) >= target.entropy * np.log(len(tokens)))
    if target.repeats is not None and often(a) > max(target.repeats, budget / total):
        a = bisect(lambda x: often(x) > max(target.repeats, budget / total))
    weight, out, shares = weights(a), Counter(), {}
    for source, n in tokens.items():
        whole, rest = divmod(int(weight[source] * budget + 1e-6), n)
        shares[source] = (weight[source], weight[source] * budget)
        own = [r for r in rows if r[1] == source]
        block = {r[0]: (r[3] % 2**64) >> (64 - (target.blocks.bit_length() - 1)) for r in own}
        keys = spark.createDataFrame([(source, whole + 1, b) for b in sorted(set(block.values()))], "source string, e int, b int")
        key = {r.b: r.k for r in keys.selectExpr("b", f"xxhash64({target.seed}, source, e, b) as k").collect()}
        by_doc = defaultdict(list)
        for r in own:
            by_doc[key[block[r[0]]], block[r[0]], r[3], r[0] is not None, r[0] or 0].append(r)
        used, stop = 0, False
        for _, group in sorted(by_doc.items()):
            size = sum(r[2] for r in group)
            stop |= used + size > rest or rest == 0
            used += size
            for r in group:
                for epoch in range(1, whole + 1 + (not stop)):
                    out[r[0], source, epoch] += 1
    return out, shares


def test_mixing_against_brute_force(spark):
    rows = [(k if k % 97 else k // 2, "w " * (1 + k * 7 % 23), "hot" if k % 3 else f"s{k % 5}") for k in range(1, 900)] + [(None, "w w", None), (9001, None, "hot"), (9002, "", "none"), (9003, "w " * 40, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for target in (mixing.Target(entropy=0.9, repeats=None, blocks=16), mixing.Target(entropy=0.99, repeats=2.0, blocks=4), mixing.Target(entropy=None, repeats=4.0, budget=5000, blocks=64), mixing.Target(entropy=0.5, repeats=1.0, seed=3)):
        want, shares = brute_mixture(spark, docs, target)
        got = mixing.mixture(docs, target).collect()
        # The exponents agree to 1e-9, which can move a budget by a token, and so the last document of a source.
        have = Counter((r.doc_id, r.source, r.epoch) for r in got)
        assert all(abs(r.weight - shares[r.source][0]) < 1e-6 for r in got)
        assert sum(((have - want) + (want - have)).values()) <= len(shares) and sum(want.values()) > 300


def test_toxicity_model_against_counts(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    m = toxicity.fit(docs, labels)
    label = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.text, label[r.doc_id]) for r in docs.collect() if r.doc_id in label]

    def features(word):
        for k in (0, *toxicity.STEMS):
            if k == 0 or len(word) > k:
                h = textkernels.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([k or len(word)])) + np.uint64(k)
                yield k, int(textkernels.mix(h)[0] & np.uint64(toxicity.BUCKETS - 1))

    known, counts = {}, (Counter(), Counter())
    words_of = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode())
    for text, y in rows:
        own = set(words_of(text))
        for w in own - set(known):
            known[w] = list(features(w))
        counts[y].update(b for _, b in {x for w in own for x in known[w]})
    n0, n1 = sum(counts[0].values()), sum(counts[1].values())
    rate, s = n1 / (n0 + n1), m.settings
    weight = {}
    for b in set(counts[0]) | set(counts[1]):
        x, y = counts[1][b] + s.prior * rate, counts[0][b] + s.prior * (1 - rate)
        odds = math.log(x / y) - math.log(rate / (1 - rate))
        weight[b] = math.copysign(max(abs(odds) - s.caution * math.sqrt(1 / x + 1 / y), 0), odds)
    assert np.allclose([m.weights[b] for b in weight], list(weight.values()), atol=1e-5) and np.count_nonzero(m.weights) == sum(abs(v) > 1e-9 for v in weight.values())
    # The scale of the law: clean tokens' scores, a word at a time.
    score = lambda w: max((weight[b] for _, b in known[w]), key=abs) - s.drift
    clean = [score(w) for t, y in rows if not y for w in words_of(t)]
    assert abs(np.mean(np.exp(m.lam * np.array(clean))) - 1) < 0.02
    for text, _ in rows[:60]:
        scores = np.array([score(w) for w in words_of(text)])
        found = toxicity.maximal_segments(scores)
        level = [m.lam * x[2] - m.log_k - math.log(max(len(scores), 1)) for x in found]
        best, sure, passages = toxicity.evidence(scores.astype(np.float32), m)
        assert not found or abs(best - max(level)) < 1e-3
        chance = 0.0
        for r in range(1, len(level) + 1):
            t = sum(sorted(level, reverse=True)[:r]) + math.lgamma(r + 1)
            if t > 0:
                chance = max(chance, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        assert abs(chance - sure) < 1e-3 * max(1, sure) and len(passages) == sum(x >= -math.log(s.significance) for x in level)
    seen = np.array([toxicity.score_texts(pa.array([t]), m)[0][0] for t, _ in rows])
    y = np.array([b for _, b in rows])
    q = 1 / (1 + np.exp(-(m.slope * seen + m.offset)))
    assert abs((q - y).sum()) < 0.5 and m.slope > 0  # the calibration's own condition


def test_toxicity_of_very_long_and_repeated_rows(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    m = toxicity.fit(docs, labels)
    label = {r.doc_id: r.toxic for r in labels.collect()}
    clean = next(r.text for r in docs.orderBy("doc_id").collect() if label.get(r.doc_id) == 0 and len(r.text) > 300)
    long = clean * (3_000_000 // len(clean))
    got = toxicity.score(spark.createDataFrame([(1, long), (1, clean), (1, clean)], "doc_id long, text string"), m).collect()
    assert len(got) == 3 and {r.predicted for r in got} == {0} and got[1].score == got[2].score


def test_chat_format(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"),
        (5, 0, "user", "hi"), (5, 1, "assistant", "yo"), (5, 2, "user", "more"), (6, 0, None, None), (6, 0, None, None), (7, None, "user", "hi"), (None, 3, "user", ""), (8, 0, "user", None),
        *[(9, k, "user", f"t{k}") for k in range(600)], *[(10, k, "user", f"t{k}") for k in range(599)],
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", chat_format.F.lit(1))
    got = {r.conv_id: r for r in chat_format.collapse_snapshots(df, bucket=16).collect()}
    assert set(got) == {3, 4, 6, 8, 9, None}
    assert got[3].n_copies == 2 and got[3].rendered == "<|user|>\nhi\n<|assistant|>\nyo\n<|user|>\nmore\n" and got[6].n_turns == 2
    assert got[9].n_turns == 600 and got[9].rendered.endswith("t598\n<|user|>\nt599\n")
    assert chat_format.collapse_snapshots(df.where("false")).count() == 0
    nul = spark.createDataFrame([(1, 0, None, "a"), (2, 0, "\x00", "a"), (3, 0, "a", None), (4, 0, "a", "\x00"), (5, 0, None, "a")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.n_copies) for r in chat_format.collapse_snapshots(nul).collect()} == {(1, 2), (2, 1), (3, 1), (4, 1)}
