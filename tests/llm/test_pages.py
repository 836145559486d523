"""HTML extraction against pages of known main text."""

import math
from collections import defaultdict

import numpy as np

from tilewright.llm import html_extract as X

HEAD = '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><article>";</script></head><body>'
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'


def text(page: str) -> str:
    return X._main_texts([X.blocks_of(page)], X.Settings())[0]


def test_article_without_its_surroundings():
    page = (
        HEAD + NAV + '<header class="masthead">Site</header><div class="ad">Buy now</div><div id="cookie-notice">We use cookies</div><main><article class="post has-sidebar"><h1>Title &eacute;&#233;</h1>'
        '<p><b>First   part<br><p>Second&nbsp;one <i>in</i>line &lt;tag&gt;</p><aside>Related</aside><form><label>Mail</label></form><figure>Fig</figure><!-- <p>no</p> --><ul><li>one<li>two</ul>'
        '<p class="advert">Sponsored</p><p>Last</article></main><section class="comments"><article class="comment">Me too</article></section><footer>&copy; me</footer></body></html>'
    )
    assert text(page) == "Title éé\nFirst part\nSecond one inline <tag>\nFig\none\ntwo\nLast"
    assert text("") == "" and text("plain words only") == "plain words only" and text("<p>a<p hidden>b</p>c") == "a\nc"


def test_unclosed_and_broken_markup():
    assert text("<article><h1>A</h1><p>b <b>c</p><div>d</article><footer>e") == "A\nb c\nd"
    assert text('<article><p title="a > b">x</p></article>') == "x"
    assert text("<article>a < b & c</article>") == "a < b & c"


def test_shared_words_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(0, 80))
        words = [str(x) for x in rng.integers(0, 3, n)]
        page = np.sort(rng.integers(0, 4, n))
        got = X.shared_words(words, page, 4)
        want = np.zeros(n, bool)
        runs = {}
        for i in range(n - 3):
            if page[i] == page[i + 3]:
                runs.setdefault(tuple(words[i : i + 4]), []).append(i)
        for at in runs.values():
            if len({page[i] for i in at}) > 1:
                for i in at:
                    want[i : i + 4] = True
        assert got.tolist() == want.tolist()


def test_pages_without_articles_lose_what_they_share(spark):
    share = "<div>All our pages carry this very long line of text about the site</div>"
    rows = [(k, f"http://h.example/{k}", f"<body>{share}<div>Only page number {k} says this and that for {k} reasons</div></body>") for k in range(300)]
    rows += [(500, None, None), (501, "nonsense", ""), (502, "http://h.example/x", HEAD + NAV + "<article><p>Mine</p></article>"), (1, rows[1][1], rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as shard", "'x' as text")
    got = X.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[k].text == f"Only page number {k} says this and that for {k} reasons" and by[k].n_chars == len(by[k].text) for k in range(300))
    assert by[500].text == by[501].text == "" and by[502].text == "Mine" and by[500].n_chars == 0
    assert X.extract(pages.where("false")).count() == 0


def own(k: int, n: int = 40) -> str:
    """Words that only page ``k`` has."""
    return " ".join(f"w{k}x{i}" for i in range(n))


def extracted(spark, bodies):
    rows = [(k, f"http://h.example/{k}", f"<body>{b}</body>") for k, b in enumerate(bodies)]
    return {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}


def test_the_array_judges_pages_with_an_article(spark):
    notice = "Our shop sells very many things at low prices every day of the week"
    bodies = [f"<article>teaser {k}</article><div>{own(k)}</div><div>{notice}</div>" for k in range(30)]
    bodies += [f"<article><p>{own(k)}</p><p>{notice}</p></article>" for k in range(30, 60)]
    got = extracted(spark, bodies)
    assert all(got[k] == f"teaser {k}\n{own(k)}" for k in range(30)) and all(got[k] == own(k) for k in range(30, 60))
    # A paragraph that fewer than half of the pages have stays in their articles.
    few = [f"<article><p>{own(k)}</p>{f'<p>{notice}</p>' if k < 20 else ''}</article>" for k in range(60)]
    got = extracted(spark, few)
    assert all(got[k] == (f"{own(k)}\n{notice}" if k < 20 else own(k)) for k in range(60))


def test_copies_and_quotes_stay(spark):
    quote = own(99, 20)
    bodies = [f"<div>{own(0)}</div>"] * 2 + [f"<div>{own(1, 300)} copy {k}</div>" for k in range(40)] + [f"<div>{own(2)}</div><div>{quote}</div>", f"<div>{own(3)}</div><div>{quote}</div>", f"<div>{own(4)}</div>"]
    got = extracted(spark, bodies)
    assert got[0] == got[1] == own(0) and all(got[2 + k] == f"{own(1, 300)} copy {k}" for k in range(40))
    assert got[42] == f"{own(2)}\n{quote}" and got[43] == f"{own(3)}\n{quote}" and got[44] == own(4)


def test_runs_are_counted_over_a_whole_host(spark):
    notice = "Ten pages of a very large host carry this line of text and no other"
    got = extracted(spark, [f"<div>{own(k)}</div>{f'<div>{notice}</div>' if k % 300 == 0 else ''}" for k in range(3000)])
    assert all(got[k] == own(k) for k in range(3000))


def test_long_lists_go_in_parts(spark):
    notice = "All our pages carry this very long line of text about the site"
    rows = [(k, f"http://h{k % 9}.example/{k}", f"<div>{own(k)}</div><div>{notice}</div>") for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in X.extract(pages, X.Settings(listed=20)).collect()}
    assert got == {k: own(k) for k in range(90)}


def brute_texts(pages, s=X.Settings()):  # noqa: B008
    """Main texts of (page_id, url, html), by counting every run of words of every page of a host."""
    hosts = defaultdict(list)
    for k, (_, url, _) in enumerate(pages):
        host = url.split("://", 1)[1].split("/")[0].split("@")[-1].split(":")[0].lower() if url and "://" in url else ""
        hosts[host].append(k)
    out = {}
    for rows in hosts.values():
        parsed = {k: X.blocks_of(pages[k][2] or "") for k in rows}
        total = len({pages[k][2] or "" for k in rows})
        sketch = dict(zip(rows, X.sketches([parsed[k] for k in rows]).tolist(), strict=True))
        stream = {k: [(w, zone, j) for j, (zone, text) in enumerate(parsed[k]) for w in text.split()] for k in rows}
        runs = lambda k: ((i, tuple(w for w, _, _ in stream[k][i : i + 8])) for i in range(len(stream[k]) - 7))  # noqa: E731, B023
        whole, free = defaultdict(set), defaultdict(set)
        for k in rows:
            for i, run in runs(k):
                whole[run].add(sketch[k])
                if all(z != X.ARTICLE for _, z, _ in stream[k][i : i + 8]):
                    free[run].add(sketch[k])

        def unlike(found):
            left, n = sorted(found), 0
            while left and n < 10:
                left, n = [x for x in left if (x ^ left[0]).bit_count() > s.near], n + 1  # noqa: B023
            return n

        need = min(max(math.ceil(s.share * total - 1e-9), s.least), s.enough)
        mostly = {r for r, p in whole.items() if unlike(p) >= s.enough and 2 * len(p) > total}
        often = {r for r, p in free.items() if unlike(p) >= need} | mostly
        for k in rows:
            words = stream[k]
            gone, inside = [False] * len(words), [False] * len(words)
            for i, run in runs(k):
                for q in range(i, i + 8):
                    gone[q] |= run in often and words[q][1] == X.OPEN
                    inside[q] |= run in mostly and words[q][1] == X.ARTICLE
            if 2 * sum(inside) <= sum(z == X.ARTICLE for _, z, _ in words):
                gone = [a or b for a, b in zip(gone, inside, strict=True)]
            texts = []
            for j, (zone, text) in enumerate(parsed[k]):
                if zone == X.FRAME:
                    continue
                own = [(w, g) for (w, _, b), g in zip(words, gone, strict=True) if b == j]
                if any(g for _, g in own):
                    parts, at = [], 0
                    while at < len(own):
                        end = next((e for e in range(at, len(own)) if own[e][1] != own[at][1]), len(own))
                        parts.append([own[at][1], [w for w, _ in own[at:end]]])
                        at = end
                    for p in parts:
                        p[0] = p[0] and not (len(p[1]) < 8 and 2 * len(p[1]) < len(own))
                    merged = []
                    for g, ws in parts:
                        if merged and merged[-1][0] == g:
                            merged[-1][1] += ws
                        else:
                            merged.append([g, list(ws)])
                    kept = [ws for g, ws in merged if not g and (len(ws) >= s.alone or len(ws) == len(own) or zone == X.ARTICLE)]
                    if not kept:
                        continue
                    text = " ".join(w for ws in kept for w in ws)
                texts.append(text)
            out[k] = "\n".join(texts)
    return out


def test_whole_tables_against_brute_force(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 400, n))
    common = [words(int(n)) for n in rng.integers(6, 30, 12)]
    rows = []
    for k in range(240):
        host = ("a.example", "b.example", "C.example:80", "d.example")[int(rng.integers(0, 4))]
        some = [f"<div>{common[int(i)]}</div>" for i in rng.integers(0, 12, int(rng.integers(0, 4)))]
        mixed = f"<p>{words(12)} {common[k % 3]} {words(9)}</p>"
        article = f"<article><h1>{words(4)}</h1><p>{words(60)}</p>{mixed}{'<p>' + common[11] + '</p>' if host[0] == 'a' else ''}</article>"
        body = article if k % 2 else f"<div>{words(70)}</div>{mixed}"
        rows.append((k if k % 11 else None, f"http://{host}/{k}", f"<body>{NAV}{''.join(some[:1])}{body}{''.join(some[1:])}<footer>{words(5)}</footer></body>"))
    rows += rows[:5] + [(300, None, None), (301, "no url", "<p>alone"), (302, "http://a.example/long", f"<article><p>{words(150_000)}</p></article>"), (303, "http://b.example/long", f"<div>{words(150_000)} {common[0]}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rows").repartition(5)
    got = sorted((r.page_id is None, r.page_id, r.url or "", r.text, r.n_chars) for r in X.extract(pages).collect())
    want = brute_texts(rows)
    assert got == sorted((i is None, i, u or "", want[k], len(want[k])) for k, (i, u, _) in enumerate(rows))
    plain = ["\n".join(t for z, t in X.blocks_of(h or "") if z != X.FRAME) for _, _, h in rows]
    assert sum(want[k] != plain[k] for k in range(len(rows))) > 50
    with_article = [k for k, (_, _, h) in enumerate(rows) if h and "<article" in h]
    assert any(want[k] != plain[k] for k in with_article) and any(want[k] == plain[k] for k in with_article)


def page_rows(bodies):
    return [(k, f"http://h.example/{k}", f"<body>{b}</body>") for k, b in enumerate(bodies)]


def test_runs_of_articles_are_counted_over_all_pages(spark):
    notice = "Our shop sells very many things at low prices every day of the week"
    plain = [f"<article><p>{own(k)}</p></article>" for k in range(1500)]
    noted = [f"<article><p>{own(k)}</p><p>{notice}</p></article>" for k in range(1500)]
    # The pages with the notice are those that a draw of 256 by their hash would leave out, up to 1,000.
    hashes = spark.createDataFrame(page_rows(noted), "page_id long, url string, html string").selectExpr("page_id", f"pmod(xxhash64(page_id, html), {1 << 20}) < {(256 << 20) / 1500} AS drawn")
    left = sorted(r.page_id for r in hashes.where("NOT drawn").collect())[:1000]
    assert len(left) == 1000
    got = extracted(spark, [noted[k] if k in set(left) else plain[k] for k in range(1500)])
    assert got == {k: own(k) for k in range(1500)}


def test_runs_that_under_half_of_the_articles_have_stay_outside(spark):
    notice = "Our shop sells very many things at low prices every day of the week"
    bodies = [f"<article><p>{own(k)}</p>{f'<p>{notice}</p>' if k < 20 else ''}</article>{f'<div>{notice}</div>' if k == 59 else ''}" for k in range(60)]
    got = extracted(spark, bodies)
    assert got[59] == f"{own(59)}\n{notice}" and all(got[k] == (f"{own(k)}\n{notice}" if k < 20 else own(k)) for k in range(59))


def test_small_arrays_and_copies_against_brute_force(spark):
    rng = np.random.default_rng(8)
    common = [own(1000 + i, 14) for i in range(8)]
    bodies = []
    for k in range(160):
        # Common paragraph i is on about 36 to 64 % of the pages, inside articles or outside; the first two mostly on late pages.
        some = [c for i, c in enumerate(common) if rng.random() < (0.36 + 0.04 * i if i > 1 else (0.05, 0.95)[k >= 78 - 4 * i])]
        inside, outside = [c for c in some if rng.random() < 0.9], [c for c in some if rng.random() < 0.1]
        bodies.append(f"<article><p>{own(k, 90)}</p>{''.join(f'<p>{c}</p>' for c in inside)}</article>{''.join(f'<div>{c}</div>' for c in outside)}")
    rows = page_rows(bodies)
    # Copies of pages without a paragraph do not outweigh it.
    rows += [(1000 + j, f"http://h.example/c{j}", rows[j % 40][2]) for j in range(600)]
    rows += [(5000 + k, f"http://g{k % 30}.example/", f"<article><p>{own(2000 + k)}</p><p>{common[0]}</p></article>") for k in range(400)]
    want = brute_texts(rows)
    plain = ["\n".join(t for z, t in X.blocks_of(h) if z != X.FRAME) for _, _, h in rows]
    assert 0 < sum(want[k] != plain[k] for k in range(160)) and any(c in want[k] for k in range(160) for c in common)
    for size, parts in ((16, 3), (1, 2), (1024, 1)):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = {r.page_id: r.text for r in X.extract(pages, X.Settings(pages=size)).collect()}
        assert [got[i] for i, _, _ in rows] == [want[k] for k in range(len(rows))]


def test_runs_that_reach_into_an_article_without_common_runs(spark):
    words = [f"z{i}" for i in range(8)]
    bodies = [f"<div>{own(k)}</div><div>{' '.join(words)}</div>" for k in range(30)] + [f"<div>{' '.join(words[:7])}</div><article>{words[7]} {own(30)}</article>"]
    bodies += [f"<div>{own(k)}</div>" for k in range(31, 80)]
    want = brute_texts(page_rows(bodies))
    assert extracted(spark, bodies) == want and want[30] == f"{words[7]} {own(30)}"


def test_thinned_counts_lose_no_run_of_half_the_pages():
    rng = np.random.default_rng(3)
    common = own(0, 8)
    s = X.Settings(enough=2)
    for _ in range(60):
        n = int(rng.integers(20, 120))
        some = int(rng.integers(n // 2 + 1, n + 1))
        each = [int(x) for x in rng.integers(1, 6, n)]
        parsed = [[(X.ARTICLE, own(1 + k, 30) + (" " + common if k < some else ""))] for k in range(n)]
        deal = [k for k in range(n) for _ in range(each[k])]
        if rng.random() < 0.5:
            rng.shuffle(deal)
        size = int(rng.integers(1, 60))
        slices = [deal[at : at + size] for at in range(0, len(deal), size)]
        packed = [x for part in slices for x in X._pack([parsed[k] for k in part], np.zeros(len(part), np.int64), np.full(len(part), n), s, 1, np.full(len(part), len(deal)))]
        name = X.Runs([[(X.ARTICLE, common)]], np.zeros(1, np.int64), 8).names[0]
        found = X._count(packed, s, False)
        assert name in found["name"][found["mostly"]]
