"""The pipeline's stages, each against what its operator says of its own input."""

import re
from collections import Counter

import corpus_pipeline as P
from tilewright.llm import decontam, line_dedup, ngram_join, toxicity
from tilewright.session import table


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]
    before = docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "source_mixing":
            assert after.columns == columns
        a, b = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
        assert set(b) <= set(a)
        if name == "toxicity":
            toxic = {r.doc_id for r in table(spark, sf_dir, "labels").where("toxic = 1").collect()}
            assert len(b) > 0.8 * len(a) and all(a[i].text == b[i].text for i in b)
            assert len(set(a) - set(b) - toxic) < 0.05 * len(a)
        if name == "line_dedup":
            count = Counter(x for r in b.values() for x in {y.strip().lower() for y in r.text.split("\n")} if x)
            assert set(b) == set(a) and max(count.values()) < 10 and all(r.n_chars == len(r.text) for r in b.values())
        if name == "ngram_jaccard_join":
            left = ngram_join.near_duplicates(after).collect()
            assert all(r.n_links == 0 and (r.n_copies == 1 or not b[r.doc_id].text) for r in left)
        if name == "benchmark_decontamination":
            flat = {i: " ".join(re.findall(r"[^\W_]+", r.text.lower())) for i, r in a.items()}
            items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in table(spark, sf_dir, "benchmark").collect()]
            held = {i for i, t in flat.items() if any(x in t for x in items)}
            assert held & set(b) == set() and len(set(a) - set(b) - held) <= 1
        if name == "source_mixing":
            assert set(b) == set(a) or len(b) > 0.5 * len(a)
        before = after


def test_run_gives_the_last_stage(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert {"doc_id", "text", "source", "epoch", "block_key", "weight"} <= set(out.columns) and out.count() > 0


def awkward(spark, sf_dir):
    """Some documents with null and repeated ids, null texts, exact copies of one id, and a passage of the benchmark without an id."""
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").limit(60)
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    words = lambda k: " ".join(f"p{k}q{i}" for i in range(80))
    rows = [(None, None, "en", "s", 0), (None, words(1), "en", "s", 1), (None, words(1), "en", "s", 1), (7001, words(2), "en", "s", 1), (7001, words(2), "en", "s", 1), (7001, words(3), "de", "s", 1), (7002, words(3) + " end", "de", None, 1)]
    rows += [(None, f"before {item} after", "en", "s", 1), (7003, f"before {item} after", "en", "s", 1), (7004, "", "en", "s", 0), (7004, "\n\n", "en", "s", 2)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def test_stages_on_null_and_repeated_ids(spark, sf_dir):
    docs = awkward(spark, sf_dir)
    rows = lambda df: Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())
    all_rows = rows(docs)
    stages = dict(P.STAGES)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    assert rows(stages["toxicity"](spark, docs, sf_dir)) == rows(toxicity.score(docs, model).where("predicted = 0"))
    cut = stages["line_dedup"](spark, docs, sf_dir)
    assert rows(cut) == rows(line_dedup.dedup_lines(docs)) and sum(rows(cut).values()) == sum(all_rows.values())
    once = rows(stages["ngram_jaccard_join"](spark, docs, sf_dir))
    assert once - all_rows == Counter() and all(n == 1 for (_, t, *_), n in once.items() if t and t.strip())
    mine = {(i, t[:4]) for i, t, *_ in once if t and t[:2] in ("p1", "p2", "p3")}
    assert mine == {(None, "p1q0"), (7001, "p2q0"), (7001, "p3q0")}
    assert {t for i, t, *_ in once if i == 7004 or t is None} == {"", "\n\n", None}
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    left = rows(stages["benchmark_decontamination"](spark, docs, sf_dir))
    assert not any(t and item in t for _, t, *_ in left)
    found = {(r.doc_id) for r in decontam.find_contaminated(docs, table(spark, sf_dir, "benchmark")).collect()}
    assert all_rows - left == Counter({k: n for k, n in all_rows.items() if k[0] in found and not (k[0] is None and (k[1] is None or item not in k[1]))})
    assert sum(rows(stages["source_mixing"](spark, docs, sf_dir)).values()) > 0


def test_stages_on_an_empty_table(spark, sf_dir):
    none = table(spark, sf_dir, "documents").where("false")
    for name, stage in P.STAGES:
        got = stage(spark, none, sf_dir)
        assert got.count() == 0 and (name == "source_mixing" or got.columns == none.columns)
