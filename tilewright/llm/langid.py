"""Language ID: families first, then one-versus-one linear support vector machines within a family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textkernels as tk
from tilewright.session import checkpointed

#: Features of a text: counts of byte trigrams in so many buckets.
BUCKETS = 1 << 11


@dataclass(frozen=True)
class Settings:
    """Parameters of the classifier. Training takes ``sample`` labelled rows at most, in equal parts by language."""

    sample: int = 8000
    cost: float = 1.0
    rounds: int = 200


@dataclass
class Model:
    """Languages by family, and the linear classifiers between families and between languages of one."""

    families: list[list[str]] = field(default_factory=list)
    between: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    within: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)


def profiles(column: pa.Array) -> np.ndarray:
    """Unit-length features of whole texts: square roots of the counts of byte trigrams within words.

    Words are letters, lower-cased, with a blank at both ends; null and texts without a word are zero.
    """
    out = np.zeros((len(column), BUCKETS), np.float32)
    letter = tk.WORD_BYTE.copy()
    letter[48:58] = False
    for p in tk.pieces(column, lower=True, size=tk.PIECE // 2):
        if not len(p.data):
            continue
        text = np.where(letter[p.data], p.data, 32).astype(np.uint32)
        before, after = np.roll(text, 1), np.roll(text, -1)
        before[p.starts[:-1][p.starts[:-1] < len(text)]] = 32  # a text has no neighbours
        after[p.starts[1:][p.starts[1:] > 0] - 1] = 32
        gram = (before << np.uint32(16)) | (text << np.uint32(8)) | after
        doc = tk.owners(p.starts)
        inside = text != 32
        bucket = ((gram * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64)
        counts = np.bincount(doc[inside] * BUCKETS + bucket[inside], minlength=p.n * BUCKETS)
        out[p.first : p.first + p.n] = counts.reshape(p.n, BUCKETS)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    np.divide(out, norm, out=out, where=norm > 0)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss; ``y`` is 1 or -1.

    Accelerated gradient steps on the whole sample, classes weighted equally.
    """
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (1e-3 / s.cost + 4.0)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(s.rounds):
        slack = np.maximum(1 - y * (x @ v), 0)
        gradient = 1e-3 / s.cost * v - 2 * (x.T @ (weight * y * slack))
        new = v - step * gradient
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def group_families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Families of languages: the tree of their mean profiles, cut where it is clearest.

    The two nearest groups join, by the mean cosine distance of their members, until one is left (the first
    of equals, in alphabetical order). Of the cuts that leave two groups at least, one of them with
    several languages, the one is taken at which the distance of the next merge differs most from that of the last
    one; of equals the one with more groups. Two languages or one are a single family.
    """
    names = sorted(means)
    if len(names) < 3:
        return [names] if names else []
    unit = np.stack([means[a] / max(float(np.linalg.norm(means[a])), 1e-12) for a in names])
    gap = 1 - unit @ unit.T
    groups, steps = [[i] for i in range(len(names))], []
    while len(groups) > 1:
        height, i, j = min((float(gap[np.ix_(groups[i], groups[j])].mean()), i, j) for i, j in combinations(range(len(groups)), 2))
        groups = [sorted(groups[i] + groups[j]), *(g for k, g in enumerate(groups) if k not in (i, j))]
        steps.append((height, groups))
    cuts = [(steps[k + 1][0] - steps[k][0], -k) for k in range(len(steps) - 1)]
    return sorted([names[i] for i in g] for g in steps[-max(cuts)[1]][1])


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """A model of the text and lang of ``docs``, from a bounded sample.

    The sample takes the same number of texts of each language, those with the smallest hash, each
    once however many copies it has; texts without a letter and rows without a language don't count. Without any there is no language.

    Only hashes are ranked, and of these only a range of each language that holds some four times as many as are
    taken, so what meets in a language's task is bounded by ``settings.sample``. The hashes that are taken, as many at
    most, then pick their texts where these are.
    """
    known = docs.select(F.col("text"), F.col("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", "text", F.shiftrightunsigned(F.xxhash64("text"), 11).alias("order"), F.length("text").alias("size"))
    counts = checkpointed(known.groupBy("lang").agg(F.count_distinct("order", "size").alias("texts")))
    share = max(settings.sample // max(counts.count(), 1), 2)
    # Rows come from a range of hashes that holds over four times as many different texts as are taken, or
    # all of a small language, so that what is ranked doesn't grow with the corpus, and is never too little.
    reach = F.lit(4.0 * share + 64) / F.col("texts")
    ranked = (
        known.select("lang", "order", "size")
        .join(F.broadcast(counts) if counts.count() <= 10_000 else counts, "lang")
        .where(F.col("order") < reach * float(1 << 53))
        .select("lang", "order", "size")
        .distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "size")))
        .where(F.col("rank") <= share)
        .drop("rank")
    )
    taken = checkpointed(ranked)
    few = known.join(F.broadcast(taken) if taken.count() <= 1 << 20 else taken, ["lang", "order", "size"]).groupBy("lang", "order", "size").agg(F.first("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = profiles(b.column("text"))
            yield pa.record_batch({"lang": b.column("lang"), "x": pa.array([(np.round(r * 65535)).astype(np.uint16).tobytes() for r in x], pa.binary())})

    got = few.select("lang", "text").mapInArrow(features, "lang string, x binary").toArrow()
    lang = np.array(got.column("lang").to_pylist(), object)
    m = Model()
    if not len(lang):
        return m
    x = np.stack([np.frombuffer(r, np.uint16) for r in got.column("x").to_pylist()]).astype(np.float32) / 65535
    m.families = group_families({a: x[lang == a].mean(axis=0) for a in sorted(set(lang))})
    home = {a: i for i, f in enumerate(m.families) for a in f}
    family = np.array([home[a] for a in lang])
    for i, j in combinations(range(len(m.families)), 2):
        use = (family == i) | (family == j)
        m.between[i, j] = train_svm(x[use], np.where(family[use] == i, 1, -1).astype(np.float32), settings)
    for names in m.families:
        for a, b in combinations(names, 2):
            use = (lang == a) | (lang == b)
            m.within[a, b] = train_svm(x[use], np.where(lang[use] == a, 1, -1).astype(np.float32), settings)
    return m


def _vote(x: np.ndarray, names: list, machines: dict) -> tuple[np.ndarray, np.ndarray]:
    """(index into names, probability) by the summed probabilities of all machines between two of them; the first of equals."""
    if len(names) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    share = np.zeros((len(x), len(names)))
    for i, j in combinations(range(len(names)), 2):
        w = machines[names[i], names[j]]
        p = 1 / (1 + np.exp(-np.clip(4 * (x @ w[:-1] + w[-1]), -30, 30)))
        share[:, i] += p
        share[:, j] += 1 - p
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    return best, share[np.arange(len(x)), best] * len(names) / 2


def predict(docs: DataFrame, m: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1).

    The family is predicted first, then the language within it; the score is the product of both
    votes' probabilities. Ties go to the first family or language, in alphabetical order. Texts are taken whole. `und` and 0 for null, a text without a letter, or a model without languages.
    Columns of these names are replaced; rows don't depend on each other.
    """
    src = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(m)
    lettered = f"__{text_col}_has_letter"
    keep = src.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 2048):
                b = whole.slice(at, 2048)
                n = b.num_rows
                names, score = np.full(n, "und", object), np.zeros(n)
                if model.families and n:
                    x = profiles(b.column(text_col))
                    family, p = _vote(x, list(range(len(model.families))), model.between)
                    for k, members in enumerate(model.families):
                        own = np.flatnonzero(family == k)
                        lang, q = _vote(x[own], members, model.within)
                        names[own] = np.array(members, object)[lang]
                        score[own] = np.clip(p[own] * q, 0, 1)
                has = b.column(lettered).to_numpy(zero_copy_only=False).astype(bool)
                names[~has], score[~has] = "und", 0.0
                columns = [b.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    flagged = src.withColumn(lettered, F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))
    return flagged.mapInArrow(run, T.StructType(list(src.schema.fields)).add("lang_pred", "string").add("score", "double"))
