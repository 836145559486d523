"""Toxicity: maximum-scoring segments over token log-odds, aggregated by extreme-value calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm import textkernels as tk

#: Token hashes fall into this many buckets, whatever the vocabulary: the model is a vector of fixed size.
BUCKETS = 1 << 21
#: Beside the whole word, a token has its beginnings of so many bytes as features, so that forms of a
#: word that were never seen get the log-odds of their stem.
STEMS = (4, 5, 6, 7, 8)
#: A table of labels of up to so many bytes is broadcast; a larger one meets its documents in a shuffle.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Settings:
    """Parameters of the model and of the search."""

    prior: float = 2.0  # weight of the Dirichlet prior of a token bucket, in tokens
    caution: float = 2.0  # standard deviations taken off a token's log-odds
    drift: float = 0.5  # taken off each token, so that chance passages lose score
    significance: float = 1e-3  # of a passage, by the extreme-value law


@dataclass
class Model:
    """What scoring needs; its size doesn't depend on the corpus."""

    weights: np.ndarray  # float32 score of each token bucket
    lam: float = 1.0  # scale of the extreme-value law
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    settings: Settings = field(default_factory=Settings)


def _features(column: pa.Array) -> Iterator[tuple[tk.Piece, tk.Words, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Of each piece: (tokens, buckets) of whole words, then of each stem length the tokens that are longer."""

    def of(p: tk.Piece, w: tk.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hashed = tk.SpanHash(p.data)
        every = np.arange(len(w.begin))
        for k in (0, *STEMS):
            which = every if k == 0 else np.flatnonzero(w.end - w.begin > k)
            begin = w.begin[which]
            h = hashed(begin, begin + k if k else w.end) + np.uint64(k)
            yield which, (tk.mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)

    for p in tk.pieces(column, lower=True):
        w = tk.words(p)
        yield p, w, of(p, w)


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of documents by token bucket and label, summed over a task. Columns text and label come in.

    A document counts once a bucket: a long one repeats its own words, which says nothing of its label.
    """
    totals = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        label = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        for p, w, features in _features(b.column("text")):
            doc = tk.owners(w.first)
            for which, bucket in features:
                once = np.unique(doc[which] * BUCKETS + bucket)
                own = label[p.first + once // BUCKETS]
                for k in (0, 1):
                    totals[k] += np.bincount(once[own == k] % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(totals.any(axis=0))
    yield pa.record_batch({"bucket": pa.array(used, pa.int32()), "clean": pa.array(totals[0, used]), "toxic": pa.array(totals[1, used])})


def _token_scores(column: pa.Array, m: Model) -> Iterator[tuple[tk.Piece, tk.Words, np.ndarray]]:
    """Of each piece the scores of its tokens: the feature that says most, less the drift."""
    for p, w, features in _features(column):
        score = np.zeros(len(w.begin), np.float32)
        for which, bucket in features:
            x = m.weights[bucket]
            score[which] = np.where(np.abs(x) > np.abs(score[which]), x, score[which])
        yield p, w, score - np.float32(m.settings.drift)


def token_weights(clean: np.ndarray, toxic: np.ndarray, s: Settings) -> np.ndarray:
    """Log-odds of each bucket, against those of all tokens, made cautious by their own error.

    Each label's counts have a Dirichlet prior of ``prior`` tokens a bucket, shared out as the labels
    share all tokens, so a bucket seen once says little and one never seen says nothing.
    """
    rate = toxic.sum() / max((clean + toxic).sum(), 1)
    a, b = toxic + s.prior * rate, clean + s.prior * (1 - rate)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(a / b) - np.log(rate / (1 - rate))
        error = np.sqrt(1 / a + 1 / b)
    cautious = np.sign(odds) * np.maximum(np.abs(odds) - s.caution * error, 0)
    return np.where(clean + toxic > 0, np.nan_to_num(cautious), 0).astype(np.float32)


def karlin_lambda(scores: np.ndarray, frequency: np.ndarray) -> float:
    """The positive root of sum(f * exp(l * score)) = 1 over the scores of clean tokens, by bisection."""
    f = frequency / max(frequency.sum(), 1e-300)
    if not ((scores > 0) & (f > 0)).any() or (f * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 0.05
    while (f * np.exp(np.minimum(high * scores, 500))).sum() < 1 and high < 100:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (f * np.exp(np.minimum(mid * scores, 500))).sum() < 1 else (low, mid)
    return max((low + high) / 2, 1e-3)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) of a sequence, in linear time.

    Runs of positive scores are the only places where a segment can begin or end, so they are found
    first and the search goes over them. A candidate joins the nearest earlier one whose left sum is
    smaller, if that raises the score; the stack of candidates is what remains.
    """
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    positive = scores > 0
    if not positive.any():
        return []
    flips = np.flatnonzero(np.diff(np.concatenate([[False], positive, [False]]).astype(np.int8)))
    stack: list[list] = []  # begin, end, left sum, right sum, index of the nearest earlier one with a smaller left sum
    for begin, end in zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True):
        left, right = float(total[begin]), float(total[end])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([begin, end, left, right, j])
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(x[0], x[1], x[3] - x[2]) for x in stack]


def evidence(scores: np.ndarray, m: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """(best level, evidence, significant passages) of one document's token scores.

    The level of a passage of score S among n tokens is lambda S - ln(K n): by the extreme-value law,
    chance gives exp(-level) such passages. The r best passages of a document together have the chance
    exp(-t) t^(r-1) / (r! (r-1)!) of their summed level t; the evidence is the least such chance over r, as a
    negative log, at the price of a halving for each further passage.
    """
    found = maximal_segments(scores)
    if not found:
        return float("nan"), 0.0, []
    level = m.lam * np.array([x[2] for x in found]) - m.log_k - np.log(max(len(scores), 1))
    r = np.arange(1, len(level) + 1)
    log_factorial = np.cumsum(np.log(r))
    t = np.cumsum(np.sort(level)[::-1]) + log_factorial
    some = t > 0
    chance = t[some] - (r[some] - 1) * np.log(t[some]) + log_factorial[some] + (log_factorial - np.log(r))[some] - (r[some] - 1) * np.log(2)
    sure = level >= -np.log(m.settings.significance)
    passages = [(*found[i][:2], float(level[i])) for i in np.flatnonzero(sure)]
    return float(level.max()), float(max(chance.max(initial=0.0), 0.0)), passages


def score_texts(column: pa.Array, m: Model, passages: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Per text: the log of 1 + its evidence, the level of its best passage, and passages as byte spans if asked for."""
    out, best, spans = np.zeros(len(column)), np.full(len(column), np.nan), [[] for _ in range(len(column) if passages else 0)]
    for p, w, scores in _token_scores(column, m):
        hot = np.concatenate([[0], np.cumsum(scores > 0)])
        for d in np.flatnonzero(np.diff(hot[w.first])):
            own = scores[w.first[d] : w.first[d + 1]]
            best[p.first + d], sure, found = evidence(own, m)
            out[p.first + d] = np.log1p(sure)
            if passages:
                at = w.first[d]
                spans[p.first + d] = [(int(w.begin[at + a] - p.starts[d]), int(w.end[at + b - 1] - p.starts[d]), level) for a, b, level in found]
    return out, best, spans


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of documents that have one label; a document with contradictory labels has none."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    # The size of labels is known from its count; beyond the bound both sides are shuffled by doc_id.
    if labels.count() * 16 <= BROADCAST_BYTES:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, "doc_id").select("text", "label")


def _fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on weighted points, by damped Newton steps."""
    if not (n * y).sum() or not (n * (1 - y)).sum():
        rate = (n * y).sum() / max(n.sum(), 1)
        return 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    a, b = 0.0, 0.0
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = n * q * (1 - q)
        g = np.array([(n * (q - y) * x).sum() + 1e-2 * a, (n * (q - y)).sum()])
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """A model of every labelled row. Counts and calibration go over all of them; what comes to the
    driver has at most ``BUCKETS`` rows, or histograms of 8192 bins a label, whatever the corpus."""
    train = _labelled(docs, labels)
    counts = train.mapInArrow(count_tokens, "bucket int, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = counts.toArrow()
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got.column("bucket").to_numpy()
    clean[at], toxic[at] = got.column("clean").to_numpy(), got.column("toxic").to_numpy()
    m = Model(token_weights(clean, toxic, settings), settings=settings)
    if not toxic.sum() or not clean.sum():
        m.slope, m.offset = 0.0, -4.0 if not toxic.sum() else 4.0
        return m
    background = train.where("label = 0")
    tokens = _histogram(background, m, lambda column, model: np.concatenate([np.zeros(0), *(x for _, _, x in _token_scores(column, model))]), -64.0, 64, per_row=False)
    m.lam = karlin_lambda(tokens.value.to_numpy(float), tokens.n.to_numpy(float))
    levels = _histogram(background, m, lambda column, model: score_texts(column, model)[1], -256.0, 16)
    if len(levels):
        # A Gumbel law of scale 1 has its mean at ln K plus Euler's constant.
        m.log_k = float((levels.value * levels.n).sum() / levels.n.sum() - 0.5772156649)
    seen = _histogram(train, m, lambda column, model: score_texts(column, model)[0], 0.0, 256)
    m.slope, m.offset = _fit_logistic(seen.value.to_numpy(float), seen.label.to_numpy(float), seen.n.to_numpy(float))
    return m


def _histogram(train: DataFrame, m: Model, values: Callable[[pa.Array, Model], np.ndarray], low: float, per_unit: int, per_row: bool = True) -> pd.DataFrame:
    """(label, value, n): counts over all rows of ``train`` of ``values`` of their texts, in 8192 bins of
    width 1 / per_unit from ``low``; NaN doesn't count. Values that aren't one a row count under label 0."""
    shared = train.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 8192), np.int64)
        for b in batches:
            value = values(b.column("text"), shared.value)
            label = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64) if per_row else np.zeros(len(value), np.int64)
            ok = ~np.isnan(value)
            at = np.clip(((value[ok] - low) * per_unit).round(), 0, 8191).astype(np.int64)
            counts += np.bincount(label[ok] * 8192 + at, minlength=2 * 8192).reshape(2, 8192)
        used = np.argwhere(counts)
        yield pa.record_batch({"label": pa.array(used[:, 0], pa.int32()), "bin": pa.array(used[:, 1], pa.int32()), "n": pa.array(counts[counts > 0])})

    out = train.mapInArrow(run, "label int, bin int, n bigint").groupBy("label", "bin").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    shared.unpersist()
    return out.assign(value=out.bin / per_unit + low).sort_values(["label", "bin"])


def score(docs: DataFrame, m: Model, text_col: str = "text", passages: bool = False) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1), predicted (1 if score >= 0.5) and, if asked for,
    passages: byte spans of the significant passages and their extreme-value level.

    Null and empty texts have no passage and get the score of such texts. Columns of these names are
    replaced; rows don't depend on each other, so repeated rows get equal scores.
    """
    src = docs.drop("score", "predicted", "passages")
    keep = src.columns
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model = shared.value
            x, _, spans = score_texts(b.column(text_col), model, passages)
            s = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            more = {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}
            if passages:
                more["passages"] = pa.array([[{"begin": p, "end": q, "level": v} for p, q, v in x] for x in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("level", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*b.columns, *more.values()], [*keep, *more])

    out = T.StructType(list(src.schema.fields)).add("score", "double").add("predicted", "integer")
    if passages:
        out = out.add("passages", T.ArrayType(T.StructType().add("begin", "long").add("end", "long").add("level", "double")))
    return src.mapInArrow(run, out)
