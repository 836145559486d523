"""Mixing sources to target weights: temperature, a bisected exponent, budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """What the mixture has to meet.

    entropy: of the weights, as a part of the log of the number of sources. repeats: the most times
    that a source may be gone over. budget: tokens of the mixture; all tokens there are by default.
    """

    entropy: float | None = 0.95
    repeats: float | None = 3.0
    budget: int | None = None
    seed: int = 17
    blocks: int = 4096  # of a source, a power of two


def token_counts(docs: DataFrame, text_col: str = "text") -> Column:
    """Tokens of a whole text: runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def _evaluate(shares: DataFrame, exponents: list[float], ratio: float) -> dict[float, tuple[float, float]]:
    """Per exponent: the entropy of the weights, and the most often that a source is gone over."""
    a = F.explode(F.array(*[F.lit(x) for x in exponents])).alias("a")
    sums = shares.select("log_share", a).groupBy("a").agg(
        F.sum(F.exp(F.col("a") * F.col("log_share"))).alias("z"),
        F.sum(F.exp(F.col("a") * F.col("log_share")) * F.col("a") * F.col("log_share")).alias("zl"),
        F.max((F.col("a") - 1) * F.col("log_share")).alias("most"),
    )
    return {r.a: (math.log(r.z) - r.zl / r.z, ratio * math.exp(r.most) / r.z) for r in sums.collect()}


def bisect_exponent(shares: DataFrame, target: Target, ratio: float, passes: int = 6, inner: int = 31) -> float:
    """The exponent in 0 to 1 of the sources' token shares that meets the target.

    Entropy falls and repetition falls as the exponent rises. It is the largest exponent that reaches
    the entropy, or 1; if that goes over a source too often, the smallest one that doesn't. Each pass
    over the sources tells ``inner`` exponents at once, which are five halvings of the interval.
    ``shares`` has a row a source with log_share; nothing else comes to the driver than a row an exponent.
    """
    n = shares.count()

    def search(enough: float, value: int, below: bool) -> float:
        """The edge of the exponents of which the value is at most (at least) ``enough``."""
        low, high = 0.0, 1.0
        for _ in range(passes):
            points = [low + (high - low) * k / (inner + 1) for k in range(inner + 2)]
            seen = _evaluate(shares, points, ratio)
            good = [seen[x][value] <= enough if below else seen[x][value] >= enough for x in points]
            if below:  # true from some point on
                k = good.index(True) if any(good) else len(points) - 1
                low, high = points[max(k - 1, 0)], points[k]
            else:  # true up to some point
                k = max((i for i, g in enumerate(good) if g), default=0)
                low, high = points[k], points[min(k + 1, len(points) - 1)]
            if low == high:
                break
        return high if below else low

    exponent = 1.0
    if target.entropy is not None and n > 1:
        exponent = search(target.entropy * math.log(n) - 1e-12, 0, below=False)
    if target.repeats is not None and n:
        exponent = max(exponent, search(max(target.repeats, ratio) + 1e-12, 1, below=True))
    return exponent


def source_weights(docs: DataFrame, target: Target) -> DataFrame:
    """(source, tokens, weight, budget) of each source with a token. ``docs`` has source and n_tokens."""
    sources = checkpointed(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.withColumn("log_share", F.log(F.col("tokens") / F.lit(float(max(total, 1)))))
    budget = target.budget if target.budget is not None else total
    exponent = bisect_exponent(shares, target, budget / max(total, 1)) if total else 1.0
    raw = F.exp(F.lit(exponent) * F.col("log_share"))
    z = shares.agg(F.sum(raw)).first()[0] or 1.0
    return shares.select("source", "tokens", (raw / F.lit(z)).alias("weight"), F.floor(raw / F.lit(z) * F.lit(float(budget)) + 1e-6).cast("long").alias("budget"))


def mixture(docs: DataFrame, target: Target = Target(), text_col: str = "text") -> DataFrame:  # noqa: B008
    """All columns of ``docs``, a row for each time that a document is used, with n_tokens, weight,
    epoch, block and block_key.

    A source's weight is its share of all tokens to the power of one exponent for all (see
    ``bisect_exponent``), over the sum of these. Its budget of tokens is gone through in epochs: all of
    its documents in each whole epoch, and of the last one the documents that fit, in order, before
    the first that doesn't. The order of an epoch is a permutation of the source's blocks, given by
    block_key, and of documents within a block by a hash of doc_id. So each source keeps to its budget,
    and misses it by less than a document.

    Documents without a source are a source of their own. Sources without a token have no rows. Rows that
    repeat a doc_id are counted each; those in the last epoch are taken or left together, if together
    they fit. Columns of these names are replaced.
    """
    names = ("n_tokens", "weight", "epoch", "block", "block_key")
    src = docs.drop(*names)
    order = F.xxhash64(F.lit(target.seed), F.col("row.doc_id"))
    bits = target.blocks.bit_length() - 1
    rows = src.select(F.struct(*[F.col(f"`{c}`") for c in src.columns]).alias("row"), token_counts(src, text_col).alias("n_tokens"))
    rows = rows.withColumns({"source": F.col("row.source"), "h": order}).withColumn("block", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    plan = checkpointed(rows.select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", "h", "block"))
    weights = source_weights(plan, target).select(
        "source",
        "weight",
        F.expr("budget div tokens").cast("int").alias("whole"),
        F.expr("budget % tokens").alias("rest"),
    )
    key = lambda source, epoch, block: F.xxhash64(F.lit(target.seed), source, epoch, block)
    blocks = plan.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).alias("b").join(weights.alias("w"), F.expr("b.source <=> w.source")).select("b.*", "weight", "whole", "rest")
    run = Window.partitionBy("source").orderBy("last_key", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("last_key", key(F.col("source"), F.col("whole") + 1, F.col("block"))).withColumn("upto", F.sum("n").over(run))
    blocks = blocks.withColumn("left", F.col("rest") - F.col("upto") + F.col("n"))  # of the budget, when the block begins
    blocks = checkpointed(blocks.select("source", "block", "weight", "whole", "n", "left"))
    # Of each source one block at most fits in part: its documents are gone through one by one.
    edge = blocks.where("left > 0 AND left < n").select(F.col("source").alias("edge_source"), F.col("block").alias("edge_block"), "left")
    inside = plan.join(F.broadcast(edge) if edge.count() <= 100_000 else edge, F.expr("source <=> edge_source AND block = edge_block"))
    by_doc = inside.groupBy("source", "h", "doc_id", "left").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = by_doc.withColumn("upto", upto).where(F.col("upto") <= F.col("left")).groupBy("source").agg(F.max(F.struct("h", "doc_id")).alias("cut")).select(F.col("source").alias("cut_source"), "cut")
    known = blocks.join(cut, F.expr("source <=> cut_source"), "left").select(
        F.col("source").alias("of_source"), F.col("block").alias("of_block"), "weight", "whole", (F.col("n") <= F.col("left")).alias("fits"), (F.col("left") > 0).alias("edge"), "cut"
    )
    last = F.col("fits") | (F.col("edge") & F.coalesce(F.struct(F.col("h"), F.col("row.doc_id").alias("doc_id")) <= F.col("cut"), F.lit(False)))
    used = rows.join(known, F.expr("source <=> of_source AND block = of_block")).withColumn("times", F.col("whole") + last.cast("int"))
    used = used.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return used.select(*[F.col("row").getField(c).alias(c) for c in src.columns], "n_tokens", "weight", "epoch", "block", key(F.col("source"), F.col("epoch"), F.col("block")).alias("block_key"))
