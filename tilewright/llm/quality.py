"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to a in that is for it with as was on be by this are from or have an not they at but his he we which you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le".split(),
}


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: ``metric`` has to lie within ``low`` and ``high``, where given."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table that the registered query uses.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.05),
    Rule("dup_line_ratio", high=0.50),
    Rule("stop_word_ratio", low=0.08),
    Rule("repeat_word_ratio", high=0.50),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _metrics(body: Column, words: Column) -> dict[str, Column]:
    """Counts of one text. ``words`` is the array of its words."""
    lines = F.split(body, "\n", -1)
    with_word = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": _let(with_word, lambda x: F.size(x)).cast("long"),
        "n_dup_lines": _let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.btrim(F.lower(w), F.lit(".,;:!?\"'()")).isin(stops))).cast("long"),
    }


#: Words in a 3-word window that the text has twice or more, from ``windows``: sorted longs of which
#: the low ``bits`` bits are a window's position and the others its hash. Windows of equal hash are repeats
#: only if their words are equal too.
REPEAT_WORDS = """
size(array_distinct(flatten(transform(
  filter(windows, (x, k) -> {before} OR {after}),
  x -> array(x & (shiftleft(1L, bits) - 1L), (x & (shiftleft(1L, bits) - 1L)) + 1L, (x & (shiftleft(1L, bits) - 1L)) + 2L)))))
"""


def _same(other: str) -> str:
    """SQL for whether window ``x`` has the hash and the words of its neighbour."""
    at = lambda v, d: f"get(words, int({v} & (shiftleft(1L, bits) - 1L)) + {d})"
    words = " AND ".join(f"{at('x', d)} = {at(other, d)}" for d in range(3))
    return f"coalesce(shiftright(x ^ {other}, bits) = 0 AND {words}, false)"


REPEAT_WORDS = REPEAT_WORDS.format(before=_same("get(windows, k - 1)"), after=_same("get(windows, k + 1)"))


def quality_metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` in a struct ``row``, with the counts that rules are made of.

    Words are runs of characters other than space and tab to carriage return; null has none. Windows
    of three words are sorted by a 64-bit hash of which the position takes the low bits that a text
    of this many words needs. That brings equal windows side by side, so a text is counted in n log n steps
    whatever it repeats. Neighbours of equal hash are compared word by word, so a text of any length has no
    false repeats; one is missed only where an unlike window of the same hash lies between two equal ones
    and none beside them (at ten million words 40 bits are left: some 50 pairs of unlike windows share a
    hash, and a repeat has a chance of 1 in 100,000 to lie around one).
    """
    body = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    bare = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+", -1))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # A generator keeps the array of words from being computed again in each expression.
    base = base.select("row", F.explode(F.array(words)).alias("words"))
    base = base.select("row", "words", F.greatest(F.length(F.bin(F.size("words"))), F.lit(1)).cast("int").alias("bits"))
    window = F.expr(
        "CASE WHEN size(words) >= 3 THEN transform(sequence(0, size(words) - 3), i -> "
        "(shiftleft(shiftright(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), bits), bits) | CAST(i AS BIGINT))) "
        "ELSE CAST(array() AS ARRAY<BIGINT>) END"
    )
    base = base.select("row", "words", "bits", F.explode(F.array(F.sort_array(window))).alias("windows"))
    counts = _metrics(body, F.col("words"))
    return base.select("row", *[c.alias(n) for n, c in counts.items()], F.expr(REPEAT_WORDS).cast("long").alias("n_repeat_words"))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression that is true where every rule holds."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    metrics = {
        "n_words": F.col("n_words"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (metrics[r.metric] >= r.low)
        if r.high is not None:
            verdict = verdict & (metrics[r.metric] <= r.high)
    return verdict


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the counts, ``base_failed`` and ``kept``, in one projection.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed, and every rule holds. Null and empty texts have no words and fail. Columns of
    ``docs`` with the names of results are replaced; repeated rows each give a row.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keep = [c for c in docs.columns if c not in {*results, "base_failed", "kept"}]
    return quality_metrics(docs, text_col).select(
        *[F.col("row").getField(c).alias(c) for c in keep], *results, failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept")
    )
