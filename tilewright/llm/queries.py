"""The registered queries over these operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import chat_format, decontam, html_extract, langid, line_dedup, mixing, ngram_join, quality, suffix_dedup, toxicity
from tilewright.session import table


def _fold(mod: int) -> Column:
    """The crc32 of doc_id as text, modulo ``mod``: what says which rows are held out."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(mod))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapse_snapshots(table(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op4_chat_format": """
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM conversations
), lists AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY n) AS turns FROM numbered GROUP BY conv_id
), classes AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, turns FROM lists GROUP BY n_turns, turns
), prefixes AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM lists)
)
SELECT c.conv_id, c.n_turns, c.n_copies,
       list_aggregate(list_transform(c.turns, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || chr(10)), 'string_agg', '') AS rendered
FROM classes c WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.turns = c.turns)
""",
    "op8_line_dedup": f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, line, pos, key IN (SELECT key FROM frequent) AS gone FROM keyed
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}


def _quality_sql() -> str:
    stops = ", ".join("'" + w + "'" for w in sorted({w for ws in quality.STOP_WORDS.values() for w in ws}))
    metric = {
        "n_words": "n_words",
        "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0.0)",
        "symbol_ratio": "coalesce(n_symbols / nullif(word_chars, 0), 0.0)",
        "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0.0)",
        "stop_word_ratio": "coalesce(n_stop / nullif(n_words, 0), 0.0)",
        "repeat_word_ratio": "coalesce(n_repeat_words / nullif(n_words, 0), 0.0)",
    }
    tests = [f"{metric[r.metric]} {op} {v}" for r in quality.RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None]
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), tri AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), often AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM tri) WHERE k >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM often, (VALUES (0), (1), (2)) AS t(d) GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(body) - length(translate(body, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
    list_filter(string_split(body, chr(10)), lambda x: length(trim(x, {_BLANK})) > 0) AS lines,
    len(list_filter(words, lambda w: trim(lower(w), '.,;:!?"''()') IN ({stops}))) AS n_stop FROM base
), sums AS (
  SELECT doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_stop,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM counted LEFT JOIN covered c USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {' AND '.join(tests)}) AS kept
FROM sums
"""


ORACLE_SQL["op6_quality_rules"] = _quality_sql()
