"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.session import checkpointed

WHITE = " \t\n\x0b\f\r"
#: Up to so many frequent lines (two longs each) are broadcast; more are joined by a shuffle.
BROADCAST_LINES = 1 << 20


def line_key(line: Column) -> Column:
    """A line without white space (space, tab to carriage return) at both ends, ASCII letters lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, pos, h1, h2): the lines that have a key; h1 and h2 make up a 128-bit hash of it."""
    key = F.col("key")
    return (
        docs.select("doc", "th", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select("doc", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(key != "")
        .select("doc", "th", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))
    )


def frequent_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs) of the line keys found in ``min_docs`` documents or more.

    ``docs`` has doc, th and body. Each document counts once a key; the counts combine before they
    are shuffled, so a line that every document has costs one row a task.
    """
    once = _lines(docs).select("h1", "h2", "doc").distinct()
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """All columns of ``docs``, with repeated lines taken out of the text, and n_lines and n_dropped.

    A line goes from every document if its key (see ``line_key``) has at least one code point and is
    found in ``min_docs`` distinct documents or more. The other lines stay as they are, joined by
    newlines. A null or empty text is one empty line, which never goes; null becomes ''. Rows that
    repeat an id count as one document and each give a row; all null ids count as one document.
    n_lines and n_dropped replace columns of these names; an empty table gives no rows.

    Only hashes and positions are shuffled by hash. The frequent hashes are written and counted: up to
    ``BROADCAST_LINES`` meet the lines where these are; beyond, both sides are shuffled as they are, and as
    neither is aggregated in that stage, a hash that a large part of all lines has is split over tasks.
    Dropped positions come back to their document as bit masks of 64 lines each, in an array without gaps,
    so that a text with very many dropped lines stays linear. A document's lines are in one task, as they
    are one row.
    """
    src = docs.drop("n_lines", "n_dropped")
    wide = src.select(F.struct(*[F.col(f"`{c}`") for c in src.columns]).alias("row"))
    doc, text = F.col("row").getField(id_col), F.coalesce(F.col("row").getField(text_col), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    keyed = keyed.withColumn("th", F.xxhash64("body"))
    frequent = checkpointed(frequent_lines(keyed, min_docs).select("h1", "h2"))
    if frequent.count() <= broadcast_lines:
        frequent = F.broadcast(frequent)
    gone = (
        _lines(keyed)
        .join(frequent, ["h1", "h2"], "left_semi")
        .groupBy("doc", "th", F.expr("pos div 64").cast("int").alias("block"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("mask"))
        .groupBy("doc", "th")
        .agg(F.sort_array(F.collect_list(F.struct("block", "mask"))).alias("by_block"))
        .select(
            F.col("doc").alias("gone_doc"),
            F.col("th").alias("gone_th"),
            F.expr("flatten(transform(by_block, (b, i) -> concat(array_repeat(0L, b.block - coalesce(get(by_block, i - 1).block, -1) - 1), array(b.mask))))").alias("masks"),
        )
    )
    joined = wide.withColumn("th", F.xxhash64(text)).join(gone, doc.eqNullSafe(F.col("gone_doc")) & (F.col("th") == F.col("gone_th")), "left")
    lines = F.split(text, "\n", -1)

    def stays(_: Column, i: Column) -> Column:
        mask = F.coalesce(F.get(F.col("masks"), F.floor(i / 64).cast("int")), F.lit(0).cast("long"))
        return F.getbit(mask, i % 64) == 0

    kept = F.when(F.col("masks").isNull(), lines).otherwise(F.filter(lines, stays))
    cut = joined.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return cut.select(
        *[F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in src.columns],
        "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )
