"""Chat formatting: collapse cumulative snapshots of logged conversations, render the maximal ones.

DataFrame functions only: no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import checkpointed


@dataclass(frozen=True)
class Template:
    """How a turn is written; role and text are put in between, as they are."""

    start: str = "<|"
    after_role: str = "|>\n"
    end: str = "\n"


def rolling_hashes(turns: DataFrame, bucket: int = 256) -> DataFrame:
    """(conv, n, p1, p2): p1 and p2 identify the first n turns of a conversation.

    Turns are ordered by turn (null first), role and text, and numbered from 1. A turn's hash takes
    in its number, so the running XOR of these hashes names the sequence. Numbers and XORs run within
    buckets of ``bucket`` turn values and then over the buckets, so a conversation that holds a large
    part of all rows is spread over many tasks.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    inner = Window.partitionBy("conv", "bucket").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    at = turns.withColumn("bucket", F.floor(F.col("turn") / bucket).cast("long"))
    offsets = at.groupBy("conv", "bucket").agg(F.count(F.lit(1)).alias("rows")).select("conv", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    numbered = at.alias("a").join(offsets.alias("b"), F.expr("a.conv <=> b.conv AND a.bucket <=> b.bucket")).select("a.*", "first")
    numbered = numbered.withColumn("n", F.row_number().over(inner) + F.col("first"))
    # A null leaves a hash as it is, so whether there is a value goes in beside it.
    own = lambda seed: F.xxhash64(F.lit(seed), "n", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    hashed = numbered.select("conv", "bucket", "turn", "role", "text", "n", own(1).alias("h1"), own(2).alias("h2")).withColumns({"x1": F.bit_xor("h1").over(upto), "x2": F.bit_xor("h2").over(upto)})
    whole = hashed.groupBy("conv", "bucket").agg(F.bit_xor("h1").alias("w1"), F.bit_xor("h2").alias("w2"))
    zero = F.lit(0).cast("long")
    carried = whole.select("conv", "bucket", F.coalesce(F.bit_xor("w1").over(before), zero).alias("c1"), F.coalesce(F.bit_xor("w2").over(before), zero).alias("c2"))
    return (
        hashed.alias("a")
        .join(carried.alias("b"), F.expr("a.conv <=> b.conv AND a.bucket <=> b.bucket"))
        .select("a.conv", "n", F.col("x1").bitwiseXOR(F.col("c1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("c2")).alias("p2"))
    )


def _turn(t: Template, role: Column, text: Column) -> Column:
    return F.concat(F.lit(t.start), F.coalesce(role, F.lit("")), F.lit(t.after_role), F.coalesce(text, F.lit("")), F.lit(t.end))


def collapse_snapshots(conversations: DataFrame, template: Template | None = None, bucket: int = 256) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of each maximal conversation.

    A conversation goes if its turns are the first turns of a longer one. Of conversations with equal
    turns the one with the smallest id stays, and n_copies counts them. Turns compare by number, role
    and text; null roles and texts equal only themselves and are written as ''. Turns without a
    conv_id make up one conversation. An empty table gives no rows; other columns are ignored.

    Hashes of turns are written once and read by all that follows. A conversation is one row of the result,
    so its turns meet in the task that renders it; up to there its rows are dealt by ``bucket`` turns.
    """
    turns = conversations.select(F.col("conv_id").alias("conv"), F.col("turn"), F.col("role"), F.col("text"))
    rolled = checkpointed(rolling_hashes(turns, bucket))
    ends = rolled.groupBy("conv").agg(F.max(F.struct("n", "p1", "p2")).alias("end")).select("conv", "end.*")
    finals = ends.groupBy("n", "p1", "p2").agg(F.min(F.struct(F.col("conv").isNotNull().alias("known"), "conv")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    finals = finals.select(F.col("first.conv").alias("conv"), "n", "p1", "p2", "n_copies")
    longer = rolled.alias("r").join(ends.select("conv", F.col("n").alias("last")).alias("e"), F.expr("r.conv <=> e.conv AND r.n < e.last"))
    prefixes = longer.select("r.n", "r.p1", "r.p2").distinct()
    maximal = finals.join(prefixes, ["n", "p1", "p2"], "left_anti").select(F.col("conv").alias("kept"), F.col("n").alias("n_turns"), "n_copies")
    t = template or Template()
    # Structs sort as turns are numbered: by turn, role and text, null first.
    own = F.struct("turn", "role", "text")
    kept = turns.join(maximal, F.col("conv").eqNullSafe(F.col("kept"))).groupBy("kept", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(own)).alias("turns"))
    lines = F.transform("turns", lambda x: _turn(t, x["role"], x["text"]))
    return kept.select(F.col("kept").alias("conv_id"), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(lines, "").alias("rendered"))
