"""Collapse of cumulative conversation logs, and chat rendering.

A chat service that logs the whole conversation after each exchange leaves
every prefix of a conversation beside it. Turns get a rolling prefix hash (two
64-bit words: exclusive-or over the turns so far of hashes that include the
turn's place), so "is a prefix of" becomes an equality: a conversation whose
own hash is the hash of a longer one's prefix is dropped by an anti-join, and
equal conversations leave the smallest id. Texts enter the shuffle once, for
the conversations that stay. DataFrame functions only.

Defined cases: a null role is ``unknown``, a null text is empty; rows without
conv_id are one conversation whose id is null; turns are ordered by turn
(nulls first), role, and the text's SHA-256; rows repeated within a
conversation count once; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.shared import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(conversations: DataFrame) -> DataFrame:
    """Normalised turns: conv_id, turn, role, digest, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return conversations.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, n (turns so far), two prefix hashes, and whether it is whole."""
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("turn").eqNullSafe(F.lag("turn").over(by)) & F.col("role").eqNullSafe(F.lag("role").over(by)) & F.col("digest").eqNullSafe(F.lag("digest").over(by))
    once = rows.select("conv_id", "turn", "role", "digest").withColumn("again", same).where(~F.col("again"))
    placed = once.withColumn("n", F.row_number().over(by))
    return placed.select(
        "conv_id",
        "n",
        F.bit_xor(F.xxhash64("n", "role", "digest")).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64("digest", "role", "n", F.lit(1))).over(so_far).alias("h2"),
        F.lead("n").over(by).isNull().alias("whole"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of conversations that prefix no other."""
    hashed, _ = materialize(prefixes(turns(conversations)), "turns")
    key = ["n", "h1", "h2"]
    whole = hashed.where("whole").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    longer = hashed.where(~F.col("whole")).select(*key).distinct()
    return whole.join(longer, key, "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "copies")


def rendered(conversations: DataFrame) -> DataFrame:
    """Maximal conversations as one text each: conv_id, n_turns, copies, text."""
    kept, _ = materialize(maximal(conversations), "maximal")
    right = kept.withColumnRenamed("conv_id", "kept_id")
    said = turns(conversations).join(right, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    turn = F.struct("turn", "role", "digest", "text")
    whole = said.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("copies").alias("copies"), F.sort_array(F.collect_set(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(f"{CLOSE}\n"))), "")
    return whole.select("conv_id", "n_turns", "copies", text.alias("text"))
