"""Chat formatting: collapse cumulative snapshots of a conversation, then render what is left.  Built-in functions only.

A logged conversation is a set of (turn, role, text); one that holds just the turns of another up to some turn is a
snapshot of it.  Every turn has a 128-bit hash, and the hash of a prefix is the exclusive or of its turns' hashes, so
prefix hashes roll from turn to turn and can be continued from one block of turns to the next: a conversation of any
length is cut into blocks of ``BLOCK`` turns that are hashed side by side, and only the blocks' totals meet.  A
conversation whose full hash occurs among the distinct proper-prefix hashes is dropped by an anti-join; of equal
conversations the smallest id stays.  A first turn that a third of all conversations share is one key there, reduced
before it is shuffled.  Texts take part only in the rendering, which gives one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.shared import Stash

BLOCK = 256


def _turns(chats: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    cols = ((conv_id, "conv_id", None), (turn, "turn", "bigint"), (role, "role", "string"), (text, "text", "string"))
    named = [F.col(f"`{c}`").cast(k).alias(a) if k else F.col(f"`{c}`").alias(a) for c, a, k in cols]
    return chats.select(*named).where("conv_id IS NOT NULL").withColumn("blk", F.floor(F.coalesce("turn", F.lit(-(2**63))) / BLOCK))


def _xor(h: str) -> Column:
    return F.bit_xor(h).alias(h)


def maximal(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that no other one continues; equal ones are named by the smallest id."""
    stash = Stash(chats.sparkSession)
    rows = _turns(chats, conv_id, turn, role, text)
    parts = [F.lit(s) for s in (11, 23)]
    rows = rows.select("conv_id", "blk", "turn", *[F.xxhash64(s, "turn", F.isnull("role"), "role", F.isnull("text"), "text").alias(f"h{i}") for i, s in enumerate(parts)])
    rows = rows.distinct().groupBy("conv_id", "blk", "turn").agg(_xor("h0"), _xor("h1"), F.count(F.lit(1)).alias("n"))
    inner = Window.partitionBy("conv_id", "blk").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    rolled = stash.keep(
        rows.select("conv_id", "blk", "turn", F.sum("n").over(inner).alias("n"), *[F.bit_xor(h).over(inner).alias(h) for h in ("h0", "h1")]), "rolled"
    )
    total = rolled.groupBy("conv_id", "blk").agg(F.max_by(F.struct("n", "h0", "h1"), F.struct("n")).alias("t"))
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offset = total.select(
        "conv_id", "blk", F.coalesce(F.sum("t.n").over(before), zero).alias("n_"),
        *[F.coalesce(F.bit_xor(F.col(f"t.{h}")).over(before), zero).alias(f"{h}_") for h in ("h0", "h1")],
        (F.lead("blk").over(Window.partitionBy("conv_id").orderBy("blk")).isNull()).alias("final"), F.col("t.n").alias("size"),
    )
    prefix = rolled.join(offset, ["conv_id", "blk"]).select(
        "conv_id", (F.col("n") + F.col("n_")).alias("n"), *[F.col(h).bitwiseXOR(F.col(f"{h}_")).alias(h) for h in ("h0", "h1")],
        (F.col("final") & (F.col("n") == F.col("size"))).alias("full"),
    )
    prefix = stash.keep(prefix, "prefix")
    full = prefix.where("full").groupBy("n", "h0", "h1").agg(F.min("conv_id").alias("conv_id"))
    proper = prefix.where("NOT full").select("n", "h0", "h1").distinct()
    return full.join(proper, ["n", "h0", "h1"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(role: Column, text: Column) -> Column:
    """One turn in the ChatML layout."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Maximal conversations rendered in turn order: ``(conv_id, part, n_turns, rendered)``.

    ``part`` counts from 0; a part holds the turns of one block of ``BLOCK`` turn numbers, so no row grows with the
    conversation, and the parts of a conversation one after another are its text.  ``n_turns`` counts the part's turns.
    Repeated rows count once; several rows of one turn are ordered by role and text, nulls first; a null turn comes
    first; null roles and texts render as empty but differ from empty ones; rows without ``conv_id`` belong to no
    conversation and are left out; an empty table gives none.
    """
    rows = _turns(chats, conv_id, turn, role, text)
    rows = rows.join(maximal(chats, conv_id, turn, role, text).select("conv_id"), "conv_id", "left_semi")
    item = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "role", "text")
    parts = rows.groupBy("conv_id", "blk").agg(F.array_sort(F.collect_set(item)).alias("turns"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("blk")) - 1
    text_of = F.array_join(F.transform("turns", lambda t: render(t["role"], t["text"])), "")
    return parts.select("conv_id", number.cast("bigint").alias("part"), F.size("turns").cast("bigint").alias("n_turns"), text_of.alias("rendered"))
