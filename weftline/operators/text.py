"""Suffix arrays over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.blocked import scan_blocks, sorted_positions
from weftline.plans.fixpoint import is_small, one_table
from weftline.plans.shared import Stash


SMALL_BYTES = 4_000_000  # some 50 bytes of memory each in one task


def byte_sequence(texts: DataFrame, text: str, start: Column | None = None) -> DataFrame:
    """``(idx, b)`` of the bytes of the texts; ``idx`` counts from ``start`` (0 for a single text)."""
    data, first = F.col(text).cast("binary"), F.lit(0) if start is None else start
    every = F.transform(F.sequence(F.lit(0), F.octet_length(F.col(text)) - 1), lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int"))
    some = F.when(F.octet_length(F.col(text)) > 0, every).otherwise(F.array().cast("array<int>"))
    return texts.select(first.cast("bigint").alias("first"), F.posexplode(some).alias("i", "b")).select((F.col("first") + F.col("i")).alias("idx"), "b")


def suffix_array(seq: DataFrame, small: bool | None = None) -> DataFrame:
    """``(pos, idx)``: starts of the suffixes of a byte sequence ``(idx, b)`` in the order of unsigned bytes.

    Prefix doubling: suffixes are ranked by their first k symbols, then by pairs of ranks k apart.
    """
    if is_small(seq, SMALL_BYTES) if small is None else small:

        def kernel(s):
            order = np.argsort(s.column(0).to_numpy(), kind="stable")
            rank = s.column(1).to_numpy().astype(np.int64)[order] + 1
            n, k = len(rank), 1
            at = np.argsort(rank, kind="stable")
            while n:
                second = np.zeros(n, np.int64)
                second[:-k] = rank[k:] if k < n else 0
                at = np.lexsort((second, rank))
                step = np.concatenate([[0], (rank[at[1:]] != rank[at[:-1]]) | (second[at[1:]] != second[at[:-1]])])
                rank[at] = np.cumsum(step) + 1
                if rank[at[-1]] == n or k >= n:
                    break
                k *= 2
            return pa.table({"pos": np.arange(n), "idx": at})

        return one_table(seq.select("idx", "b"), kernel, "pos bigint, idx bigint")
    stash, k, n = Stash(seq.sparkSession), 1, seq.count()
    now = stash.keep(seq.select("idx", (F.col("b").cast("bigint") + 1).alias("r")), "ranks")
    while True:
        ahead = now.select((F.col("idx") - k).alias("idx"), F.col("r").alias("s")).where("idx >= 0")
        pairs = now.join(ahead, "idx", "left").select("idx", "r", F.coalesce("s", F.lit(0).cast("bigint")).alias("s"))
        pairs = stash.keep(pairs, "pairs")
        stash.drop(now)
        groups = sorted_positions(pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n")), [F.col("r"), F.col("s")], "g")
        below = scan_blocks(groups, F.col("n"), idx="g", out="below").select("r", "s", "below")
        now = stash.keep(pairs.join(below, ["r", "s"]).select("idx", (F.col("below") + 1).alias("r")), "ranks")
        stash.drop(pairs)
        k *= 2
        if k > n or now.select("r").distinct().count() == n:
            return now.select((F.col("r") - 1).alias("pos"), "idx")
