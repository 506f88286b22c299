"""Prefix scans and neighbour comparisons over a sequence, see ``weftline.plans.blocked`` for the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.blocked import BLOCK, scan_blocks


def scan(df: DataFrame, value: Column, op: str = "sum", zero=0, **how) -> DataFrame:
    """Exclusive forward scan; ``inclusive`` and ``back`` select the other three forms, ``keys`` partitions it."""
    return scan_blocks(df, value, op, zero, **how)


def scan_total(df: DataFrame, value: Column, op: str = "sum", **how) -> tuple[DataFrame, DataFrame]:
    """The scan and, as one row ``total``, the fold of everything."""
    from weftline.operators.aggregate import reduce

    return scan(df, value, op, **how), reduce(df, op, value, "total")


def changes(df: DataFrame, value: str = "val", idx: str = "idx", out: str = "changed", block: int = BLOCK) -> DataFrame:
    """Whether a value differs from the one before; true at the first position.

    Each block is compared within itself, and its first row with the last value of the block before.
    """
    rows = df.withColumn("__b", F.floor(F.col(idx) / block))
    ends = rows.groupBy("__b").agg(F.max_by(F.struct(value), idx).alias("__e"))
    before = ends.select("__b", F.lag("__e").over(Window.orderBy("__b")).alias("__p"))  # a row for each block
    own = F.lag(F.struct(value)).over(Window.partitionBy("__b").orderBy(idx))
    prev = rows.withColumn("__o", own).join(before, "__b").withColumn("__q", F.coalesce("__o", "__p"))
    same = F.col("__q").isNotNull() & F.col(f"__q.{value}").eqNullSafe(F.col(value))
    return prev.withColumn(out, ~same).drop("__b", "__o", "__p", "__q")


def dense_rank_sorted(df: DataFrame, value: str = "val", idx: str = "idx", out: str = "rank", block: int = BLOCK) -> DataFrame:
    """Dense rank from 0 of a sequence sorted by value: changes, then an inclusive scan of them."""
    marked = changes(df, value, idx, "__c", block)
    return scan_blocks(marked, F.col("__c").cast("bigint"), idx=idx, inclusive=True, out=out, block=block).withColumn(out, F.col(out) - 1).drop("__c")
