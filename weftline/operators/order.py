"""Sorting, merging, selection, bucketing, permutation, transposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.blocked import sorted_positions


def sort_sequence(df: DataFrame, *keys: Column, idx: str = "idx", out: str = "pos") -> DataFrame:
    """Stable sort by ``keys``: ties keep their old order; ``out`` is the new position."""
    return sorted_positions(df, [*keys, F.col(idx)], out)


def merge(a: DataFrame, b: DataFrame, key: str = "val", idx: str = "idx") -> DataFrame:
    """Merge of two sorted sequences: ``(pos, val, src)``; of equal values those of ``a`` come first."""
    both = a.select(key, idx, F.lit(0).alias("src")).union(b.select(key, idx, F.lit(1).alias("src")))
    return sorted_positions(both, [F.col(key), F.col("src"), F.col(idx)]).select("pos", key, "src")


def upper_bounds(sorted_values: DataFrame, probes: DataFrame, value: str = "val") -> DataFrame:
    """For each distinct probe the number of values not above it: one sort of both sides, no pairs."""
    from weftline.plans.blocked import scan_blocks

    counts = sorted_values.groupBy(value).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(0))
    asked = probes.select(value).distinct().select(value, F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("k"))
    placed = sorted_positions(counts.unionByName(asked), [F.col(value), F.col("k")], "idx")
    return scan_blocks(placed, F.col("n"), inclusive=True, out="bound").where("k = 1").select(value, "bound")


def select_kth(df: DataFrame, k: int, value: str = "val", idx: str = "idx") -> DataFrame:
    """The row at position ``k`` (from 0) of the sorted order."""
    return sorted_positions(df, [F.col(value), F.col(idx)]).where(F.col("pos") == k)


def around_pivot(df: DataFrame, pivot: Column, value: str = "val") -> DataFrame:
    """``side``: 0 for values below the pivot, 1 for the others."""
    return df.withColumn("side", (F.col(value) >= pivot).cast("int"))


def pivot_buckets(df: DataFrame, pivots: list, value: str = "val") -> DataFrame:
    """``bucket`` 2i for values between pivots i - 1 and i, 2i + 1 for those equal to pivot i; pivots ascend."""
    col = F.lit(2 * len(pivots))
    for i in reversed(range(len(pivots))):
        col = F.when(F.col(value) < pivots[i], 2 * i).when(F.col(value) == pivots[i], 2 * i + 1).otherwise(col)
    return df.withColumn("bucket", col.cast("bigint"))


def transpose(cells: DataFrame, row: str = "i", col: str = "j") -> DataFrame:
    """A matrix as ``(i, j, value)`` with rows and columns exchanged: names change, nothing moves."""
    return cells.withColumnRenamed(row, "__r").withColumnRenamed(col, row).withColumnRenamed("__r", col)


def block_move(df: DataFrame, bucket: Column, n: int) -> DataFrame:
    """Rows of a bucket together in one partition."""
    return df.repartition(n, bucket)


def permuted(df: DataFrame, k: int, n: int, idx: str = "idx", out: str = "idx") -> DataFrame:
    """Positions ``idx * k mod n``, a permutation for k prime to n; exact for any bigint through decimals."""
    return df.withColumn(out, F.pmod(F.col(idx).cast("decimal(20,0)") * F.lit(k).cast("decimal(18,0)"), F.lit(n).cast("decimal(20,0)")).cast("bigint"))


def hash_sample(df: DataFrame, size: int, n: int, seed: int = 0, idx: str = "idx") -> DataFrame:
    """``size`` rows drawn with replacement from positions ``0 .. n - 1``: draw j takes hash(seed, j) mod n."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n))
    return df.sparkSession.range(size).select(F.col("id").alias("draw"), at.alias(idx)).join(df, idx)
