"""Ordered sequences: map, filter, compaction, gather, scatter, copies and fills.

A sequence is a DataFrame with a unique bigint ``idx``; order is always by ``idx``, never by partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.blocked import scan_blocks

Pred = Callable[[Column], Column] | Column


def _col(p, over: str) -> Column:
    return p(F.col(over)) if callable(p) and not isinstance(p, Column) else p


def map_values(df: DataFrame, f: Pred, value: str = "val", out: str = "val") -> DataFrame:
    """``out = f(value)`` at every position."""
    return df.withColumn(out, _col(f, value))


def keep_if(df: DataFrame, predicate: Pred, value: str = "val") -> DataFrame:
    """Stable filter; rows whose predicate is null go."""
    return df.where(_col(predicate, value))


def keep_count(df: DataFrame, predicate: Pred, value: str = "val", out: str = "n") -> DataFrame:
    """Number of rows that ``keep_if`` keeps, as one row."""
    return df.agg(F.count_if(F.coalesce(_col(predicate, value), F.lit(False))).alias(out))


def pack(df: DataFrame, flag: Pred, idx: str = "idx", out: str = "pos") -> DataFrame:
    """Rows whose flag is true with their dense position from 0, in order."""
    marked = df.withColumn("__f", F.coalesce(_col(flag, idx), F.lit(False)))
    return scan_blocks(marked, F.col("__f").cast("bigint"), idx=idx, out=out).where("__f").drop("__f")


def pack_index(df: DataFrame, flag: Pred, idx: str = "idx") -> DataFrame:
    """Indices of true flags with their dense position."""
    return pack(df.select(idx, F.coalesce(_col(flag, idx), F.lit(False)).alias("__g")), F.col("__g"), idx).select("pos", idx)


def partition(df: DataFrame, flag: Pred, idx: str = "idx", out: str = "pos") -> DataFrame:
    """Stable two-way split: rows with a true flag first, each half in order; ``out`` is the new position."""
    marked = df.withColumn("__f", F.coalesce(_col(flag, idx), F.lit(False)))
    both = scan_blocks(scan_blocks(marked, F.col("__f").cast("bigint"), idx=idx, out="__t"), (~F.col("__f")).cast("bigint"), idx=idx, out="__u")
    total = marked.agg(F.count_if("__f").alias("__k"))
    both = both.join(F.broadcast(total))  # one row
    return both.withColumn(out, F.when(F.col("__f"), F.col("__t")).otherwise(F.col("__u") + F.col("__k"))).drop("__f", "__t", "__u", "__k")


def split(df: DataFrame, left: Pred, right: Pred, value: str = "val") -> tuple[DataFrame, DataFrame]:
    """Rows of the left and of the right predicate; rows of neither are dropped, rows of both go left."""
    a, b = F.coalesce(_col(left, value), F.lit(False)), F.coalesce(_col(right, value), F.lit(False))
    return df.where(a), df.where(~a & b)


def gather(positions: DataFrame, source: DataFrame, at: str = "at", idx: str = "idx") -> DataFrame:
    """``source`` looked up at ``positions.at``; positions outside the source give nulls."""
    return positions.join(source.withColumnRenamed(idx, at), at, "left")


def scatter(df: DataFrame, target: str, idx: str = "idx", out: str = "rank") -> DataFrame:
    """The inverse permutation: ``idx`` becomes a value and ``target`` the position."""
    return df.select(F.col(target).alias("__i"), F.col(idx).alias(out)).withColumnRenamed("__i", idx)


def fill(df: DataFrame, value, out: str = "val") -> DataFrame:
    """The same value at every position."""
    return df.withColumn(out, F.lit(value))


def concat(*parts: DataFrame, idx: str = "idx") -> DataFrame:
    """Sequences one after another, positions renumbered; each part has positions from 0 without gaps."""
    shifted = []
    base: Column = F.lit(0).cast("bigint")
    for i, p in enumerate(parts):
        shifted.append(p.withColumn("__part", F.lit(i)))
    rows = shifted[0]
    for p in shifted[1:]:
        rows = rows.unionByName(p)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.alias("a").join(sizes.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy("a.__part").agg(F.coalesce(F.sum("b.n"), base).alias("__o"))
    return rows.join(F.broadcast(ahead), "__part").withColumn(idx, F.col(idx) + F.col("__o")).drop("__part", "__o")  # a row for each argument
