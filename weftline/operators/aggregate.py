"""Reductions: global and keyed folds, arg-best, histograms, bounding boxes and tree roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.blocked import scan_blocks


def reduce(df: DataFrame, op: str, value: Column, out: str = "value") -> DataFrame:
    """Fold by an associative and commutative operation; an empty input gives null, no neutral element is folded in."""
    return df.agg({"sum": F.sum, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or, "xor": F.bit_xor, "product": F.product}[op](value).alias(out))


def reduce_by(df: DataFrame, key: str, op: str, value: Column, out: str = "value") -> DataFrame:
    """Keyed fold, combined before the shuffle."""
    return df.groupBy(key).agg({"sum": F.sum, "min": F.min, "max": F.max}[op](value).alias(out))


def arg_best(df: DataFrame, value: Column, idx: str = "idx", largest: bool = True) -> DataFrame:
    """Position and value of the best row; of equal ones the lowest position."""
    best = F.max(F.struct(value.alias("v"), (-F.col(idx)).alias("i"))) if largest else F.min(F.struct(value.alias("v"), F.col(idx).alias("i")))
    return df.where(value.isNotNull()).agg(best.alias("b")).select((F.col("b.i") * (-1 if largest else 1)).alias(idx), F.col("b.v").alias("value"))


def bounding_box(points: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Smallest and largest coordinate on each axis."""
    return points.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))])


def extreme_points(points: DataFrame) -> DataFrame:
    """Ids of the leftmost (lowest y, then id, on ties) and rightmost (highest y, lowest id) point."""
    low, high = F.min(F.struct("x", "y", "id")), F.max(F.struct("x", "y", (-F.col("id")).alias("i")))
    return points.agg(low.alias("l"), high.alias("r")).select(F.col("l.id").alias("leftmost"), (-F.col("r.i")).alias("rightmost"))


def histogram(df: DataFrame, bucket: Column, buckets: int) -> DataFrame:
    """``(bucket, n, first)`` for every bucket of ``0 .. buckets - 1``: its count and the position where it starts."""
    counts = df.groupBy(bucket.cast("bigint").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(buckets).select(F.col("id").alias("idx")).join(counts, "idx", "left").na.fill(0, ["n"])
    return scan_blocks(every, F.col("n"), out="first").select(F.col("idx").alias("bucket"), "n", "first")


def quadtree_rollup(cells: DataFrame, cell: str, levels: int, bits: int = 2) -> DataFrame:
    """``(level, cell, n)``: points in every non-empty cell of every level, from the Morton cells of the finest one.

    Points are counted once at the finest level; coarser levels add up those counts.
    """
    fine = cells.groupBy(F.col(cell).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    up = fine.select("c", "n", level).select("level", F.expr(f"shiftright(c, ({levels} - level) * {bits})").alias("cell"), "n")
    return up.groupBy("level", "cell").agg(F.sum("n").alias("n"))
