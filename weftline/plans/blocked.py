"""Global positions and prefix scans without a one-partition window.

A window without partition keys puts all rows into one task.  Here rows are cut into blocks in the required order,
each block is scanned by itself, and only the blocks' totals, one row each, are scanned together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.shared import Stash

BLOCK = 1 << 16

#: Name of an associative and commutative operation -> its aggregate and the column form that combines two values.
OPS = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def scan_blocks(
    df: DataFrame, value: Column, op: str = "sum", zero=0, inclusive: bool = False, back: bool = False, idx: str = "idx",
    keys: tuple[str, ...] = (), out: str = "scan", block: int = BLOCK,
) -> DataFrame:
    """``df`` plus the scan of ``value`` in the order of the unique integer ``idx``, within ``keys`` if any are given.

    Exclusive scans start from ``zero``; with ``back`` the scan runs from the last row to the first.
    """
    agg, join = OPS[op]
    at = F.floor(F.col(idx) / block)
    rows = df.withColumn("__v", value).withColumn("__b", at)
    low, high = (0, Window.unboundedFollowing) if back else (Window.unboundedPreceding, 0)
    if not inclusive:
        low, high = (1, high) if back else (low, -1)
    inner = Window.partitionBy(*keys, "__b").orderBy(idx).rowsBetween(low, high)
    outer = Window.partitionBy(*keys).orderBy("__b")
    outer = outer.rowsBetween(1, Window.unboundedFollowing) if back else outer.rowsBetween(Window.unboundedPreceding, -1)
    totals = df.withColumn("__v", value).withColumn("__b", at).groupBy(*keys, "__b").agg(agg("__v").alias("__t"))
    before = totals.select(*keys, "__b", agg("__t").over(outer).alias("__o"))
    part = rows.withColumn("__s", agg("__v").over(inner)).join(before, [*keys, "__b"])
    both = F.when(F.col("__s").isNull(), F.col("__o")).when(F.col("__o").isNull(), F.col("__s")).otherwise(join(F.col("__s"), F.col("__o")))
    kind = dict(rows.dtypes)["__v"]
    if not inclusive:
        both = join(F.coalesce(both, F.lit(zero)), F.lit(zero)) if op == "sum" else F.coalesce(both, F.lit(zero))
    return part.withColumn(out, both.cast("bigint" if op == "sum" and kind in ("int", "smallint", "tinyint") else kind)).drop("__v", "__b", "__s", "__o")


def sorted_positions(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """``df`` plus each row's position from 0 in the total order ``order`` (which must not tie).

    Rows are range-partitioned and sorted once; the partition numbers are written before they are used, so a lost task
    cannot move rows between partitions.
    """
    stash = Stash(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ranged = stash.keep(ranged.withColumn("__i", F.monotonically_increasing_id()), "ranged")
    within = F.row_number().over(Window.partitionBy("__p").orderBy("__i")) - 1
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__p", before.alias("__o"))
    return ranged.withColumn("__w", within).join(F.broadcast(sizes), "__p").withColumn(out, (F.col("__w") + F.col("__o")).cast("bigint")).drop("__p", "__i", "__w", "__o")
