"""Synthetic inputs as plans over ``spark.range``: nothing is built on the driver, every row follows from its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _u(seed: int, i: Column | str = "id") -> Column:
    """Reproducible uniform double in [0, 1) for each row number."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), i), 11) / F.lit(float(1 << 53))


def sequence(spark: SparkSession, n: int, kind: str = "identity", m: int = 1024, seed: int = 0) -> DataFrame:
    """``(idx, val)``: ``modular`` i mod m, ``identity`` i, ``ones`` 1, ``flags`` 1 with probability 1/m, ``random`` in 0..m-1."""
    value = {
        "modular": F.col("id") % m,
        "identity": F.col("id"),
        "ones": F.lit(1),
        "flags": (_u(seed) * m < 1).cast("int"),
        "random": F.floor(_u(seed) * m),
    }[kind]
    return spark.range(n).select(F.col("id").alias("idx"), value.cast("bigint").alias("val"))


def sort_input(spark: SparkSession, n: int, kind: str = "random", seed: int = 0, swaps: int = 1024) -> DataFrame:
    """``random``, ``exponential``, ``almost`` (sorted but for some swapped neighbours) or ``equal`` doubles."""
    value = {
        "random": _u(seed),
        "exponential": -F.log(1 - _u(seed)),
        "almost": (F.col("id") + F.when(_u(seed, F.shiftright("id", 1)) * n < 2 * swaps, F.when(F.col("id") % 2 == 0, 1).otherwise(-1)).otherwise(0)),
        "equal": F.lit(1.0),
    }[kind]
    return spark.range(n).select(F.col("id").alias("idx"), value.cast("double").alias("val"))


def points(spark: SparkSession, n: int, kind: str = "in", axes: int = 2, seed: int = 0) -> DataFrame:
    """``(id, x, y[, z])``: uniform ``in`` or ``on`` the unit ball, ``square``, or ``plummer`` (dense in the middle)."""
    names = "xyz"[:axes]
    if kind == "square":
        return spark.range(n).select("id", *[(_u(seed + i) * 2 - 1).alias(a) for i, a in enumerate(names)])
    angle, up = _u(seed) * 2 * F.pi(), _u(seed + 1) * 2 - 1
    flat = F.sqrt(1 - up * up)
    unit = [F.cos(angle), F.sin(angle)] if axes == 2 else [flat * F.cos(angle), flat * F.sin(angle), up]
    radius = {
        "on": F.lit(1.0),
        "in": F.pow(_u(seed + 2), F.lit(1.0 / axes)),
        "plummer": 1 / F.sqrt(F.pow(F.greatest(_u(seed + 2), F.lit(1e-9)), F.lit(-2.0 / 3)) - 1 + 1e-12),
    }[kind]
    return spark.range(n).select("id", *[(c * radius).alias(a) for c, a in zip(unit, names, strict=True)])


def cube_grid(spark: SparkSession, side: int) -> DataFrame:
    """Undirected edges ``(id, u, v)`` of a cubic grid with wrap-around, three from each vertex."""
    n = side**3
    step = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("axis")
    rows = spark.range(n).select(F.col("id").alias("a"), step)
    size = F.when(F.col("axis") == 0, 1).when(F.col("axis") == 1, side).otherwise(side * side)
    at = F.floor(F.col("a") / size) % side
    b = F.col("a") + F.when(at == side - 1, -(side - 1)).otherwise(1) * size
    rows = rows.withColumn("b", b.cast("bigint")).where("a <> b")
    return rows.select((F.col("a") * 3 + F.col("axis")).alias("id"), F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def rmat(spark: SparkSession, scale: int, edges: int, seed: int = 0, a: float = 0.5, b: float = 0.1, c: float = 0.1) -> DataFrame:
    """Undirected R-MAT edges over ``2^scale`` vertices, loops left out."""
    u = v = F.lit(0).cast("bigint")
    for k in range(scale):
        r = _u(seed + k)
        u = u * 2 + (r >= a + b).cast("bigint")
        v = v * 2 + (((r >= a) & (r < a + b)) | (r >= a + b + c)).cast("bigint")
    rows = spark.range(edges).select("id", u.alias("p"), v.alias("q")).where("p <> q")
    return rows.select("id", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
