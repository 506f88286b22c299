"""Derived inputs over the driver's tables: sequences, a part graph, points, a height field and its rays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.text import byte_sequence
from weftline.plans.blocked import scan_blocks, sorted_positions
from weftline.session import table


def seq_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("val"))


def order_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("val"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on neighbouring lines of every order, numbered by (u, v)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    a, b = lines.alias("a"), lines.alias("b")
    near = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)
    pairs = a.join(b, near).where("a.l_partkey <> b.l_partkey")
    pairs = pairs.select(F.least("a.l_partkey", "b.l_partkey").alias("u"), F.greatest("a.l_partkey", "b.l_partkey").alias("v")).distinct()
    out = sorted_positions(pairs, [F.col("u"), F.col("v")], "id")
    return out.select("id", "u", "v", ((F.col("u") * 7919 + F.col("v") * 104729) % 1000003).alias("w"))


def part_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def points(spark: SparkSession, sf_dir: str, axes: int = 2) -> DataFrame:
    names = "xyz"[:axes]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])


def knap_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    return rows.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("weight"), F.floor("p_retailprice").cast("bigint").alias("value"))


def grid_points(spark: SparkSession) -> DataFrame:
    """A 9 x 9 height field."""
    i, j = F.floor(F.col("id") / 9), F.col("id") % 9
    return spark.range(81).select("id", i.cast("double").alias("x"), j.cast("double").alias("y"), (((i * 3 + j * 5) % 7).cast("double") / 8).alias("z"))


def grid_tris(spark: SparkSession) -> DataFrame:
    """Its 128 triangles, two a cell."""
    k, cell = F.col("id") % 2, F.floor(F.col("id") / 2)
    i, j = F.floor(cell / 8), cell % 8
    a, right, cross, up = i * 9 + j, (i + 1) * 9 + j, (i + 1) * 9 + j + 1, i * 9 + j + 1
    return spark.range(128).select("id", a.alias("a"), F.when(k == 0, right).otherwise(cross).alias("b"), F.when(k == 0, cross).otherwise(up).alias("c"))


def grid_rays(spark: SparkSession) -> DataFrame:
    """A slanted ray from above into each cell."""
    i, j = F.floor(F.col("id") / 8), F.col("id") % 8
    return spark.range(64).select("id", (i + 0.3).alias("ox"), (j + 0.6).alias("oy"), F.lit(10.0).alias("oz"), F.lit(0.01).alias("dx"), F.lit(0.02).alias("dy"), F.lit(-1.0).alias("dz"))


def suffix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(idx, b)`` of the bytes of all texts, joined in doc_id order."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n"))
    placed = sorted_positions(rows, [F.col("doc_id"), F.col("text")])
    return byte_sequence(scan_blocks(placed, F.col("n"), idx="pos", out="start"), "text", F.col("start"))
