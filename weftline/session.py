"""Local session for tests and the bench; on a cluster the caller brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A ``local[cpus]`` session with adaptive execution and UTC timestamps."""
    os.environ.setdefault("PYTHONHASHSEED", "0")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weftline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data directory; works for any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
