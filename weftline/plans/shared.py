"""Tables in the folder that all executors share.

An iterative plan has to cut its lineage, and a cut that lives on one executor's disk dies with that executor.  So
every cut here is a Parquet table below ``spark.checkpoint.dir``: written through Spark's commit protocol, readable by
every executor, and no larger than the rows in it.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session.

    Where none is named, a local session gets a fresh folder of its own, kept for the application; a cluster gets an
    error, as a folder of the driver's machine is not the one that its executors would write to.
    """
    found = spark.sparkContext.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not found:
        master = spark.sparkContext.master or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"{KEY} must name a folder that all executors share; master is {master}")
        app = spark.sparkContext.applicationId
        if app not in _own:
            folder = tempfile.mkdtemp(prefix="weftline-shared-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[app] = f"file://{folder}"
        found = _own[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


class Stash:
    """Materialises DataFrames as Parquet below the shared folder and can remove superseded ones."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the written rows."""
        path = fresh_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        self.kept[path] = out
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables made by ``keep`` that no later plan reads."""
        for df in tables:
            if path := getattr(df, "_weftline_path", None):
                self.kept.pop(path, None)
                remove_path(self.spark, path)

    def only(self, df: DataFrame) -> DataFrame:
        """Delete all tables of this stash but ``df``, and return that."""
        path = getattr(df, "_weftline_path", None)
        self.drop(*[t for p, t in list(self.kept.items()) if p != path])
        return df


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
