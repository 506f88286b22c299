"""Raw binary layouts as a Spark data source, read in parallel by byte ranges.

Files carry no schema; the ``layout`` option names it.  Numbers are little-endian, ``int`` has 4 bytes, ``long`` and
``double`` 8.  Layouts of fixed-size items (``array``, the parts of meshes and ray tests, the targets of graphs) are cut
into ranges of items that are read independently; those whose items have their own lengths are cut after one pass over
the table of lengths.

    register(spark)
    spark.read.format("weftline_binary").option("layout", "array").option("item", "double").load(path)
"""

from __future__ import annotations

import struct
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE = 1 << 20  # items of a range

#: Item kinds: NumPy fields and the column types they become.
ITEMS = {
    "int": [("val", "<i4", "bigint")],
    "long": [("val", "<i8", "bigint")],
    "double": [("val", "<f8", "double")],
    "int_pair": [("k", "<i4", "bigint"), ("v", "<i4", "bigint")],
    "point2": [("x", "<f8", "double"), ("y", "<f8", "double")],
    "point3": [("x", "<f8", "double"), ("y", "<f8", "double"), ("z", "<f8", "double")],
    "triangle": [(n, "<i4", "bigint") for n in "abc"],
    "ray": [(n, "<f8", "double") for n in ("ox", "oy", "oz", "dx", "dy", "dz")],
}
GRAPH_MAGIC = 0xDEADBEEF  # fixed value of the format


def _open(path: str):
    system, where = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return system.open_input_file(where)


def _ints(f, at: int, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(f.read_at(n * np.dtype(kind).itemsize, at), kind)


class Range(InputPartition):
    def __init__(self, first: int, count: int, at: int = 0, extra=None):
        self.first, self.count, self.at, self.extra = first, count, at, extra


def _ranges(n: int, size: int, at: int) -> list[Range]:
    return [Range(i, min(RANGE, n - i), at + i * size) for i in range(0, n, RANGE)]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layout = options["path"], options.get("layout", "array")
        self.item, self.part = options.get("item", "long"), options.get("part", "")
        self.size = int(options.get("size", "1"))

    def _fixed(self) -> tuple[str, int, int]:
        """Item kind, number of items and where they start."""
        with _open(self.path) as f:
            if self.layout == "array":
                return self.item, int(_ints(f, 0, "<i8", 1)[0]), 8
            if self.layout == "raw":
                return self.item, self.size, 0
            kinds = {"mesh2": ["point2", "triangle"], "mesh3": ["point3", "triangle"], "rays": ["point3", "triangle", "ray"]}[self.layout]
            names, at = ["points", "tris", "rays"], 0
            for name, kind in zip(names, kinds, strict=False):
                n = int(_ints(f, at, "<i8", 1)[0])
                if name == (self.part or "points"):
                    return kind, n, at + 8
                at += 8 + n * np.dtype([x[:2] for x in ITEMS[kind]]).itemsize
        raise ValueError(f"{self.layout} has no part {self.part}")

    def partitions(self):
        if self.layout in ("string", "strings", "string_ints", "graph", "adjlist"):
            return self._varying()
        kind, n, at = self._fixed()
        return _ranges(n, np.dtype([x[:2] for x in ITEMS[kind]]).itemsize, at)

    def _varying(self):
        with _open(self.path) as f:
            if self.layout == "string":
                return [Range(0, int(_ints(f, 0, "<i4", 1)[0]), 4)]
            if self.layout == "graph":
                n, m = (int(x) for x in _ints(f, 0, "<i4", 2))
                ends = np.cumsum(_ints(f, 8, "<i4", n).astype(np.int64))
                return [Range(r.first, r.count, r.at, self._owners(ends, r)) for r in _ranges(m, 4, 8 + 4 * n)]
            if self.layout == "adjlist":
                magic, bits, n, m, _ = (int(x) for x in _ints(f, 0, "<u8", 5))
                if magic != GRAPH_MAGIC or bits not in (32, 64):
                    raise ValueError("not an adjacency file")
                size = bits // 8
                ends = _ints(f, 40, f"<u{size}", n + 1).astype(np.int64)[1:]
                return [Range(r.first, r.count, r.at, self._owners(ends, r) + (size,)) for r in _ranges(m, size, 40 + size * (n + 1))]
            n = int(_ints(f, 0, "<i8", 1)[0])
            lengths, out, at = _ints(f, 8, "<i4", n).astype(np.int64), [], 8 + 4 * n
            more = 4 if self.layout == "string_ints" else 0
            for i in range(0, n, RANGE):
                some = lengths[i : i + RANGE]
                out.append(Range(i, len(some), at, some.tolist()))
                at += int(some.sum()) + more * len(some)
            return out

    @staticmethod
    def _owners(ends: np.ndarray, r: Range) -> tuple:
        """First vertex with edges in a range, and where its and the next vertices' edges end."""
        v = bisect_right(ends, r.first)
        last = bisect_right(ends, r.first + r.count - 1)
        return v, ends[v : last + 1].tolist()

    def read(self, r: Range | None):
        if r is None:  # no items
            return
        with _open(self.path) as f:
            if self.layout == "string":
                yield (f.read_at(r.count, r.at),)
            elif self.layout in ("strings", "string_ints"):
                at = r.at
                for i, n in enumerate(r.extra):
                    s = f.read_at(n, at)
                    at += n
                    if self.layout == "strings":
                        yield (r.first + i, s.decode("utf-8", "replace"))
                    else:
                        yield (r.first + i, s.decode("utf-8", "replace"), struct.unpack("<i", f.read_at(4, at))[0])
                        at += 4
            elif self.layout in ("graph", "adjlist"):
                v, ends = r.extra[:2]
                dst = _ints(f, r.at, "<i4" if self.layout == "graph" else f"<u{r.extra[2]}", r.count).astype(np.int64)
                src = v + np.searchsorted(np.array(ends), np.arange(r.first, r.first + r.count), "right")
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
            else:
                kind = self._fixed()[0]
                fields = ITEMS[kind]
                items = _ints(f, r.at, np.dtype([x[:2] for x in fields]), r.count)
                cols = [pa.array(np.ascontiguousarray(items[n]).astype(np.int64 if t == "bigint" else np.float64)) for n, _, t in fields]
                first = pa.array(np.arange(r.first, r.first + r.count))
                yield pa.RecordBatch.from_arrays([first, *cols], names=["idx", *[x[0] for x in fields]])


class BinarySource(DataSource):
    @classmethod
    def name(cls):
        return "weftline_binary"

    def schema(self):
        layout = self.options.get("layout", "array")
        if layout == "string":
            return "text binary"
        if layout == "strings":
            return "idx bigint, s string"
        if layout == "string_ints":
            return "idx bigint, k string, v bigint"
        if layout in ("graph", "adjlist"):
            return "src bigint, dst bigint"
        part = self.options.get("part", "") or "points"
        kind = self.options.get("item", "long") if layout in ("array", "raw") else {"points": "point2" if layout == "mesh2" else "point3", "tris": "triangle", "rays": "ray"}[part]
        return "idx bigint, " + ", ".join(f"{n} {t}" for n, _, t in ITEMS[kind])

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BinarySource)


def read_binary(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    """One part of a binary file; see the module's text for layouts."""
    register(spark)
    reader = spark.read.format("weftline_binary").option("layout", layout)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def read_knapsack(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Items ``(id, value, weight)`` and the capacity of a text ``n capacity (value weight)*``."""
    from pyspark.sql import functions as F

    rows = spark.read.text(path, wholetext=True).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").cast("array<bigint>").alias("a"))
    n, capacity = rows.select(F.col("a")[0], F.col("a")[1]).first()
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("id")
    items = rows.select("a", at) if n else rows.select("a", F.lit(0).alias("id")).limit(0)
    return items.select(F.col("id").cast("bigint").alias("id"), F.get("a", F.col("id") * 2 + 2).alias("value"), F.get("a", F.col("id") * 2 + 3).alias("weight")), int(capacity)


def write_arrays(path: str, *arrays: tuple[str, list]) -> None:
    """Small files of ``long n; item[n]`` one after another, for tests and examples."""
    with open(path, "wb") as f:
        for kind, rows in arrays:
            fields = [x[:2] for x in ITEMS[kind]]
            f.write(struct.pack("<q", len(rows)) + np.array([tuple(r) if isinstance(r, (tuple, list)) else (r,) for r in rows], np.dtype(fields)).tobytes())
