"""Files that executors write below the shared folder and read by byte ranges, through Arrow's file systems."""

from __future__ import annotations

import math

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


READ_BYTES = 64 << 20


def split_by_volume(refs: DataFrame, place: list[str], stored: tuple[str, ...], length: str = "length") -> DataFrame:
    """``refs`` dealt into ranges of ``place``, as many as their stored bytes and the session ask for.

    References are far smaller than what they refer to, so left alone a few tasks would read everything.  ``stored`` are
    the columns that name a stored piece, which counts once.
    """
    spark = refs.sparkSession
    pieces = refs.groupBy(*stored).agg(F.max(length).alias("n"))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / READ_BYTES))
    return refs.repartitionByRange(n, *place).sortWithinPartitions(*place)


class ShardWriter:
    """Numbered files of one task attempt.

    The name holds the partition and the attempt, so an attempt never touches what another one wrote; rows refer to the
    files of the attempt that succeeded, and nothing refers to the files of the others.
    """

    def __init__(self, folder: str, suffix: str, most: int):
        self.system, self.folder = open_place(folder)
        self.uri, self.suffix, self.most = folder.rstrip("/"), suffix, most
        task = TaskContext.get()
        self.partition = task.partitionId() if task else 0
        self.stem = f"shard-{self.partition:06d}-{task.taskAttemptId() if task else 0}"
        self.count, self.out, self.size, self.name = 0, None, 0, ""

    def room(self, size: int) -> bool:
        """Open a file that has room for ``size`` more bytes; True if that is a new one."""
        if self.out is not None and self.size + size <= self.most:
            return False
        self.close()
        self.system.create_dir(self.folder, recursive=True)
        name = f"{self.stem}-{self.count:04d}{self.suffix}"
        self.out = self.system.open_output_stream(f"{self.folder}/{name}")
        self.name, self.size, self.count = f"{self.uri}/{name}", 0, self.count + 1
        return True

    def write(self, data: bytes) -> int:
        """Append and return the offset of ``data``."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self, tail: bytes = b"") -> None:
        if self.out is not None:
            self.out.write(tail)
            self.out.close()
            self.out = None


class RangeReader:
    """Reads byte ranges; the file read last stays open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            system, path = open_place(name)
            self.file, self.name = system.open_input_file(path), name
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{name} ends within {offset}+{length}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None
