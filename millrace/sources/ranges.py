"""Byte ranges of large files: opened by the store's own library, dealt over tasks by size.

Spark's binary reader loads a file into one row and refuses those above 2 GB.
Here a file is a set of ranges: what has to be walked in order (a chain of
headers) is walked by one task a file that reads the headers alone, and what
they point at is read by as many tasks as its bytes ask for.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one task reads, about, and bytes that are fetched at a time where headers are walked.
TASK_BYTES, AHEAD = 64 << 20, 64 << 10


def uri(path: str) -> str:
    """A path as the store's library takes it: ``file:/x`` as ``file:///x``."""
    return f"file://{path.removeprefix('file:')}" if path.startswith("file:/") and not path.startswith("file://") else path


class Stores:
    """Files of any store, opened for reading; one connection a task and store."""

    def __init__(self):
        self.known: dict[str, fs.FileSystem] = {}

    def open(self, path: str):
        path = uri(path)
        scheme, _, rest = path.partition("://")
        top = f"{scheme}://{rest.split('/')[0]}"
        if top not in self.known:
            self.known[top], inner = fs.FileSystem.from_uri(path)
        elif scheme == "file":
            inner = rest
        else:
            inner = fs.FileSystem.from_uri(path)[1]
        return self.known[top].open_input_file(inner)


class Ahead:
    """A seekable file that fetches some bytes ahead, for walks in small steps."""

    def __init__(self, file, ahead: int = AHEAD):
        self.file, self.size, self.ahead = file, file.size(), ahead
        self.at, self.begin, self.held = 0, 0, b""

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = min(n if n >= 0 else self.size, max(0, self.size - self.at))
        if not self.begin <= self.at <= self.at + n <= self.begin + len(self.held):
            self.begin, self.held = self.at, self.file.read_at(min(max(n, self.ahead), self.size - self.at), self.at) if n else b""
        out = self.held[self.at - self.begin : self.at - self.begin + n]
        self.at += len(out)
        return out

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True


def listed(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``file`` and ``size`` of files of any size; nothing of them is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))


def spread(rows: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Rows dealt by a key to a given number of tasks, so that rows of a few bytes aren't merged into one."""
    return rows.repartition(max(1, tasks or rows.sparkSession.sparkContext.defaultParallelism), *keys)


def dealt(pieces: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Pieces (``file``, ``at``, ``size`` and more) to tasks by where they lie, neighbours together, in the order of the file.

    As many tasks as ``task_bytes`` asks for, and at least as many as can run.
    """
    total = pieces.agg(F.sum("size")).first()[0] or 0
    bin_bytes = max(1, min(task_bytes, total // (4 * pieces.sparkSession.sparkContext.defaultParallelism) + 1))
    bins = pieces.withColumn("_bin", F.floor(F.col("at") / bin_bytes))
    return spread(bins, "file", "_bin", tasks=-(-total // bin_bytes) if total > task_bytes else None).sortWithinPartitions("file", "at").drop("_bin")
