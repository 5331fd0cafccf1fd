"""Tar archives of any size: an index of members first, then reads of their ranges.

One task an archive walks its chain of headers and touches nothing else; the
members it names are then dealt over tasks by their bytes.  A task holds one
member at a time.
"""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.staging import staged
from millrace.sources import ranges

#: Bytes of a member at most: what one value of a binary column holds.
MOST_BYTES = (1 << 31) - 1
#: Rows of an index batch, and bytes of members that go on together.
_ROWS, _TOGETHER = 4096, 8 << 20


def tar_index(spark: SparkSession, path: str, pattern: str = "*.tar") -> DataFrame:
    """``file``, ``ordinal``, ``member``, ``at`` and ``size`` of the files in archives.

    Long names, POSIX extensions and sizes beyond eight octal digits are known.
    Links, folders and devices are passed over, as are all bytes behind the end
    mark.  A cut-off archive, a broken header and a sparse member are errors.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = ranges.Stores()
        names = ["file", "ordinal", "member", "at", "size"]
        for b in batches:
            for name in b.column("file").to_pylist():
                found: list[list] = [[], [], [], []]
                n = 0
                with stores.open(name) as f, tarfile.open(fileobj=ranges.Ahead(f), mode="r:") as t:
                    for m in t:
                        t.members = []  # the index is the table, not a list in memory
                        if not m.isfile():
                            continue
                        if m.issparse():
                            raise ValueError(f"sparse member {m.name} in {name}")
                        if m.offset_data + m.size > f.size():
                            raise ValueError(f"cut off: {name}")
                        for column, value in zip(found, (n, m.name, m.offset_data, m.size)):
                            column.append(value)
                        n += 1
                        if len(found[0]) == _ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * _ROWS), *map(pa.array, found)], names)
                            found = [[], [], [], []]
                    # the library takes a broken header for the end; an end mark is a block of zeros, or nothing
                    last = f.read_at(min(512, f.size() - t.offset), t.offset) if t.offset < f.size() else b""
                    if last.strip(b"\0") or len(last) % 512:
                        raise ValueError(f"cut off or broken at byte {t.offset}: {name}")
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found[0])), *map(pa.array, found)], names)

    files = ranges.spread(ranges.listed(spark, path, pattern).select("file"), "file")
    return files.mapInArrow(walk, "file string, ordinal bigint, member string, at bigint, size bigint")


def tar_members(spark: SparkSession, path: str, pattern: str = "*.tar", index: DataFrame | None = None, task_bytes: int = ranges.TASK_BYTES) -> DataFrame:
    """``archive``, ``member`` and ``content`` of the files in archives, or of those rows of their index that are given."""
    pieces = staged(tar_index(spark, path, pattern), "tar-index") if index is None else index

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, opened, file = ranges.Stores(), "", None
        for b in batches:
            held: list[tuple] = []
            size = 0
            for name, member, at, n in zip(*(b.column(c).to_pylist() for c in ("file", "member", "at", "size"))):
                if n > MOST_BYTES:
                    raise ValueError(f"{member} in {name} has {n} bytes; a value holds {MOST_BYTES}")
                if name != opened:
                    if file is not None:
                        file.close()
                    file, opened = stores.open(name), name
                if held and size + n > _TOGETHER:
                    yield _batch(held)
                    held, size = [], 0
                content = file.read_at(n, at)
                if len(content) < n:
                    raise ValueError(f"cut off: {name}")
                held.append((name, member, content))
                size += n
            if held:
                yield _batch(held)
        if file is not None:
            file.close()

    return ranges.dealt(pieces, task_bytes).select("file", "member", "at", "size").mapInArrow(fetch, "archive string, member string, content binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, members, contents = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(members, pa.string()), pa.array(contents, pa.binary())], ["archive", "member", "content"])


def write_tar(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (``member``, ``content``) as one archive a task in a folder; returns ``archive`` (its name) and ``member``, staged.

    A task that runs again writes an archive of its own, so only those named in the result count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(ranges.uri(folder))
        store.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.tar"
        sink = archive = None
        for b in batches:
            if sink is None:
                sink = store.open_output_stream(f"{top}/{name}", compression=None)
                archive = tarfile.open(fileobj=sink, mode="w|", format=tarfile.PAX_FORMAT)
            for member, content in zip(b.column("member"), b.column("content")):
                info = tarfile.TarInfo(member.as_py())
                raw = content.as_py() or b""
                info.size = len(raw)
                archive.addfile(info, io.BytesIO(raw))
            yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), b.column("member")], ["archive", "member"])
        if archive is not None:
            archive.close()
            sink.close()

    return staged(rows.select(F.col("member").cast("string").alias("member"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "archive string, member string"), "tar-written")
