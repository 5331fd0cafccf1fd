"""Token counts from flat, unindexed token files.

A token file is a bare run of fixed-width ids in which an end-of-document id
closes each document; nothing says where documents begin.  The scan cuts files
into blocks, looks for the separator in each block with one vectorised
comparison, and stitches documents that cross blocks with a prefix scan over
one small row per block.

Defined results: an empty document counts 0 tokens; ids after the last
separator form a last document of their own; an empty file holds none; a file
whose size is no multiple of the id width raises.  Repeated rows are documents of
their own; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import keep, shared_dir, spread, staged, work_path

#: Bytes of a block; a task holds one block at a time.
BLOCK_BYTES = 8 << 20
#: Texts gathered before a write.
WRITE_BYTES = 4 << 20
#: Blocks that one task scans, and files that one task asks for their sizes, one after another.
BLOCKS_PER_TASK, FILES_PER_TASK = 8, 64


#: White space that the library's pattern would backtrack through, one stack frame a character.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_SPACE = re.compile(f"{_SPACE}{{1000,}}")


def encode_ordinary(encoding, text: str) -> list[int]:
    """The library's ids of a text of any length.

    A long run of white space is one word up to its last character, which belongs
    to what follows; the library gets that word as it is, without its pattern.
    """
    ids: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("token_files", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, vocab: str, pattern: str, folder: str, eod: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every whole text's ids, each closed by ``eod``, to files in ``folder``.

    ``folder`` is a URI that all executors reach.  Returns the staged manifest
    (``file``, ``ordinal``, the id column).  A task that runs again writes a
    file of its own, so the manifest never names one that was left half done.
    Null texts are empty documents.
    """
    out = keep(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        encoding = _encoding(vocab, pattern)
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}-{uuid.uuid4().hex[:12]}.bin"
        end, ordinal, sink = np.array([eod], dtype), 0, None
        for batch in batches:
            if sink is None:
                sink = store.open_output_stream(f"{top}/{name}", compression=None)
            held, size = [], 0
            for t in batch.column(text_col):
                ids = np.array(encode_ordinary(encoding, t.as_py() or ""), dtype)
                held += (ids, end)
                size += ids.nbytes
                if size >= WRITE_BYTES:
                    sink.write(np.concatenate(held).tobytes())
                    held, size = [], 0
            if held:
                sink.write(np.concatenate(held).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(id_col)], ["file", "ordinal", id_col])
            ordinal += n
        if sink is not None:
            sink.close()

    return staged(out.mapInArrow(run, f"file string, ordinal bigint, `{id_col}` {dict(out.dtypes)[id_col]}"), "token-manifest")


def count_tokens(files: DataFrame, folder: str, eod: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the named files: ``file``, ``ordinal``, ``first_token``, ``n_tokens``.

    ``files`` has a column ``file`` of names in ``folder``.  Blocks are spread
    over all tasks whatever the sizes of the files; the prefix scan shuffles
    one row of five numbers per block.
    """
    width = np.dtype(dtype).itemsize
    block = max(width, block_bytes - block_bytes % width)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            names = b.column("file").to_pylist()
            found = [store.get_file_info(f"{top}/{n}").size for n in names]
            if odd := [n for n, s in zip(names, found) if s % width]:
                raise ValueError(f"size is no multiple of {width} bytes: {odd[0]}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.int64())], ["file", "size"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, at, size in zip(*(b.column(c).to_pylist() for c in ("file", "at", "size"))):
                with store.open_input_file(f"{top}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(block, size - at), at), dtype)
                ends = np.flatnonzero(ids == eod) + at // width
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([size // width], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends[-1] if len(ends) else None], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))], ["file", "at", "tokens", "n_ends", "last_end", "ends"])

    # counts are given, for rows of a few bytes would otherwise be merged into one task
    names = staged(files.select("file").distinct(), "token-names", light=True)
    sized = staged(names.repartition(-(-names.count() // FILES_PER_TASK) or 1, "file").mapInArrow(sizes, "file string, size bigint").where("size > 0"), "token-sizes", light=True)
    n = sized.agg(F.sum(F.ceil(F.col("size") / block))).first()[0] or 1
    blocks = sized.select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(block).cast("bigint"))).alias("at")).repartition(spread(files.sparkSession, n, BLOCKS_PER_TASK), "file", "at")
    found = staged(blocks.mapInArrow(scan, "file string, at bigint, tokens bigint, n_ends bigint, last_end bigint, ends array<bigint>"), "token-blocks")

    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.drop("ends").select(
        "file", "at",
        F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.max("last_end").over(earlier), F.lit(-1)).alias("open_since"),
    )
    closed = (
        found.join(stitched, ["file", "at"])
        .select("file", "before", "open_since", "ends", F.posexplode("ends").alias("k", "end"))
        .select("file", (F.col("before") + F.col("k")).alias("ordinal"), (F.when(F.col("k") == 0, F.col("open_since")).otherwise(F.get("ends", F.col("k") - 1)) + 1).alias("first_token"), "end")
        .select("file", "ordinal", "first_token", (F.col("end") - F.col("first_token")).alias("n_tokens"))
    )
    last = found.groupBy("file").agg(F.sum("n_ends").alias("ordinal"), (F.coalesce(F.max("last_end"), F.lit(-1)) + 1).alias("first_token"), F.max("tokens").alias("tokens"))
    unclosed = last.where("tokens > first_token").select("file", "ordinal", "first_token", (F.col("tokens") - F.col("first_token")).alias("n_tokens"))
    return closed.unionByName(unclosed)


def document_token_counts(docs: DataFrame, vocab: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files, then count every document from the files alone.

    Returns the id column, ``n_tokens``, ``file`` and ``first_token``.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    folder = work_path(spark, "tokens")
    manifest = write_token_files(docs, vocab, pattern, folder, eod, id_col=id_col, text_col=text_col)
    counts = count_tokens(manifest.select("file"), folder, eod)
    return manifest.join(counts, ["file", "ordinal"]).select(id_col, "n_tokens", "file", "first_token")
