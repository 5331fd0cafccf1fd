"""Writers.  Tables go through Spark's committers; single JSON documents through a replacing move."""

from __future__ import annotations

import io
import json
import uuid
import wave
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.files import exists, hadoop_path


def replace_file(spark: SparkSession, part: str, path: str) -> None:
    """Move a file over another in one step of the store; a reader finds the old one or the new one."""
    fs = spark._jvm.org.apache.hadoop.fs
    source, target = fs.Path(part), hadoop_path(spark, path)[1].makeQualified(fs.Path(path))
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(hadoop_path(spark, part)[1].makeQualified(source), target, options)


def write_document(spark: SparkSession, path: str, data) -> None:
    """One JSON document, whole or not at all: written beside its place, then moved over it in one step."""
    name = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    part, store = hadoop_path(spark, name)
    out = store.create(part, True)
    out.write(bytearray(json.dumps(data, ensure_ascii=False, indent=2).encode()))
    out.hsync()
    out.close()
    replace_file(spark, name, path)


def manifest(rows: DataFrame, path: str, by_split: bool = False) -> None:
    """JSON arrays, one a task, which ``files.manifest`` reads; or Parquet in a folder for each split, so that readers prune."""
    if by_split:
        rows.write.mode("overwrite").partitionBy("split").parquet(path)
    else:
        array_lines(rows).write.mode("overwrite").text(path)


def array_lines(rows: DataFrame) -> DataFrame:
    """The lines of one JSON array for each task: brackets around its rows, commas in front of all but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            if b.num_rows:
                heads = pa.array([lead] + [","] * (b.num_rows - 1))
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(heads, b.column(0), "")], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])

    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(run, "value string")


def cache_index(index: DataFrame, path: str) -> None:
    """The keyed cache as a Parquet table, sorted inside files by key."""
    index.repartition("clip_id").sortWithinPartitions("clip_id").write.mode("overwrite").parquet(path)


def cache_index_document(index: DataFrame, path: str) -> None:
    """The keyed cache as one JSON document that maps each key to its entry without the key.

    For interchange; one document holds all entries, so it is for indexes that
    the driver can hold. Entries come in order of the key.
    """
    spark = index.sparkSession
    rows = index.orderBy("clip_id").select("clip_id", F.to_json(F.struct(*(c for c in index.columns if c != "clip_id"))).alias("entry"))
    write_document(spark, path, {r.clip_id: json.loads(r.entry) for r in rows.toLocalIterator()})


def progress(spark: SparkSession, done: DataFrame, path: str) -> None:
    """Completed shard numbers, sorted; one number per shard comes to the driver."""
    write_document(spark, path, {"completed_shard_indices": sorted(r[0] for r in done.select("shard_index").distinct().collect())})


def scoring_template(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, emptyValue="")


def inputs(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def codes(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def restored(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, after a replacement that broke off between its two moves was taken back."""
    target, store = hadoop_path(spark, path)
    old, _ = hadoop_path(spark, f"{path}.old")
    if not store.exists(target) and store.exists(old):
        store.rename(old, target)
    return store.exists(target)


def wav_files(rows: DataFrame, folder: str) -> DataFrame:
    """Clips of (``clip_id``, ``sample_rate``, ``channels``: samples from -1 to 1) as 16-bit PCM files; returns clip_id, file and bytes.

    Lazy like any frame: what writes its rows writes the files. A task that runs again replaces them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for b in batches:
            files, sizes = [], []
            for clip, rate, channels in zip(*(b.column(c) for c in ("clip_id", "sample_rate", "channels"))):
                x = np.array(channels.as_py(), float)
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(len(x)), w.setsampwidth(2), w.setframerate(rate.as_py())
                    w.writeframes(np.clip(np.round(x.T * 32768), -32768, 32767).astype("<i2").tobytes())
                files.append(f"{clip.as_py()}.wav")
                sizes.append(held.tell())
                with store.open_output_stream(f"{top}/{files[-1]}", compression=None) as out:
                    out.write(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), pa.array(files, pa.string()), pa.array(sizes, pa.int64())], ["clip_id", "file", "bytes"])

    return rows.select("clip_id", "sample_rate", "channels").mapInArrow(run, f"clip_id {dict(rows.dtypes)['clip_id']}, file string, bytes bigint")


def transferred(listed: DataFrame, source: str, target: str, per_task: int = 16) -> DataFrame:
    """Files copied from one store to another, for fetching and for publishing: ``file`` and ``bytes`` of each.

    ``listed`` has a column ``file`` of paths below ``source``.  Tasks copy in
    pieces; a file that is already there with the same size is left alone, so a
    broken transfer goes on where it stopped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, top), (there, base) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target)
        for b in batches:
            sizes = []
            for name in b.column("file").to_pylist():
                sizes.append(size := here.get_file_info(f"{top}/{name}").size)
                if there.get_file_info(f"{base}/{name}").size == size:
                    continue
                there.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                fs.copy_files(f"{top}/{name}", f"{base}/{name}", source_filesystem=here, destination_filesystem=there, use_threads=False)
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(sizes, pa.int64())], ["file", "bytes"])

    names = listed.select("file").distinct()
    return names.repartition(max(1, -(-names.count() // per_task)), "file").mapInArrow(run, "file string, bytes bigint")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType)


def content_digest(rows: DataFrame) -> list[Column]:
    """Aggregates that tell the content of a table apart from another's, whatever the order of rows: ``rows``, for each
    column the sum of its values' hashes, and over all columns together the sum and the exclusive or of the rows' hashes.

    The sums find a value that has changed, those over whole rows values that have changed places between rows.
    """
    part = {f.name: F.to_json(F.struct(F.col(f"`{f.name}`"))) if _holds_map(f.dataType) else F.col(f"`{f.name}`") for f in rows.schema}
    wide = lambda h: F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string")
    own = [wide(F.xxhash64(F.lit(k), c)).alias(f"column {name}") for k, (name, c) in enumerate(part.items())]
    # a null is hashed by its place too, so that it differs from no column
    whole = F.xxhash64(*(x for k, c in enumerate(part.values()) for x in (F.lit(k), c.isNull(), c)))
    return [F.count(F.lit(1)).alias("rows"), *own, wide(whole).alias("whole rows"), F.coalesce(F.bit_xor(whole), F.lit(0)).alias("whole rows, mixed")]


def verified(rows: DataFrame, path: str, required: tuple[str, ...] = ()) -> None:
    """A table that takes its place only after it was read back with its columns and the content that was written.

    The digest of what is written is taken by an observation of the writing job,
    and that of what was written by reading it again; see ``content_digest``.
    The table before it is moved aside, not deleted, until the new one stands;
    ``restored`` takes it back if the job ends in between.
    """
    spark = rows.sparkSession
    part = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    written = Observation()
    rows.observe(written, *content_digest(rows)).write.parquet(part)
    check_content(spark.read.parquet(part), rows.columns, written.get, required)
    target, store = hadoop_path(spark, path)
    old, _ = hadoop_path(spark, f"{path}.old")
    if restored(spark, path):
        store.delete(old, True)
        if not store.rename(target, old):
            raise OSError(f"could not move {path} aside")
    if not store.rename(hadoop_path(spark, part)[0], target):
        restored(spark, path)
        raise OSError(f"could not move to {path}")
    store.delete(old, True)


def check_content(back: DataFrame, columns: list[str], written: dict, required: tuple[str, ...] = ()) -> None:
    """Raise unless a table has these columns and that content."""
    if lost := set(required or columns) - set(back.columns):
        raise ValueError(f"columns lost: {sorted(lost)}")
    whole = back.select(*(F.col(f"`{c}`") for c in columns))
    found = whole.agg(*content_digest(whole)).first().asDict()
    if (n := found["rows"]) != written["rows"]:
        raise ValueError(f"{written['rows']} rows written, {n} read back")
    if odd := [name.removeprefix("column ") for name, value in written.items() if found.get(name) != value]:
        raise ValueError(f"other content read back: {odd}")


def save_best(spark: SparkSession, state: DataFrame, path: str, loss: float, best: float) -> float:
    """Overwrite the best state only if the loss is below the best so far; returns the best."""
    if not loss < best:
        return best
    verified(state, path)
    return loss


def run_metadata(spark: SparkSession, path: str, base: dict, architecture: dict, extra: dict) -> dict:
    """Metadata with a UTC time; ``extra`` wins over ``architecture``, that over ``base``."""
    data = {**base, "last_checkpoint_time": datetime.now(timezone.utc).isoformat(), **architecture, **extra}
    write_document(spark, path, data)
    return data


def log_lines(steps: DataFrame, path: str, message: str) -> None:
    """Append a line with a UTC time for every row."""
    steps.select(F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("  "), F.expr(message))).write.mode("append").text(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete raw input that is no longer needed."""
    p, store = hadoop_path(spark, path)
    return store.delete(p, True) if exists(spark, path) else False
