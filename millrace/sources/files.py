"""Readers of manifests, lists, tensors and archives.  All go through Spark's readers, whatever the store."""

from __future__ import annotations

import io
import json
import os
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas
from millrace.operators.staging import staged
from millrace.sources import json_arrays

# Fixed value: where lines end in the transcript format besides line feeds and carriage returns.
OTHER_LINE_ENDS = "[\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def hadoop_path(spark: SparkSession, path: str):
    """A path of the session's stores and the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = hadoop_path(spark, path)
    return store.exists(p)


def first_existing(spark: SparkSession, *candidates: tuple[str, ...]) -> tuple[str, ...] | None:
    """The first group of paths that are all there."""
    return next((group for group in candidates if all(exists(spark, p) for p in group)), None)


def discover(spark: SparkSession, pattern: str, fallback: str | None = None) -> str | None:
    """The first path, in order, that matches a glob pattern."""
    p, store = hadoop_path(spark, pattern)
    found = sorted(s.getPath().toString() for s in store.globStatus(p) or [])
    return found[0] if found else fallback


def manifest(spark: SparkSession, path: str, split: str | None = None, schema: T.StructType = schemas.MANIFEST, place: str | None = None, block_bytes: int = json_arrays.BLOCK_BYTES) -> DataFrame:
    """JSON arrays of clips, each read by many tasks; with a split, only its rows.

    ``place`` names a column that says where a record stands (file and byte), so ordering by it gives the manifest's order.
    """
    rows = json_arrays.records(spark, path, schema, place=place, block_bytes=block_bytes)
    return rows if split is None else rows.where(F.col("split") == split)


def raw_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of clips with whatever further fields they have."""
    return json_arrays.records(spark, path, None)


def split_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def eval_sentences(spark: SparkSession, path: str) -> DataFrame:
    return json_arrays.records(spark, path, schemas.EVAL_SENTENCE)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of each file with their place, read in as many pieces as the file is cut into.

    Spark's reader ends lines at line feeds and carriage returns; the other line
    ends are found inside its lines.  Rows of a piece come in order, so a place is
    one within the piece plus the lines of the pieces before it.
    """
    found = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_piece"), F.explode(F.split("value", OTHER_LINE_ENDS, -1)).alias("value"))
    found = staged(found.withColumn("_at", F.monotonically_increasing_id()), "lines")
    pieces = found.groupBy("file", "_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("file", "_piece", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return found.join(before, ["file", "_piece"]).select("file", (F.col("_at") + F.col("_shift")).alias("line"), "value")


def sample_list(spark: SparkSession, path: str, keep_file: bool = False) -> DataFrame:
    """``ordinal``, ``relpath``, ``num_samples`` of sample lists, if asked for behind their ``file``: the first line and blank lines don't count; a row without exactly two fields is an error."""
    rows = _lines(spark, path).where("line > 0").where(~F.col("value").rlike(r"\A\s*\z"))
    parts = F.split("value", "\t", -1)
    checked = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), "value")))
    named = rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).alias("ordinal"), checked.alias("p"))
    return named.select(*(["file"] if keep_file else []), "ordinal", F.get("p", F.lit(0)).alias("relpath"), F.get("p", F.lit(1)).cast("bigint").alias("num_samples"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal`` and ``text`` of every line, blank ones included."""
    return _lines(spark, path).select(F.col("line").alias("ordinal"), F.col("value").alias("text"))


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal`` and ``names`` of an optional JSON object; none if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "ordinal int, names array<string>")
    rows = json_arrays.entries(spark, path, T.ArrayType(T.StringType()), "ordinal")
    return rows.select(F.col("ordinal").cast("int").alias("ordinal"), F.col("value").alias("names"))


def cache_index(spark: SparkSession, path: str) -> DataFrame:
    """Cache records from a JSON object keyed by clip; empty if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.CACHE_INDEX)
    return json_arrays.entries(spark, path, schemas.CACHE_RECORD, "clip_id").select("clip_id", "value.*")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """``shard_index`` of completed shards; empty if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "shard_index int")
    return spark.read.schema(schemas.PROGRESS).json(path, multiLine=True).select(F.explode("completed_shard_indices").alias("shard_index")).distinct()


def metadata(spark: SparkSession, path: str, checkpoint: str | None = None) -> DataFrame | None:
    """One row of run metadata; None if it, or the checkpoint beside it, is missing."""
    if not exists(spark, path) or checkpoint is not None and not exists(spark, checkpoint):
        return None
    return spark.read.schema(schemas.METADATA).json(path, multiLine=True)


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Scored CSV rows, every field as text; blank cells are empty, not null."""
    return spark.read.schema(schemas.SCORE).csv(path, header=True, multiLine=True, escape='"', nullValue="\0").fillna("")


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _decoded(files: DataFrame, decode, schema: T.StructType) -> DataFrame:
    """Rows that ``decode(path, bytes)`` yields, in small Arrow batches."""
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                for row in decode(path, content.as_py()):
                    rows.append(dict(zip(arrow.names, row)))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in t])
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary()}[t.simpleString()]


def code_tensors(spark: SparkSession, path: str) -> DataFrame:
    """``clip_id`` and ``codes`` of one ``.npy`` matrix per clip."""

    def decode(name: str, content: bytes):
        yield os.path.basename(name).removesuffix(".npy"), np.load(io.BytesIO(content), allow_pickle=False).astype(np.int16).tolist()

    return _decoded(_binary(spark, path, "*.npy"), decode, schemas.SEMANTIC_CODES)


def pcm_samples(raw: bytes, width: int) -> np.ndarray:
    """Samples of 1 to 4 bytes, little-endian, in [-1, 1); those of one byte are unsigned."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    if width == 3:  # the lowest byte of four is zero
        padded = np.zeros((len(raw) // 3, 4), np.uint8)
        padded[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return padded.reshape(-1).view("<i4") / 2.0**31
    return np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)


def wav_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sample_rate`` and ``channels`` of PCM WAV files of 8 to 32 bits, samples in [-1, 1)."""

    def decode(name: str, content: bytes):
        with wave.open(io.BytesIO(content)) as w:
            x = pcm_samples(w.readframes(w.getnframes()), w.getsampwidth()).reshape(-1, w.getnchannels()).T
            yield name, w.getframerate(), x.tolist()

    return _decoded(_binary(spark, path, "*.wav"), decode, T.StructType([T.StructField("path", T.StringType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def listed_order(path: Column) -> list[Column]:
    """Files of the longer suffix by path, then those of the shorter one."""
    return [F.when(path.endswith(".protos"), 0).otherwise(1), path]


def with_codes(items: DataFrame, most: int | None = None) -> DataFrame:
    """Sentences that have semantics, in order of file, item and place; with ``most``, the first so many."""
    rows = items.select("file", "item", F.posexplode("sentences").alias("place", "sentence")).where(F.size("sentence.semantics") > 0).select("file", "item", "place", "sentence.*")
    return rows if most is None else rows.orderBy(*listed_order(F.col("file")), "item", "place").limit(most)


def load_config(path: str) -> dict:
    """A settings file with an ``extends`` chain; a child's keys replace its parent's, learning rates merge one level."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            own = json.load(f)
        else:
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML settings need PyYAML; JSON ones don't") from e
            own = yaml.safe_load(f)
    parent = own.pop("extends", None)
    if not parent:
        return own
    return merge_config(load_config(os.path.normpath(os.path.join(os.path.dirname(path), parent))), own)


def merge_config(base: dict, own: dict) -> dict:
    out = {**base, **own}
    if "learning_rate" in base and "learning_rate" in own:
        out["learning_rate"] = {**base["learning_rate"], **own["learning_rate"]}
    return out


def rank_environment(env: dict[str, str] | None = None) -> tuple[int, int, int]:
    """(rank, local rank, world size) of a launcher's environment; one process by default."""
    env = os.environ if env is None else env
    rank, local, world = int(env.get("RANK", 0)), int(env.get("LOCAL_RANK", 0)), int(env.get("WORLD_SIZE", 1))
    if not 0 <= rank < world or local < 0:
        raise ValueError(f"rank {rank} (local {local}) of {world}")
    return rank, local, world
