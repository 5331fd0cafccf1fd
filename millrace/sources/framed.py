"""Files of messages behind their lengths: read in pieces that begin at frames.

A frame is a length in four bytes and a message.  Only the chain of lengths says
where frames begin, so one task a file walks it, touching lengths alone where
messages are long, and notes every frame that begins a new piece.  Pieces are then
dealt over tasks, and of each message only the fields that are asked for are decoded.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import schemas
from millrace.operators.staging import staged
from millrace.sources import ranges

#: Bytes of a piece, about; a longer message is a piece of its own.
PIECE_BYTES = 1 << 20
#: Fields of a sentence: its texts, and its semantics with their values.
TEXTS, SEMANTICS, VALUES = 1, 3, 1


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


def _packed(raw: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in raw:
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            out.append(value)
            value = shift = 0
    return out


def parse_sentence(raw: bytes, columns: tuple[str, ...] = ("texts", "semantics")) -> dict:
    """Those of the texts and the semantics (each a list of values) that are asked for."""
    out: dict = {c: [] for c in columns}
    for number, value in _fields(raw):
        if number == TEXTS and "texts" in out:
            out["texts"].append(value.decode())
        elif number == SEMANTICS and "semantics" in out:
            values: list[int] = []
            for n, v in _fields(value):
                if n == VALUES:
                    values += _packed(v) if isinstance(v, bytes) else [v]
            out["semantics"].append({"values": values})
    return out


def frame_pieces(spark: SparkSession, path: str, pattern: str = "*.{protos,proto}", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``file``, ``item`` (of its first frame), ``n`` frames, ``at`` and ``size`` of the pieces of files; a file that is cut off is an error."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = ranges.Stores()
        for b in batches:
            for name in b.column("file").to_pylist():
                with stores.open(name) as f:
                    ahead, at, item = ranges.Ahead(f), 0, 0
                    begun, first = 0, 0
                    while at < ahead.size:
                        ahead.seek(at)
                        head = ahead.read(4)
                        at += 4 + (struct.unpack("<I", head)[0] if len(head) == 4 else 0)
                        if len(head) < 4 or at > ahead.size:
                            raise ValueError(f"cut off: {name}")
                        item += 1
                        if at - begun >= piece_bytes or at == ahead.size:
                            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (first, item - first, begun, at - begun))], ["file", "item", "n", "at", "size"])
                            begun, first = at, item

    files = ranges.spread(ranges.listed(spark, path, pattern).where("size > 0").select("file"), "file")
    return files.mapInArrow(walk, "file string, item bigint, n bigint, at bigint, size bigint")


def _messages(spark: SparkSession, path: str, pattern: str, piece_bytes: int, make, schema: T.StructType, arrow: pa.Schema) -> DataFrame:
    """A row ``make(message)`` of every frame, behind its file and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = ranges.Stores()
        for b in batches:
            for name, item, at, size in zip(*(b.column(c).to_pylist() for c in ("file", "item", "at", "size"))):
                with stores.open(name) as f:
                    raw = f.read_at(size, at)
                rows, begin = [], 0
                while begin < len(raw):
                    (n,) = struct.unpack_from("<I", raw, begin)
                    rows.append((name, item + len(rows), make(raw[begin + 4 : begin + 4 + n])))
                    begin += 4 + n
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], arrow)

    pieces = staged(frame_pieces(spark, path, pattern, piece_bytes), "frames")
    return ranges.dealt(pieces).select("file", "item", "at", "size").mapInArrow(run, schema)


def packed_sentences(spark: SparkSession, path: str, pattern: str = "*.{protos,proto}", sentences_field: int = 4, columns: tuple[str, ...] = ("texts", "semantics"), piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``file``, ``item`` and ``sentences`` of every message; sentences have those ``columns`` that are asked for."""
    kinds = {"texts": pa.list_(pa.string()), "semantics": pa.list_(pa.struct([("values", pa.list_(pa.int32()))]))}
    sentence = pa.struct([(c, kinds[c]) for c in columns])
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("item", T.LongType()), T.StructField("sentences", T.ArrayType(T.StructType([f for f in schemas.SENTENCE if f.name in columns])))])
    arrow = pa.schema([("file", pa.string()), ("item", pa.int64()), ("sentences", pa.list_(sentence))])
    return _messages(spark, path, pattern, piece_bytes, lambda body: [parse_sentence(v, columns) for n, v in _fields(body) if n == sentences_field], schema, arrow)


def sentence_counts(spark: SparkSession, path: str, pattern: str = "*.{protos,proto}", sentences_field: int = 4, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``file``, ``item`` and ``n_sentences``: fields are stepped over, and no sentence is decoded."""
    schema = T.StructType.fromDDL("file string, item bigint, n_sentences bigint")
    arrow = pa.schema([("file", pa.string()), ("item", pa.int64()), ("n_sentences", pa.int64())])
    return _messages(spark, path, pattern, piece_bytes, lambda body: sum(n == sentences_field for n, _ in _fields(body)), schema, arrow)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _part(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def sentence_message(texts: list[str], semantics: list[list[int]]) -> bytes:
    """The message that ``parse_sentence`` reads."""
    return b"".join([*(_part(TEXTS, t.encode()) for t in texts), *(_part(SEMANTICS, _part(VALUES, b"".join(map(_varint, v)))) for v in semantics)])


def write_sentences(rows: DataFrame, folder: str, sentences_field: int = 4) -> DataFrame:
    """Rows (``sentences``: structs of ``texts`` and ``semantics``, arrays of values) as one framed file a task; returns ``file`` and ``n``, staged.

    A task that runs again writes a file of its own, so only those named in the result count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(ranges.uri(folder))
        store.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.protos"
        n = 0
        with store.open_output_stream(f"{top}/{name}", compression=None) as sink:
            for b in batches:
                for row in b.column("sentences"):
                    body = b"".join(_part(sentences_field, sentence_message(s["texts"] or [], s["semantics"] or [])) for s in row.as_py() or [])
                    sink.write(struct.pack("<I", len(body)) + body)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    return staged(rows.select("sentences").mapInArrow(run, "file string, n bigint"), "framed-written")
