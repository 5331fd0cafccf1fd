"""JSON arrays and objects of any size, read by many tasks.

One document holds all records, so no byte says by itself whether it stands in a
string or how deep it is nested.  A first pass over blocks tells, for each way in
which a block could begin (inside a string or not, behind an open backslash or
not), how it would end: quote parity, backslash carry and change of depth.  A walk
over these few numbers a block fixes the true state at the beginning of every
block.  A second pass then cuts each block at the commas of depth one; an element
that crosses blocks belongs to the task where it begins, which reads on to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.staging import scratch, staged
from millrace.sources import ranges

#: Bytes of a block, and of elements that go on together.
BLOCK_BYTES, _TOGETHER = 8 << 20, 4 << 20
_QUOTE, _BACKSLASH, _COMMA = b'"\\,'
_OPENING, _CLOSING = b"[{", b"]}"
#: Change of depth by byte.
_STEP = np.zeros(256, np.int8)
_STEP[list(_OPENING)], _STEP[list(_CLOSING)] = 1, -1
_BOM = b"\xef\xbb\xbf"


def open_quotes(raw: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are quotes without an open backslash before them, and whether one is open at the end."""
    quotes = raw == _QUOTE
    slashes = np.flatnonzero(raw == _BACKSLASH)
    if not len(slashes) and not escaped:
        return quotes, False
    if escaped and len(raw):
        if not len(slashes) or slashes[0]:  # the first byte is what the open backslash covers
            quotes[0] = False
        else:
            slashes = slashes[1:]
    if not len(slashes):
        return quotes, False
    # in a run of backslashes every second one opens; the last of an odd run covers the byte behind it
    begins = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    ends = np.append(begins[1:], len(slashes)) - 1
    behind = slashes[ends[(ends - begins) % 2 == 0]] + 1
    quotes[behind[behind < len(raw)]] = False
    return quotes, bool(len(behind) and behind[-1] == len(raw))


def outline(raw: np.ndarray) -> list[int]:
    """For a block that begins behind no open backslash, then for one behind one: quote parity, an open backslash at the end,
    and the change of depth from outside and from inside a string."""
    out = []
    for escaped in (False, True):
        quotes, open_ = open_quotes(raw, escaped)
        inside = np.bitwise_xor.accumulate(quotes) if len(raw) else quotes
        steps = _STEP[raw].astype(np.int64)
        within = int(steps[inside].sum())
        out += [int(quotes.sum()) & 1, int(open_), int(steps.sum()) - within, within]
    return out


def borders(raw: np.ndarray, inside: bool, escaped: bool, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[bool, bool, int]]:
    """Places of the commas and brackets that bound elements of depth one, which of them elements follow, and the state at the end."""
    quotes, open_ = open_quotes(raw, escaped)
    strings = np.bitwise_xor.accumulate(quotes) ^ inside if len(raw) else quotes
    at = np.flatnonzero(((_STEP[raw] != 0) | (raw == _COMMA)) & ~strings)
    steps = _STEP[raw[at]].astype(np.int64)
    depths = depth + np.cumsum(steps)
    begins = (depths == 1) & (steps >= 0)
    on = begins | ((depths == 0) & (steps < 0))
    state = (bool(strings[-1]) if len(raw) else inside, open_ if len(raw) else escaped, int(depths[-1]) if len(at) else depth)
    return at[on], begins[on], state


def elements(spark: SparkSession, path: str, pattern: str | None = None, kind: str = "[", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file``, ``at`` (the byte behind the comma or bracket before it) and ``element`` of documents that are each one array, or one object (``kind`` ``{``).

    An element of an object is ``"key": value``.  Empty files hold none; a document of another kind, one that is cut off and one with something behind it are errors.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = ranges.Stores()
        for b in batches:
            ats, found = b.column("at").to_pylist(), []
            for name, group in groupby(zip(b.column("file").to_pylist(), ats), itemgetter(0)):
                with stores.open(name) as f:
                    found += [outline(np.frombuffer(f.read_at(min(block_bytes, f.size() - at), at), np.uint8)) for _, at in group]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("at"), pa.array(found, pa.list_(pa.int64()))], ["file", "at", "outline"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, inside, escaped, depth = None, False, False, 0
        for b in batches:
            out = []
            for name, at, found in zip(*(b.column(c).to_pylist() for c in ("file", "at", "outline"))):
                if name != current:
                    current, inside, escaped, depth = name, False, False, 0
                out.append((name, at, inside, escaped, depth))
                parity, open_, outer, inner = found[4:] if escaped else found[:4]
                depth += inner if inside else outer
                inside, escaped = inside ^ bool(parity), bool(open_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["file", "at", "inside", "escaped", "depth"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = ranges.Stores()
        for b in batches:
            for name, group in groupby(zip(*(b.column(c).to_pylist() for c in ("file", "at", "inside", "escaped", "depth"))), itemgetter(0)):
                with stores.open(name) as f:
                    for _, at, *state in group:
                        yield from _elements(f, name, at, block_bytes, tuple(state), kind)

    sizes = ranges.listed(spark, path, pattern).where("size > 0")
    pieces = sizes.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(block_bytes).cast("bigint"))).alias("at"), F.lit(block_bytes).cast("bigint").alias("size"))
    pieces = staged(pieces, "json-blocks")
    outlines = ranges.dealt(pieces).select("file", "at").mapInArrow(blocks, "file string, at bigint, outline array<bigint>")
    states = outlines.repartition("file").sortWithinPartitions("file", "at").mapInArrow(walk, "file string, at bigint, inside boolean, escaped boolean, depth bigint")
    states = staged(states, "json-states").withColumn("size", F.lit(block_bytes).cast("bigint"))
    return ranges.dealt(states).drop("size").mapInArrow(cut, "file string, at bigint, element string")


def _elements(f, name: str, at: int, block_bytes: int, state: tuple[bool, bool, int], kind: str) -> Iterator[pa.RecordBatch]:
    """The elements that begin in a block."""
    size = f.size()
    raw = f.read_at(min(block_bytes, size - at), at)
    places, begins, after = borders(np.frombuffer(raw, np.uint8), *state)
    if at == 0:
        head = raw.removeprefix(_BOM).lstrip()
        if head and head[:1] != kind.encode():
            raise ValueError(f"not one {'array' if kind == '[' else 'object'}: {name}")
        if not head and size > block_bytes:
            raise ValueError(f"it begins with {block_bytes} blanks: {name}")
    if at + len(raw) == size and (after[2] != 0 or after[0]):
        raise ValueError(f"cut off: {name}")
    # behind a document's end there is nothing
    closed = np.flatnonzero(~begins)
    rest = raw[places[closed[0]] + 1 :] if len(closed) else raw if state[2] == 0 and at else b""
    if rest.strip():
        raise ValueError(f"something stands behind its end: {name}")
    ats: list[int] = []
    texts: list[bytes] = []
    held = 0
    for i in np.flatnonzero(begins).tolist():
        begin = int(places[i]) + 1
        text = raw[begin : places[i + 1]] if i + 1 < len(places) else _onward(f, name, raw[begin:], at + len(raw), after, block_bytes)
        if text := text.strip():
            ats.append(at + begin)
            texts.append(text)
            held += len(text)
        if held >= _TOGETHER:
            yield _rows(name, ats, texts)
            ats, texts, held = [], [], 0
    if texts:
        yield _rows(name, ats, texts)


def _onward(f, name: str, text: bytes, at: int, state: tuple[bool, bool, int], block_bytes: int) -> bytes:
    """The rest of an element that goes on behind its block."""
    parts, step = [text], min(block_bytes, 64 << 10)
    while True:
        raw = f.read_at(min(step, f.size() - at), at)
        if not raw:
            raise ValueError(f"cut off: {name}")
        places, _, state = borders(np.frombuffer(raw, np.uint8), *state)
        if len(places):
            return b"".join([*parts, raw[: places[0]]])
        parts.append(raw)
        at, step = at + len(raw), min(2 * step, BLOCK_BYTES)


def _rows(name: str, ats: list[int], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(ats), pa.string()), pa.array(ats, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["file", "at", "element"])


def records(spark: SparkSession, path: str, schema: T.StructType | None, pattern: str | None = None, place: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The records of arrays; without a schema it is inferred. ``place`` names a column of where each record stands: its file and byte."""
    found = elements(spark, path, pattern, block_bytes=block_bytes)
    if schema is None:
        lines = scratch(spark, "json-lines")
        found.select(F.translate("element", "\r\n", "  ")).write.text(lines)  # neither can stand in a string
        return spark.read.json(lines)
    where = [F.struct("file", "at").alias(place)] if place else []
    return found.select(F.from_json("element", schema).alias("r"), *where).select("r.*", *([place] if place else []))


def entries(spark: SparkSession, path: str, value: T.DataType, key: str = "key", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Key and value (``value``) of every entry of objects."""
    found = elements(spark, path, kind="{", block_bytes=block_bytes)
    whole: Column = F.from_json(F.concat(F.lit("{"), "element", F.lit("}")), T.MapType(T.StringType(), value))
    return found.select(F.explode(whole).alias(key, "value"))
