"""Files that many tasks read: archives by their index, JSON documents by their structure."""

import io
import json
import os
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import archives, files, framed, json_arrays


def tar(path, fmt, rng, n=200):
    want = {}
    with tarfile.open(path, "w", format=fmt) as t:
        for i in range(n):
            name = ("d/" * rng.choice([1, 70]) if fmt != tarfile.USTAR_FORMAT else "d/") + f"é{i}"
            raw = rng.randbytes(rng.choice([0, 1, 511, 512, 513, 5000]))
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            if i % 10 == 3:
                info.type, info.size = rng.choice([tarfile.DIRTYPE, tarfile.SYMTYPE]), 0
            else:
                want[name] = raw
            t.addfile(info, io.BytesIO(raw))
    return want


@pytest.mark.parametrize("fmt", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_archives_equal_the_library(spark, tmp_path, fmt):
    rng = random.Random(fmt)
    want = {(f"{k}.tar", name): raw for k in range(3) for name, raw in tar(tmp_path / f"{k}.tar", fmt, rng).items()}
    rows = archives.tar_members(spark, str(tmp_path), task_bytes=20_000).collect()
    assert {(os.path.basename(r.archive), r.member): bytes(r.content) for r in rows} == want and len(rows) == len(want)
    ordinals = archives.tar_index(spark, str(tmp_path)).groupBy("file").agg(F.count("*").alias("n"), F.max("ordinal").alias("m")).collect()
    assert {(r.n, r.m + 1) for r in ordinals} == {(len(want) // 3,) * 2}


def test_an_archive_above_two_gigabytes(spark, tmp_path):
    """A sparse file: its index is read, and members on both sides of the hole."""
    with open(tmp_path / "big.tar", "wb") as f:
        for name, size in (("one", 1 << 20), ("hole", 2_500_000_256), ("two", 700)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf())
            at = f.tell()
            f.write(name.encode())
            f.seek(at + -(-size // 512) * 512)
        f.write(b"\0" * 1024)
    index = archives.tar_index(spark, str(tmp_path))
    assert [(r.member, r.at, r["size"]) for r in index.orderBy("ordinal").collect()] == [("one", 512, 1 << 20), ("hole", (1 << 20) + 1024, 2_500_000_256), ("two", 1536 + (1 << 20) + 2_500_000_256, 700)]
    ends = archives.tar_members(spark, str(tmp_path), index=index.where("member <> 'hole'")).select("member", F.length("content").alias("n"), F.substring("content", 1, 3).alias("c")).collect()
    assert {(r.member, r.n, bytes(r.c)) for r in ends} == {("one", 1 << 20, b"one"), ("two", 700, b"two")}
    with pytest.raises(Exception, match="a value holds"):
        archives.tar_members(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("cut", [700, 512 + 100, 1024 + 512 + 10])
def test_cut_off_archives_are_errors(spark, tmp_path, cut):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as t:
        for name in "ab":
            info = tarfile.TarInfo(name)
            info.size = 600
            t.addfile(info, io.BytesIO(b"x" * 600))
    (tmp_path / "cut.tar").write_bytes(held.getvalue()[:cut])
    with pytest.raises(Exception, match="cut off|unexpected end|truncated"):
        archives.tar_members(spark, str(tmp_path)).collect()


def test_written_archives_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(f"m{i}", os.urandom(i * 7)) for i in range(50)] + [("none", None)], "member string, content binary").repartition(3)
    named = archives.write_tar(rows, f"file://{tmp_path}/out")
    assert named.count() == 51
    got = {r.member: bytes(r.content) for r in archives.tar_members(spark, f"{tmp_path}/out").collect()}
    assert got == {r.member: bytes(r.content or b"") for r in rows.collect()}


NASTY = ['"', "\\", '\\"', "\\\\", "[", "]", "{", "}", ",", ":", "\\\\\\", "é", "🙂", "\n", "", "a,b", '{"x": [1, "]"]}', "\\u0022"]


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return "".join(rng.choice(NASTY) for _ in range(rng.randrange(6)))
    if kind == 2:
        return rng.choice([None, True, 1.5, -3, 10**12])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NASTY) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1 << 20])
@pytest.mark.parametrize("kind", "[{")
def test_elements_at_every_border(block, kind):
    """Without Spark: states of all blocks, then each block's elements, against the library."""
    rng = random.Random(block)
    for n in range(40):
        whole = [value(rng) for _ in range(rng.randrange(8))] if kind == "[" else {f"{rng.choice(NASTY)}{i}": value(rng) for i in range(rng.randrange(8))}
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2])) + rng.choice(["", "\n", "  \n"])
        raw = text.encode()
        got, inside, escaped, depth = [], False, False, 0
        for at in range(0, len(raw), block):
            part = np.frombuffer(raw[at : at + block], np.uint8)
            for b in json_arrays._elements(Bytes(raw), "x", at, block, (inside, escaped, depth), kind):
                got += b.column("element").to_pylist()
            found = json_arrays.outline(part)
            parity, open_, outer, inner = found[4:] if escaped else found[:4]
            depth += inner if inside else outer
            inside, escaped = inside ^ bool(parity), bool(open_)
        assert (depth, inside) == (0, False)
        assert [json.loads(x) for x in got] == whole if kind == "[" else json.loads("{" + ",".join(got) + "}") == whole and len(got) == len(whole)


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at : at + n]


def test_records_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    files = [[{"id": 1000 * f + i, "text": "".join(rng.choice(NASTY) for _ in range(9)), "tags": [rng.choice(NASTY)], "more": {"x": i}} for i in range(rng.choice([0, 1, 400]))] for f in range(5)]
    for k, rows in enumerate(files):
        (tmp_path / f"{k}.json").write_text(("﻿" if k == 1 else "") + json.dumps(rows, indent=k or None, ensure_ascii=False))
    (tmp_path / "5.json").write_text("")
    got = json_arrays.records(spark, str(tmp_path), schema, place="place", block_bytes=997)
    assert got.rdd.getNumPartitions() > 1 and got.select(F.spark_partition_id()).distinct().count() > 1
    rows = got.orderBy("place").collect()
    assert [(r.id, r.text, r.tags) for r in rows] == [(x["id"], x["text"], x["tags"]) for f in files for x in f]
    raw = json_arrays.records(spark, str(tmp_path), None, block_bytes=997)
    assert raw.count() == len(rows) and raw.select("more.x").distinct().count() > 1


def test_entries_of_objects(spark, tmp_path):
    whole = {f'k"{i}\\': {"v": i, "s": "},{"} for i in range(300)}
    (tmp_path / "x.json").write_text(json.dumps(whole, indent=1))
    got = json_arrays.entries(spark, str(tmp_path / "x.json"), T.StructType.fromDDL("v int, s string"), block_bytes=211)
    assert {r.key: r.value.asDict() for r in got.collect()} == whole


@pytest.mark.parametrize("text", ["[1, 2", '["a', '{"a": 1}', "[1] [2]", "[1], 2", "1", '[{"a": "b}]'])
def test_broken_documents_are_errors(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="cut off|not one array|behind its end"):
        json_arrays.elements(spark, str(tmp_path), block_bytes=3).collect()


def test_framed_files_in_pieces(spark, tmp_path):
    rng = random.Random(8)
    files = {}
    for k in range(3):
        items = [[([rng.choice(NASTY)] * rng.randrange(3), [[rng.randrange(1 << 31) for _ in range(rng.randrange(4))]] * rng.randrange(3)) for _ in range(rng.randrange(5))] for _ in range((1, 0, 300)[k])]
        bodies = [b"".join(framed._part(4, framed.sentence_message(*s)) for s in item) + framed._part(9, b"other") for item in items]
        (tmp_path / f"{k}.protos").write_bytes(b"".join(len(b).to_bytes(4, "little") + b for b in bodies))
        files[f"{k}.protos"] = items
    pieces = framed.frame_pieces(spark, str(tmp_path), piece_bytes=500)
    assert pieces.count() > 10 and pieces.agg(F.sum("n")).first()[0] == sum(map(len, files.values()))
    got = framed.packed_sentences(spark, str(tmp_path), piece_bytes=500)
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    want = {(f, i): [{"texts": t, "semantics": [{"values": v} for v in s]} for t, s in item] for f, items in files.items() for i, item in enumerate(items)}
    assert {(os.path.basename(r.file), r.item): [s.asDict(recursive=True) for s in r.sentences] for r in got.collect()} == want
    texts = framed.packed_sentences(spark, str(tmp_path), columns=("texts",))
    assert texts.schema["sentences"].dataType.elementType.names == ["texts"]
    assert {(os.path.basename(r.file), r.item): r.n_sentences for r in framed.sentence_counts(spark, str(tmp_path)).collect()} == {k: len(v) for k, v in want.items()}
    whole = (tmp_path / "2.protos").read_bytes()
    for cut in (1, 3, len(whole) - 1):
        (tmp_path / "cut").mkdir(exist_ok=True)
        (tmp_path / "cut" / "c.protos").write_bytes(whole[:cut])
        with pytest.raises(Exception, match="cut off"):
            framed.frame_pieces(spark, str(tmp_path / "cut")).collect()


def test_lines_of_files_in_many_pieces(spark, tmp_path):
    """Places count on over pieces; all line ends of the format end lines."""
    rng = random.Random(4)
    want = {}
    for k in range(3):
        text = "".join(rng.choice(["a", "bé", "", "x\ty", " "]) * rng.randrange(9) + rng.choice(["\n", "\r\n", "\r", "\x0b", "\x85", "\u2028"]) for _ in range(2000)) + "end" * (k % 2) + "\n" * (k == 2)
        (tmp_path / f"{k}.wrd").write_bytes(text.encode())
        want[f"{k}.wrd"] = text.splitlines() if not text.endswith(("\x0b", "\x85", "\u2028")) else [*text.splitlines(), ""]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {}
        for r in files._lines(spark, str(tmp_path)).collect():
            got.setdefault(os.path.basename(r.file), {})[r.line] = r.value
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {f: [v for _, v in sorted(lines.items())] for f, lines in got.items()} == want
