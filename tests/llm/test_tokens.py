"""Operators 1 and 3 against the public tokenizer libraries."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, token_files
from millrace.llm.common import work_path

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_librarys_on_random_text(library):
    r, own = random.Random(1), bpe.load(VOCAB)
    pool = [chr(c) for c in range(1, 0x2FFF)] + [chr(c) for c in range(0x1F300, 0x1F500)] + list(" \t\n\r\x0b\x1c\x85\xa0　'sldremt019") * 400
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += [t + "<|endoftext|>" + t[::-1] for t in texts[:50]]
    for text, ids in zip(texts, own.encode_all(texts)):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 700, " " * 5000 + "b", "\n" * 999, "x1" * 500, "é" * 400])
def test_endless_words(library, text):
    assert bpe.load(VOCAB).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_scalar_and_array_forms_merge_alike():
    own = bpe.load(VOCAB)
    words = ["lower", "newest", "Straße", "tokenization", "aaaaaaaaab"]
    raw = [w.encode() for w in words]
    assert own.merge_all(raw, 24) == [own.merge(w) for w in raw] == [own.merge_long(w) for w in raw]


def test_bytes_that_are_no_text_decode_to_the_replacement():
    own = bpe.load(VOCAB)
    assert own.decode([own.first[0xC3]]) == "�"


def test_round_trip_rows(spark, edge, edge_rows, library):
    got = sorted(map(tuple, bpe.round_trip(edge, VOCAB).collect()), key=repr)
    want = []
    for i, t, *_ in edge_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_encode_then_decode(spark, edge, nothing):
    encoded = bpe.encode_documents(edge, VOCAB, carry=("lang",))
    back = {r.doc_id: r.text for r in bpe.decode_documents(encoded.where("doc_id is not null"), VOCAB).collect()}
    assert back == {r.doc_id: r.text or "" for r in edge.where("doc_id is not null").collect()}
    assert bpe.encode_documents(nothing, VOCAB).count() == 0


def test_token_counts(spark, edge, edge_rows, nothing, plain):
    got = token_files.document_token_counts(edge, RANKS, public_tokenizers.PATTERN, 50256)
    assert sorted([(r.doc_id, r.n_tokens) for r in got.collect()], key=repr) == sorted([(i, len(plain.encode_ordinary(t or ""))) for i, t, *_ in edge_rows], key=repr)
    assert token_files.document_token_counts(nothing, RANKS, public_tokenizers.PATTERN, 50256).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_documents_across_blocks(spark, block):
    """Any block size finds the same documents: empty ones, ones over several blocks, an unclosed one."""
    from pyarrow import fs

    folder = work_path(spark, "flat")
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    lengths = {"a.bin": [3, 0, 0, 50, 1], "b.bin": [0], "c.bin": [7, 2]}
    want = set()
    for name, sizes in lengths.items():
        ids, at = [], 0
        for k, n in enumerate(sizes):
            want.add((name, k, at, n))
            ids += [1] * n + [9]
            at += n + 1
        if name == "c.bin":
            ids += [1] * 5
            want.add((name, len(sizes), at, 5))
        with store.open_output_stream(f"{top}/{name}") as f:
            f.write(b"".join(i.to_bytes(2, "little") for i in ids))
    store.open_output_stream(f"{top}/d.bin").close()
    files = spark.createDataFrame([(n,) for n in ("a.bin", "b.bin", "c.bin", "d.bin")], "file string")
    assert {tuple(r) for r in token_files.count_tokens(files, folder, 9, block_bytes=block).select("file", "ordinal", "first_token", "n_tokens").collect()} == want


def test_many_tasks_scan_one_file(spark, monkeypatch):
    from pyarrow import fs

    folder, tables = work_path(spark, "flat"), {}
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/x.bin") as f:
        f.write(b"\1\0\1\0\1\0\2\0" * 500)
    real = token_files.staged
    monkeypatch.setattr(token_files, "staged", lambda df, name, **more: tables.setdefault(name, real(df, name, **more)))
    got = token_files.count_tokens(spark.createDataFrame([("x.bin",)], "file string"), folder, 2, block_bytes=100)
    assert got.where("n_tokens = 3").count() == got.count() == 500
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and len(tables["token-blocks"].inputFiles()) > 2


def test_a_cut_off_file_is_an_error(spark):
    from pyarrow import fs

    folder = work_path(spark, "flat")
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/x.bin") as f:
        f.write(b"\1\0\1")
    with pytest.raises(Exception, match="no multiple"):
        token_files.count_tokens(spark.createDataFrame([("x.bin",)], "file string"), folder, 9).select(F.count("*")).collect()


def test_long_white_space(spark):
    """Runs that overflow the stack of the library's pattern; short ones are cut alike and equal the library."""
    encoding = token_files._encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(300):
        parts = [rng.choice([" ", "\n", "\u3000", " \n\t", "\x1c"]) * rng.choice([1, 2, 999, 1000, 1003]) + rng.choice(["", "x", "it's", "12", "é!"]) for _ in range(rng.randint(1, 5))]
        text = rng.choice(["", "a "]) + "".join(parts)
        assert token_files.encode_ordinary(encoding, text) == encoding.encode_ordinary(text)
    texts = ["x" + " " * 5_000_000 + "y", "\n" * 5_000_000, "q" * 5_000_000, ("a " * 1000 + " " * 2000 + "\n") * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_files.document_token_counts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, 50256).collect()}
    long = lambda text: len(encoding._encode_single_piece(text))
    assert got == {0: 1 + long(" " * 4_999_999) + len(encoding.encode_ordinary(" y")), 1: long("\n" * 5_000_000), 2: long("q" * 5_000_000), 3: len(encoding.encode_ordinary(texts[3]))}
