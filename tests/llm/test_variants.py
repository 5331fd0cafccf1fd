"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm import anagram_hash as m


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = plain_counts(rows)
    form, number = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        number[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, number[w], counts.get(form[w])))
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def drawn(seed, letters, n_docs=40, stems=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(stems)]
    for w in list(words):
        for _ in range(6):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            words.append(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[1:] + w[:1]]))
    weights = [rng.choice([1, 6, 40, 250]) for _ in words]
    return [(i, " ".join(rng.choices(words, weights, k=400)).replace(" a", rng.choice([" A", ", a"]))) for i in range(n_docs)]


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcde"), (3, "eéÉß×z"), (4, "aaab")])
def test_equals_plain_code(spark, seed, letters):
    rows = drawn(seed, letters)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(m.variants(df)) == plain(rows)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in df.collect()])
    assert got(m.variants(df)) == want and len(want) > 50


def test_a_chain_of_forms(spark):
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(5 ** (k + 1)))
    found = {w: (f, r) for w, f, r, *_ in got(m.variants(spark.createDataFrame([(None, text)], "doc_id bigint, text string")))}
    plainly = {w: (f, r) for w, f, r, *_ in plain([(None, text)])}
    assert found == plainly and {r for _, r in found.values()} == {"abjihg"}


def test_edge_rows(spark, edge, edge_rows, nothing):
    assert got(m.variants(edge)) == plain([(r[0], r[1]) for r in edge_rows])
    assert m.variants(nothing).collect() == []


def test_long_texts(spark, monkeypatch):
    """Stretches end beside runs; a word of many letters is one word."""
    monkeypatch.setattr(m, "STRETCH", 50)
    text = "Aardvark x " * 30 + "b" * 700 + " " + ("b" * 699 + "c ") * 3
    assert m.document_words(3, text, 1) == Counter(plainly(3, text))
    monkeypatch.setattr(m, "STRETCH", 1 << 20)
    big = "z" * 200_000
    rows = [(i, f"{big} {big[1:]} {'q' + big[1:]} " + "lorem ipsum " * 300_000 * (i == 0)) for i in range(6)]
    found = {(len(w), w[0], n, k) for w, _, _, n, k, _ in got(m.variants(spark.createDataFrame(rows, "doc_id bigint, text string")))}
    assert {x for x in found if x[0] > 10} == {(200_000, "z", 6, 2), (199_999, "z", 6, 2), (200_000, "q", 6, 2)}


def plainly(doc_id, text):
    counts = Counter()
    for run in re.findall("[A-Za-zÀ-ÿ]+", text):
        run = run.lower()
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return counts


def test_anagrams_do_not_meet(spark):
    """A large class of one key makes no pairs but the near ones."""
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefghij", 10)) for _ in range(3000)}
    df = spark.createDataFrame([(i, " ".join(words)) for i in range(7)], "doc_id bigint, text string")
    assert len({r.word for r in m.variants(df).collect()} & words) > 2950  # the others have lost a letter in three documents
    table = spark.createDataFrame(list(enumerate(sorted(words))), "word_id bigint, word string").selectExpr("*", "1L AS n")
    reduced = m._reductions(table)
    assert reduced.where("place >= 0").groupBy("key").count().agg({"count": "max"}).first()[0] > 2000
    assert reduced.where("place >= 0").groupBy("key", "rest", "place").count().agg({"count": "max"}).first()[0] == 1
