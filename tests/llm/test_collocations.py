"""Collocations against plain counts."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations as m
from millrace.llm import queries


def plain_counts(rows):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang][" ".join(words[i : i + k])] += 1
    return counts, totals


def plain(rows, least, top):
    out = []
    counts, totals = plain_counts(rows)
    for lang, found in counts.items():
        frequent = {p: f for p, f in found.items() if f >= least}
        longer = Counter()
        for q, f in frequent.items():
            w = q.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    p = " ".join(w[i : i + k])
                    longer[p] = max(longer[p], f)
        scored = []
        for p, a in frequent.items():
            w = p.split(" ")
            if len(w) < 2 or longer[p] >= a:
                continue
            cuts = [(1000 * a * totals[lang] // (frequent[" ".join(w[:k])] * frequent[" ".join(w[k:])]), k) for k in range(1, len(w))]
            value, k = min(cuts)
            scored.append((-value, -a, p.encode(), p, frequent[" ".join(w[:k])], frequent[" ".join(w[k:])]))
        for i, (value, a, _, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, p, -a, left, right, totals[lang], -value))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def drawn(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "x", "aa", "\x00q", "New", "york", "city", "🙂", "b\x1cb", "b\x0bb"]
    seps = [" "] * 12 + [". ", ",", "\n", "  ", "\t", " ; "]
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        docs.append((text + rng.choice(["", " New York City of lights", "a a a a a a a a"]), rng.choice(["en", "en", "en", "fr", None])))
    return docs + [(None, "en"), ("", "xx"), ("a b", "yy")]


@pytest.mark.parametrize("seed,group,cells,block", [(1, 1 << 20, 1 << 15, 1 << 22), (2, 64, 1 << 15, 200), (3, 256, 1 << 10, 60)])
def test_equals_plain_code(spark, monkeypatch, seed, group, cells, block):
    """Also with parts of a few words, shares of a small sketch that is full, and many small automata."""
    monkeypatch.setattr(m, "GROUP", group)
    monkeypatch.setattr(m, "BLOCK_BYTES", block)
    monkeypatch.setattr(m, "ROUND_BYTES", 2 * block)
    monkeypatch.setattr(m, "HELD", 50 if seed > 1 else 1 << 20)
    monkeypatch.setattr(m, "SLICE", 1 << 8 if seed == 3 else 1 << 15)
    rows = drawn(seed)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    least = 6
    table, totals = m.phrase_counts(df, least=least, most_cells=cells)
    counts, words = plain_counts(rows)
    assert {(r.lang, r.phrase): r.f for r in table.collect()} == {(g, p): f for g, c in counts.items() for p, f in c.items() if f >= least}
    assert {r.lang: r.n for r in totals.collect() if r.n} == {g: n for g, n in words.items() if n}
    assert got(m.ranked(table, totals, 15)) == plain(rows, least, 15)


def test_a_full_sketch_lets_more_through(spark, monkeypatch):
    monkeypatch.setattr(m, "SLICE", 8)
    corpus = m._corpus(spark.createDataFrame(drawn(4), "text string, lang string"), "text", "lang", 0)
    hot = m.hot_cells(corpus, 16, 6, 1, 0)
    loose = {(r.lang, r.phrase) for r in m.candidates(corpus, hot, 16, 1, 0).where("phrase is not null").collect()}
    counts, _ = plain_counts(drawn(4))
    assert {(g, p) for g, c in counts.items() for p, f in c.items() if f >= 6} <= loose


def test_shares_cover_all(spark, monkeypatch):
    """A sketch of bounded size takes the corpus in shares."""
    monkeypatch.setattr(m, "SLICE", 1 << 8)
    rows = drawn(6, 400)
    df = spark.createDataFrame(rows, "text string, lang string")
    size = sum(len((t or "").encode()) for t, _ in rows)
    assert m.WORDS * size / 5 / (m.LOAD * 10) > 3 * 256
    assert got(m.ranked(*m.phrase_counts(df, least=10, most_cells=1 << 8), 50)) == plain(rows, 10, 50)


def test_edge_rows(spark, edge, edge_rows, nothing):
    assert got(m.collocations(edge, least=2, top=100)) == plain([(r[1], r[2]) for r in edge_rows], 2, 100)
    assert m.collocations(nothing).collect() == []


def test_exact_scores(spark):
    cases = [(10**13, 10**15, 3 * 10**13, 7 * 10**12), (100, 5, 3, 7), (2**40, 2**45, 2**41 + 1, 2**42 + 3), (10**12, 10**14, 10**12, 10**12)]
    df = spark.createDataFrame(cases, "a bigint, n bigint, l bigint, r bigint")
    assert [r.s for r in df.select(m.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()] == [1000 * a * n // (x * y) for a, n, x, y in cases]


def test_long_texts(spark):
    """Megabytes in one piece, one word of megabytes, many pieces; ties at cuts."""
    rows = [("to be or not " * 300_000, "en"), ("y" * 3_000_000, "en"), (";" * 1_000_000 + " to be", "en"), (" " * 2_000_000 + "to be", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert got(m.collocations(df)) == plain(rows, 100, 2000)


def test_counters_stop(monkeypatch):
    """Sixteen bits don't wrap, however often a place is raised."""
    row = np.zeros(4, np.uint16)
    m.raise_all(row, np.array([2] * 200_000 + [1] * 3, np.uint64))
    assert row.tolist() == [0, 3, m._FULL - 1, 0]


def test_counts_past_sixteen_bits(spark):
    """Phrases of 2^16 occurrences and some more in one task are as frequent as they are."""
    n = 65_536 + 50
    df = spark.createDataFrame([("zq ;" * 50, "en")] + [("zq ;" * 1024, "en")] * 64, "text string, lang string").coalesce(1)
    assert [tuple(r) for r in m.phrase_counts(df)[0].collect()] == [("en", "zq", n)]


def test_readings_do_not_grow(spark, monkeypatch):
    """However full the sketch, the corpus is read a fixed number of times; counts stay exact, and those by automata are the same."""
    read = []
    for name in ("hot_cells", "candidates"):
        monkeypatch.setattr(m, name, lambda *a, f=getattr(m, name): read.append(f.__name__) or f(*a))
    monkeypatch.setattr(m, "SLICE", 1 << 6)
    monkeypatch.setattr(m, "ROUND_BYTES", 100)
    monkeypatch.setattr(m, "BLOCK_BYTES", 100)
    rows = drawn(7, 400)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    found = {(r.lang, r.phrase): r.f for r in m.phrase_counts(df, least=10, most_cells=1 << 6)[0].collect()}
    assert found == {(g, p): f for g, c in plain_counts(rows)[0].items() for p, f in c.items() if f >= 10}
    assert len(read) <= 2 * m.SHARES
    some = spark.createDataFrame([k for k in sorted(found)[::40]], "lang string, phrase string")
    counted = m.listed_counts(m._corpus(df, "text", "lang", 0), some, 10)
    assert {(r.lang, r.phrase): r.f for r in counted.collect()} == {k: found[k] for k in sorted(found)[::40]}


def test_overlaps_across_parts(monkeypatch):
    monkeypatch.setattr(m, "GROUP", 8 * 7)
    phrases = ["a", "a a", "a a a a a", "a b"]
    counts = np.zeros(4, np.int64)
    m.tally(m.automaton(phrases), m.tokens_of(b"a " * 50 + b"b, " + b"a a." * 3), counts)
    assert counts.tolist() == [56, 52, 46, 1]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({queries.ORACLE_SQL['op11_collocations']})").fetchall()
    assert got(queries.QUERIES["op11_collocations"](spark, sf)) == sorted(want) and want
