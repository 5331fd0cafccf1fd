"""Multiset hashes against plain Python."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import multiset_hash as m
from millrace.llm import queries


def vector(text):
    lanes = [0] * (m.IDENTITY + m.LANES)
    for line in (text or "").split("\n"):
        digest = hashlib.sha256(line.encode()).hexdigest()
        for k in range(m.IDENTITY):
            lanes[k] += int(digest[8 * k : 8 * k + 8], 16)
        for i in range(0, max(1, len(line)), m.BLOCK):
            w = ["", *line[i : i + m.BLOCK].split(" "), ""]
            for pair in {f"{a} {b}" for a, b in zip(w, w[1:])}:
                h = int(hashlib.md5(pair.encode()).hexdigest()[:2], 16)
                lanes[m.IDENTITY + h % m.LANES] += 1 if h >= m.LANES else -1
    return [x % m.MODULUS for x in lanes]


def like(a, b):
    if a[: m.IDENTITY] == b[: m.IDENTITY]:
        return 1.0
    half = m.MODULUS // 2
    x, y = ([(v + half) % m.MODULUS - half for v in z[m.IDENTITY :]] for z in (a, b))
    both = sum(v * v for v in x) + sum(v * v for v in y)
    return round(max(0.0, min(1.0, 2 * sum(p * q for p, q in zip(x, y)) / both)), 6) if both else 0.0


def written(lanes):
    return "".join(f"{x:08x}" for x in lanes)


def expected(rows):
    """Rows are (id, text), ids distinct and not null."""
    rows = sorted(rows, reverse=True)
    out = {}
    for i, (k, text) in enumerate(rows):
        text, beyond = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + beyond[:half]
        a, b, c = vector(text), vector(edited), vector(beyond)
        out[k] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), like(a, b), like(a, c))
    return out


def found(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect()}


def test_equals_plain_code(spark, edge_rows):
    texts = [r[1] for r in edge_rows[:10]]
    texts += ["x" * 20_000 + " tail of one line", "a\nb\nb", "b\na\nb", "🙂 é\n\n", " a  b "]
    rows = [(i * 7 % 97, t) for i, t in enumerate(texts)]
    assert found(m.edit_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))) == expected(rows)


def test_neighbours_over_many_ranges(spark):
    rows = [(i * i % 10_007 - 5000, f"words of {i % 5}\nand {i}") for i in range(0, 3000, 3)]
    rows = list({k: (k, t) for k, t in rows}.values())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert found(m.edit_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_order_insertion_and_deletion(spark):
    a, b, more = "one two\nthree four\n\nfive", "five\n\none two\nthree four", "six seven\nsix seven"
    got = spark.createDataFrame([(1, a), (2, b), (3, more), (4, f"{a}\n{more}"), (5, "one two\nthree four\nfive")], "doc_id int, text string")
    lanes = {r._id: r.lanes for r in m.fingerprints(got).collect()}
    assert lanes[1] == lanes[2] != lanes[5]
    two = spark.createDataFrame([(lanes[1], lanes[3], lanes[4])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = two.select(m.added(F.col("a"), F.col("b")).alias("sum"), m.removed(F.col("c"), F.col("b")).alias("rest"), m.likeness(F.col("a"), F.col("c")).alias("near")).first()
    assert r["sum"] == lanes[4] and r["rest"] == lanes[1] and 0.4 < r["near"] < 1
    assert {k: v for k, v in lanes.items()} == {k: vector(t) for k, t in [(1, a), (2, b), (3, more), (4, f"{a}\n{more}"), (5, "one two\nthree four\nfive")]}


def test_ties_nulls_and_clashing_names(spark, edge, edge_rows, nothing):
    got = m.edit_likeness(edge).collect()
    assert len(got) == len(edge_rows) and set(got[0].asDict()) == {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in got) == sorted((r[0] is None, r[0] or 0, written(vector(r[1]))) for r in edge_rows)
    twice = [r for r in got if r.doc_id == 0]
    assert len(twice) == 2 and max(r.near_next for r in twice) == 1.0
    alone = m.edit_likeness(spark.createDataFrame([(None, "a b c d")], "doc_id bigint, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest()
    assert m.edit_likeness(nothing).collect() == []


def test_long_texts(spark):
    """A line of some megabytes, lines by the hundred thousand."""
    rows = [(1, "word " * 400_000), (2, "\n" * 100_000 + "end"), (3, "x" * 2_000_000)]
    assert found(m.edit_likeness(spark.createDataFrame(rows, "doc_id bigint, text string"))) == expected(rows)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = queries.QUERIES["op13_fingerprints"](spark, sf)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op13_fingerprints']})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_one_exchange_of_texts_and_no_python(spark):
    plan = m.edit_likeness(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Single" not in plan
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("a,b,least,most", [("a b c d e f g h\n" * 9, "a b c d e f g h\n" * 8 + "q r s t", 0.8, 1.0), ("a b c d", "e f g h", 0.0, 0.5), ("", "", 1.0, 1.0), ("x", "", 0.0, 0.6)])
def test_likeness(spark, a, b, least, most):
    lanes = {r._id: r.lanes for r in m.fingerprints(spark.createDataFrame([(1, a), (2, b)], "doc_id int, text string")).collect()}
    assert least <= like(lanes[1], lanes[2]) <= most
