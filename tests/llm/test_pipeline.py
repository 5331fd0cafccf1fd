"""The five stages, one by one and together."""

import re

import corpus_pipeline
import public_tokenizers
import pytest
import tokenizers

from millrace.llm import pii_crf, queries


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture()
def folder(spark, tmp_path, edge):
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_the_columns(spark, edge, folder):
    docs = edge
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    assert stage("encode")(spark, docs, folder).count() == docs.count()


def test_decisions_take_effect(spark, edge, folder):
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    language = stage("language")(spark, edge, folder)
    assert not {1, 2, 3, 4} & set(ids(language)) and {0, 6, 7} <= set(ids(language))
    near = stage("near_duplicates")(spark, edge, folder)
    assert ids(near) == sorted([0, 1, 2, 3, 4, 5, 7, 8, 9, 11, None], key=repr)
    clean = stage("decontaminate")(spark, edge, folder)
    assert 9 not in ids(clean) and clean.count() == edge.count() - 1


def test_rows_that_share_an_id_or_have_none(spark):
    word = lambda k: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{k}x" for i in range(60))
    a, b, c, d = map(word, "abcd")
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, c), (None, c), (None, d), (None, d), (None, d + " more"), (4, "..."), (4, "..."), (4, "!"), (5, None), (None, None), (None, "..."), (None, "...")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in stage("near_duplicates")(spark, docs, "").collect()), key=repr)
    one = [x for x in got if x in ((None, d), (None, d + " more"))]
    assert len(one) == 1
    assert sorted(set(got) - set(one), key=repr) == sorted([(1, a), (1, b), (3, c), (4, "..."), (4, "!"), (5, None), (None, None), (None, "...")], key=repr)
    assert len(got) == 10 and got.count((None, "...")) == 2


def test_whole_run(spark, folder, nothing):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(len(r.token_ids) == r.n_tokens for r in rows)
    nothing.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_equals_plain_stages(spark):
    """The rows of the smallest tables by plain code: letters, pairwise sets, window sets, masks, and the tokenizers library."""
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t)]

    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(t) for _, t in rows)]
    label = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    for _ in range(10):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    rows = [r for i, r in enumerate(rows) if label[i] == i]

    ascii_words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[i : i + 10]) for w in map(ascii_words, items) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    rows = [(i, t) for i, t in rows if not any(tuple(w[k : k + n]) in windows for w in [ascii_words(t)] for n in sizes for k in range(len(w) - n + 1))]

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = pii_crf.find_all([t for _, t in rows], pii_crf.fitted())
    want = {i: library.encode(pii_crf.mask(t, base + more), add_special_tokens=False).ids for (i, t), (base, more) in zip(rows, found)}
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert links and got == want


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
