"""The queries of this subpackage: thin ones over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat token files."""
    from millrace.llm.token_files import document_token_counts

    docs = table(spark, sf_dir, "documents")
    return document_token_counts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, eod=50256).select("doc_id", "n_tokens")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from millrace.llm.main_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    from millrace.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: five-word shingles, similarity 0.8 or more."""
    from millrace.llm.dart_minhash import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: pattern spans and those of the network."""
    from millrace.llm.secret_cnn import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: pattern spans and those of the field."""
    from millrace.llm.pii_crf import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover."""
    from millrace.llm.decontaminate import contaminated_documents, with_digest

    found = contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return with_digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Windows of an item and stretches of a document are compared as joined words.
OP7_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wanted AS (
    SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS stretch
    FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)
), stretches AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS stretch
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, item, i, n FROM stretches JOIN wanted USING (n, stretch)
), per_item AS (
    SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
), per_word AS (
    SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN per_item USING (doc_id) LEFT JOIN per_word USING (doc_id)
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from archives through their index."""
    from millrace.llm.warc_index import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM o
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learnt outside the held-out third."""
    from millrace.llm.langid_kn import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    from millrace.llm.quality_trees import fit, judge_documents

    docs = table(spark, sf_dir, "documents")
    found = judge_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    from millrace.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), counts AS (
    SELECT lang, k, p, count(*)::HUGEINT AS f
    FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS p FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)
    GROUP BY ALL HAVING count(*) >= 100
), phrases AS (
    SELECT lang, k, p, f, string_split(p, ' ') AS w FROM counts WHERE k > 1
), cuts AS (
    SELECT x.lang, x.p, x.f AS a, c, l.f AS l, r.f AS r, n, 1000 * x.f * n // (l.f * r.f) AS score
    FROM (SELECT *, unnest(range(1, k)) AS c FROM phrases) x JOIN totals USING (lang)
    JOIN counts l ON l.lang = x.lang AND l.p = array_to_string(w[1 : c], ' ') JOIN counts r ON r.lang = x.lang AND r.p = array_to_string(w[c + 1 :], ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1
), inner_ AS (
    SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS p, max(f) AS longer
    FROM (SELECT lang, w, f, s, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM phrases)) GROUP BY ALL
), stay AS (
    SELECT * FROM best LEFT JOIN inner_ USING (lang, p) WHERE longer IS NULL OR longer < a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM stay QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) <= 2000
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent form that each is a variant of."""
    from millrace.llm.anagram_hash import variants

    return variants(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how like they are."""
    from millrace.llm.multiset_hash import edit_likeness

    return edit_likeness(table(spark, sf_dir, "documents"))


#: Lanes 0-7 are sums of SHA-256 words of lines, lanes 8-135 sums of signs of word pairs.
OP13_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), e AS (
    SELECT doc_id, n, text, left(text, n - n // 2) || left(coalesce(lead(text) OVER w, first(text) OVER (ORDER BY doc_id DESC)), n // 2) AS edited,
           coalesce(lead(doc_id) OVER w, first(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id
    FROM d WINDOW w AS (ORDER BY doc_id DESC)
), lines AS (
    SELECT doc_id, side, row_number() OVER () AS i, line
    FROM (SELECT doc_id, 0 AS side, unnest(string_split(text, chr(10))) AS line FROM e UNION ALL SELECT doc_id, 1, unnest(string_split(edited, chr(10))) FROM e)
), whole AS (
    SELECT doc_id, side, k AS lane, ('0x' || substr(sha256(line), 8 * k + 1, 8))::BIGINT AS value FROM lines, (SELECT unnest(range(8)) AS k)
), words AS (
    SELECT doc_id, side, string_split(substr(line, 8192 * b + 1, 8192), ' ') AS w
    FROM (SELECT doc_id, side, line, unnest(range(greatest(1, (length(line) + 8191) // 8192))) AS b FROM lines)
), pairs AS (
    SELECT doc_id, side, unnest(list_distinct(list_transform(range(0, len(w) + 1), lambda i: coalesce(w[i], '') || ' ' || coalesce(w[i + 1], '')))) AS pair FROM words
), signs AS (
    SELECT doc_id, side, 8 + h % 128 AS lane, CASE WHEN h >= 128 THEN 1 ELSE -1 END AS value FROM (SELECT doc_id, side, ('0x' || substr(md5(pair), 1, 2))::BIGINT AS h FROM pairs)
), sums AS (
    SELECT doc_id, side, lane, sum(value)::HUGEINT AS v FROM (SELECT * FROM whole UNION ALL SELECT * FROM signs) GROUP BY ALL
), lanes AS (
    SELECT doc_id, side, list(v ORDER BY lane) AS v
    FROM (SELECT doc_id, side, lane, coalesce(v, 0) AS v FROM (SELECT DISTINCT doc_id, side FROM sums) CROSS JOIN (SELECT unnest(range(136)) AS lane) LEFT JOIN sums USING (doc_id, side, lane))
    GROUP BY doc_id, side
), joined AS (
    SELECT e.doc_id, e.n, e.edited, a.v AS a, b.v AS b, c.v AS c
    FROM e JOIN lanes a ON a.doc_id = e.doc_id AND a.side = 0 JOIN lanes b ON b.doc_id = e.doc_id AND b.side = 1 JOIN lanes c ON c.doc_id = e.next_id AND c.side = 0
), dots AS (
    SELECT *, list_dot_product(a[9:]::DOUBLE[], a[9:]::DOUBLE[]) AS aa, list_dot_product(b[9:]::DOUBLE[], b[9:]::DOUBLE[]) AS bb, list_dot_product(c[9:]::DOUBLE[], c[9:]::DOUBLE[]) AS cc,
           list_dot_product(a[9:]::DOUBLE[], b[9:]::DOUBLE[]) AS ab, list_dot_product(a[9:]::DOUBLE[], c[9:]::DOUBLE[]) AS ac,
           list_transform(a[1:8], lambda x: x % 4294967296) AS ia, list_transform(b[1:8], lambda x: x % 4294967296) AS ib, list_transform(c[1:8], lambda x: x % 4294967296) AS ic
    FROM joined
)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(list_transform(a, lambda x: printf('%08x', ((x % 4294967296 + 4294967296) % 4294967296)::BIGINT)), '') AS fingerprint,
       array_to_string(list_transform(b, lambda x: printf('%08x', ((x % 4294967296 + 4294967296) % 4294967296)::BIGINT)), '') AS edited_fingerprint,
       CASE WHEN ia = ib THEN 1.0::DOUBLE WHEN aa + bb = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, ab * 2 / (aa + bb))), 6) END AS near_edited,
       CASE WHEN ia = ic THEN 1.0::DOUBLE WHEN aa + cc = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, ac * 2 / (aa + cc))), 6) END AS near_next
FROM dots
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_main_text": op2_main_text,
    "op3_bpe": op3_bpe,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_secrets": op5_secrets,
    "op6_personal_data": op6_personal_data,
    "op7_decontaminate": op7_decontaminate,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op7_decontaminate": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op13_fingerprints": OP13_SQL,
}
