"""All queries over the driver's tables, with the SQL each must agree with.

``QUERIES`` holds thin callables over the operators; ``ORACLE_SQL`` states the
same results independently in DuckDB SQL.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import arrays, numeric, signal, text, tokens
from millrace.operators import batches, cache, checkpoints, conversion, losses, metrics, scores, shards, splits, staging, validate
from millrace.sources import archives, files, framed, keyed, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VALIDATION_SHARE, BASE_VOCAB, BUDGET, CHUNK = 0.05, 32_000, 1_000_000_000, 16
KHMER_SAMPLES = [
    (-1, "តម្លៃ $37 ក្នុងឆ្នាំ 1998 ។"), (-2, "ថ្ងៃទី 17 ខែសីហា ឆ្នាំ 2031"), (-3, "28-11/1975"), (-4, "៛ 812.50"), (-5, "640,000 រៀល"),
    (-6, "83"), (-7, "7000300"), (-8, "00"), (-9, "ab7 44 2.71, 15cm 008 -3 6,500 12%"), (-10, "៛9។yes"), (-11, "លេខ ០១២ ៤៥៦ ៧៨៩"), (-12, ""),
]
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in KHMER_SAMPLES)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clips: the audio columns follow from id and length."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("clip_id"), "doc_id", "text",
        F.when(F.col("doc_id") % 17 != 0, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))).alias("audio_path"),
        (F.col("n_chars") / 15.0).alias("duration_seconds"),
        F.when(F.col("doc_id") % 13 == 0, 16000).otherwise(24000).alias("sample_rate"), F.col("source").alias("speaker"),
    )


MANIFEST_SQL = """m AS (
    SELECT 'doc_' || doc_id AS clip_id, doc_id, text, CASE WHEN doc_id % 17 <> 0 THEN source || '/' || doc_id || '.wav' END AS audio_path,
           n_chars / 15.0::DOUBLE AS duration_seconds, CASE WHEN doc_id % 13 = 0 THEN 16000 ELSE 24000 END AS sample_rate, source AS speaker
    FROM documents
), s AS (
    SELECT *, CASE WHEN ('0x' || substr(sha256(clip_id), 1, 8))::BIGINT % 10000 < 500 THEN 'validation' ELSE 'train' END AS split FROM m
)"""


@query(f"WITH {MANIFEST_SQL} SELECT clip_id, split FROM s")
def split_assignment(spark, sf_dir):
    return splits.assign_splits(manifest_view(spark, sf_dir), VALIDATION_SHARE).select("clip_id", "split")


@query(f"WITH {MANIFEST_SQL} SELECT v.split, count(s.split) AS n FROM (VALUES ('train'), ('validation')) v(split) LEFT JOIN s ON s.split = v.split GROUP BY v.split")
def split_counts(spark, sf_dir):
    return splits.split_counts(splits.assign_splits(manifest_view(spark, sf_dir), VALIDATION_SHARE))


@query(f"""WITH {MANIFEST_SQL} SELECT count(*) AS clips, round(sum(duration_seconds) / 3600, 6) AS hours, count(*) FILTER (split = 'train') AS train,
    count(*) FILTER (split = 'validation') AS validation, count(speaker) AS with_speaker, round(100.0 * count(speaker) / greatest(count(*), 1), 6) AS speaker_percent FROM s""")
def manifest_totals(spark, sf_dir):
    found = splits.manifest_totals(splits.assign_splits(manifest_view(spark, sf_dir), VALIDATION_SHARE))
    return found.withColumns({"hours": F.round("hours", 6), "speaker_percent": F.round("speaker_percent", 6)})


_RUNS = f"{tokens.KHMER_CLASS}+|{tokens.OTHER_CLASS}+"


@query(f"""SELECT doc_id, len(r) AS n_runs, len(list_filter(r, lambda x: regexp_matches(x, '^{tokens.KHMER_CLASS}'))) AS n_khmer, sha256(array_to_string(r, '|')) AS runs_sha256
    FROM (SELECT doc_id, regexp_extract_all(text, '{_RUNS}') AS r FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_VALUES})))""")
def script_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(KHMER_SAMPLES, "doc_id bigint, text string"))
    r = rows.select("doc_id", tokens.script_runs(F.col("text")).alias("r"))
    return r.select("doc_id", F.size("r").cast("bigint").alias("n_runs"), F.size(F.filter("r", lambda x: x["kind"] == "khmer")).cast("bigint").alias("n_khmer"), F.sha2(F.array_join(F.transform("r", lambda x: x["chunk"]), "|"), 256).alias("runs_sha256"))


@query("""SELECT doc_id, len(b) AS n_ids, sha256(array_to_string(list_transform(b, lambda h: least(('0x' || h)::INT + 3, 31999)), ',')) AS ids_sha256
    FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)""")
def byte_tokens(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id", tokens.byte_ids(F.col("text"), BASE_VOCAB).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))


@query("SELECT conv_id, turn, sha256(text) AS text_sha256 FROM conversations")
def byte_round_trip(spark, sf_dir):
    """Texts to byte ids and back; the SQL digests the texts themselves."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(tokens.byte_text(tokens.byte_ids(F.col("text"))), 256).alias("text_sha256"))


@query("SELECT o_orderkey, array_to_string(list_filter([o_orderkey % 7, o_custkey % 9, 4, 5, o_orderkey % 3], lambda i: i > 4), ',') AS kept FROM orders")
def reserved_filter(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k, F.concat_ws(",", tokens.drop_reserved(F.array(k % 7, c % 9, F.lit(4).cast("bigint"), F.lit(5).cast("bigint"), k % 3)).cast("array<string>")).alias("kept"))


@query("""WITH c AS (SELECT conv_id, turn, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS ch FROM conversations),
    f AS (SELECT ch, min((conv_id, turn, pos)) AS first FROM c GROUP BY ch)
    SELECT ch AS char, CAST(4 + row_number() OVER (ORDER BY first) AS INT) AS id FROM f""")
def char_vocab(spark, sf_dir):
    return tokens.char_vocabulary(table(spark, sf_dir, "conversations"), "text", "conv_id", "turn")


@query("SELECT o_orderkey, o_custkey % 8000 + 32000 AS extended, o_custkey % 8000 AS back, (o_custkey % 40000) >= 32000 AS is_added, (o_orderkey % 40000) < 32000 AS is_original FROM orders")
def id_offsets(spark, sf_dir):
    ext = tokens.to_extended(F.col("o_custkey") % tokens.KHMER_SIZE, BASE_VOCAB)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", ext.alias("extended"))
    return rows.select("o_orderkey", "extended", tokens.from_extended(F.col("extended"), BASE_VOCAB).alias("back"), tokens.is_extended(F.col("o_custkey") % 40_000, BASE_VOCAB).alias("is_added"), tokens.is_original(F.col("o_orderkey") % 40_000, BASE_VOCAB).alias("is_original"))


@query("""WITH t AS (SELECT l_orderkey, l_partkey >= 100 AS khmer, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey, khmer ORDER BY pos) AS g FROM t),
    r AS (SELECT l_orderkey, khmer, g, min(pos) AS first_pos, count(*) AS n_ids FROM i GROUP BY ALL)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_pos) - 1 AS run, khmer, first_pos, n_ids FROM r""")
def decode_runs(spark, sf_dir):
    dense = batches.ordinals(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", by=("l_orderkey",), name="pos")
    return tokens.decode_runs(dense, "l_orderkey", "pos", "l_partkey", 100)


_REASON = """CASE WHEN audio_path IS NULL OR audio_path = '' THEN 'missing_audio_path' WHEN text IS NULL OR trim(text, ' \t\n\r') = '' THEN 'empty_text' WHEN length(text) > 500 THEN 'text_too_long'
    WHEN duration_seconds < 0.3 THEN 'audio_too_short' WHEN duration_seconds > 30.0 THEN 'audio_too_long' WHEN sample_rate <> 24000 THEN 'unexpected_sample_rate_' || sample_rate END"""


def _validated(spark, sf_dir):
    """Verdicts in the order of the manifest, which here is that of the ids."""
    rows = manifest_view(spark, sf_dir).withColumn("ids", tokens.byte_ids(F.col("text"), BASE_VOCAB))
    return validate.validate(rows, place="doc_id", ids=F.col("ids"), vocab_size=tokens.vocabulary_total(BASE_VOCAB))


@query(f"WITH {MANIFEST_SQL} SELECT clip_id, {_REASON} AS reason FROM m")
def validation_reasons(spark, sf_dir):
    return _validated(spark, sf_dir).select("clip_id", "reason")


@query(f"WITH {MANIFEST_SQL}, v AS (SELECT doc_id, {_REASON} AS reason FROM m) SELECT reason, count(*) AS n, min(doc_id) AS first, (SELECT count(*) FROM v) AS total, (SELECT count(*) FROM v WHERE reason IS NULL) AS ok FROM v WHERE reason IS NOT NULL GROUP BY reason")
def validation_summary(spark, sf_dir):
    return validate.summary(_validated(spark, sf_dir), "doc_id")


@query(f"""WITH {MANIFEST_SQL}, v AS (SELECT doc_id, {_REASON} AS reason FROM m), r AS (SELECT reason, count(*) AS n, min(doc_id) AS first FROM v WHERE reason IS NOT NULL GROUP BY reason)
    SELECT (SELECT count(reason IS NULL OR NULL) || '/' || count(*) || ' samples passed validation.' FROM v) || (SELECT string_agg(chr(10) || '  ' || reason || ': ' || n, '' ORDER BY n DESC, first) FROM r) AS report""")
def validation_report(spark, sf_dir):
    return validate.report(_validated(spark, sf_dir), "doc_id")


@query(f"WITH {MANIFEST_SQL} SELECT clip_id FROM m WHERE ({_REASON}) IS NULL")
def usable_clips(spark, sf_dir):
    return validate.usable(manifest_view(spark, sf_dir)).select("clip_id")


@query(f"SELECT o_orderkey, translate(o_custkey::VARCHAR, '0123456789', '{text.KHMER_DIGITS}') AS khmer, o_custkey::VARCHAR AS back FROM orders")
def khmer_digits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.translate(F.col("o_custkey").cast("string"), "0123456789", text.KHMER_DIGITS).alias("khmer"))
    return rows.withColumn("back", text.khmer_digits_to_ascii(F.col("khmer")))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_words(digits: str) -> str:
    """Number words in DuckDB SQL: six digits at a time, from tables of words by place."""
    silent = ["", *text.DIGIT_WORDS[1:]]
    rows = [[w and w + u for w in silent] for u in text.UNIT_WORDS] + [text.TENS_WORDS, silent]
    group = " || ".join(f"{_sql_list(r)}[g[{i + 1}]::INT + 1]" for i, r in enumerate(rows))
    bare = f"ltrim({digits}, '0')"
    padded = f"lpad({bare}, (ceil(length({bare}) / 6.0) * 6)::INT, '0')"
    return f"CASE WHEN {bare} = '' THEN '{text.DIGIT_WORDS[0]}' ELSE array_to_string(list_transform(regexp_extract_all({padded}, '[0-9]{{6}}'), lambda g: {group}), '{text.MILLION}') END"


_BIG = "(o_orderkey * o_custkey * 7919 * (1 + o_orderkey % 3) - CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey * o_custkey * 7919 * (1 + o_orderkey % 3) * 2 ELSE 0 END)"


@query(f"SELECT o_orderkey, CASE WHEN n < 0 THEN '{text.MINUS}' ELSE '' END || {_sql_words('abs(n)::VARCHAR')} AS words FROM (SELECT o_orderkey, {_BIG} AS n FROM orders)")
def number_words(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = k * c * 7919 * (1 + k % 3)
    return table(spark, sf_dir, "orders").select(k, text.integer_words(F.when(k % 11 == 0, -n).otherwise(n)).alias("words"))


@query(f"""SELECT p_partkey, {_sql_words("split_part(p_retailprice::DECIMAL(18, 2)::VARCHAR, '.', 1)")} || '{text.POINT}' ||
    array_to_string(list_transform(string_split(split_part(p_retailprice::DECIMAL(18, 2)::VARCHAR, '.', 2), ''), lambda d: {_sql_list(text.DIGIT_WORDS)}[d::INT + 1]), '') AS words FROM part""")
def decimal_words(spark, sf_dir):
    parts = F.split(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), r"\.")
    return table(spark, sf_dir, "part").select("p_partkey", text.decimal_words(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("words"))


_PRICE = "split_part(o_totalprice::DECIMAL(18, 2)::VARCHAR, '.', {})"
_MONTH = f"{_sql_list(text.MONTHS)}[month(o_orderdate::DATE)]"


@query(f"""SELECT o_orderkey, 'due ' || {_sql_words(_PRICE.format(1))} || '{text.DOLLAR}' || '{text.POINT}' || array_to_string(list_transform(string_split({_PRICE.format(2)}, ''), lambda d: {_sql_list(text.DIGIT_WORDS)}[d::INT + 1]), '')
    || ' by {text.DAY}' || {_sql_words("day(o_orderdate::DATE)::VARCHAR")} || ' {text.MONTH}' || {_MONTH} || ' {text.YEAR}' || {_sql_words("year(o_orderdate::DATE)::VARCHAR")}
    || ' or ' || {_sql_words("o_custkey::VARCHAR")} || '{text.RIEL} for ' || {_sql_words("o_orderkey::VARCHAR")} || ', not 5km' AS normalized FROM orders""")
def normalize_amounts(spark, sf_dir):
    """Dollars, a date, riel and a plain number in one text per order; the SQL builds the words on its own."""
    d = F.col("o_orderdate").cast("date")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = F.concat(F.lit("due  $"), price, F.lit(" by "), F.date_format(d, "d/M/yyyy"), F.lit("\tor ៛"), F.col("o_custkey").cast("string"), F.lit(" for "), F.translate(F.col("o_orderkey").cast("string"), "0123456789", text.KHMER_DIGITS), F.lit(", not 5km "))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normalize(raw).alias("normalized"))


#: Characters of the added vocabulary in the next queries, with ids from 3 on; the first two are reserved ids.
_CHARS = "កខគឃងចឆជឈញដឋឌឍណតថទធនបផពភមយរលវសហឡអ"
_CHAR_IDS = {c: 3 + i for i, c in enumerate(_CHARS)}
_MIXED = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_VALUES}))"


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(KHMER_SAMPLES, "doc_id bigint, text string"))


def _mixed_ids():
    return tokens.encode_mixed(F.col("text"), F.create_map(*(F.lit(x) for kv in _CHAR_IDS.items() for x in kv)), BASE_VOCAB)


@query(f"""SELECT doc_id, len(ids) AS n_ids, sha256(array_to_string(ids, ',')) AS ids_sha256, len(list_filter(ids, lambda i: i >= {BASE_VOCAB})) AS n_added FROM (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '[\u1780-\u17FF\u19E0-\u19FF]+|[^\u1780-\u17FF\u19E0-\u19FF]+'),
    lambda r: CASE WHEN unicode(r) BETWEEN 6016 AND 6143 OR unicode(r) BETWEEN 6624 AND 6655
        THEN list_transform(list_filter(list_transform(string_split(r, ''), lambda c: coalesce(nullif(instr('{_CHARS}', c), 0) + 2, 1)), lambda i: i > 4), lambda i: i + {BASE_VOCAB})
        ELSE list_transform(regexp_extract_all(hex(encode(r)), '..'), lambda h: ('0x' || h)::BIGINT + 3) END)) AS ids FROM {_MIXED})""")
def mixed_encode(spark, sf_dir):
    rows = _mixed(spark, sf_dir).select("doc_id", tokens.checked_ids(_mixed_ids(), tokens.vocabulary_total(BASE_VOCAB)).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.size(F.filter("ids", lambda i: tokens.is_extended(i, BASE_VOCAB))).cast("bigint").alias("n_added"))


@query(f"""SELECT doc_id, sha256(array_to_string(list_filter(string_split(text, ''), lambda c: NOT (unicode(c) BETWEEN 6016 AND 6143 OR unicode(c) BETWEEN 6624 AND 6655) OR instr('{_CHARS[2:]}', c) > 0), '')) AS text_sha256 FROM {_MIXED}""")
def mixed_decode(spark, sf_dir):
    """Mixed ids back to text; added characters without an id, or with a reserved one, are gone."""
    chars = F.create_map(*(F.lit(x) for c, i in _CHAR_IDS.items() for x in (i, c)))
    ids = _mixed(spark, sf_dir).select("doc_id", _mixed_ids().alias("ids"))
    return ids.select("doc_id", F.sha2(tokens.decode_mixed(F.col("ids"), chars, BASE_VOCAB), 256).alias("text_sha256"))


@query("SELECT c_nationkey AS list, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ordinal, 'x/' || c_custkey || '.flac' AS relpath, (c_custkey * 8 + 16000)::BIGINT AS num_samples FROM customer")
def list_scan(spark, sf_dir):
    """Customers written as a sample list for each nation, below a header line, and read by the lists' reader."""
    path = staging.scratch(spark, "list")
    k, n = F.col("c_custkey").cast("bigint"), F.col("c_nationkey")
    customers = table(spark, sf_dir, "customer")
    lines = customers.select(n, k.alias("at"), F.concat(F.lit("x/"), k.cast("string"), F.lit(".flac\t"), (k * 8 + 16_000).cast("string")).alias("value"))
    heads = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.lit(-1).cast("bigint").alias("at"), F.lit("/root").alias("value"))
    lines.unionByName(heads).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "at").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    found = files.sample_list(spark, path, keep_file=True)
    return found.select(F.regexp_extract("file", "c_nationkey=([0-9]+)", 1).cast("int").alias("list"), F.col("ordinal").cast("bigint").alias("ordinal"), "relpath", F.col("num_samples").cast("bigint").alias("num_samples"))


@query("SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents")
def manifest_scan(spark, sf_dir):
    """Documents written as JSON arrays and read back in blocks that cut through records, strings and escapes."""
    path = staging.scratch(spark, "manifest")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    sinks.manifest(rows.withColumn("text", F.concat(F.lit('"[{\\\\'), "text")), path)
    back = files.manifest(spark, path, schema=rows.schema, block_bytes=1 << 16)
    return back.select("doc_id", "lang", "source", "n_chars", F.sha2(F.substring("text", 6, 1 << 30), 256).alias("text_sha256"))


@query("SELECT page_id, octet_length(encode(html)) AS n_bytes, sha256(html) AS html_sha256 FROM pages")
def archive_scan(spark, sf_dir):
    """Pages written as tar archives and read back by their index."""
    path = staging.scratch(spark, "archives")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.col("html").alias("content"))
    archives.write_tar(pages, path)
    found = archives.tar_members(spark, path, task_bytes=1 << 20)
    return found.select(F.regexp_extract("member", r"(\d+)\.html", 1).cast("bigint").alias("page_id"), F.octet_length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("html_sha256"))


@query("""SELECT doc_id, len(l)::BIGINT AS n_sentences, sha256(array_to_string(l, '|')) AS texts_sha256, list_sum(list_transform(l, lambda x: length(x) * 40000 + 7))::BIGINT AS total
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def framed_scan(spark, sf_dir):
    """Documents written as framed messages of sentences and read back in pieces that begin at frames."""
    path = staging.scratch(spark, "framed")
    line = lambda k: F.struct(F.array(k).alias("texts"), F.array(F.array(F.length(k) * 40_000, F.lit(7))).alias("semantics"))
    head = F.struct(F.array(F.col("doc_id").cast("string")).alias("texts"), F.expr("array(array(0))").alias("semantics"))
    framed.write_sentences(table(spark, sf_dir, "documents").select(F.concat(F.array(head), F.transform(F.split("text", "\n"), line)).alias("sentences")), path)
    back = framed.packed_sentences(spark, path, piece_bytes=1 << 16).select(F.get("sentences", F.lit(0))["texts"][0].cast("bigint").alias("doc_id"), F.expr("slice(sentences, 2, size(sentences) - 1)").alias("s"))
    total = F.aggregate(F.flatten(F.flatten(F.transform("s", lambda s: F.transform(s["semantics"], lambda v: v["values"])))), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return back.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.sha2(F.array_join(F.transform("s", lambda s: s["texts"][0]), "|"), 256).alias("texts_sha256"), total.alias("total"))


@query("SELECT event_id, user_id FROM events WHERE event_id <= 700")
def step_cap(spark, sf_dir):
    return metrics.capped_steps(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 700)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def last_lines(spark, sf_dir):
    return metrics.last_lines(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def preview(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("less"))
    return metrics.preview(rows, "less", "o_orderkey").drop("less")


@query("SELECT c_custkey, regexp_replace(c_name, '#0*([0-9]+)', '-\\1') AS line FROM customer")
def patched_lines(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.patched(F.col("c_name"), "#0*([0-9]+)", "-$1").alias("line"))


@query("SELECT event_id, value < coalesce(min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS improved FROM events")
def best_overall(spark, sf_dir):
    """One global order over ranges, without a window in one task."""
    return metrics.best_so_far(table(spark, sf_dir, "events"), "value", "event_id").select("event_id", "improved")


@query("SELECT event_id, step FROM (SELECT event_id, step, lag(step) OVER (ORDER BY event_id) AS before FROM (SELECT event_id, event_id // 100 % 5 AS step FROM events) WHERE step > 0) WHERE step IS DISTINCT FROM before")
def new_steps_overall(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.floor(F.col("event_id") / 100) % 5).alias("step"))
    return metrics.new_steps(rows, "step", "event_id").select("event_id", "step")


@query()
def normalize_text(spark, sf_dir):
    """Rows only: the five passes use lookbehind, which DuckDB's expressions lack; tests hold a plain model against it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(KHMER_SAMPLES, "doc_id bigint, text string"))
    return rows.select("doc_id", text.normalize(F.col("text")).alias("normalized"))


_ORDERED = "o AS (SELECT clip_id, (duration_seconds * 50400.0)::DOUBLE AS d, row_number() OVER (ORDER BY sha256(clip_id), clip_id) AS i FROM m), z AS (SELECT clip_id, i, trunc(d)::BIGINT AS bytes FROM o)"
_FOLD = f"""w(i, clip_id, bytes, shard, used) AS (
    SELECT i, clip_id, bytes, 0, bytes FROM z WHERE i = 1
    UNION ALL SELECT z.i, z.clip_id, z.bytes, CASE WHEN w.used + z.bytes > {BUDGET} THEN w.shard + 1 ELSE w.shard END, CASE WHEN w.used + z.bytes > {BUDGET} THEN z.bytes ELSE w.used + z.bytes END
    FROM w JOIN z ON z.i = w.i + 1)"""


def _planned(spark, sf_dir):
    return shards.plan_shards(manifest_view(spark, sf_dir).select("clip_id", "duration_seconds"), BUDGET, 50_400.0)


_PLAN_SQL = f"WITH RECURSIVE {MANIFEST_SQL}, {_ORDERED}, {_FOLD}"


@query(f"{_PLAN_SQL} SELECT clip_id, bytes, shard FROM w")
def shard_plan(spark, sf_dir):
    return _planned(spark, sf_dir)


@query(f'{_PLAN_SQL} SELECT shard AS "index", count(*) AS n_clips, sum(bytes)::BIGINT AS total_audio_bytes FROM w GROUP BY shard')
def shard_table(spark, sf_dir):
    return shards.shard_table(_planned(spark, sf_dir))


@query(f'{_PLAN_SQL} SELECT DISTINCT shard AS "index" FROM w WHERE shard % 3 <> 0')
def shard_pending(spark, sf_dir):
    table_ = shards.shard_table(_planned(spark, sf_dir)).select("index")
    done = table_.where("index % 3 = 0").select(F.col("index").alias("shard_index"))
    return shards.pending(table_, shards.complete(done, done))


@query(f'{_PLAN_SQL} SELECT shard AS "index", array_to_string(list(clip_id ORDER BY sha256(clip_id), clip_id), \',\') AS clip_ids FROM w GROUP BY shard')
def shard_clip_ids(spark, sf_dir):
    return shards.shard_clips(_planned(spark, sf_dir)).select("index", F.array_join("clip_ids", ",").alias("clip_ids"))


@query(f"""{_PLAN_SQL} SELECT w.shard AS "index", (row_number() OVER (PARTITION BY w.shard ORDER BY sha256(clip_id), clip_id) - 1)::INT AS place, clip_id, m.sample_rate, s.split
    FROM w JOIN m USING (clip_id) JOIN s USING (clip_id) QUALIFY m.sample_rate = 24000""")
def shard_samples(spark, sf_dir):
    view = manifest_view(spark, sf_dir)
    found = shards.shard_samples(shards.shard_clips(_planned(spark, sf_dir)), view.where("sample_rate = 24000").select("clip_id", "sample_rate"), splits.assign_splits(view, VALIDATION_SHARE))
    return found.select("index", "place", "clip_id", "sample_rate", "split")


@query(f"WITH {MANIFEST_SQL} SELECT clip_id, row_number() OVER (ORDER BY sha256(clip_id), clip_id) - 1 AS place FROM m")
def stable_order(spark, sf_dir):
    rows = manifest_view(spark, sf_dir).select("clip_id", F.sha2("clip_id", 256).alias("h"))
    return batches.ordinals(rows, "h", "clip_id", name="place").select("clip_id", "place")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_comment_bytes, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM (SELECT *, octet_length(encode(l_returnflag || l_linestatus)) AS l_comment_bytes FROM lineitem)")
def ordinals_payload(spark, sf_dir):
    """Global ordinals of rows that carry columns beside the order's."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", F.octet_length(F.concat("l_returnflag", "l_linestatus")).cast("bigint").alias("l_comment_bytes"))
    return batches.ordinals(rows, "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", name="place").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_comment_bytes", "place")


_LAST = "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query(_LAST)
def cache_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return cache.last_by_key(rows, "user_id", "ts", "event_id").select("user_id", "event_type", "value", "event_id")


SAVES = 6


@query(_LAST)
def cache_saves(spark, sf_dir):
    """The events of each stretch of ids saved after the one before, each save writing its own rows alone; merged on reading."""
    path = staging.scratch(spark, "keyed")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    least, most = rows.agg(F.min("ts"), F.max("ts")).first()
    ends = [least + (most - least) * k / SAVES for k in range(SAVES)]
    for k, begin in enumerate(ends):
        later = F.col("ts") < F.lit(ends[k + 1]) if k + 1 < SAVES else F.lit(True)
        keyed.save(spark, rows.where((F.col("ts") >= F.lit(begin)) & later), path, "user_id", "ts", "event_id")
    return keyed.load(spark, path, "user_id").select("user_id", "event_type", "value", "event_id")


@query("SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM (SELECT DISTINCT user_id FROM events)")
def cache_merge(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return cache.upsert(users.withColumn("version", F.lit("old")), users.where("user_id % 2 = 0").withColumn("version", F.lit("new")), "user_id")


@query(f"SELECT e.event_id, c.event_id AS cached_event FROM events e JOIN ({_LAST}) c USING (user_id)")
def cache_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    held = cache.last_by_key(rows.select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("user_id", F.col("event_id").alias("cached_event"), F.lit("v1").alias("codec_revision"))
    return cache.lookup(rows.select("event_id", "user_id"), held, "v1", "user_id").select("event_id", "cached_event")


@query("""SELECT clip_id, '{"text":"' || l || '","n":' || n || '}' AS record FROM (SELECT 'doc_' || doc_id AS clip_id, lang AS l, n_chars AS n FROM documents)""")
def cache_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("clip_id"), F.col("lang").alias("text"), F.col("n_chars").alias("n"))
    return cache.payload(rows)


@query("""WITH k AS (SELECT n_nationkey, unnest([('architecture_version', 'a1', CASE WHEN n_nationkey % 5 = 0 THEN 'a2' ELSE 'a1' END), ('base_model', n_name, n_name), ('tokenizer', 't', 't'), ('dataset', CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END, n_name),
    ('vocab_size', '40000', '40000'), ('hidden_dim', NULL, NULL)]) AS x FROM nation) SELECT n_nationkey, x[1] AS field, x[2] AS saved, x[3] AS current FROM k WHERE x[2] IS DISTINCT FROM x[3]""")
def metadata_diff(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    side = lambda version, data: n.select("n_nationkey", version.alias("architecture_version"), F.col("n_name").alias("base_model"), F.lit("t").alias("tokenizer"), data.alias("dataset"), F.lit(40_000).alias("vocab_size"))
    saved = side(F.lit("a1"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")))
    return checkpoints.differences(saved, side(F.when(F.col("n_nationkey") % 5 == 0, "a2").otherwise("a1"), F.col("n_name")), "n_nationkey")


def _permutation_sql(n: str, keys: list[tuple[int, int, int]]) -> str:
    """Rounds of the permutation over (``l``, ``r``) on a grid of ``a`` by ``b`` for ``n`` places, until all are below ``n``."""
    move = lambda x, k: f"(({x} * {keys[k][0]} + {keys[k][1]}) % 2147483647 * {keys[k][2]} % 2147483629)"
    steps = "SELECT ordinal, p // b AS l, p % b AS r, a, b, n FROM walked WHERE p >= n"
    for k in range(len(keys)):
        steps = f"SELECT ordinal, (l + {move('r', k)}) % a AS l, r, a, b, n FROM ({steps})" if k % 2 == 0 else f"SELECT ordinal, l, (r + {move('l', k)}) % b AS r, a, b, n FROM ({steps})"
    first = steps.replace("FROM walked WHERE p >= n", "FROM started")
    # the grid side is the root of n, rounded up
    return f"""started AS (SELECT ordinal, ordinal AS p, ceil(sqrt(n))::BIGINT AS a, ((n + ceil(sqrt(n))::BIGINT - 1) // ceil(sqrt(n))::BIGINT) AS b, n FROM ({n})),
        walked(ordinal, p, a, b, n) AS (SELECT ordinal, l * b + r, a, b, n FROM ({first}) UNION ALL SELECT ordinal, l * b + r, a, b, n FROM ({steps})), placed AS (SELECT ordinal, p, n FROM walked WHERE p < n)"""


RANKS, SEED, EPOCH = 7, 5, 3


@query(f"""WITH RECURSIVE e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS ordinal, count(*) OVER () AS n FROM events),
    {_permutation_sql("SELECT ordinal, n FROM e", batches.permutation_keys(1, SEED, EPOCH)[2])}
    SELECT event_id, (q % {RANKS})::INT AS rank, q // {RANKS} AS step FROM (SELECT event_id, unnest(range(p, (n + {RANKS} - 1) // {RANKS} * {RANKS}, n)) AS q FROM placed JOIN (SELECT event_id, ordinal FROM e) USING (ordinal))""")
def rank_shares(spark, sf_dir):
    """Events dealt to seven ranks in an epoch's order, equally many to each."""
    rows = batches.ordinals(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return batches.rank_shares(rows, "ordinal", rows.count(), RANKS, SEED, EPOCH).select("event_id", "rank", "step")


@query("""WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations),
    n AS (SELECT conv_id, max(len(ids)) AS longest FROM t GROUP BY conv_id), p AS (SELECT conv_id, turn, ids, (ceil(longest / 8.0) * 8)::INT AS padded FROM t JOIN n USING (conv_id))
    SELECT conv_id, turn, padded AS padded_length, sha256(array_to_string(list_concat(ids, list_transform(range(padded - len(ids)), lambda x: 0)), ',')) AS input_sha256,
        sha256(array_to_string(list_concat(ids, list_transform(range(padded - len(ids)), lambda x: -100)), ',')) AS labels_sha256, len(ids) AS attended FROM p""")
def pad_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " ", -1), F.length).alias("ids"))
    found = batches.pad_batches(rows.withColumn("labels", F.col("ids")), "conv_id", "ids", "labels", multiple=8)
    digest = lambda c: F.sha2(F.concat_ws(",", F.col(c).cast("array<string>")), 256)
    return found.select("conv_id", "turn", "padded_length", digest("input_ids").alias("input_sha256"), digest("padded_labels").alias("labels_sha256"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("attended"))


@query("SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:16], ' ') AS head FROM conversations")
def truncate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(arrays.truncate(F.split("text", " ", -1), 16), " ").alias("head"))


@query("""SELECT item_id::VARCHAR AS sentence_id, 'short' AS category, e AS experiment_id, l AS listener, '' AS pronunciation, '' AS naturalness, '' AS english_preservation, '' AS no_severe_artifacts, '' AS notes
    FROM benchmark, (VALUES ('EXP001'), ('EXP002')) x(e), (VALUES ('listener_1'), ('listener_2')) y(l)""")
def eval_template(spark, sf_dir):
    s = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.lit("short").alias("category"))
    return scores.template(s, ["EXP001", "EXP002"])


@query("""WITH r AS (SELECT 'EXP' || (user_id % 7) AS experiment_id, user_id % 7 <> 3 AND event_id % 5 <> 0 AS scored, (3 + event_id % 3)::DOUBLE AS p, (2 + event_id % 4)::DOUBLE AS n, (4 + event_id % 2)::DOUBLE AS e, event_id % 97 = 0 AS bad FROM events),
    a AS (SELECT experiment_id, count(*) FILTER (scored) AS n_scored, coalesce(sum(p) FILTER (scored), 0) / greatest(count(*) FILTER (scored), 1) AS pronunciation, coalesce(sum(n) FILTER (scored), 0) / greatest(count(*) FILTER (scored), 1) AS naturalness,
        coalesce(sum(e) FILTER (scored), 0) / greatest(count(*) FILTER (scored), 1) AS english_preservation, count(*) FILTER (scored AND bad) AS severe_artifact_count FROM r GROUP BY experiment_id)
    SELECT *, concat_ws(',', CASE WHEN pronunciation < 4.0 THEN 'pronunciation' END, CASE WHEN naturalness < 3.8 THEN 'naturalness' END, CASE WHEN english_preservation < 3.8 THEN 'english_preservation' END) AS failed_gates,
        pronunciation >= 4.0 AND naturalness >= 3.8 AND english_preservation >= 3.8 AND severe_artifact_count = 0 AS passes_release_gate FROM a""")
def score_summary(spark, sf_dir):
    k, u = F.col("event_id"), F.col("user_id")
    scored = (u % 7 != 3) & (k % 5 != 0)
    cell = lambda c: F.when(scored, c.cast("string")).otherwise("")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("EXP"), (u % 7).cast("string")).alias("experiment_id"), cell(3 + k % 3).alias("pronunciation"), cell(2 + k % 4).alias("naturalness"), cell(4 + k % 2).alias("english_preservation"), cell(F.when(k % 97 == 0, 0).otherwise(1)).alias("no_severe_artifacts"))
    return scores.summarize(rows).withColumn("failed_gates", F.array_join("failed_gates", ","))


# Warm-up, plateau and decay ends, and rates of each experiment's parameter groups.
SCHEDULES = [
    ("EXP001", "lora", 2000, 10000, 35000, 5e-5, 1e-4, 1e-5), ("EXP001", "khmer_embedding", 2000, 10000, 35000, 1e-4, 2e-4, 2e-5),
    ("EXP002", "lora", 2000, 10000, 35000, 2.5e-5, 5e-5, 5e-6), ("EXP002", "khmer_embedding", 2000, 10000, 35000, 5e-5, 1e-4, 1e-5),
    ("EXP003", "lora", 2000, 10000, 35000, 1e-4, 2e-4, 2e-5), ("EXP003", "khmer_embedding", 2000, 10000, 35000, 1e-4, 2e-4, 2e-5),
]


@query("""SELECT event_id AS step, e AS experiment_id, g AS param_group, CASE WHEN event_id <= 0 THEN a WHEN event_id <= w THEN a + (event_id::DOUBLE / w) * (p - a) WHEN event_id <= q THEN p WHEN event_id <= d THEN p + ((event_id - q)::DOUBLE / (d - q)) * (z - p) ELSE z END AS lr
    FROM events, (VALUES """ + ", ".join(f"('{e}', '{g}', {w}, {q}, {d}, {a}::DOUBLE, {p}::DOUBLE, {z}::DOUBLE)" for e, g, w, q, d, a, p, z in SCHEDULES) + ") s(e, g, w, q, d, a, p, z)")
def lr_schedule(spark, sf_dir):
    """The rates of all parameter groups at every event's step."""
    for s in SCHEDULES:
        numeric.check_schedule(*s[2:5])
    groups = F.array(*(F.struct(F.lit(e).alias("experiment_id"), F.lit(g).alias("param_group")) for e, g, *_ in SCHEDULES))
    steps = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.inline(groups))
    return metrics.scheduled_rates(steps, spark.createDataFrame(SCHEDULES, schemas.SCHEDULE)).select("step", "experiment_id", "param_group", "lr")


@query("""SELECT event_id, round(CASE WHEN s <= 2000 THEN a + (s::DOUBLE / 2000) * (p - a) WHEN s <= 10000 THEN p WHEN s <= 35000 THEN p + ((s - 10000)::DOUBLE / 25000) * (z - p) ELSE z END * 1e9, 3) AS nano_lr
    FROM (SELECT event_id, event_id * 37 % 40000 AS s, 'EXP00' || (user_id % 3 + 1) AS e, CASE WHEN event_id % 2 = 0 THEN 'lora' ELSE 'khmer_embedding' END AS g FROM events)
    JOIN (VALUES """ + ", ".join(f"('{e}', '{g}', {a}::DOUBLE, {p}::DOUBLE, {z}::DOUBLE)" for e, g, _, _, _, a, p, z in SCHEDULES) + ") t(e, g, a, p, z) USING (e, g)")
def lr_lookup(spark, sf_dir):
    k = F.col("event_id")
    steps = table(spark, sf_dir, "events").select(k, (k * 37 % 40_000).alias("step"), F.concat(F.lit("EXP00"), (F.col("user_id") % 3 + 1).cast("string")).alias("experiment_id"), F.when(k % 2 == 0, "lora").otherwise("khmer_embedding").alias("param_group"))
    return metrics.scheduled_rates(steps, spark.createDataFrame(SCHEDULES, schemas.SCHEDULE)).select("event_id", F.round(F.col("lr") * 1e9, 3).alias("nano_lr"))


@query("SELECT event_id, value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS improved FROM events")
def best_so_far(spark, sf_dir):
    return metrics.best_so_far(table(spark, sf_dir, "events"), "value", "event_id", "user_id").select("event_id", "improved")


@query("SELECT event_id FROM events WHERE event_id > 0 AND event_id % 500 = 0")
def step_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(numeric.due(F.col("event_id"), 500)).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 50 = 0 OR event_id = 1")
def log_steps(spark, sf_dir):
    return table(spark, sf_dir, "events").where(numeric.log_due(F.col("event_id"), 50)).select("event_id")


@query("SELECT event_id, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6, 3) AS seconds FROM events")
def step_elapsed(spark, sf_dir):
    return metrics.elapsed(table(spark, sf_dir, "events"), "ts", "user_id").select("event_id", F.round("seconds", 3).alias("seconds"))


@query("SELECT event_id, step FROM (SELECT event_id, step, lag(step) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT event_id, user_id, event_id // 100 % 5 AS step FROM events) WHERE step > 0) WHERE step IS DISTINCT FROM before")
def new_steps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.floor(F.col("event_id") / 100) % 5).alias("step"))
    return metrics.new_steps(rows, "step", "event_id", "user_id").select("event_id", "step")


@query("SELECT round(avg(m), 6) AS mean FROM (SELECT event_id % 4 AS r, avg(value) AS m FROM events GROUP BY r)")
def rank_mean_of_means(spark, sf_dir):
    return metrics.mean_of_means(table(spark, sf_dir, "events").withColumn("rank", F.col("event_id") % 4), "rank", "value").select(F.round("mean", 6).alias("mean"))


@query("SELECT round(coalesce(avg(value), 0), 6) AS mean FROM (SELECT value FROM events ORDER BY ts, event_id LIMIT 50)")
def capped_mean(spark, sf_dir):
    return metrics.capped_mean(table(spark, sf_dir, "events"), "value", "ts", "event_id").select(F.round("mean", 6).alias("mean"))


@query("SELECT user_id, (r // 16)::BIGINT AS micro_batch, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events) GROUP BY ALL")
def micro_batch_mean(spark, sf_dir):
    rows = batches.ordinals(table(spark, sf_dir, "events"), "event_id", by=("user_id",))
    return metrics.micro_batch_means(rows, "ordinal", "value", CHUNK, "user_id").withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) < 1e-4 AS silent FROM embeddings")
def rms_check(spark, sf_dir):
    return metrics.audio_check(table(spark, sf_dir, "embeddings"), "embedding", "vec_id").withColumn("rms", F.round("rms", 6))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: (embedding[i]::DOUBLE + embedding[i + 32]::DOUBLE) / 2)), 5) AS total FROM embeddings")
def mono_mix(spark, sf_dir):
    e = F.col("embedding")
    m = arrays.mono(F.array(F.slice(e, 1, 32), F.slice(e, 33, 32)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(m, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def _resample_sql(old: int, new: int) -> str:
    """Every output sample as a sum over all input samples, each weighed by a sinc under a Hann window."""
    t = f"(i / {old}::DOUBLE - j / {new}::DOUBLE) * {min(old, new)} * 0.99"
    x = f"pi() * ({t})"
    return f"""SELECT vec_id, {new} AS rate, len(y)::BIGINT AS n, round(list_sum(y), 4) + 0.0 AS total, round(list_sum(list_transform(range(1, len(y) + 1), lambda k: y[k] * k)), 2) + 0.0 AS moment
        FROM (SELECT vec_id, list_transform(range(0, (len(embedding) * {new} + {old} - 1) // {old}), lambda j: list_sum(list_transform(range(0, len(embedding)), lambda i:
            CASE WHEN abs({t}) >= 6 THEN 0 ELSE embedding[i + 1]::DOUBLE * (CASE WHEN {t} = 0 THEN 1 ELSE sin({x}) / ({x}) END) * cos({x} / 12) ** 2 * {min(old, new)} * 0.99 / {old} END))) AS y FROM embeddings)"""


@query(f"{_resample_sql(16000, 24000)} UNION ALL {_resample_sql(44100, 32000)}")
def resample(spark, sf_dir):
    """Embeddings as signals of 16 and 44.1 kHz, taken to 24 and 32 kHz."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.inline(F.array(*(F.struct(F.lit(new).alias("rate"), signal.resampled(F.col("embedding"), old, new).alias("y")) for old, new in ((16_000, 24_000), (44_100, 32_000))))))
    total = F.aggregate("y", F.lit(0.0), lambda s, x: s + x)
    moment = F.aggregate(F.transform("y", lambda x, k: x * (k + 1)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", "rate", F.size("y").cast("bigint").alias("n"), F.round(total, 4).alias("total"), F.round(moment, 2).alias("moment"))


@query("""WITH r AS (SELECT vec_id, label AS g, list_transform(embedding, lambda x: x::DOUBLE * 20) AS z, CASE WHEN vec_id % 5 = 0 THEN -100 ELSE vec_id % 64 END AS y, vec_id % 7 AS c FROM embeddings),
    e AS (SELECT g, CASE WHEN y <> -100 THEN ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[y + 1] END AS base,
        CASE WHEN y BETWEEN 20 AND 50 THEN list_filter([ln(list_sum(list_transform(z[1:32], lambda x: exp(x)))) - z[c + 1], CASE WHEN c <> 3 THEN ln(list_sum(list_transform(z[33:64], lambda x: exp(x)))) - z[33 + 2 * c] END], lambda x: x IS NOT NULL) END AS codes FROM r)
    SELECT g AS label, count(base) AS n_tokens, coalesce(sum(len(codes)), 0)::BIGINT AS n_codes, round(sum(base) / count(base), 6) AS base_loss, round(sum(list_sum(codes)) / sum(len(codes)), 6) AS semantic_loss,
        round(sum(base) / count(base) + sum(list_sum(codes)) / sum(len(codes)), 6) AS loss FROM e GROUP BY g""")
def masked_loss(spark, sf_dir):
    """Embeddings as logits of 64 tokens and of two codebooks; ids divisible by 5 have an ignored label."""
    k, c = F.col("vec_id"), (F.col("vec_id") % 7).cast("int")
    z = F.transform("embedding", lambda x: x.cast("double") * 20)
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("g"), z.alias("token_logits"), F.when(k % 5 == 0, -100).otherwise((k % 64).cast("int")).alias("label"),
        F.array(F.slice(z, 1, 32), F.slice(z, 33, 32)).alias("codebook_logits"), F.array(c, F.when(c == 3, -100).otherwise(2 * c)).alias("codebook_labels"),
    )
    found = losses.masked_loss(rows, 20, 50, "g").withColumnRenamed("g", "label")
    return found.withColumns({x: F.round(x, 6) for x in ("base_loss", "semantic_loss", "loss")})


@query("SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:turn + 3], ' ') || '|' || array_to_string(list_reverse(string_split(text, ' '))[1:turn + 3], ' ') AS codes FROM conversations")
def trim_codes(spark, sf_dir):
    w = F.split("text", " ", -1)
    cut = arrays.trim_codes(F.array(w, F.reverse(w)), F.col("turn").cast("int") + 3)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(cut, lambda c: F.array_join(c, " ")), "|").alias("codes"))


@query("SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 10 BETWEEN 3 AND 6 THEN o_custkey END, CASE WHEN o_custkey % 10 BETWEEN 3 AND 6 THEN o_orderkey END], lambda x: x IS NOT NULL), ',') AS labels FROM orders")
def mask_gather(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k, F.concat_ws(",", arrays.gather_labels(F.array(k % 10, c % 10), F.array(c, k), 3, 6).cast("array<string>")).alias("labels"))


@query("SELECT l_orderkey, l_linenumber, printf('%.3f', n / 16000.0::DOUBLE)::DOUBLE AS duration_seconds FROM (SELECT l_orderkey, l_linenumber, l_partkey * 8 + 16000 AS n FROM lineitem)")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.duration_seconds(F.col("l_partkey") * 8 + 16_000, F.lit(16_000)).alias("duration_seconds"))


@query("SELECT source, round(sum(octet_length(encode(text)))::DOUBLE / sum(n_chars / 15.0::DOUBLE), 6) AS rate FROM documents GROUP BY source")
def byte_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("source").agg(F.round(numeric.byte_rate(F.octet_length("text"), F.col("n_chars") / 15.0), 6).alias("rate"))


@query("SELECT doc_id, trunc(n_chars / 15.0::DOUBLE * 50400.0::DOUBLE)::BIGINT AS audio, trunc(n_chars / 15.0::DOUBLE * 75.0::DOUBLE * 2 * 5)::BIGINT AS semantic FROM documents")
def size_estimates(spark, sf_dir):
    d = F.col("n_chars") / 15.0
    return table(spark, sf_dir, "documents").select("doc_id", numeric.audio_bytes(d, 50_400.0).alias("audio"), numeric.semantic_bytes(d).alias("semantic"))


@query("SELECT sum(p_size)::BIGINT AS total, coalesce(sum(p_size) FILTER (p_partkey % 7 = 0 OR p_partkey % 11 = 0), 0)::BIGINT AS trainable, round(100.0 * coalesce(sum(p_size) FILTER (p_partkey % 7 = 0 OR p_partkey % 11 = 0), 0) / sum(p_size), 6) AS percent FROM part")
def trainable_parameters(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("layers.lora_A."), k.cast("string"))).when(k % 11 == 0, F.concat(F.lit("embeddings."), k.cast("string"))).otherwise(F.concat(F.lit("body."), k.cast("string")))
    found = metrics.trainable_parameters(table(spark, sf_dir, "part").select(name.alias("name"), F.col("p_size").cast("bigint").alias("n")))
    return found.withColumn("percent", F.round("percent", 6))


@query("SELECT count(*) AS checked, count(*) FILTER (user_id % 10 = 0) AS failed, count(*) FILTER (user_id % 10 <> 0) AS passed FROM events WHERE event_id % 4 <> 0")
def codec_tally(spark, sf_dir):
    one = F.array_repeat(F.lit(1), 5)
    codes = F.when(F.col("event_id") % 4 == 0, F.slice(F.array(one), 1, 0)).otherwise(F.array(one, F.when(F.col("user_id") % 10 == 0, F.slice(one, 1, 3)).otherwise(one)))
    return metrics.codec_tally(table(spark, sf_dir, "events").select(codes.alias("codes")))


@query("SELECT sum(len(string_split(text, '.')))::BIGINT AS n_sentences FROM documents")
def sentence_count(spark, sf_dir):
    return metrics.sentence_count(table(spark, sf_dir, "documents").select(F.split("text", r"\.", -1).alias("sentences")))


@query("SELECT round(stddev_samp(x), 6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def weight_spread(spark, sf_dir):
    return metrics.weight_spread(table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("e")), "e").select(F.round("std", 6).alias("std"))


@query("""SELECT 'omni_' || (CASE WHEN c_custkey % 5 = 0 THEN 'dev' ELSE 'train' END) || '_' || replace(c_name, '#', '_') AS clip_id, c_mktsegment AS text, CASE WHEN c_custkey % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
    '/audio/x/' || replace(c_name, '#', '_') || '.flac' AS audio_path, printf('%.3f', (c_custkey * 8 + 16000) / 16000.0::DOUBLE)::DOUBLE AS duration_seconds, 16000 AS sample_rate, CASE WHEN c_custkey % 3 = 0 THEN 'spk' || c_nationkey END AS speaker, 'customers' AS source
    FROM customer WHERE c_custkey % 10 <> 7 AND c_custkey % 4 <> 0""")
def manifest_conversion(spark, sf_dir):
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").withColumns({"split": F.when(k % 10 == 7, "test").when(k % 5 == 0, "dev").otherwise("train"), "ordinal": k, "relpath": F.concat(F.lit("x/"), F.translate("c_name", "#", "_"), F.lit(".flac"))})
    samples = base.select("split", "ordinal", "relpath", (k * 8 + 16_000).alias("num_samples"))
    speakers = base.select("ordinal", F.when(k % 3 == 0, F.array(F.concat(F.lit("spk"), F.col("c_nationkey").cast("string")))).otherwise(F.slice(F.array(F.lit("")), 1, 0)).alias("names"))
    return conversion.convert(samples, base.select("split", "ordinal", F.col("c_mktsegment").alias("text")), speakers, base.where(k % 4 != 0).select("relpath"), "/audio", 16_000, "customers")


@query("SELECT CASE WHEN c_custkey % 5 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS missing FROM customer WHERE c_custkey % 4 = 0 GROUP BY ALL")
def missing_audio(spark, sf_dir):
    k = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(F.when(k % 5 == 0, "dev").otherwise("train").alias("split"), F.col("c_name").alias("relpath"), k)
    return conversion.missing_audio(base, base.where(k % 4 != 0).select("relpath"))


@query("SELECT p_partkey, p_name AS kept_key, p_size AS kept_value FROM part")
def renamed_keys(spark, sf_dir):
    m = F.create_map(F.concat(F.lit("generator."), F.col("p_name")), F.col("p_size"), F.lit("decoder.x"), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(cache.renamed_keys(m)).alias("kept_key", "kept_value"))


@query("SELECT o_orderkey, (o_orderkey % 2 = 0 OR o_custkey % 2 = 1) AS same FROM orders")
def same_modules(spark, sf_dir):
    a = F.array(F.lit("attention"), F.lit("mlp"))
    b = F.when((F.col("o_orderkey") % 2 == 0) | (F.col("o_custkey") % 2 == 1), F.array(F.lit("mlp"), F.lit("attention"), F.lit("mlp"))).otherwise(F.array(F.lit("mlp")))
    return table(spark, sf_dir, "orders").select("o_orderkey", arrays.same_set(a, b).alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'extra' WHEN o_orderkey % 3 = 0 THEN 'architecture' ELSE 'base' END AS winner, 3 AS n_keys FROM orders")
def metadata_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    none = F.map_filter(F.create_map(F.lit("k"), F.lit("")), lambda k, v: F.lit(False))
    merged = checkpoints.merged_metadata(
        F.create_map(F.lit("k"), F.lit("base"), F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")),
        F.when(k % 3 == 0, F.create_map(F.lit("k"), F.lit("architecture"))).otherwise(none),
        F.when(k % 2 == 0, F.create_map(F.lit("k"), F.lit("extra"))).otherwise(none),
    )
    return table(spark, sf_dir, "orders").select(k, F.element_at(merged, "k").alias("winner"), F.size(merged).alias("n_keys"))


@query("SELECT user_id, step, event_id FROM (SELECT *, lag(step) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM (SELECT event_id, user_id, event_id // 100 % 5 AS step FROM events) WHERE step > 0) WHERE step IS DISTINCT FROM before")
def stream_new_steps(spark, sf_dir):
    """The events as a file stream, step changes by user kept in state across batches."""
    from millrace.streaming import watch

    static = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet")
    steps = stream.select("user_id", (F.floor(F.col("event_id") / 100) % 5).alias("step"), "event_id")
    out, log = staging.scratch(spark, "steps"), staging.scratch(spark, "steps-log")
    watch.run_available(watch.new_steps(steps, "user_id", "step", "event_id"), log, watch.idempotent(out))
    return spark.read.parquet(out).select("user_id", "step", "event_id")


def _is_folder(spark: SparkSession, path: str) -> bool:
    from millrace.sources.files import hadoop_path

    p, store = hadoop_path(spark, path)
    return store.getFileStatus(p).isDirectory()
