"""Spelling variants by anagram hashing.

Each letter has an integer value, the fifth power of its place in the alphabet, and
a word's key is the sum of its letters' values: words of the same letters share it,
whatever their order.  A word without one of its letters has the key less that
letter's value.  So the keys of two words differ by one letter's value (addition,
removal) or by the difference of two (exchange) exactly when reduced keys meet: the
longer word's with the shorter one's key, or both words' reduced keys.

Keys alone would bring all anagrams of a set of letters together, and a class of
them can be large.  So the order of the letters that are left takes part in the
join, as a 64-bit polynomial of the reduced word, and for exchanges the place of the
letter as well.  A reduced word and a place leave one word for each letter of the
alphabet, which bounds every group, however many words there are.  What meets is then
verified on the words themselves.

A word's form is its near word of largest count if that is five times its own; since
counts grow fivefold along forms, roots are found by doubling in a number of rounds
that follows from the largest count.

Defined results: a null or empty text has no words; a null id counts as an empty one
in the checksum.  Repeated documents count again.  Of near words of equal count the
least by code points is the form.  An empty table gives an empty result.  Other
columns, whatever their names, are not read.  Texts are processed whole; memory is
some 100 bytes a letter of the longest word and 100 a distinct word of a text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep, release, staged

#: Least code points and occurrences of a word, the ratio of counts of a form, and one in how many runs loses a letter.
LEAST_LETTERS, LEAST_COUNT, RATIO, CUT = 6, 5, 5, 199
#: Code points of a stretch of text, and distinct words that a task holds.
STRETCH, HELD = 1 << 20, 1 << 18

_LETTER = "A-Za-zÀ-ÿ"
_BEYOND = re.compile(f"[^{_LETTER}]")
_FOLD = {c: c + 32 for c in range(65, 91)}
#: Value of each code point: places in the alphabet a-z, then U+00C0 to U+00FF, to the fifth power.
_VALUES = np.zeros(256, np.uint64)
_VALUES[97:123] = np.arange(1, 27, dtype=np.uint64) ** np.uint64(5)
_VALUES[192:256] = np.arange(27, 91, dtype=np.uint64) ** np.uint64(5)
#: Base of the polynomial of letters, and the coefficients of its letters.
_BASE = 0x9E3779B97F4A7C15
_COEFFICIENTS = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def runs(text: str, least: int = LEAST_LETTERS) -> Counter:
    """Runs of letters of at least so many code points, lower-cased in A-Z alone."""
    found: Counter = Counter()
    pattern = re.compile(f"[{_LETTER}]{{{least},}}")
    at = 0
    while at < len(text):
        border = _BEYOND.search(text, at + STRETCH)
        end = border.start() if border else len(text)
        found.update(pattern.findall(text, at, end))
        at = end
    folded: Counter = Counter()
    for run, n in found.items():
        folded[run if run.islower() else run.translate(_FOLD)] += n
    return folded


def document_words(doc_id: object, text: str | None, least: int = LEAST_LETTERS) -> Counter:
    """Words of a document of at least so many code points; a run whose checksum says so has lost a letter."""
    words: Counter = Counter()
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs(text or "", least).items():
        h = zlib.crc32(run.encode(), begun)
        if h % CUT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            words[run] += n
    return words


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words that occur often enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                held.update(document_words(doc_id.as_py(), text.as_py()))
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    found = keep(docs, id_col, text_col).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def reduced(words: list[str]) -> tuple[np.ndarray, ...]:
    """For every letter of every word: the word's number, the letter's place, and the key and the order of the rest;
    whether the letter before it is another one; then key and order of the whole words."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    total = len(codes)
    one, none = np.ones(1, np.uint64), np.zeros(1, np.uint64)
    power, back = (np.cumprod(np.concatenate([one, np.full(total, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    summed = np.concatenate([none, np.cumsum(_COEFFICIENTS[codes] * power[:total], dtype=np.uint64)])
    values = np.concatenate([none, np.cumsum(_VALUES[codes], dtype=np.uint64)])
    keys, orders = values[ends] - values[starts], (summed[ends] - summed[starts]) * back[starts]
    number = np.repeat(np.arange(len(words)), lengths)
    at, first = np.arange(total), starts[number]
    order = (summed[at] - summed[first]) * back[first] + (summed[ends[number]] - summed[at + 1]) * back[first + 1]
    other = (at == first) | (codes != np.roll(codes, 1))
    return number, at - first, keys[number] - _VALUES[codes], order, other, keys, orders


def _reductions(words: DataFrame) -> DataFrame:
    """Reduced words: ``place`` of the letter that is missing, or -1 for a whole word."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            number, place, key, order, other, keys, orders = reduced(batch.column(1).to_pylist())
            columns = [np.concatenate([key, keys]).view(np.int64), np.concatenate([order, orders]).view(np.int64), np.concatenate([place, np.full(len(ids), -1)]).astype(np.int32), np.concatenate([other, np.zeros(len(ids), bool)]), np.concatenate([ids[number], ids])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "rest", "place", "other", "word_id"])

    return words.select("word_id", "word").mapInArrow(cut, "key bigint, rest bigint, place int, other boolean, word_id bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a`` and ``b``, ids of words that differ by one letter, each pair once; ``words``: word_id, word."""
    found = _reductions(words)
    cut, whole = found.where("place >= 0"), found.where("place < 0")
    one, two = cut.select("key", "rest", "place", F.col("word_id").alias("a")), cut.select("key", "rest", "place", F.col("word_id").alias("b"))
    exchanged = one.join(two, ["key", "rest", "place"]).where("a < b").select("a", "b")
    longer = cut.where("other").select("key", "rest", F.col("word_id").alias("a"))
    lacking = longer.join(whole.select("key", "rest", F.col("word_id").alias("b")), ["key", "rest"]).select("a", "b")
    named = exchanged.unionByName(lacking)
    for side in "ab":
        named = named.join(words.select(F.col("word_id").alias(side), F.col("word").alias(f"word_{side}"), F.col("n").alias(f"n_{side}")), side)
    return named.where(F.levenshtein("word_a", "word_b", 1) == 1)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word."""
    words = staged(word_counts(docs, id_col, text_col).withColumn("word_id", F.monotonically_increasing_id()), "words", light=True)
    pairs = near_pairs(words)
    seen = lambda a, b: F.struct(F.col(a).alias("word_id"), F.col(f"n_{a}").alias("n"), (-F.col(f"n_{b}")).alias("less"), F.col(f"word_{b}").alias("word"), F.col(b).alias("near"))
    both = pairs.select(F.inline(F.array(seen("a", "b"), seen("b", "a"))))
    best = both.groupBy("word_id", "n").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "word", "near")).alias("best"))
    formed = F.col("best.less") <= -RATIO * F.col("n")
    forms = staged(best.select("word_id", "n_near", *(F.when(formed, F.col(f"best.{c}")).alias(c) for c in ("less", "word", "near"))), "forms", light=True)
    roots = _roots(forms.where("near is not null").select("word_id", F.col("near").alias("root")), words)
    roots = roots.join(words.select(F.col("word_id").alias("root"), F.col("word").alias("root_word")), "root").select("word_id", "root_word")
    named = forms.select("word_id", "n_near", F.col("word").alias("form"), (-F.col("less")).alias("form_n")).join(roots, "word_id", "left")
    return words.join(named, "word_id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def _roots(steps: DataFrame, words: DataFrame) -> DataFrame:
    """The last word of each chain of forms; each round doubles the steps that a link spans."""
    most, longest = words.agg(F.max("n")).first()[0] or 0, 0
    while most >= RATIO * LEAST_COUNT:
        most, longest = most // RATIO, longest + 1
    links, spans = steps, 1
    while spans < longest:
        onward = links.select(F.col("word_id").alias("root"), F.col("root").alias("onward"))
        doubled = staged(links.join(onward, "root", "left").select("word_id", F.coalesce("onward", "root").alias("root")), "roots", light=True)
        if links is not steps:
            release(links)
        links, spans = doubled, 2 * spans
    return links
