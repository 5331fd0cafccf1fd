"""Collocations: frequent phrases by how much more often their parts meet than chance.

1. A count-min sketch of all phrases of one to five words: two rows of counters, a
   phrase's upper bound being the lower of its two.  Counters stop at the least count,
   so a byte holds one.  Tasks send them in slices, which are summed by slice; what
   returns to the driver and goes to all tasks is one bit a counter, whether it reaches
   the least count.  The number of counters follows from the bytes of text.
2. Candidates are the phrases whose upper bound, and that of the phrases inside them,
   reaches the least count.  The second reading counts their occurrences: a task keeps
   phrases and counts in the order of their hashes and sends on what it cannot hold,
   the rarest first; sums by phrase are exact, the sketch only keeps rare phrases out.
3. Scores, dominated phrases and ranks are joins and windows over the counts.

The corpus is read twice, and where ``MOST_CELLS`` is not enough, in ``SHARES`` shares
of the phrases by their hash: four times, however large it is.  A sketch that is fuller
than ``LOAD`` lets more rare phrases through to the sums.

The sketch sees every phrase, so no frequent phrase is missed.  A phrase of which two
64-bit hashes both equal another's would count as that one in the task that meets both.

``listed_counts`` counts phrases of the caller's: they are dealt into blocks of at most
``BLOCK_BYTES``, which go to the tasks in rounds of at most ``ROUND_BYTES``.  Each block
compiles into an Aho-Corasick automaton of phrases guarded by spaces on both sides;
words stand between single spaces and a full stop of its own between pieces, so
overlapping matches count and none crosses a border.  It reads the corpus once a round.

Defined results: a null text is an empty one; texts without words add nothing; a null
language is ``und``.  Repeated documents count again.  An empty table gives an empty
result.  Ties are in the order of the contract: score, count, phrase by UTF-8 bytes.
Other columns, whatever their names, are not read.  Texts are processed whole: one of
more than ``GROUP`` bytes is cut in front of a word, and each part sees the four words
behind it, in the sketch and in the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import release, staged, work_path

#: Words of a phrase at most, its least count, and rows of the result for each language.
WORDS, LEAST, TOP = 5, 100, 2000
#: Counters of a row of the sketch at most, how full they are on average in parts of the least count, counters of a slice.
MOST_CELLS, LOAD, SLICE = 1 << 27, 0.6, 1 << 15
#: Shares of the phrases that a sketch of their own each takes, at most.
SHARES = 2
#: Counts of phrases that tasks send together.
COUNTERS = 1 << 12
#: Bytes of phrases of an automaton, of all automata that tasks get at a time, and of text that is handled at once.
BLOCK_BYTES, ROUND_BYTES, GROUP = 4 << 20, 8 << 20, 1 << 20
#: Tasks that scan the corpus, for each core of the cluster, at most, bytes of text below which one a core is enough, phrases that a task holds, and that it sends together.
TASKS, TASK_BYTES, HELD, BATCH = 4, 1 << 30, 1 << 21, 1 << 16
#: The least count lies below.
_FULL = 1 << 15

#: Stands for the end of a piece, as a word of its own; no word has that character.
_END = b"."
_FOLD = bytes(0x2E if c in b".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_VALUE = itemgetter(1)
_ROWS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def spaced(raw: bytes) -> bytes:
    """A text with an end mark between spaces for each character that ends a piece."""
    return raw.translate(_FOLD).replace(_END, b" . ")


def tokens_of(raw: bytes) -> list[bytes]:
    """Words and end marks of a text."""
    return spaced(raw).split()


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word; end marks have 0. Each different word is hashed once."""
    coded = words.dictionary_encode()
    known = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_numpy(zero_copy_only=False))), np.uint64).reshape(-1, 2) | np.uint64(1)
    known[pc.is_in(coded.dictionary, pa.array(["", "."])).to_numpy(zero_copy_only=False)] = 0
    both = known[coded.indices.to_numpy()]
    return both[:, 0], both[:, 1]


def phrase_hashes(words: np.ndarray, seeds: np.ndarray, mix: np.uint64, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1 to ``size`` words: where they begin, and their hashes."""
    at = np.flatnonzero(words)
    h = (words[at] ^ seeds[at]) * mix
    yield at, h ^ (h >> np.uint64(29))
    for k in range(1, size):
        on = at + k < len(words)
        at, h = at[on], h[on]
        on = words[at + k] != 0
        at, h = at[on], h[on]
        h = (h * mix) + words[at + k]
        h = h ^ (h >> np.uint64(31))
        yield at, h * mix


def groups(batches: Iterator[pa.RecordBatch], names: dict[str, int]) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """Words and end marks of some texts together, the number of each one's language, and how many of them phrases may begin at.

    ``names`` gets the languages in the order of their numbers.
    """
    most = GROUP // 8
    held: list[bytes] = []
    numbers: list[int] = []
    size = 0

    def flat() -> tuple[pa.Array, np.ndarray, int]:
        lists = pc.ascii_split_whitespace(pa.array(held, pa.string()))
        words = lists.flatten()
        return words, np.repeat(numbers, pc.list_value_length(lists).to_numpy()), len(words)

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            if not text.is_valid:
                continue
            number = names.setdefault(lang.as_py(), len(names))
            raw = spaced(text.as_py().encode()) + b" ."
            if len(raw) > GROUP:  # alone, in parts: phrases begin in a part and may end behind it
                words = pc.ascii_split_whitespace(pa.array([raw], pa.large_string())).flatten()
                for i in range(0, len(words), most):
                    part = words[i : i + most + WORDS - 1].cast(pa.string())
                    yield part, np.full(len(part), number), most
                continue
            held.append(raw)
            numbers.append(number)
            size += len(raw)
            if size > GROUP:
                yield flat()
                held, numbers, size = [], [], 0
    if held:
        yield flat()


class Grams:
    """All phrases of groups of words, by their hashes."""

    def __init__(self, cells: int, shares: int, share: int):
        self.names: dict[str, int] = {}
        self.seeds = np.zeros(0, np.uint64)
        self.shift, self.shares, self.share = np.uint64(64 - (cells.bit_length() - 1)), np.uint64(shares), np.uint64(share)

    def seeds_of(self, langs: np.ndarray) -> np.ndarray:
        if len(self.seeds) < len(self.names):
            self.seeds = np.array([xxhash.xxh64_intdigest(name.encode(), 3) for name in self.names], np.uint64)
        return self.seeds[langs]

    def of(self, words: np.ndarray, seeds: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """For each number of words: where phrases of this share begin, their hashes, and their counters."""
        for k, (at, h) in enumerate(phrase_hashes(words, seeds, _MIX[0], WORDS), 1):
            on = at < most
            if self.shares > 1:
                on &= h % self.shares == self.share
            at, h = at[on], h[on]
            yield k, at, h, ((h * _ROWS[0]) >> self.shift, (h * _ROWS[1]) >> self.shift)


def _corpus(docs: DataFrame, text_col: str, lang_col: str, size: int) -> DataFrame:
    """``text`` and ``lang``, in a bounded number of tasks, since each sends a sketch or counts of its own."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.select(F.col(f"`{text_col}`").alias("text"), lang.alias("lang")).coalesce(cores * max(1, min(TASKS, size // (cores * TASK_BYTES))))


def raise_all(row: np.ndarray, places: np.ndarray, most: int = _FULL - 1) -> None:
    """Add one at every place; counters stop at ``most``, so none of them wraps."""
    places = np.sort(places.astype(np.uint32))
    first = np.flatnonzero(np.diff(places, prepend=places[:1] ^ np.uint32(1)))
    at = places[first]
    row[at] = np.minimum(row[at] + np.diff(first, append=len(places)), most)


def hot_cells(corpus: DataFrame, cells: int, least: int, shares: int, share: int) -> list[np.ndarray]:
    """For both rows of the sketch, one bit a counter: whether it reaches ``least``."""
    if not 0 < least < _FULL:
        raise ValueError(f"the least count lies between 1 and {_FULL - 1}: {least}")
    small = np.uint8 if least < 256 else np.uint16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, any_ = Grams(cells, shares, share), np.zeros((2, cells), small), False
        for words, langs, most in groups(batches, grams.names):
            any_ = True
            for _, _, _, places in grams.of(word_hashes(words)[0], grams.seeds_of(langs), most):
                for row, place in zip(rows, places):
                    raise_all(row, place, least)
        step = min(SLICE, cells)
        for i in range(0, 2 * cells if any_ else 0, step):
            part = rows.reshape(-1)[i : i + step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(counts, small).astype(np.uint32)
                sums[i] = np.minimum(sums[i] + part, least) if i in sums else part
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([np.packbits(part >= least).tobytes()], pa.binary())], ["slice", "bits"])

    summed = corpus.mapInArrow(count, "slice bigint, counts binary").repartition("slice").mapInArrow(add, "slice bigint, bits binary")
    bits = np.zeros(2 * cells // 8, np.uint8)
    for r in summed.collect():
        bits[r["slice"] // 8 : r["slice"] // 8 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return [bits[: cells // 8], bits[cells // 8 :]]


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


class Tallies:
    """Phrases of a task with their counts so far, in the order of their hashes."""

    def __init__(self):
        self.hashes, self.others, self.counts, self.langs = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.phrases = pa.array([], pa.large_string())
        self.fresh: list[tuple] = []
        self.waiting = 0

    def add(self, words: pa.Array, size: int, at: np.ndarray, hashes: np.ndarray, others: np.ndarray, langs: np.ndarray) -> None:
        """Phrases of ``size`` words that begin at ``at``."""
        order = np.argsort(hashes)
        at, hashes, others = at[order], hashes[order], others[order]
        new = np.ones(len(at), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (others[1:] != others[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(first, append=len(at))
        at, hashes, others = at[first], hashes[first], others[first]
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = (self.hashes[place] == hashes) & (self.others[place] == others)
            np.add.at(self.counts, place[known], counts[known])
            at, hashes, others, counts = at[~known], hashes[~known], others[~known], counts[~known]
        if len(at):
            phrases = pc.binary_join_element_wise(*(words.take(pa.array(at + i)) for i in range(size)), " ")
            self.fresh.append((hashes, others, counts, langs[at], phrases.cast(pa.large_string())))
            self.waiting += len(at)

    def merge(self) -> None:
        parts = [(self.hashes, self.others, self.counts, self.langs, self.phrases), *self.fresh]
        hashes, others, counts, langs = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((others, hashes))
        hashes, others, counts = hashes[order], others[order], counts[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (others[1:] != others[:-1])
        first = np.flatnonzero(new)
        self.hashes, self.others, self.langs = hashes[first], others[first], langs[order[first]]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts
        self.phrases = pa.concat_arrays([p[4] for p in parts]).take(pa.array(order[first]))
        self.fresh, self.waiting = [], 0

    def taken(self, names: list[str], most: int) -> Iterator[pa.RecordBatch]:
        """All but the ``most`` most frequent ones, which stay."""
        leave = np.zeros(len(self.counts), bool)
        leave[np.argsort(self.counts)[: max(0, len(leave) - most)]] = True
        at = np.flatnonzero(leave)
        for i in range(0, len(at), BATCH):
            part = at[i : i + BATCH]
            langs = pa.array(names, pa.string()).take(pa.array(self.langs[part]))
            yield pa.RecordBatch.from_arrays([langs, self.phrases.take(pa.array(part)).cast(pa.string()), pa.array(self.counts[part], pa.int64())], ["lang", "phrase", "n"])
        self.hashes, self.others, self.counts, self.langs = (x[~leave] for x in (self.hashes, self.others, self.counts, self.langs))
        self.phrases = self.phrases.take(pa.array(np.flatnonzero(~leave)))


def candidates(corpus: DataFrame, hot: list[np.ndarray], cells: int, shares: int, share: int) -> DataFrame:
    """``lang``, ``phrase`` and ``n`` of what may reach the least count: its occurrences, in parts of which their sum is exact; with a null phrase, counts of words."""
    shared = corpus.sparkSession.sparkContext.broadcast(hot)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, tallies, totals = Grams(cells, shares, share), Tallies(), np.zeros(0, np.int64)
        for words, langs, most in groups(batches, grams.names):
            (hashes, second), seeds = word_hashes(words), grams.seeds_of(langs)
            others = phrase_hashes(second, seeds, _MIX[1], WORDS)
            parts = None
            for (k, at, h, places), (begin, other) in zip(grams.of(hashes, seeds, len(words)), others):
                if k == 1:
                    more = np.bincount(langs[begin[begin < most]], minlength=len(grams.names))
                    more[: len(totals)] += totals
                    totals = more
                if shares > 1:
                    other = other[np.searchsorted(begin, at)]
                elif parts is not None:  # a phrase is no more frequent than the two that are shorter by a word
                    on = parts[at] & parts[at + 1]
                    at, h, other, places = at[on], h[on], other[on], [p[on] for p in places]
                on = _set(shared.value[0], places[0])
                at, h, other, place = at[on], h[on], other[on], places[1][on]
                on = _set(shared.value[1], place)
                at, h, other = at[on], h[on], other[on]
                parts = np.zeros(len(words) + 1, bool)
                parts[at] = True
                on = at < most
                tallies.add(words, k, at[on], h[on], other[on], langs)
            if tallies.waiting > HELD // 2:
                tallies.merge()
                if len(tallies.counts) > HELD:
                    yield from tallies.taken(list(grams.names), HELD // 2)
        tallies.merge()
        yield from tallies.taken(list(grams.names), 0)
        if share == 0 and len(totals):
            yield pa.RecordBatch.from_arrays([pa.array(list(grams.names), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(totals, pa.int64())], ["lang", "phrase", "n"])

    return corpus.mapInArrow(find, "lang string, phrase string, n bigint")


def _rounds(named: DataFrame) -> tuple[DataFrame, int]:
    """The candidates with ``round``: each round holds at most one block of a language, and all its blocks together are bounded."""
    sized = named.withColumn("bytes", F.octet_length("phrase") + 2)
    blocks, most = 1, None
    while most is None or most > BLOCK_BYTES:
        dealt = sized.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
        sizes = dealt.groupBy("lang", "block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
        most = max((r["bytes"] for r in sizes if r["n"] > 1), default=0)
        blocks *= 2
    blocks //= 2
    filled: list[int] = []
    langs: list[set] = []
    placed = []
    for r in sorted(sizes, key=lambda r: (-r["bytes"], r["lang"], r["block"])):
        at = next((i for i, x in enumerate(filled) if x + r["bytes"] <= ROUND_BYTES and r["lang"] not in langs[i]), len(filled))
        if at == len(filled):
            filled.append(0)
            langs.append(set())
        filled[at] += r["bytes"]
        langs[at].add(r["lang"])
        placed.append((r["lang"], r["block"], at))
    rounds = named.sparkSession.createDataFrame(placed, "lang string, block bigint, round int")
    return dealt.join(rounds, ["lang", "block"]).select("lang", "phrase", "round"), len(filled)


def automaton(phrases: list[str]):
    """Phrases with spaces on both sides, valued by their places in the list."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        found.add_word(f" {phrase} ", i)
    found.make_automaton()
    return found


def guarded(tokens: list[bytes]) -> str:
    """Words between single spaces, and an end mark of its own between pieces."""
    return f" {b' '.join(tokens).decode()} "


def matches(corpus: DataFrame, phrases: dict[str, list[str]], least: int) -> DataFrame:
    """``lang``, ``phrase`` and ``f`` of the phrases that occur often enough: counters of a task go on in slices, like those of the sketch."""
    shared = corpus.sparkSession.sparkContext.broadcast(phrases)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: dict[str, object] = {}
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                if not text.is_valid or lang not in shared.value:
                    continue
                if lang not in automata:
                    automata[lang], counts[lang] = automaton(shared.value[lang]), np.zeros(len(shared.value[lang]), np.int64)
                held = waiting.setdefault(lang, [])
                held += tokens_of(text.as_py().encode())
                held.append(_END)
                if len(held) > GROUP // 8:
                    tally(automata[lang], waiting.pop(lang), counts[lang])
            for lang, held in waiting.items():
                tally(automata[lang], held, counts[lang])
        for lang, found in counts.items():
            for i in range(0, len(found), COUNTERS):
                if (part := found[i : i + COUNTERS]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([i], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["lang", "slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, i, counts in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(counts, np.int64)
                sums[lang, i] = sums[lang, i] + part if (lang, i) in sums else part
        for (lang, i), found in sums.items():
            at = np.flatnonzero(found >= least).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([shared.value[lang][i + j] for j in at], pa.string()), pa.array(found[at], pa.int64())], ["lang", "phrase", "f"])

    slices = corpus.mapInArrow(scan, "lang string, slice bigint, counts binary").repartition("lang", "slice")
    return slices.mapInArrow(add, "lang string, phrase string, f bigint")


def tally(machine, tokens: list[bytes], counts: np.ndarray) -> None:
    """Add all matches, overlapping ones too, to the counts by phrase."""
    step = GROUP // 8
    for i in range(0, len(tokens), step):
        # the part before ends in the space that this one's first phrase begins with
        text = guarded(tokens[max(0, i - WORDS + 1) : i + step])
        skip = len(guarded(tokens[i - WORDS + 1 : i])) if i else 0  # matches that end there have been counted
        found = np.fromiter((v for end, v in machine.iter(text) if end >= skip) if skip else map(_VALUE, machine.iter(text)), np.int64)
        counts += np.bincount(found, minlength=len(counts))


def listed_counts(corpus: DataFrame, named: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase`` and ``f`` of listed phrases (``lang``, ``phrase``, each once) that occur often enough; the corpus is read once a round of automata."""
    spark = corpus.sparkSession
    dealt, rounds = _rounds(named)
    dealt = staged(dealt, "rounds", light=True)
    counted = work_path(spark, "counts")
    empty = spark.createDataFrame([], "lang string, phrase string, f bigint")
    empty.write.parquet(counted)
    for k in range(rounds):
        phrases: dict[str, list[str]] = {}
        for r in dealt.where(F.col("round") == k).select("lang", "phrase").collect():
            phrases.setdefault(r["lang"], []).append(r["phrase"])
        matches(corpus.where(F.col("lang").isin(list(phrases))), phrases, least).write.mode("append").parquet(counted)
    release(dealt)
    return spark.read.schema(empty.schema).parquet(counted)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_cells: int = MOST_CELLS) -> tuple[DataFrame, DataFrame]:
    """Tables of ``lang``, ``phrase``, ``f`` for all phrases of at least ``least`` occurrences, and of ``lang``, ``n``, its words."""
    spark: SparkSession = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("bigint"))).first()[0] or 0
    corpus = _corpus(docs, text_col, lang_col, size)
    wanted = WORDS * size / 5 / (LOAD * least)  # five bytes a word, or somewhat more
    cells = max(SLICE, min(most_cells, 1 << (max(1, int(wanted)) - 1).bit_length()))
    shares = max(1, min(SHARES, -(-int(wanted) // cells)))
    path = work_path(spark, "candidates")
    for share in range(shares):
        hot = hot_cells(corpus, cells, least, shares, share)
        candidates(corpus, hot, cells, shares, share).write.mode("append").parquet(path)
    listed = spark.read.schema("lang string, phrase string, n bigint").parquet(path)
    totals = listed.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = listed.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return staged(counts, "counts", light=True), totals


def _joined(words: Column, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact for products of up to 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    above, below = wide(a) * wide(n) * F.lit(1000).cast("decimal(38,0)"), wide(left) * wide(right)
    return F.call_function("div", above, below)


def ranked(counts: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of each language; ``counts``: lang, phrase, f; ``totals``: lang, n."""
    words = counts.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w"))
    phrases = words.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "w", "k")
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = phrases.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.col("w"), 1, F.col("cut")).alias("left"), _joined(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(F.broadcast(totals), "lang")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = phrases.where("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    inner = inner.groupBy("lang", _joined(F.col("w"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    stay = best.join(inner, ["lang", "phrase"], "left").where("longer is null or longer < a")
    rows = stay.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    # the best of each share of a language's phrases first, so that few reach the task that ranks them
    share = F.pmod(F.xxhash64("phrase"), F.lit(16))
    rows = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top).drop("share", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the best phrases of each language."""
    return ranked(*phrase_counts(docs, text_col, lang_col, least), top)
