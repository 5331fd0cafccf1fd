"""Benchmark decontamination: a prefix-filtered containment join.

A benchmark item is the set of its windows of ``WINDOW`` consecutive words (an
item of fewer words is one window).  A window is contained in a document only
if every word of it is there, so its rarest word alone is a necessary prefix.
Words are ordered by their count over all documents, each window is filed
under its rarest word with that word's place in the window, and a document is
probed only where such a word stands: the place fixes where the window would
begin (positional bound), the window must end within the document (length
bound), and the words of that stretch are then compared with the window
(exact verification).

A benchmark of at most ``PART_BYTES`` bytes of item text goes to every task, and
each document is judged where it is read.  A larger one stays a table: tasks get
two bit filters of fixed size, one of the rarest words and one of the windows,
and each document hands on the stretches of words that pass both.  These few are
joined with the windows by a 128-bit hash and then word by word.  Either way the
documents are read once for the counts and once for the search, whatever the
benchmark's size, and what is shipped has a fixed bound; a filter that fills up
lets more stretches through to the join, and no result changes.

Defined results: A-Z count as a-z; words are runs of ASCII letters, digits and
all characters beyond ASCII.  A null or wordless text has no words and no
hits.  A null or wordless item has no windows.  Windows of an item without an id
hit words like others, but there is no id to count or list.
Rows that share an item id are one item.  Repeated documents are judged row by
row, so each keeps its own result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep, schema_with, staged

WINDOW = 10
#: Bytes of item text that are shipped to every task as they are.
PART_BYTES = 4 << 20
#: Bits of a filter, windows of a piece of an item, and distinct words that a task holds.
FILTER_BITS, PIECE, COUNTED = 1 << 26, 4096, 1 << 20

#: A-Z become a-z; ASCII that is neither letter nor digit becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[list[bytes]]:
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))] if words else []


class PrefixIndex:
    """Windows filed under their rarest word."""

    def __init__(self, items: list[tuple[str | None, bytes]], counts: dict[bytes, int], window: int = WINDOW):
        #: rarest word -> {(place in the window, words of the window)}
        self.places: dict[bytes, set[tuple[int, int]]] = {}
        #: the window's words, joined -> the items that have it
        self.items: dict[bytes, set[str | None]] = {}
        for item, raw in items:
            for w in windows_of(words_of(raw), window):
                at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
                self.places.setdefault(w[at], set()).add((at, len(w)))
                self.items.setdefault(b" ".join(w), set()).add(item)
        self.prefixes = frozenset(self.places)

    def probe(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Stretches of words that are a window, and the items whose windows occur."""
        spans, found = [], set()
        if self.prefixes.isdisjoint(words):
            return spans, found
        n, places, items = len(words), self.places, self.items
        for p in [i for i, w in enumerate(words) if w in places]:
            for at, size in places[words[p]]:
                first = p - at
                if first >= 0 and first + size <= n and (hit := items.get(b" ".join(words[first : first + size]))):
                    spans.append((first, first + size))
                    found |= hit
        return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans."""
    total, end = 0, 0
    for a, b in sorted(set(spans)):
        if b > end:
            total += b - max(a, end)
            end = b
    return total


def word_counts(docs: DataFrame, wanted: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each wanted word stands in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(held.value)}
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            total += np.bincount(np.fromiter((number[w] for raw in texts for w in words_of(raw.as_py()) if w in number), np.int64), minlength=len(number))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["word", "n"])

    rows = keep(docs, text_col).mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    return {wanted[i]: n for i, n in zip(rows["word"].to_pylist(), rows["n"].to_pylist())}


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """``item`` (the id as a string, null for none) and ``raw`` of the items that can have windows."""
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("raw")).where("length(raw) > 0")


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Places of 64-bit hashes in a filter of ``FILTER_BITS`` bits."""
    return (hashes.astype(np.int64).view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)


def filled(hashes: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits, set where one of the hashes falls; tasks hand on their filters by pages that are not empty."""
    page = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FILTER_BITS, bool)
        for b in batches:
            held[_bits(b.column(0).to_numpy(zero_copy_only=False))] = True
        pages = [k for k in range(FILTER_BITS // page) if held[k * page : (k + 1) * page].any()]
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int32()), pa.array([np.packbits(held[k * page : (k + 1) * page]).tobytes() for k in pages], pa.binary())], ["page", "bits"])

    def union(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in pages:
            for k, raw in zip(b.column("page").to_pylist(), b.column("bits").to_pylist()):
                bits = np.frombuffer(raw, np.uint8)
                held[k] = held[k] | bits if k in held else bits
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["page", "bits"])

    schema = "page int, bits binary"
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in hashes.mapInArrow(run, schema).repartition(8, "page").mapInArrow(union, schema).toLocalIterator():
        out[r.page * page // 8 : (r.page + 1) * page // 8] |= np.frombuffer(r.bits, np.uint8)
    return out


def all_word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``word`` (a 64-bit hash) and ``n`` of all words; tasks count before the shuffle, a million distinct words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in held], pa.int64()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()):
                held.update(words_of(raw.as_py()))
                if len(held) > COUNTED:
                    yield flush()
        yield flush()

    return keep(docs, text_col).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def filed_windows(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """``item``, ``rare`` (its rarest word's hash), ``stretch`` (its words, joined), ``key`` (their hash), ``at`` and ``size`` of every distinct window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw in zip(b.column("item").to_pylist(), b.column("raw").to_pylist()):
                words = words_of(raw)
                number = max(1, len(words) - window + 1) if words else 0
                for first in range(0, number, PIECE):  # a piece has all words of its windows
                    some = words[first : min(first + PIECE, number) + window - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([some], pa.list_(pa.binary())), pa.array([[_hash(w) for w in some]], pa.list_(pa.int64()))], ["item", "piece", "words", "hashes"])

    pieces = staged(items.mapInArrow(cut, "item string, piece bigint, words array<binary>, hashes array<bigint>"), "benchmark-pieces")
    wanted = pieces.select(F.explode("hashes").alias("word")).distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = pieces.select("piece", F.explode(F.array_distinct("hashes")).alias("word")).join(wanted, "word").groupBy("piece").agg(F.map_from_entries(F.collect_set(F.struct("word", "n"))).alias("counts"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words, counts in zip(b.column("item").to_pylist(), b.column("words").to_pylist(), b.column("counts").to_pylist()):
                known, seen = dict(counts), {}
                for w in windows_of(words, window):
                    at = min(range(len(w)), key=lambda i: (known[_hash(w[i])], w[i], i))
                    seen[b" ".join(w)] = (_hash(w[at]), at, len(w))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(seen), pa.string()), pa.array([r for r, *_ in seen.values()], pa.int64()), pa.array(list(seen), pa.binary()), pa.array(map(_hash, seen), pa.int64()), pa.array([x for _, x, _ in seen.values()], pa.int32()), pa.array([n for *_, n in seen.values()], pa.int32())],
                    ["item", "rare", "stretch", "key", "at", "size"],
                )

    joined = pieces.select("item", "piece", "words").join(ranked, "piece").select("item", "words", "counts")
    return staged(joined.mapInArrow(file, "item string, rare bigint, stretch binary, key bigint, at int, size int").distinct(), "benchmark-windows")


def found_stretches(texts: DataFrame, windows: DataFrame, text_col: str, window: int) -> DataFrame:
    """``text_key``, ``spans`` (first and end of every stretch that is a window, in turn) and ``item_ids`` of each distinct text that has one."""
    rare, keys = filled(windows.select("rare")), filled(windows.select("key"))
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window`` of them
    held = texts.sparkSession.sparkContext.broadcast((rare, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, keys = held.value
        known: dict[bytes, bool] = {}

        def passes(bits: np.ndarray, h: int) -> bool:
            k = (h & ((1 << 64) - 1)) % FILTER_BITS
            return bool(bits[k >> 3] >> (7 - (k & 7)) & 1)

        for b in batches:
            out: list[tuple[str, int, int, bytes, int]] = []
            for key, raw in zip(b.column("text_key").to_pylist(), b.column(text_col).cast(pa.binary())):
                words = words_of(raw.as_py())
                for w in set(words).difference(known):
                    known[w] = passes(rare, _hash(w))
                tried = set()
                for p in [i for i, w in enumerate(words) if known[w]]:
                    for size in sizes:
                        tried.update((f, size) for f in range(max(0, p - size + 1), min(p, len(words) - size) + 1))
                for first, size in tried:
                    stretch = b" ".join(words[first : first + size])
                    if passes(keys, h := _hash(stretch)):
                        out.append((key, first, size, stretch, h))
                if len(known) > COUNTED:
                    known.clear()
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))], ["text_key", "first", "size", "stretch", "key"])

    candidates = texts.mapInArrow(run, "text_key string, first int, size int, stretch binary, key bigint").distinct()
    hits = staged(candidates.join(windows.select("key", "stretch", "item"), ["key", "stretch"]).select("text_key", "first", "size", "item"), "benchmark-hits")
    return hits.groupBy("text_key").agg(F.collect_set(F.struct("first", (F.col("first") + F.col("size")).alias("end"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("item_ids"))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted strings) and ``contaminated``.

    ``carry`` names columns of ``docs`` to pass on.  ``benchmark`` has
    ``item_id`` and ``text``.
    """
    names = [id_col, *(c for c in carry if c != id_col)]
    out = keep(docs, *dict.fromkeys([*names, text_col]))
    items = benchmark_items(benchmark)
    size = items.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()[0]
    schema = schema_with(out, names, "n_words bigint, n_hit bigint, item_ids array<string>, contaminated boolean")

    def judged(batch: pa.RecordBatch, made: list[tuple[int, int, list[str]]]) -> pa.RecordBatch:
        n, hit, ids = zip(*made) if made else ((),) * 3
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array([h > 0 for h in hit], pa.bool_())], [*names, "n_words", "n_hit", "item_ids", "contaminated"])

    if size > part_bytes:
        windows = filed_windows(items, staged(all_word_counts(out, text_col), "word-counts"), window)
        keyed = out.withColumn("text_key", F.sha2(F.col(text_col).cast("binary"), 256))
        found = staged(found_stretches(keyed.select("text_key", text_col), windows, text_col, window), "benchmark-found")

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(b.column(text_col).cast(pa.binary()), b.column("spans").to_pylist(), b.column("item_ids").to_pylist())
                yield judged(b, [(len(words_of(raw.as_py())), covered([(s["first"], s["end"]) for s in spans or []]), ids or []) for raw, spans, ids in rows])

        return keyed.join(found, "text_key", "left").drop("text_key").mapInArrow(tell, schema)

    rows = items.toArrow()
    pairs = list(zip(rows["item"].to_pylist(), rows["raw"].to_pylist()))
    vocabulary = sorted({w for _, raw in pairs for w in words_of(raw)})
    counts = word_counts(out, vocabulary, text_col) if vocabulary else {}
    held = docs.sparkSession.sparkContext.broadcast((pairs, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PrefixIndex(*held.value, window)
        for batch in batches:
            made = []
            for raw in batch.column(text_col).cast(pa.binary()):
                words = words_of(raw.as_py())
                spans, found = index.probe(words)
                made.append((len(words), covered(spans), sorted(found - {None})))
            yield judged(batch, made)

    return out.mapInArrow(run, schema)


def with_digest(found: DataFrame) -> DataFrame:
    """Adds ``n_items`` and the SHA-256 of the sorted item ids joined by commas."""
    return found.withColumns({"n_items": F.size("item_ids").cast("bigint"), "items_sha256": F.sha2(F.array_join("item_ids", ","), 256)})
