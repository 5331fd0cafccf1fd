"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is a weighted set: its shingles of ``SHINGLE`` words, each of weight
one (or its number of occurrences, ``weighted``).  Every element owns the
quarter plane of weight and rank; hashed darts fall on it at unit density, the
same for every document that has the element.  A document keeps the darts
below its elements' weights, each dart belongs to one of ``K`` coordinates,
and the earliest dart of each coordinate forms the signature.  Two signatures
agree in a coordinate with the probability of the weighted Jaccard similarity.
Bands of ``ROWS`` coordinates are the join keys.

The plane is cut dyadically: region (v, r) spans weights from ``2**v - 1`` and
ranks from ``2**r - 1``, both to twice their size, in ``2**r`` by ``2**v`` cells
of unit area.  So an element costs about the area it shows, not its weight.

Links come from candidates of the bands, each verified on whole texts:

1. documents with equal shingle sets become one representative;
2. the least member of each bucket is its leader, all members are compared
   with it, and verified pairs merge into components;
3. buckets that still hold several components go on in rounds.  Each round
   takes a number of members of each such bucket (the same ones in all buckets
   they share), compares them with all members of other components, and
   retires them, until no bucket is open.

From the second round on a pair is formed only if it passes two exact bounds,
which no pair of the wanted similarity fails:

- shingles that one open document alone has meet no other; what is left of a
  document bounds all its intersections;
- each document carries a parity bitmap of its shingles, of four bits or more
  for each.  Bits in which two bitmaps differ (the wider one folded by xor) are
  no more than the shingles in which the sets differ.

So every pair of a bucket is either bounded below the similarity, compared, or
found connected; a bucket never emits all of its pairs, and there is no cap.
Members of a large bucket are dealt over several tasks, its leaders copied to
each.  A pair at similarity 0.8 shares no bucket with a probability of about
``(1 - 0.8**ROWS)**BANDS``.

Defined results: words are runs of letters and digits in lower case; fewer
words than a shingle form one shingle.  Rows are told apart by id and text, so
texts that share an id are compared like others.  A text without words (null,
empty, punctuation only) is a class of its own.  ``class_id`` is the least id
of the class; null where no row of the class has an id.  Repeated rows get
equal classes.  Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release, staged

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
K = BANDS * ROWS
#: Members of an open bucket that are compared with all others in the first round; later rounds take four times as many, up to the last number.
LEADERS, MOST_LEADERS = 16, 4096
#: Members of a bucket that one task compares with its leaders.
DEALT = 20_000
#: A set of equal documents is joined by broadcast from this share of all documents on; so there are at most as many such sets.
HEAVY = 1_000
#: Shingle hashes that a verifying task remembers.
REMEMBERED = 4 << 20
#: Least bits of a parity bitmap for each shingle.
BITS = 4

_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_U = np.uint64
_STEP = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)
#: Cumulative probabilities of a Poisson(1) count, as 53-bit thresholds.
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * (1.0 / (1 << 53))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of a whole text, and how often each occurs."""
    words = text.lower().encode().translate(_FOLD).split() if text else []
    if not words:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    digest = xxhash.xxh3_64_intdigest
    ids = np.fromiter(map(digest, words), _U, len(words))
    n = max(1, len(ids) - size + 1)
    total = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(ids))):
            total += ids[k : k + n] * (_STEP[k % 8] * _U(2 * (k // 8) + 1))
    return np.unique(_mix(total), return_counts=True)


@lru_cache(maxsize=256)
def _cells(levels: int, depth: int) -> tuple[np.ndarray, ...]:
    """The dyadic cells of weight levels and rank depths up to these: salt, lower weight, width, lower rank, height."""
    parts = []
    for v in range(levels + 1):
        for r in range(depth + 1):
            across, along = 1 << r, 1 << v  # cells over the weights and over the ranks of the region
            at = np.arange(across * along)
            salt = _mix((at + 1).astype(_U) * _U(0x8CB92BA72F3D8DD7) ^ np.full(len(at), (v << 8 | r) + 1, _U) * _U(0xD1B54A32D192ED03))
            width, height = along / across, across / along
            parts.append((salt, along - 1 + (at // along) * width, np.full(len(at), width), across - 1 + (at % along) * height, np.full(len(at), height)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def darts(elements: np.ndarray, weights: np.ndarray, limit: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts of rank up to ``limit`` inside the weighted regions: rank, coordinate, identity.

    Each cell's count is Poisson(1) by its own hash, so every document throws
    the same darts there, whatever its weights and its limit are.
    """
    depth = int(np.floor(np.log2(1 + limit)))
    levels = np.maximum(np.ceil(np.log2(1 + weights)).astype(np.int64) - 1, 0)  # the last level that starts below the weight
    ranks, dartboard = [], []
    for level in np.unique(levels):
        own = levels == level
        salt, left, width, low, height = (x for x in _cells(int(level), depth))
        near = np.flatnonzero(low <= limit)
        salt, left, width, low, height = (x[near] for x in (salt, left, width, low, height))
        with np.errstate(over="ignore"):
            cell = _mix((elements[own][:, None] ^ salt[None, :]).ravel())
            count = np.searchsorted(_POISSON, _unit(cell), side="right")
            at = np.repeat(np.arange(len(cell)), count)
            nth = (np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + 1).astype(_U)
            dart = _mix(cell[at] + nth * _U(0x2545F4914F6CDD1D))
            which = at % len(salt)
            rank = low[which] + _unit(dart) * height[which]
            weight = left[which] + _unit(_mix(dart ^ _U(0x9FB21C651E98DF25))) * width[which]
        inside = (rank <= limit) & (weight < weights[own][at // len(salt)])
        ranks.append(rank[inside])
        dartboard.append(dart[inside])
    rank, dart = np.concatenate(ranks), np.concatenate(dartboard)
    coordinate = (_mix(dart ^ _U(0x5851F42D4C957F2D)) % _U(k)).astype(np.int64)
    return rank, coordinate, dart


def signature(elements: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """The identity of the earliest dart of each coordinate."""
    limit = k * (np.log(k) + 3) / float(weights.sum())
    while True:
        rank, coordinate, dart = darts(elements, weights, limit, k)
        out, filled = np.zeros(k, _U), np.zeros(k, bool)
        order = np.argsort(-rank, kind="stable")
        out[coordinate[order]] = dart[order]
        filled[coordinate] = True
        if filled.all():
            return out
        limit *= 2


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(rows)], _U)
        return _mix((sig.reshape(bands, rows) * step).sum(axis=1, dtype=_U) + np.arange(1, bands + 1, dtype=_U) * _U(0xE7037ED1A0B428DB)).view(np.int64)


def members_of(text: str | None, weighted: bool = False) -> np.ndarray:
    """Distinct hashes of a text's shingles; if weighted, of its first, second, ... occurrences of each.

    The plain similarity of the latter is the weighted one of the former.
    """
    elements, times = shingles(text)
    if not weighted or not len(elements):
        return elements
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    with np.errstate(over="ignore"):
        return np.unique(_mix(np.repeat(elements, times) + nth.astype(_U) * _U(0xD1B54A32D192ED03)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the similarity is at least ``least``; sizes too far apart need no look at the elements."""
    return min(len(a), len(b)) >= least * max(len(a), len(b)) and similarity(a, b) >= least


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """For each bit, the parity of the hashes that fall on it: words, a power of two of them."""
    words = 1 << int(np.ceil(np.log2(max(1, BITS * len(hashes) / 64))))
    parity = np.bincount((hashes % _U(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ, the wider one folded once: at most the hashes that one of the sets has alone."""
    words = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > words, F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)


def placed_rows(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``place`` (128 bits, the same for the same id and text), ``id`` and ``text`` of each row; if asked for, the whole ``row``."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *row)
    named = F.when(F.col("id").isNull(), "").otherwise(F.concat(F.lit("id "), F.col("id").cast("string")))
    held = F.concat(named, F.lit(" "), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    return rows.select(F.unhex(F.md5(held.cast("binary"))).alias("place"), *rows.columns)


def signatures(rows: DataFrame, weighted: bool = False) -> DataFrame:
    """``place``, ``id``, ``same`` (digest of the shingle set; null without words) and ``keys`` of each placed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, keys = [], []
            for t in b.column("text"):
                elements, times = shingles(t.as_py())
                if len(elements):
                    weights = times.astype(float) if weighted else np.ones(len(elements))
                    same.append(xxhash.xxh3_128_digest(np.concatenate([elements, times.astype(_U)]).tobytes() if weighted else elements.tobytes()))
                    keys.append(band_keys(signature(elements, weights)))
                else:
                    same.append(None)
                    keys.append(np.zeros(0, np.int64))
            starts = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("place"), b.column("id"), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))],
                ["place", "id", "same", "keys"],
            )

    return rows.mapInArrow(run, f"place binary, id {dict(rows.dtypes)['id']}, same binary, keys array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, least: float, weighted: bool = False) -> DataFrame:
    """Those pairs (a, b) whose whole texts are at least ``least`` similar. ``texts``: id, text, one row an id."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        size = 0

        def elements(key, text: pa.Scalar) -> np.ndarray:
            nonlocal size
            if key not in known:
                if size > REMEMBERED:
                    known.clear()
                    size = 0
                known[key] = members_of(text.as_py(), weighted)
                size += len(known[key])
            return known[key]

        for batch in batches:
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"))
            good = [similar(elements(a, x), elements(b, y), least) for a, b, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def bounds(texts: DataFrame, ids: DataFrame, weighted: bool = False) -> DataFrame:
    """``id``, ``n`` (its shingles), ``bits`` (their bitmap) and ``u``: those of them that another of these documents has too.

    Whatever two of these documents share, each of them shares; so ``u`` bounds
    every intersection.  Shingles of one document alone are counted by two
    aggregations, each combined before its shuffle, without a join.
    """
    chosen = staged(texts.join(ids.distinct(), "id", "left_semi").select("id", "text"), "chosen")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("id").to_pylist(), b.column("text")):
                h = members_of(text.as_py(), weighted).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.int64()), pa.array(h)], ["id", "h"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [members_of(text.as_py(), weighted) for text in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(h) for h in sets], pa.int64()), pa.array([bitmap(h) for h in sets], pa.list_(pa.int64()))], ["id", "n", "bits"])

    alone = chosen.mapInArrow(spread, "id bigint, h bigint").groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    sizes = chosen.mapInArrow(drawn, "id bigint, n bigint, bits array<bigint>")
    return sizes.join(alone, "id", "left").select("id", "n", "bits", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("u"))


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``label`` (the least id of its component) for every end of (a, b) edges.

    Each round hangs every node on its least neighbour, shortens the paths by
    pointer jumping, and goes on with the edges between different trees.
    Tables, not lineage, carry the state from round to round.
    """
    label: DataFrame | None = None
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", light=True)
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("up")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("up")))
        hung = staged(ends.groupBy("id").agg(F.min("up").alias("up")), "tree", light=True)
        tree = hung
        while True:
            upper = tree.select(F.col("id").alias("up"), F.col("up").alias("top"))
            longer = staged(tree.join(upper, "up").select("id", "up", "top"), "jump", light=True)
            release(hung)
            hung, tree = longer, longer.select("id", F.col("top").alias("up"))
            if longer.where("up <> top").isEmpty():
                break
        own = tree.select("id", F.col("up").alias("label"))
        if label is None:
            label = staged(own, "labels", light=True)
        else:
            further = staged(label.join(own.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left").select("id", F.coalesce("top", "label").alias("label")), "labels", light=True)
            release(label)
            label = further
        a, b = (own.select(F.col("id").alias(x), F.col("label").alias(f"{x}2")) for x in ("a", "b"))
        rest = staged(edges.join(a, "a").join(b, "b").where("a2 <> b2").select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct(), "edges", light=True)
        release(edges, hung)
        edges = rest
    return label if label is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("label"))


def linked(reps: DataFrame, owners: DataFrame, rows: DataFrame, least: float, weighted: bool) -> DataFrame:
    """``id`` and ``label`` of every representative that has a link. ``reps``: id, keys; ``owners``: id, place; ``rows``: place, text."""
    members = staged(reps.select("id", F.explode("keys").alias("key")), "members")
    full = staged(members.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("other")).where("b <> other").select("key", "b"), "buckets", light=True)
    open_ = staged(members.join(full, "key"), "open")
    shown = open_.select("id").distinct()
    wanted = staged(owners.join(shown, "id", "left_semi"), "owners", light=True)
    # texts move once, whatever the size of the table, and are then where they are grouped
    texts = staged(rows.select("place", "text").join(wanted.hint("merge"), "place").groupBy("place", "id").agg(F.min("text").alias("text")).select("id", "text"), "texts")
    release(members)

    candidates = open_.select(F.col("id").alias("a"), "b").where("a <> b")
    done = full.select("key", F.col("b").alias("id"))
    bounded: list[str] = []
    links: DataFrame | None = None
    tried: DataFrame | None = None
    label: DataFrame | None = None
    turn = 0
    while True:
        todo = candidates.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        if tried is not None:
            todo = todo.join(tried, ["a", "b"], "left_anti")
        todo = staged(todo, "pairs", light=True)
        found = staged(verified(todo, texts, least, weighted), "links")
        tried = todo if tried is None else tried.unionByName(todo)
        if label is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            release(label)
            label = components(links)
        turn += 1

        labelled = open_.select("key", "id", *bounded).join(done, ["key", "id"], "left_anti").join(label, "id", "left").select("key", "id", *bounded, F.coalesce("label", "id").alias("label"))
        labelled = staged(labelled, "labelled", light=True)
        # retired members have met the whole bucket; what is left is open while it spans components
        several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
        several = staged(several.select("key", (F.floor(F.col("size") / DEALT) + 1).cast("int").alias("parts")), "several", light=True)
        rest = staged(labelled.join(several, "key"), "open", light=True)
        release(open_, labelled, several)
        open_ = rest
        if open_.isEmpty():
            return label
        if not bounded:
            # no partner is left for a document of which too little is found in any other open one
            bounded = ["n", "bits", "u"]
            room = staged(bounds(texts, open_.select("id"), weighted), "bounds").where(F.col("u") >= least * F.col("n") - 1e-6)
            rest = staged(open_.join(room, "id"), "open", light=True)
            release(open_)
            open_ = rest
        seats = min(MOST_LEADERS, LEADERS * 4 ** (turn - 1))
        chosen = open_.groupBy("key", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(seats)).alias("seat")).agg(F.min(F.struct("id", "label", "n", "u", "bits", "parts")).alias("m"))
        leaders = staged(chosen.select("key", *(F.col(f"m.{x}").alias(y) for x, y in (("id", "b"), ("label", "lb"), ("n", "nb"), ("u", "ub"), ("bits", "bits_b"), ("parts", "parts_b")))), "seats", light=True)
        dealt = open_.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        copied = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        most, total = F.least("u", "ub"), F.col("n") + F.col("nb")
        room_left = (most >= least * (total - most) - 1e-6) & (F.least("n", "nb") >= least * F.greatest("n", "nb") - 1e-6)
        alike = differing(F.col("bits"), F.col("bits_b")) * (1 + least) <= (1 - least) * total + 1e-6
        candidates = dealt.join(copied, ["key", "part"]).where((F.col("label") != F.col("lb")) & room_left & alike).select(F.col("id").alias("a"), "b")
        done = leaders.select("key", F.col("b").alias("id"))


def sized_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the one row of ``right`` for each key, whose ``size`` says how many rows of ``left`` have the key.

    Keys of more than a ``HEAVY``-th of the rows (so at most ``HEAVY`` keys) are joined by broadcast, all others by a shuffle.
    """
    total = right.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("size") > max(DEALT, total // HEAVY)
    large = F.broadcast(right.where(heavy).drop("size"))
    rest = left.join(F.broadcast(large.select(key)), key, "left_anti")
    return left.join(large, key).unionByName(rest.join(right.where(~heavy).drop("size"), key))


def classes(rows: DataFrame, least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """``place``, ``id``, ``class`` (one value for each class) and ``class_id`` (its least id) of each row of ``placed_rows``.

    Sets of shingles are numbered when their table is written, so no two share a number.
    """
    made = staged(signatures(rows, weighted), "signatures")
    known = made.where("same is not null").select("place", "id", "same")
    sets = known.groupBy("same").agg(F.min("place").alias("place"), F.min("id").alias("least_id"), F.count("*").alias("size"))
    sets = staged(sets.withColumn("rep", F.monotonically_increasing_id()), "sets", light=True)
    reps = made.select("same", "place", "keys").join(sets.select("same", "place", F.col("rep").alias("id")), ["same", "place"]).dropDuplicates(["same", "place"]).select("id", "keys")
    label = linked(reps, sets.select(F.col("rep").alias("id"), "place"), rows, least, weighted)
    named = staged(sets.join(label.select(F.col("id").alias("rep"), "label"), "rep", "left").select("same", F.unhex(F.lpad(F.hex(F.coalesce("label", "rep")), 16, "0")).alias("class"), "least_id", "size"), "named", light=True)
    ids = staged(named.groupBy("class").agg(F.min("least_id").alias("class_id"), F.count("*").alias("size")), "ids", light=True)
    full = staged(sized_join(named.select("same", "class", F.col("size").alias("rows")), ids, "class").select("same", "class", "class_id", F.col("rows").alias("size")), "classes", light=True)
    placed = sized_join(known, full, "same").select("place", "id", "class", "class_id")
    alone = made.where("same is null").select("place", "id", F.col("place").alias("class"), F.col("id").alias("class_id"))
    return placed.unionByName(alone)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and ``class_id``; with ``weighted``, repeated shingles count as often as they stand."""
    return classes(placed_rows(docs, id_col, text_col), least, weighted).select(F.col("id").alias(id_col), "class_id")
