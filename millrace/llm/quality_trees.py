"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from one look at a text's bytes.  Trees are grown on the driver
from a bounded sample of labelled documents (at most ``TRAIN_ROWS``, those with
the least hash of their id), with monotonic constraints on chosen features, and
are flattened into numpy arrays of nodes, so that scoring walks all trees for a
whole batch at once.  The cut-off is set on a held-out part of the sample so
that ``KEEP`` of its good documents stay.

Defined results: words are runs of anything but ASCII white space; null counts
as an empty text, which has no words and fails the base rule.  Without labels
the base rule alone decides.  Repeated rows are judged row by row; of several
labels for one id the lowest counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep

TRAIN_ROWS = 20_000
KEEP = 0.995
#: Words of a window whose repetition counts.
REPEAT = 8
#: Base rule: fewer words than this fail, and more than this share (in percent) of repeated words.
LEAST_WORDS, MOST_REPEATED = 20, 30
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

#: Feature and the direction in which quality may only fall (-1) as it grows; 0 is free.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_ratio": -1,
    "dup_line_ratio": -1,
    "repeat_ratio": -1,
    "upper_ratio": 0,
    "digit_ratio": 0,
    "punctuation_ratio": 0,
    "beyond_ascii_ratio": 0,
    "distinct_ratio": 0,
    "mean_line": 0,
    "sentence_end_ratio": 0,
}
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_PUNCTUATION = b".,;:!?\"'()-"
_HIGH = bytes(range(128, 256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``REPEAT`` words found twice or more."""
    n = len(words) - REPEAT + 1
    if n < 2:
        return 0
    number = dict(zip(words, range(len(words))))
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k, c in enumerate(_MIX):
        mixed += ids[k : k + n] * c
    order = np.sort(mixed)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))
    rows = np.lib.stride_tricks.sliding_window_view(ids, REPEAT)[at]
    found = Counter(keys := [r.tobytes() for r in rows])
    mark = np.zeros(len(words) + 1, np.int32)
    hit = at[[found[k] > 1 for k in keys]]
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + REPEAT, -1)
    return int((np.cumsum(mark) > 0).sum())


def statistics(raw: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts (``_COLUMNS``) and the features of one text in UTF-8."""
    words = raw.split()
    n = len(words)
    inner = raw.translate(None, SPACE)
    high = _count(raw, _HIGH)
    word_chars = len(inner) - _count(inner, bytes(range(128, 192)))
    symbols = _count(raw, SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    size, k = max(1, len(raw)), max(1, n)
    features = (
        np.log1p(n),
        word_chars / k,
        symbols / size,
        dup_lines / max(1, len(lines)),
        repeats / k,
        _count(raw, _UPPER) / size,
        _count(raw, _DIGIT) / size,
        _count(raw, _PUNCTUATION) / size,
        high / size,
        len(set(words)) / k,
        size / max(1, len(lines)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
    )
    return (n, word_chars, symbols, dup_lines, repeats), features


@dataclass
class Trees:
    """All trees as flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cut: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of features."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 10) -> Trees:
    """Boost logistic trees on binned features under monotonic constraints.

    A split on a constrained feature must order its two leaf values, and its
    middle bounds every value below either side.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for column, v in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            column.append(v)
        return k

    def split(k: int, rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> None:
        G, H = g[rows].sum(), h[rows].sum()
        value[k] = rate * float(np.clip(-G / (H + ridge), low, high))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(G - gl) / (H - hl + ridge), low, high)
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - ((G - gl) * wr + 0.5 * (H - hl + ridge) * wr**2) - G * G / (2 * (H + ridge))
                gain[(nl < least) | (len(rows) - nl < least)] = -np.inf
                if signs[f]:
                    gain[signs[f] * (wr - wl) < 0] = -np.inf
                if gain[s := int(np.argmax(gain))] > best[0]:
                    best = (gain[s], (f, s, wl[s], wr[s]))
        if best[1] is None:
            margin[rows] += value[k]
            return
        f, s, wl, wr = best[1]
        mid, a, b = (wl + wr) / 2, node(), node()
        feature[k], threshold[k], left[k], right[k] = f, edges[f][s], a, b
        sides = [(low, high), (low, high)]
        if signs[f]:
            sides = [(low, mid), (mid, high)] if signs[f] > 0 else [(mid, high), (low, mid)]
        goes = binned[rows, f] <= s
        split(a, rows[goes], level + 1, *sides[0], g, h)
        split(b, rows[~goes], level + 1, *sides[1], g, h)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(node())
        split(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p))
    return Trees(np.array(feature), np.array(threshold, float), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, keep_share: float = KEEP) -> Trees | None:
    """Trees from at most ``rows`` labelled documents; None without both kinds of label."""
    sample = (
        labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_y"))
        .where("_id is not null and _y is not null")
        .groupBy("_id").agg(F.min("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    # at most ``rows`` pairs of an id and a number, so the broadcast is bounded
    joined = keep(docs, id_col, text_col).join(F.broadcast(sample), F.col(id_col) == F.col("_id")).select("_id", "_y", text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(map(float, statistics(t.as_py() or b"")[1])) for t in b.column(text_col).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(found, pa.list_(pa.float64()))], ["_id", "_y", "x"])

    seen = joined.mapInArrow(run, f"_id {dict(sample.dtypes)['_id']}, _y int, x array<double>").groupBy("_id").agg(F.min("_y").alias("_y"), F.min("x").alias("x")).orderBy("_id").toArrow()
    if not len(seen):
        return None
    x, y = np.array(seen["x"].to_pylist()), np.array(seen["_y"].to_pylist(), float)
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held])) < 2:
        return None
    trees = grow(x[~held], y[~held], list(FEATURES.values()))
    good = trees.score(x[held][y[held] > 0]) if (y[held] > 0).any() else trees.score(x[y > 0])
    trees.cut = float(min(0.5, np.quantile(good, 1 - keep_share)))
    return trees


def judge_documents(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every whole text; one pass without a shuffle.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score and kept.
    """
    out = keep(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [statistics(t.as_py() or b"") for t in b.column(text_col).cast(pa.binary())]
            base = np.array([c for c, _ in both], np.int64).reshape(-1, len(_COLUMNS))
            n, repeats = base[:, 0], base[:, 4]
            failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
            score = trees.score(np.array([f for _, f in both], float)) if trees is not None and len(both) else np.ones(len(both))
            good = score >= (trees.cut if trees is not None else 0)
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(base[:, k]) for k in range(len(_COLUMNS))), pa.array(failed), pa.array(score), pa.array(~failed & good)], [id_col, *_COLUMNS, "base_failed", "score", "kept"])

    return out.mapInArrow(run, f"`{id_col}` {dict(out.dtypes)[id_col]}, " + ", ".join(f"{c} bigint" for c in _COLUMNS) + ", base_failed boolean, score double, kept boolean")
