"""Language ID with interpolated Kneser-Ney character models.

One model per language, all of the same order, estimated from a bounded sample
of labelled documents (at most ``TRAIN_DOCS`` documents and ``TRAIN_CHARS``
characters a language, those with the least hash of their id, of at most
``MOST_LANGUAGES`` languages; of a document the first ``1 / PARTS`` of these characters at most, so that a long one leaves room
for others).  For each order
the n-grams of all languages share one sorted array of 64-bit hashes; beside it
stand, for every language, the interpolated log probability of the last
character and the weight that its context leaves to the next lower order.  A
text's score in a language is the sum over its characters, found by binary
search from the highest order down, divided by their number; the least
cross-entropy wins.

The score is the winner's posterior under a temperature fitted on calibration
documents, times the fit: below one where even the winner's cross-entropy is
far above what calibration documents of that length have.  Rejection goes by
the fit alone, for a short text may be in any of several learnt languages and
still be in one of them; its cut-off lets ``ACCEPT`` of the calibration
documents pass.

Defined results: ``und`` with score 0 for a null text, a text without a
letter, and where there was nothing to learn from.  Of languages that fit
equally well the first by name wins.  Letter case, digits and punctuation don't
matter.  Repeated rows get equal results.  A text of any length takes some 40
bytes a character, for it is scored in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import keep, schema_with

ORDER = 4
TRAIN_DOCS, TRAIN_CHARS, PARTS = 400, 500_000, 20
#: Languages that are learnt at most: those with the most documents.
MOST_LANGUAGES = 500
ACCEPT, REJECT = 0.999, 0.3
#: A text fits up to so many spreads, and nats a character, above the calibration documents.
SPREADS, MARGIN = 8, 1.0
#: Share of calibration documents whose label may be wrong; without it a few of them would flatten all scores.
MISLABELLED = 0.02
UNDETERMINED = "und"
#: Characters laid out together, characters scored at once, and cells of characters by languages at once.
TOGETHER, AT_ONCE, CELLS = 1 << 19, 1 << 17, 1 << 22
_P = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_SPACE = 32


def letters(text: str | None) -> np.ndarray:
    """Code points in lower case; each run of non-letters is one space. Empty without a letter."""
    if not text:
        return np.zeros(0, np.uint32)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _LETTER[np.minimum(code, 0xFFFF)]
    if (far := code > 0xFFFF).any():
        known = known.copy()
        known[far] = [chr(c).isalpha() for c in code[far]]
    if not known.any():
        return np.zeros(0, np.uint32)
    code = np.where(known, code, np.uint32(_SPACE))
    use = known.copy()
    use[1:] |= known[:-1]
    return code[use]


def laid_out(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, ``order`` spaces before each; the places to score, and each one's text."""
    pad = np.full(order, _SPACE, np.uint32)
    size = np.array([len(t) for t in texts])
    flat = np.concatenate([x for t in texts for x in (pad, t)]) if len(texts) else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(texts)), size)
    places = np.arange(len(owner)) + (owner + 1) * order
    return flat, places, owner


def hashes(flat: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0..order the hash of the n characters that end at each place."""
    code = flat.astype(np.uint64) + np.uint64(1)
    out, power = [np.zeros(len(flat), np.uint64)], np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            h = out[-1].copy()
            h[n - 1 :] += code[: len(code) - n + 1] * power
            power = power * _P
            out.append(h)
    return out


@dataclass
class Counts:
    """Distinct n-grams of one language and one order, by hash."""

    keys: np.ndarray
    number: np.ndarray
    context: np.ndarray
    suffix: np.ndarray


def _grams(texts: list[np.ndarray], order: int) -> list[Counts]:
    flat, places, _ = laid_out(texts, order)
    h = hashes(flat, order)
    out = []
    for n in range(1, order + 1):
        keys, first, number = np.unique(h[n][places], return_index=True, return_counts=True)
        at = places[first]
        out.append(Counts(keys, number.astype(float), h[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64), h[n - 1][at] if n > 1 else np.zeros(len(at), np.uint64)))
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted hash in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    languages: list[str]
    order: int
    #: by order: sorted hashes and log probabilities, a column for each language
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    #: by order: sorted hashes of contexts (a text's start among them) and the log weights they leave to the order below
    contexts: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    unknown: np.ndarray | None = None
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    cut: float = 0.0

    def entropies(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character for each text (without letters: inf) and language, and lengths."""
        flat, places, owner = laid_out(texts, self.order)
        size = np.bincount(owner, minlength=len(texts))
        sums = np.zeros((len(texts), len(self.languages)))
        step = max(1, min(AT_ONCE, CELLS // max(1, len(self.languages))))
        for begin in range(0, len(places), step):
            part, whose = places[begin : begin + step], owner[begin : begin + step]
            low = part[0] - self.order  # what stands before decides too
            total = self._logs(hashes(flat[low : part[-1] + 1], self.order), part - low)
            first = whose[0]
            for k in range(len(self.languages)):
                found = np.bincount(whose - first, total[:, k])
                sums[first : first + len(found), k] += found
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(size[:, None] > 0, -sums / size[:, None], np.inf), size

    def _logs(self, h: list[np.ndarray], places: np.ndarray) -> np.ndarray:
        """Log probability of the character at each place, for every language."""
        total = np.zeros((len(places), len(self.languages)), np.float32)
        todo = np.arange(len(places))
        for n in range(self.order, 0, -1):
            row, known = _find(self.keys[n - 1], h[n][places[todo]])
            total[todo[known]] += self.logp[n - 1][row[known]]
            todo = todo[~known]
            if not len(todo):
                break
            if n > 1:
                row, known = _find(self.contexts[n - 1], h[n - 1][places[todo] - 1])
                total[todo[known]] += self.weight[n - 1][row[known]]
        total[todo] += self.unknown
        return total

    def scores(self, entropy: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winner, score and fit of each row; rows without letters score 0 and fit nothing."""
        best = np.argmin(entropy, axis=1)
        least = entropy[np.arange(len(best)), best]
        with np.errstate(invalid="ignore", over="ignore"):
            gap = (entropy - least[:, None]) * size[:, None] * self.temperature
            posterior = 1 / np.exp(-gap).sum(axis=1)
            fit = np.ones(len(best))
            if self.mean is not None:
                excess = least - self.mean[best] - SPREADS * self.spread[best] / np.sqrt(np.maximum(size, 1)) - MARGIN
                fit = np.exp(-2 * np.maximum(excess, 0))
        some = size > 0
        return best, np.where(some, np.nan_to_num(posterior * fit), 0.0), np.where(some, fit, 0.0)


def estimate(samples: dict[str, list[np.ndarray]], order: int = ORDER, discount: float = 0.75) -> Model:
    """Interpolated Kneser-Ney: raw counts at the top, continuation counts below."""
    names = sorted(samples)
    grams = {k: _grams(samples[k], order) for k in names}
    model = Model(names, order)
    symbols = len(np.unique(np.concatenate([grams[k][0].keys for k in names]))) + 1
    uniform = -np.log(symbols)
    for n in range(order):
        model.keys.append(np.unique(np.concatenate([grams[k][n].keys for k in names])))
        model.contexts.append(np.unique(np.concatenate([grams[k][n].context for k in names])))
        model.logp.append(np.zeros((len(model.keys[n]), len(names))))
        model.weight.append(np.zeros((len(model.contexts[n]), len(names))))
    model.unknown = np.zeros(len(names), np.float32)
    for j, k in enumerate(names):
        for n in range(order):
            g = grams[k][n]
            if n + 1 < order:  # distinct characters seen before the n-gram; at a text's start it has no other context
                above = grams[k][n + 1]
                seen = np.bincount(np.searchsorted(g.keys, above.suffix).clip(0, len(g.keys) - 1), minlength=len(g.keys)).astype(float)
                number = np.maximum(seen, 1.0)
            else:
                number = g.number
            contexts, inverse = np.unique(g.context, return_inverse=True)
            total, kinds = np.bincount(inverse, number), np.bincount(inverse)
            left = np.log(discount * kinds / total)
            if n == 0:
                model.unknown[j] = left[0] + uniform
                lower = np.full(len(model.keys[0]), left[0] + uniform)
            else:
                model.weight[n][np.searchsorted(model.contexts[n], contexts), j] = left
                lower = _lower(model, grams, names, n, j)
            own = np.searchsorted(model.keys[n], g.keys)
            p = np.exp(lower)
            p[own] += (number - discount) / total[inverse]
            model.logp[n][:, j] = np.log(p)
    model.logp, model.weight = [x.astype(np.float32) for x in model.logp], [x.astype(np.float32) for x in model.weight]
    return model


def _lower(model: Model, grams: dict[str, list[Counts]], names: list[str], n: int, j: int) -> np.ndarray:
    """For every n-gram of the shared array: what language ``j`` gives it by way of the order below."""
    keys = np.concatenate([grams[k][n].keys for k in names])
    _, first = np.unique(keys, return_index=True)
    context = np.concatenate([grams[k][n].context for k in names])[first]
    suffix = np.concatenate([grams[k][n].suffix for k in names])[first]
    return model.weight[n][np.searchsorted(model.contexts[n], context), j] + model.logp[n - 1][np.searchsorted(model.keys[n - 1], suffix), j]


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, mod 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most_docs: int, most_chars: int) -> list[tuple[str, str]]:
    """(language, text) pairs: labelled documents outside the held-out third, least hash first, long ones by their start."""
    usable = keep(docs, id_col, text_col, lang_col).where((remainder(id_col) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return []
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * most_docs / n)))), F.col(lang_col))
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    by = Window.partitionBy(lang_col).orderBy("_draw", id_col)
    chosen = (
        usable.withColumn("_draw", draw).where(F.col("_draw") < share)
        .withColumn(text_col, F.substring(text_col, 1, max(1, most_chars // PARTS)))
        .withColumns({"_row": F.row_number().over(by), "_chars": F.sum(F.length(text_col)).over(by.rowsBetween(Window.unboundedPreceding, 0))})
        .where((F.col("_row") <= most_docs) & (F.col("_chars") <= most_chars))
        .orderBy(lang_col, "_row")
    )
    rows = chosen.select(lang_col, text_col).toArrow()
    return list(zip(rows[lang_col].to_pylist(), rows[text_col].to_pylist()))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> Model | None:
    """Models of all labelled languages; every fifth sampled document calibrates."""
    pairs = [(k, x) for k, t in training_sample(docs, id_col, text_col, lang_col, most_docs, most_chars) if len(x := letters(t))]
    learn: dict[str, list[np.ndarray]] = {}
    held: list[tuple[str, np.ndarray]] = []
    for i, (k, x) in enumerate(pairs):
        if i % 5 == 4 and k in learn:
            held.append((k, x))
        else:
            learn.setdefault(k, []).append(x)
    if not learn:
        return None
    model = estimate(learn, order)
    if held:
        entropy, size = model.entropies([x for _, x in held])
        truth = np.array([model.languages.index(k) for k, _ in held])
        own = entropy[np.arange(len(truth)), truth]

        def loss(t: float) -> float:
            z = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) * size[:, None] * t)
            p = z[np.arange(len(truth)), truth] / z.sum(axis=1)
            return float(-np.log((1 - MISLABELLED) * p + MISLABELLED / len(model.languages)).mean())

        model.temperature = min((0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0), key=loss)
        # medians, so that a few calibration documents in another language widen nothing
        gap = lambda rows, j: np.median(np.abs(own[rows] - model.mean[j]) * np.sqrt(size[rows])) / 0.6745
        each = [truth == j if (truth == j).any() else truth >= 0 for j in range(len(model.languages))]
        model.mean = np.array([np.median(own[rows]) for rows in each])
        model.spread = np.array([gap(rows, j) for j, rows in enumerate(each)])
        model.cut = float(min(REJECT, np.quantile(model.scores(entropy, size)[2], 1 - ACCEPT)))
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: the id, ``carry``, held_out, lang_pred, score and accepted.

    The model is broadcast; its size is bounded by the training sample.  One
    pass without a shuffle.
    """
    names = list(dict.fromkeys([id_col, *carry]))
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = keep(docs, *dict.fromkeys([*names, text_col])).withColumn("_held", F.coalesce(remainder(id_col) == 1, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            found: list[tuple[str, float, bool]] = []
            run_, size = [], 0

            def flush(run_: list[np.ndarray]) -> None:
                if model is None:
                    found.extend([(UNDETERMINED, 0.0, False)] * len(run_))
                elif run_:
                    entropy, n = model.entropies(run_)
                    best, score, fit = model.scores(entropy, n)
                    found.extend((model.languages[k] if m else UNDETERMINED, float(s), f >= model.cut) for k, s, f, m in zip(best.tolist(), score, fit, n))

            for t in b.column(text_col):
                run_.append(x := letters(t.as_py()))
                size += len(x)
                if size >= TOGETHER:
                    flush(run_)
                    run_, size = [], 0
            flush(run_)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), b.column("_held"), pa.array([k for k, *_ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([k != UNDETERMINED and bool(f) for k, _, f in found], pa.bool_())],
                [*names, "held_out", "lang_pred", "score", "accepted"],
            )

    schema = schema_with(out, names, "held_out boolean, lang_pred string, score double, accepted boolean")
    return out.mapInArrow(run, schema)
