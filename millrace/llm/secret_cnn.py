"""Secret scan: exact patterns plus a character convolutional network.

Base spans come from fixed patterns and always stay.  The network, written in
numpy, looks at every candidate: each token of at least ``LEAST`` characters
from the alphabet of keys that mixes letters and digits and isn't inside a
base span, together with ``AROUND`` characters on either side.  A candidate longer
than a window holds is seen whole by overlapping windows, the most probable of
which counts.  It is trained
on labelled findings drawn by a seeded rule (keys of several shapes in the
contexts they leak in; against them dates, numbers, names, paths, file
names and plain words), its outputs are calibrated by temperature on a held-out
part, and its threshold is ``SURE``, or lower where that is needed to find
``RECALL`` of the secrets of another held-out part.

Defined results: a null or empty text has no spans.  Spans count code points,
the end exclusive.  Spans of different kinds may overlap; those of the network
(kind ``cnn``) never overlap a base span.  Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import keep
from millrace.llm.spans import Cover

LEAST, AROUND, WIDTH = 16, 24, 96
RECALL, SURE = 0.98, 0.9
#: Windows judged at once, which bounds the memory that long candidates take.
MOST_WINDOWS = 4096
SEED, FINDINGS = 7, 5000
KINDS = ("assign", "access", "hex")
#: Fixed value: what stands before the data of a file embedded in a URL.
EMBEDDED = ";base64,"
NETWORK = "cnn"

_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_ALPHABET = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 \t\n\"'=:+/_-.,;()[]{}<>@#$%&*!?|\\~^`")}
_UPPER, _OTHER = len(_ALPHABET) + 1, len(_ALPHABET) + 2
_CODES = _OTHER + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans, leftmost without overlap in each kind, by start and then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _DIGIT.search(text):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    else:  # without a digit only letters a-f are left
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[a-f]{24,}", text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens that mix letters and digits, touch no base span and aren't the data of an embedded file."""
    if not _DIGIT.search(text):
        return []
    covered = Cover([(a, b) for _, a, b in taken])
    return [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0]) and not text.endswith(EMBEDDED, 0, m.start()) and not covered.touches(*m.span())]


def window(text: str, start: int, end: int) -> str:
    """The candidate with its context: ``AROUND`` before, then as much as the width holds."""
    return text[max(0, start - AROUND) : start].rjust(AROUND, "\0") + text[start : max(end, start + WIDTH - 2 * AROUND)][: WIDTH - 2 * AROUND] + text[end : end + AROUND].ljust(AROUND, "\0")


def windows_of(text: str, start: int, end: int) -> Iterator[str]:
    """Windows that together see the whole candidate: one where it fits, else one every ``AROUND`` characters and one at its end."""
    room = WIDTH - 2 * AROUND
    if end - start <= room:
        yield window(text, start, end)
        return
    for k in range(start, end - room, AROUND):
        yield window(text, k, k + room)
    yield window(text, end - room, end)


def codes(windows: list[str]) -> np.ndarray:
    """Character classes of each window; upper case has a plane of its own."""
    out = np.zeros((len(windows), WIDTH, 2), np.int64)
    for i, w in enumerate(windows):
        for j, c in enumerate(w[:WIDTH]):
            if c != "\0":
                low = c.lower()
                out[i, j, 0] = _ALPHABET.get(low, _OTHER)
                out[i, j, 1] = _UPPER if low != c else 0
    return out


@dataclass
class Network:
    """Embedding, one convolution, max pooling, one hidden layer."""

    embed: np.ndarray
    conv: np.ndarray
    conv_b: np.ndarray
    hidden: np.ndarray
    hidden_b: np.ndarray
    out: np.ndarray
    out_b: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def parameters(self) -> list[str]:
        return ["embed", "conv", "conv_b", "hidden", "hidden_b", "out", "out_b"]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = self.embed[x[:, :, 0]] + self.embed[x[:, :, 1]]
        n, length, _ = e.shape
        size = self.conv.shape[0] // e.shape[2]
        wide = np.lib.stride_tricks.sliding_window_view(e, size, axis=1).transpose(0, 1, 3, 2).reshape(n, length - size + 1, -1)
        c = wide @ self.conv + self.conv_b
        top = c.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(c, top[:, None, :], axis=1)[:, 0], 0)
        h = np.maximum(pooled @ self.hidden + self.hidden_b, 0)
        return (h @ self.out + self.out_b)[:, 0], (x, wide, top, pooled, h)

    def probability(self, windows: list[str]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        z = np.concatenate([self.forward(codes(windows[k : k + 256]))[0] for k in range(0, len(windows), 256)])
        return 1 / (1 + np.exp(-z / self.temperature))

    def gradients(self, cache: tuple, dz: np.ndarray) -> dict[str, np.ndarray]:
        x, wide, top, pooled, h = cache
        g = {"out": h.T @ dz[:, None], "out_b": np.array([dz.sum()])}
        dh = (dz[:, None] @ self.out.T) * (h > 0)
        g |= {"hidden": pooled.T @ dh, "hidden_b": dh.sum(axis=0)}
        dp = (dh @ self.hidden.T) * (pooled > 0)
        n, filters = dp.shape
        at = wide[np.arange(n)[:, None], top]
        g |= {"conv": np.einsum("nf,nfw->wf", dp, at), "conv_b": dp.sum(axis=0)}
        dw = dp[:, :, None] * self.conv.T[None]
        dim = self.embed.shape[1]
        size = self.conv.shape[0] // dim
        de = np.zeros_like(self.embed)
        place = top[:, :, None] + np.arange(size)
        for plane in (0, 1):
            np.add.at(de, x[np.arange(n)[:, None, None], place, plane], dw.reshape(n, filters, size, dim))
        de[0] = 0
        return g | {"embed": de}


def labelled_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, 1 for a secret) drawn by rule."""
    r = random.Random(seed)
    letters, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = [a + b for a in ("th", "en", "er", "le", "qu", "ch", "re", "al", "st", "mo", "ta", "ion") for b in ("an", "e", "ou", "ti", "er", "os", "ment", "")]
    draw = lambda pool, n: "".join(r.choice(pool) for _ in range(n))
    onsets, vowels, codas = "b c d f g h j k l m n p r s t v w y z bl br ch cl cr dr fl fr gl gr pl pr qu sc sh sk sp st str th tr tw wh".split(), "a e i o u a e i o ea oo ai ou ee".split(), "n r s t l m d k p x ck ct ng nt rd rk rm rt sh ss st th".split() + [""] * 12
    spoken = lambda: "".join(r.choice(onsets) + r.choice(vowels) + r.choice(codas) for _ in range(r.randint(1, 3)))
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4))) if r.random() < 0.4 else spoken()
    prose = lambda: " ".join(word() for _ in range(r.randint(3, 9)))

    def secret() -> str:
        return r.choice((
            lambda: draw(letters + upper + digits, r.randint(20, 48)),
            lambda: draw(letters + upper + digits + "+/", r.randint(28, 60)) + r.choice(("", "=", "==")),
            lambda: r.choice(("sk", "pk", "ghp", "glpat", "xoxb", "key", "live", "hf", "npm", "dop_v1", "sk_live", "rk_test")) + r.choice("_-") + draw(letters + upper + digits, r.randint(20, 40)),
            lambda: r.choice(("xoxb", "xapp", "pat", word())) + f"-{draw(digits, r.randint(9, 12))}-{draw(digits, r.randint(9, 12))}-" + draw(letters + upper + digits, r.randint(20, 30)),
            lambda: r.choice(("ghp_", "pat-", "", "")) + draw("abcdef" + digits, r.randint(6, 14)) + draw(upper + digits, r.randint(2, 6)) + draw(letters + digits, r.randint(12, 24)),
            lambda: r.choice(("AIza", "AC", "SG", "ya29")) + draw(letters + upper + digits + "_-", r.randint(24, 40)),
            lambda: draw(upper + digits, r.randint(20, 32)),
            lambda: "eyJ" + draw(letters + upper + digits + "_-", r.randint(24, 50)),
        ))()

    def harmless() -> str:
        return r.choice((
            lambda: word() + "".join(word().title() for _ in range(r.randint(2, 4))) + str(r.randint(1, 999)),
            lambda: f"{word()}-{word()}-{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
            lambda: f"{word()}/{word()}/{word()}{r.randint(1, 99)}/{word()}",
            lambda: "/".join(word() for _ in range(r.randint(3, 7))) + "/" + "".join(word().title() for _ in range(r.randint(1, 3))) + str(r.randint(1, 99)) + r.choice(("", "Test", "Impl")),
            lambda: r.choice(("win32", "x86", "arm64", "v2", "h264", "utf8", "sha256", "mp3", word() + str(r.randint(1, 30)))) + "".join(r.choice("-_") + r.choice((word, word, lambda: str(r.randint(1, 99))))() for _ in range(r.randint(2, 5))),
            lambda: f"{r.randint(1, 9999)}{''.join(word() for _ in range(r.randint(3, 5)))}".upper(),
            lambda: f"{word()}_{word()}_{word()}_v{r.randint(1, 40)}",
            lambda: f"{draw(digits, 8)}-{draw(digits, 4)}-{draw(digits, 4)}-{draw(digits, 4)}-{draw(digits, 12)}a",
            lambda: f"{r.randint(1, 28)}{word().title()}{r.randint(1900, 2030)}{word()}{word()}",
            lambda: f"page{r.randint(1, 99)}of{r.randint(100, 999)}{word()}{word()}{word()}",
            lambda: f"{word()}{word()}{word()}{draw(digits, r.randint(1, 3))}",
            lambda: f"{r.choice(('ISBN', 'ISSN', 'DOI', 'EAN', 'RFC'))}-{draw(digits, 3)}-{draw(digits, r.randint(6, 10))}-{word()}",
            lambda: (word() + word() + word()).upper() + draw(digits, r.randint(1, 4)),
            lambda: f"{r.choice(('IMG', 'VID', 'DSC', 'Screenshot', 'PXL'))}{r.choice(('', '_', '-'))}{draw(digits, 8)}{r.choice(('', '_', '-', 'WA'))}{draw(digits, r.randint(3, 6))}{r.choice(('', word(), 'final2', '-copy', '_edited1'))}",
            lambda: f"//{word()}/{word()}/{r.randint(2000, 2030)}/{r.randint(10, 12)}/{word()}-{word()}-{word()}",
            lambda: f"{word()}-{word()}-{r.randint(1, 30)}-{r.randint(0, 9)}-{r.randint(0, 99)}-{r.choice(('beta', 'alpha', 'rc', 'release'))}{r.randint(1, 9)}",
            lambda: f"{draw('0123456789abcdef', 8)}-{draw('0123456789abcdef', 4)}-4{draw('0123456789abcdef', 3)}-{r.choice('89ab')}{draw('0123456789abcdef', 3)}-{draw('0123456789abcdef', 12)}",
            lambda: f"{draw(upper, 2)}{draw(digits, r.randint(12, 20))}",
        ))()

    rows = []
    for i in range(count):
        good = i % 2
        token = secret() if good else harmless()
        while len(token) < LEAST or not (_DIGIT.search(token) and _LETTER.search(token)):
            token = secret() if good else harmless() + word()
        if good and r.random() < 0.7:
            lead = r.choice(("key: ", "auth=", "Authorization: Bearer ", "access_key = \"", "credential='", "export KEY=", "client-id ", "bearer ", "private ", "pw "))
        else:
            lead = r.choice(("", "see ", "file ", "(", "in ", "id ", "ref. ", "\"", "# "))
        before, after = prose() + " " + lead, r.choice(("\" ", " ", ", ", ".\n", ") ")) + prose()
        rows.append((before + token + after, len(before), len(before) + len(token), good))
    return rows


@lru_cache(maxsize=1)
def trained(seed: int = SEED, rounds: int = 10, dim: int = 12, filters: int = 32, size: int = 5, hidden: int = 24) -> Network:
    """A network fitted by Adam on the labelled findings, calibrated and given its threshold."""
    rows = labelled_findings(seed=seed)
    # a long token is seen in several windows in use, so here too; each counts by itself
    parts = [(w, g) for t, a, b, g in rows for w in windows_of(t, a, b)]
    x, y = codes([w for w, _ in parts]), np.array([g for _, g in parts], float)
    r = np.random.default_rng(seed)
    init = lambda *shape: r.normal(0, np.sqrt(2 / shape[0]), shape)
    net = Network(r.normal(0, 0.3, (_CODES, dim)), init(size * dim, filters), np.zeros(filters), init(filters, hidden), np.zeros(hidden), init(hidden, 1), np.zeros(1))
    net.embed[0] = 0
    # the last quarter is held out: one half of it for the temperature, the other for the threshold
    held = np.arange(len(y)) >= 3 * len(y) // 4
    first_half = held & (np.arange(len(y)) % 4 < 2)
    other_half = held & ~first_half
    train = np.flatnonzero(~held)
    first, second, step = {}, {}, 0
    for _ in range(rounds):
        r.shuffle(train)
        for k in range(0, len(train), 64):
            some = train[k : k + 64]
            z, cache = net.forward(x[some])
            step += 1
            for name, g in net.gradients(cache, (1 / (1 + np.exp(-z)) - y[some]) / len(some)).items():
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                getattr(net, name)[...] -= 0.003 * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    z = net.forward(x[first_half])[0]

    def loss(t: float) -> float:
        return float(np.logaddexp(0, np.where(y[first_half] > 0, -z, z) / t).mean())

    net.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    p = 1 / (1 + np.exp(-net.forward(x[other_half])[0] / net.temperature))
    net.threshold = min(SURE, float(np.quantile(p[y[other_half] > 0], 1 - RECALL)))
    return net


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: the id, ``base`` and ``spans`` (arrays of kind, start, end), and counts by kind.

    One pass without a shuffle; the network is a few thousand numbers, sent
    with the tasks.
    """
    out = keep(docs, id_col, text_col)
    net = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, windows, owner, sure = [], [], [], set()

            def judge() -> None:
                sure.update(o for o, p in zip(owner, net.probability(windows)) if p >= net.threshold)
                windows.clear()
                owner.clear()

            for i, t in enumerate(b.column(text_col)):
                text = t.as_py() or ""
                base.append(base_spans(text))
                for a, e in candidates(text, base[-1]):
                    for w in windows_of(text, a, e):
                        windows.append(w)
                        owner.append((i, a, e))
                        if len(windows) == MOST_WINDOWS:
                            judge()
            judge()
            spans = [list(s) for s in base]
            for i, a, e in sure:
                spans[i].append((NETWORK, a, e))
            order = {k: n for n, k in enumerate((*KINDS, NETWORK))}
            spans = [sorted(s, key=lambda x: (x[1], order[x[0]])) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), *(pa.array([sum(k == kind for k, _, _ in s) for s in base], pa.int64()) for kind in KINDS), pa.array([hashlib.sha256(digest(s).encode()).hexdigest() for s in base]), pa.array(map(digest, spans), pa.string())],
                [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return out.mapInArrow(run, f"`{id_col}` {dict(out.dtypes)[id_col]}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")
