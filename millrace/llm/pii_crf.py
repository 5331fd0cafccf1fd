"""Personal data: exact patterns plus a skip-chain conditional random field.

Base spans come from fixed patterns and always stay.  The field's nodes are the
number-like and address-like chunks of a document, base matches among them,
whose labels are observed.  Address-like chunks are those that spell the sign
or the dots out, such as ``name (at) host [dot] org``.  Neighbouring chunks are
linked in a chain, and chunks with equal or similar content (the same last
seven digits, the same first seven of nine or more behind a country code or
not, the same name before an @ or its like) share a skip potential, each with
the one before it and with the nearest observed one (those before it first),
however far apart.  Loopy message passing then makes labels consistent across
the whole document: a bare number is a phone number where the same digits
stand elsewhere behind a +.
Messages of a document pass until none changes by ``SETTLED``, or ``PASSES``
times and two times more for every skip link of the document.

Weights are fitted by pseudo-likelihood on documents drawn by a seeded rule.

Defined results: a null or empty text has no spans.  Spans count code points,
the end exclusive.  Kinds of the field are ``crf_`` and a base kind; they never
overlap a base span.  Repeated rows get equal results.
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

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SURE = 0.9
PASSES, SETTLED = 64, 1e-4
SEED, DRAWN, RIDGE = 11, 1200, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
_CHUNK = re.compile(r"(?<![^\W_])[+(]{0,2}[0-9](?:[ ().-]{0,2}[0-9])++")
_SIGN = re.compile(r"\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s)[A-Za-z0-9-]++)++", re.I)
_SPELLED = re.compile(r"[\[({<]|\sdot\s", re.I)
_BEFORE = re.compile(r"([^\W\d_]+)\W{0,4}\Z")
# Words that announce a kind.
CUES = {
    "email": "mail email e-mail contact write correo courriel".split(),
    "ip": "ip host server address adresse addr client".split(),
    "card": "card visa mastercard credit karte carte tarjeta payment".split(),
    "phone": "phone tel telephone telefon téléphone teléfono call mobile fax handy cell".split(),
}
_CUE = {w: k for k, words in CUES.items() for w in words}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans by kind as listed, then by start; leftmost without overlap in each kind, failing matches dropped."""
    found: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:  # a name is the run before the @, so no start has to be tried twice
        first = at
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        if first < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", first, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    if not _ANY_DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


@dataclass
class Graph:
    """Chunks of some documents with their links, ready for message passing."""

    features: list[list[int]]
    observed: list[int]
    spans: list[tuple[int, int, int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def spelled_addresses(text: str) -> list[tuple[int, int]]:
    """Address-like chunks: a name, a spelled sign, and a host whose dots may be spelled. Leftmost, without overlap."""
    found: list[tuple[int, int]] = []
    end = 0
    for m in _SIGN.finditer(text):
        first = m.start()
        while first > end and text[first - 1] in _LOCAL:
            first -= 1
        if first < m.start() and (host := _HOST.match(text, m.end())):
            found.append((first, host.end()))
            end = host.end()
    return found


def keys_of(chunk: str) -> list[str]:
    """What a chunk has in common with similar ones; the first key is the nearer likeness."""
    if "@" in chunk:
        return [chunk.partition("@")[0].lower()]
    if sign := _SIGN.search(chunk):
        return [chunk[: sign.start()].lower()]
    d = _digits(chunk)
    if len(d) < 9:
        return [d[-7:]]
    return [d[-7:], "head " + d.lstrip("0")[-10:][:7]]


_FEATURES = ["bias", "at", "spelled", "plain_at", "plus", "paren", "dots3", "luhn", "few", "d7", "d8_12", "d13_19", "d13_19_luhn", "many", "grouped", "hyphen", *(f"cue_{k}" for k in KINDS), "tail555"]
_INDEX = {f: i for i, f in enumerate(_FEATURES)}


def _features(text: str, a: int, b: int) -> list[int]:
    s = text[a:b]
    d = _digits(s)
    n = len(d)
    names = ["bias"]
    if "@" in s:
        names.append("at")
    elif _SIGN.search(s):
        names.append("spelled" if _SPELLED.search(s) else "plain_at")
    else:
        names += ["plus"] * s.startswith("+") + ["paren"] * ("(" in s) + ["dots3"] * (s.count(".") == 3) + ["grouped"] * (" " in s) + ["hyphen"] * ("-" in s)
        names.append("few" if n < 7 else "d7" if n == 7 else "d8_12" if n < 13 else "d13_19" if n < 20 else "many")
        if 13 <= n <= 19 and luhn(d):
            names.append("d13_19_luhn")
    if m := _BEFORE.search(text[max(0, a - 24) : a]):
        if kind := _CUE.get(m[1].lower()):
            names.append(f"cue_{kind}")
    return [_INDEX[x] for x in names]


def add_document(graph: Graph, doc: int, text: str, base: list[tuple[str, int, int]]) -> None:
    """Append a document's chunks: base spans, then other chunks that touch none of them."""
    chunks = [(a, b, LABELS.index(k)) for k, a, b in base]
    if _ANY_DIGIT.search(text):
        taken = Cover([(a, b) for a, b, _ in chunks])
        for m in _CHUNK.finditer(text):  # a chunk that a letter follows is part of a word or code
            if len(_digits(m[0])) >= 7 and not text[m.end() : m.end() + 1].isalnum() and not taken.touches(m.start(), m.end()):
                chunks.append((m.start(), m.end(), -1))
    if "at" in text or "AT" in text or "At" in text:
        taken = Cover([(a, b) for a, b, _ in chunks])
        chunks += [(a, b, -1) for a, b in spelled_addresses(text) if not taken.touches(a, b)]
    last: dict[str, int] = {}
    known: dict[str, int] = {}
    waiting: dict[str, list[int]] = {}
    before, end = -1, -1
    for a, b, seen in sorted(chunks, key=lambda c: (c[0], c[2] < 0, c[1])):
        if seen < 0 and a < end:  # two readings of the same place; the first one stands
            continue
        end = max(end, b)
        node = len(graph.features)
        graph.features.append(_features(text, a, b))
        graph.observed.append(seen)
        graph.spans.append((doc, a, b))
        if before >= 0:
            graph.chain.append((before, node))
        linked = set()
        for key in keys_of(text[a:b]):
            if key in last:
                linked.add((last[key], node))
            if seen >= 0:
                linked |= {(x, node) for x in waiting.pop(key, [])}
                known[key] = node
            elif key not in known:
                waiting.setdefault(key, []).append(node)
            elif known[key] != last[key]:
                linked.add((known[key], node))
            last[key] = node
        graph.skip += sorted(linked)
        before = node


@dataclass
class Field:
    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def unary(self, graph: Graph) -> np.ndarray:
        u = np.array([self.node[f].sum(axis=0) for f in graph.features]).reshape(-1, len(LABELS))
        for i, o in enumerate(graph.observed):
            if o >= 0:
                u[i] = -1e3
                u[i, o] = 0
        return u

    def marginals(self, graph: Graph, passes: int = PASSES) -> np.ndarray:
        """Loopy sum-product over all documents of the graph at once; each stops when its own messages have settled."""
        u = self.unary(graph)
        links = [(a, b, w) for some, w in ((graph.chain, self.chain), (graph.skip, self.skip)) for a, b in some]
        if not links:
            return _softmax(u)
        m = len(links)
        source = np.array([a for a, _, _ in links] + [b for _, b, _ in links])
        target = np.concatenate([source[m:], source[:m]])
        w = np.array([x for *_, x in links])
        w = np.concatenate([w, w.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, len(LABELS)))
        doc = np.array([d for d, _, _ in graph.spans])[source]
        most = passes + 2 * np.bincount(doc[len(graph.chain) : m], minlength=doc.max() + 1)
        going = np.arange(2 * m)
        turn = 0
        while len(going):
            belief = u.copy()
            np.add.at(belief, target, message)
            z = (belief[source[going]] - message[back[going]])[:, :, None] + w[going]
            top = z.max(axis=1, keepdims=True)
            new = np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]
            step = 0.5 * (new - new.max(axis=1, keepdims=True) - message[going])
            message[going] += step
            turn += 1
            moved = np.zeros(len(most), bool)
            moved[doc[going[np.abs(step).max(axis=1) >= SETTLED]]] = True
            going = going[(moved & (turn < most))[doc[going]]]
        belief = u.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    return e / e.sum(axis=1, keepdims=True) if len(z) else z


def drawn_documents(count: int = DRAWN, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with all true spans: some announced, some repeated in a barer form, and numbers that mean nothing."""
    r = random.Random(seed)
    syllables = "th en er le qu ch re al st mo ta ion an ou ti os".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    draw = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            d = draw(16)
            if luhn(d) == valid:
                return d

    rows = []
    for _ in range(count):
        pieces: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 5)):
            kind = r.choice(("phone", "phone", "card", "email", "ip", "none", "none", "none"))
            if kind == "phone":
                area, mid, tail = draw(3), draw(3), draw(4)
                pieces.append((kind, f"+{r.randint(1, 99)} ({area}) {mid}-{tail}"))
                if r.random() < 0.25:  # another line of the same house
                    pieces.append((kind, r.choice((f"{area}-{mid}-{draw(4)}", f"({area}) {mid} {draw(4)}"))))
                if r.random() < 0.6:
                    pieces.append((kind, r.choice((f"({area}) {mid}-{tail}", f"{area}-{mid}-{tail}", f"{area}{mid}{tail}", f"{area} {mid} {tail}"))))
                if r.random() < 0.4:
                    pieces.append((kind, f"{r.choice(CUES['phone'])}: {draw(3)}-{draw(3)}-{draw(4)}"))
            elif kind == "card":
                pieces.append((kind, card(True)))
            elif kind == "email":
                name, host = f"{word()}.{draw(2)}", f"{word()}.example"
                spelled = lambda: r.choice((f"{name} (at) {host}.com", f"{name}[at]{host.replace('.', '[dot]')}[dot]org", f"{name} at {host.replace('.', ' dot ')} dot net", f"{name} <at> {host}.com"))
                pieces.append((kind, f"{name}@{host}.com" if r.random() < 0.6 else spelled()))
                if r.random() < 0.5:
                    pieces.append((kind, r.choice((spelled(), f"{name} at {host}.com", f"{name} at {host}.com"))))
            elif kind == "ip":
                pieces.append((kind, ".".join(str(r.randint(0, 255)) for _ in range(4))))
            else:
                pieces.append((kind, r.choice((lambda: card(False), lambda: draw(r.randint(7, 22)), lambda: f"{draw(4)}-{draw(2)}-{draw(2)} {draw(2)}", lambda: f"{draw(3)} {draw(3)} {draw(3)}", lambda: f"{draw(4)}-{draw(4)}", lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)), lambda: f"{word()} at {word()}.example"))()))
        r.shuffle(pieces)
        text, spans = "", []
        for kind, s in pieces:
            text += " ".join(word() for _ in range(r.randint(1, 6))) + " "
            lead, _, tail = s.rpartition(": ") if ": " in s else ("", "", s)
            text += f"{lead}: " if lead else ""
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(tail)))
            text += tail + r.choice((" ", ", ", ". "))
        rows.append((text, spans))
    return rows


@lru_cache(maxsize=1)
def fitted(seed: int = SEED, steps: int = 600) -> Field:
    """Weights by gradient ascent on the pseudo-likelihood of drawn documents."""
    graph, truth = Graph([], [], [], [], []), []
    for doc, (text, spans) in enumerate(drawn_documents(seed=seed)):
        start = len(graph.spans)
        add_document(graph, doc, text, [])
        add = {(a, b): k for k, a, b in spans}
        for d, a, b in graph.spans[start:]:
            hit = [k for (x, y), k in add.items() if x < b and a < y]
            truth.append(LABELS.index(hit[0]) if hit else 0)
    n, size = len(truth), len(LABELS)
    x = np.zeros((n, len(_FEATURES)))
    for i, f in enumerate(graph.features):
        x[i, f] = 1
    y = np.eye(size)[truth]
    node, pair = np.zeros((len(_FEATURES), size)), {"chain": np.zeros((size, size)), "skip": np.zeros((size, size))}
    ends = {"chain": np.array(graph.chain).reshape(-1, 2), "skip": np.array(graph.skip).reshape(-1, 2)}
    for _ in range(steps):
        z = x @ node
        for k, w in pair.items():
            np.add.at(z, ends[k][:, 1], y[ends[k][:, 0]] @ w)
            np.add.at(z, ends[k][:, 0], y[ends[k][:, 1]] @ w.T)
        gap = y - _softmax(z)
        node += 2.0 * (x.T @ gap / n - RIDGE * node)
        for k, w in pair.items():
            a, b = ends[k][:, 0], ends[k][:, 1]
            w += 2.0 * ((y[a].T @ gap[b] + gap[a].T @ y[b]) / n - RIDGE * w)
    return Field(node, pair["chain"], pair["skip"])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_all(texts: list[str], field: Field, sure: float = SURE) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans and added spans of each text."""
    out, graph = [], Graph([], [], [], [], [])
    for doc, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, []))
        if base or _ANY_DIGIT.search(text) or spelled_addresses(text):
            add_document(graph, doc, text, base)
    p = field.marginals(graph)
    for (doc, a, b), seen, q in zip(graph.spans, graph.observed, p):
        k = int(q.argmax())
        if seen < 0 and k and q[k] >= sure:
            out[doc][1].append((f"crf_{LABELS[k]}", a, b))
    for _, more in out:
        more.sort(key=lambda s: (LABELS.index(s[0][4:]), s[1]))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, ``base_sha256`` and ``spans`` of every whole text; one pass without a shuffle."""
    out = keep(docs, id_col, text_col)
    field = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find_all([t.as_py() or "" for t in b.column(text_col)], field)
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), *(pa.array([sum(k == kind for k, _, _ in s) for s, _ in found], pa.int64()) for kind in KINDS), pa.array([hashlib.sha256(digest(s).encode()).hexdigest() for s, _ in found], pa.string()), pa.array([digest(s + more) for s, more in found], pa.string())],
                [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return out.mapInArrow(run, f"`{id_col}` {dict(out.dtypes)[id_col]}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go together under the first."""
    parts, at = [], 0
    for a, b, kind in sorted((a, b, k.removeprefix("crf_")) for k, a, b in spans):
        if a >= at:
            parts += (text[at:a], f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all found spans masked in ``text_col``; ``length_col`` follows. Null texts stay null."""
    field = fitted()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            found = find_all([t or "" for t in texts], field)
            new = [None if t is None else mask(t, s + more) for t, (s, more) in zip(texts, found)]
            columns = []
            for name, column in zip(names, b.columns):
                if name == text_col:
                    column = pa.array(new, pa.string())
                elif name == length_col:
                    column = pa.array([n if t is None else len(t) for t, n in zip(new, column.to_pylist())], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
