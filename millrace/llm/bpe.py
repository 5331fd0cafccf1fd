"""Byte-level BPE: encoding and decoding with a contiguous rank array.

A text is cut at the special tokens, then into words by the vocabulary's own
pattern.  Each short word keeps two flat lists, its parts and the rank of each
adjacent pair.  The encoder scans the ranks for the least one, drops the
boundary there and refreshes the two neighbouring ranks until no pair can be
merged.  Words beyond ``LONG`` bytes hold the same state in a linked list with
a heap, so that one endless word costs n log n and not n squared.

Results equal those of the tokenizers library for the same file.  A null text
counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import keep, map_batches, schema_with

#: The word pattern of byte-level BPE vocabularies of this family.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = r"\t-\r \x85\xa0  -     　"

#: Words of more bytes than the last width use the heap; shorter ones share an array of the next width.
WIDTHS = (8, 12, 16, 24, 48, 192)
LONG = WIDTHS[-1]
#: Characters that are encoded together.
TOGETHER = 1 << 20
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 150_000

_GENERAL = regex.compile(WORD.replace(r"\s+(?!\S)", rf"[{SPACES}]+(?![^{SPACES}])").replace(r"\s+", rf"[{SPACES}]+").replace(r"[^\s\p{L}", rf"[^{SPACES}\p{{L}}"))
#: Texts of these characters alone need no Unicode tables; the plain engine is faster there.
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_PLAIN_TEXT = re.compile(rf"[\x00-\x7f{_LATIN}]*+\Z")
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]++| ?[0-9]++| ?[^\t-\r 0-9{_LATIN}]++|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]++")
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE(dict):
    """A vocabulary file, and the ids of the words met so far.

    As a dict it maps a word to its ids and computes them on first sight.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.first = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] << 20 | vocab[right]] = k
            self.made.append(vocab[left + right])
        order = sorted(self.rank)
        self.pairs = np.array([*order, np.iinfo(np.int64).max])
        self.pair_rank = np.array([*map(self.rank.get, order), _NEVER])
        self.made_id, self.first_id = np.array([*self.made, 0]), np.array(self.first)
        self.byte_rank = np.array([[self.rank.get(a << 20 | b, _NEVER) for b in self.first] for a in self.first])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.remembered = remembered

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        if len(raw) > LONG:
            return self.merge_long(raw)
        self[word] = ids = self.merge(raw)
        return ids

    def meet(self, words: set[str]) -> None:
        """Merge all words not met before at once, by byte length."""
        new = words.difference(self)
        if len(self) + len(new) > self.remembered:
            self.clear()
            new = words
        by_width: dict[int, list[str]] = {}
        for w in new:
            n = len(w) if w.isascii() else len(w.encode())
            if n <= LONG:
                by_width.setdefault(next(x for x in WIDTHS if n <= x), []).append(w)
        for width, some in by_width.items():
            for k in range(0, len(some), 1 << 15):
                part = some[k : k + (1 << 15)]
                self.update(zip(part, self.merge_all([w.encode() for w in part], width)))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)

    def merge_all(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        """``merge`` for many words: one row of parts and one of ranks each.

        Every round takes the least rank of each row, drops that boundary by
        shifting the row, and refreshes the two ranks beside it.
        """
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        column = np.arange(width)
        raw = np.zeros((n, width), np.uint8)
        raw[column < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        parts = self.first_id[raw]
        ranks = self.byte_rank[raw[:, :-1], raw[:, 1:]]
        ranks[column[1:] >= size[:, None]] = _NEVER
        ranks = np.concatenate([ranks, np.full((n, 1), _NEVER)], axis=1)
        done: list[tuple[int, ...]] = [()] * n
        row = np.arange(n)
        while len(row):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            if (over := least == _NEVER).any():
                for k, ids, m in zip(row[over].tolist(), parts[over].tolist(), size[over].tolist()):
                    done[k] = tuple(ids[:m])
                left = ~over
                row, parts, ranks, size, at, least = row[left], parts[left], ranks[left], size[left], at[left], least[left]
                if not len(row):
                    break
            every, size = np.arange(len(row)), size - 1
            parts[every, at] = new = self.made_id[least]
            moved = np.minimum(column + (column > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, moved, axis=1)
            moved = np.minimum(column + (column >= at[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, moved, axis=1)
            ranks[:, -1] = _NEVER
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            ranks[every, before] = np.where(at > 0, self._rank(parts[every, before], new), ranks[every, before])
            ranks[every, at] = np.where(at + 1 < size, self._rank(new, parts[every, after]), _NEVER)
        return done

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Scan for the least rank, drop that boundary, refresh both neighbours."""
        first, made, rank = self.first, self.made, self.rank.get
        parts = [first[b] for b in raw]
        ranks = [rank(a << 20 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            at = ranks.index(least)
            parts[at] = new = made[least]
            del parts[at + 1]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] << 20 | new, _NEVER)
            if at < len(ranks):
                ranks[at] = rank(new << 20 | parts[at + 1], _NEVER)
        return tuple(parts)

    def merge_long(self, raw: bytes) -> tuple[int, ...]:
        """The same merges in the same order, for words of any length."""
        n, made, rank = len(raw), self.made, self.rank.get
        parts = [self.first[b] for b in raw]
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1], _NEVER)) != _NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or rank(parts[i] << 20 | parts[j], _NEVER) != r:
                continue
            parts[i], live[j], after[i] = made[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank(parts[a] << 20 | parts[b], _NEVER)) != _NEVER:
                    heapq.heappush(heap, (r, a))
        return tuple(p for p, on in zip(parts, live) if on)

    def words(self, text: str) -> list[str]:
        return (_PLAIN if text.isascii() or _PLAIN_TEXT.match(text) else _GENERAL).findall(text)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; new words of all of them are merged together."""
        pieces: list[list] = []
        for text in texts:
            if text and self.cut and any(s in text for s in self.special):
                pieces.append([self.special[p] if k % 2 else self.words(p) for k, p in enumerate(self.cut.split(text))])
            else:
                pieces.append([self.words(text)] if text else [])
        self.meet(set(chain.from_iterable(w for text in pieces for w in text if isinstance(w, list))))
        return [list(chain.from_iterable(chain.from_iterable([(p,)] if isinstance(p, int) else map(self.__getitem__, p) for p in text))) for text in pieces]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def joined(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.text_of.__getitem__, ids))


def groups(column: pa.Array, most: int = TOGETHER) -> Iterator[list[str | None]]:
    """The column's texts in runs of about ``most`` characters, each text whole."""
    run, size = [], 0
    for t in column:
        run.append(text := t.as_py())
        size += len(text or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The encoder of a vocabulary file, once in each process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Ids of every whole text: the id column, ``carry``, ``n_tokens`` and ``token_ids``.

    ``vocab`` is a path that every executor can open.  Other columns of
    ``docs`` are left aside.  No shuffle.
    """
    names = [id_col, *carry]
    out = keep(docs, *names, text_col)
    schema = schema_with(out, names, "n_tokens bigint, token_ids array<int>")

    def make():
        bpe = load(vocab)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, values = [], []
            for texts in groups(batch.column(text_col)):
                for ids in bpe.encode_all(texts):
                    sizes.append(len(ids))
                    values.append(np.array(ids, np.int32))
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(values)))
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), ids], [*names, "n_tokens", "token_ids"])

        return step

    return map_batches(out, make, schema)


def decode_documents(encoded: DataFrame, vocab: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The text of every row's ids: the id column and ``text``; null ids count as none."""
    out = keep(encoded, id_col, ids_col)

    def make():
        bpe = load(vocab)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [bpe.decode(i.as_py() or []) for i in batch.column(ids_col)]
            return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], [id_col, "text"])

        return step

    return map_batches(out, make, f"`{id_col}` {dict(out.dtypes)[id_col]}, text string")


def round_trip(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text and return digests of both.

    Columns: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas) and ``decoded_sha256`` (of the decoded text in UTF-8).  One pass
    without a shuffle; ids leave the task as digests only.
    """
    out = keep(docs, id_col, text_col)

    def make():
        bpe = load(vocab)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = [], [], []
            for texts in groups(batch.column(text_col)):
                for ids in bpe.encode_all(texts):
                    n.append(len(ids))
                    a.append(hashlib.sha256(bpe.joined(ids).encode()).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_batches(out, make, f"`{id_col}` {dict(out.dtypes)[id_col]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
