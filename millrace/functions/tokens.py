"""Script runs, byte and character tokens, and the extended id space."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import let

# The Khmer blocks, reserved ids, the size of the Khmer vocabulary, and the stand-in encoders' offsets.
KHMER_CLASS = "[ក-៿᧠-᧿]"
OTHER_CLASS = KHMER_CLASS.replace("[", "[^", 1)
RESERVED = (0, 1, 2, 3, 4)
KHMER_SIZE = 8000
BYTE_OFFSET, CHAR_OFFSET, UNKNOWN = 3, 5, 1


def chunks(text: Column) -> Column:
    """A text as alternating runs of Khmer and other characters; joined, they give the text."""
    return F.regexp_extract_all(text, F.lit(f"{KHMER_CLASS}+|{OTHER_CLASS}+"), F.lit(0))


def script_runs(text: Column) -> Column:
    """Runs as structs of ``kind`` (khmer or other) and ``chunk``; empty chunks cannot occur."""
    return F.transform(chunks(text), lambda c: F.struct(F.when(c.rlike(f"^{KHMER_CLASS}"), "khmer").otherwise("other").alias("kind"), c.alias("chunk")))


def byte_ids(text: Column, vocab_size: int = 32000) -> Column:
    """UTF-8 bytes as ids: 3 + byte, at most the last id. Read as Latin-1, each byte is one character."""
    bytes_ = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.transform(F.filter(bytes_, lambda c: c != ""), lambda c: F.least(F.ascii(c) + BYTE_OFFSET, F.lit(vocab_size - 1)))


def byte_text(ids: Column) -> Column:
    """The inverse of ``byte_ids`` for ids from bytes."""
    pairs = F.transform(ids, lambda i: F.lpad(F.hex(i - BYTE_OFFSET), 2, "0"))
    return F.decode(F.unhex(F.array_join(pairs, "")), "UTF-8")


def drop_reserved(ids: Column) -> Column:
    """Without the reserved ids; order and repetitions stay."""
    return F.filter(ids, lambda i: ~i.isin(*RESERVED))


def char_vocabulary(texts: DataFrame, text_col: str, *order_by: str, limit: int = KHMER_SIZE) -> DataFrame:
    """``char`` and ``id``: 5 + order of first appearance; characters beyond ``limit`` ids get the unknown id.

    Characters are grouped with a partial minimum before the shuffle; the
    ranking window sees one row per distinct character.
    """
    first = (
        texts.select(*order_by, F.posexplode(F.filter(F.split(text_col, ""), lambda c: c != "")).alias("pos", "char"))
        .groupBy("char").agg(F.min(F.struct(*order_by, "pos")).alias("first"))
    )
    rank = F.row_number().over(Window.orderBy("first")) - 1 + CHAR_OFFSET
    return first.select("char", rank.alias("id")).withColumn("id", F.when(F.col("id") < limit, F.col("id")).otherwise(UNKNOWN).cast("int"))


def is_extended(id_: Column, base_size: int) -> Column:
    """Whether an id belongs to the added part; there is no upper bound."""
    return id_ >= base_size


def is_original(id_: Column, base_size: int) -> Column:
    return (id_ >= 0) & (id_ < base_size)


def to_extended(id_: Column, base_size: int, added: int = KHMER_SIZE) -> Column:
    """An id of the added vocabulary moved behind the base ids; raises out of range."""
    return F.when((id_ >= 0) & (id_ < added), id_ + base_size).otherwise(F.raise_error(F.concat(F.lit("id out of the added range: "), id_.cast("string"))))


def from_extended(id_: Column, base_size: int, added: int = KHMER_SIZE) -> Column:
    """The inverse; raises below the added part and beyond its end."""
    return (
        F.when(id_ < base_size, F.raise_error(F.concat(F.lit("a base id: "), id_.cast("string"))))
        .when(id_ >= base_size + added, F.raise_error(F.concat(F.lit("id beyond the vocabulary: "), id_.cast("string"))))
        .otherwise(id_ - base_size)
    )


def vocabulary_total(base_size: int, added: int = KHMER_SIZE) -> int:
    return base_size + added


def ids_in_range(ids: Column, total: int) -> Column:
    return F.forall(ids, lambda i: (i >= 0) & (i < total))


def checked_ids(ids: Column, total: int) -> Column:
    """The ids, or an error if one lies outside ``[0, total)``."""
    return let(ids, lambda i: F.when(ids_in_range(i, total), i).otherwise(F.raise_error(F.lit("token id out of range"))))


def no_collision(base_size: int, added: int = KHMER_SIZE) -> bool:
    """Whether base and added ids are disjoint."""
    return added > 0 and base_size >= 0 and not set(range(base_size, base_size + added)) & set(range(0, base_size))


#: An encoder of a slot: a column of string arrays to one of id arrays, one for each string.
Encoder = Callable[[Column], Column]


def byte_encoder(vocab_size: int = 32000) -> Encoder:
    """The native stand-in for a base encoder."""
    return lambda chunks: F.transform(chunks, lambda c: byte_ids(c, vocab_size))


def char_encoder(ids: Column) -> Encoder:
    """The native stand-in for an added encoder: a map from character to id."""
    one = lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(UNKNOWN))
    return lambda chunks: F.transform(chunks, lambda t: F.transform(F.filter(F.split(t, ""), lambda c: c != ""), one))


def python_encoder(encode: Callable[[str], list[int]]) -> Encoder:
    """Any encoder in Python, in Arrow batches; it is shipped to the executors as it is."""

    @F.pandas_udf("array<array<int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: None if ts is None else [list(encode(t)) for t in ts])

    return run


def encode_with(text: Column, base: Encoder, added: Encoder, base_size: int) -> Column:
    """Ids of a mixed text by two encoders: Khmer runs by ``added``, all others by ``base``.

    Reserved ids of the added encoder are dropped, the rest moves behind the
    base ids.  Runs alternate, so each encoder gets its runs as one array and
    run ``i`` is number ``i // 2`` of its own.
    """
    return _encoded(script_runs(text), base, added, base_size)


def _encoded(runs: Column, base: Encoder, added: Encoder, base_size: int) -> Column:
    own = lambda kind: F.transform(F.filter(runs, lambda r: r["kind"] == kind), lambda r: r["chunk"])
    both = F.struct(runs.alias("runs"), added(own("khmer")).alias("khmer"), base(own("other")).alias("other"))

    def joined(x: Column) -> Column:
        def run(r: Column, i: Column) -> Column:
            at = F.floor(i / 2).cast("int")
            return F.when(r["kind"] == "khmer", F.transform(drop_reserved(F.get(x["khmer"], at)), lambda k: k + base_size)).otherwise(F.get(x["other"], at))

        return F.flatten(F.transform(x["runs"], run))

    return let(both, joined)


def encode_mixed(text: Column, khmer_ids: Column, base_size: int) -> Column:
    """Ids of a mixed text by the native stand-ins: bytes, and a character map (char to id) for Khmer runs."""
    # encoders in Python can't stand below a bound value; these can, so the runs are found once
    return let(script_runs(text), lambda runs: _encoded(runs, byte_encoder(base_size), char_encoder(khmer_ids), base_size))


def id_runs(ids: Column, base_size: int) -> Column:
    """Consecutive ids of one part as structs of ``khmer`` and ``ids``: the places where the part changes, then a slice for each."""

    def split(row: Column) -> Column:
        def changes(i: Column, k: Column) -> Column:
            return F.when((k == 0) | (is_extended(i, base_size) != is_extended(F.get(row, k - 1), base_size)), k)

        def between(places: Column) -> Column:
            return F.transform(places, lambda at, k: F.struct(
                is_extended(F.get(row, at), base_size).alias("khmer"),
                F.slice(row, at + 1, F.coalesce(F.get(places, k + 1), F.size(row)) - at).alias("ids"),
            ))

        return let(F.filter(F.transform(row, changes), lambda k: k.isNotNull()), between)

    return let(ids, split)


def decode_runs(tokens: DataFrame, key: str, pos: str, id_: str, base_size: int) -> DataFrame:
    """Runs of one part per key from a long table of tokens: ``run``, ``khmer``, ``first_pos``, ``n_ids``.

    Gaps and islands: within a part the position less the row number is
    constant along a run.
    """
    khmer = is_extended(F.col(id_), base_size)
    by_part = Window.partitionBy(key, "khmer").orderBy(pos)
    islands = tokens.withColumn("khmer", khmer).withColumn("island", F.col(pos) - F.row_number().over(by_part))
    runs = islands.groupBy(key, "khmer", "island").agg(F.min(pos).alias("first_pos"), F.count("*").alias("n_ids"))
    return runs.withColumn("run", F.row_number().over(Window.partitionBy(key).orderBy("first_pos")) - 1).select(key, "run", "khmer", "first_pos", "n_ids")


def decode_with(ids: Column, base: Callable[[list[int]], str], added: Callable[[list[int]], str], base_size: int) -> Column:
    """The text of mixed ids by two decoders in Python, run by run in Arrow batches; the inverse of ``encode_with``.

    The ids come from a table: Spark does not evaluate a Python slot over
    another's outcome behind array functions in one projection.
    """

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def text(row) -> str | None:
            if row is None:
                return None
            runs = groupby((int(i) for i in row), lambda i: i >= base_size)
            return "".join(added([i - base_size for i in r]) if khmer else base(list(r)) for khmer, r in runs)

        return rows.map(text)

    return run(ids)


def decode_mixed(ids: Column, khmer_chars: Column, base_size: int) -> Column:
    """The text of mixed ids by the native stand-ins; ``khmer_chars`` maps added ids to characters."""

    def one(r: Column) -> Column:
        return F.when(r["khmer"], F.array_join(F.transform(r["ids"], lambda i: F.coalesce(F.try_element_at(khmer_chars, i - base_size), F.lit(""))), "")).otherwise(byte_text(r["ids"]))

    return let(id_runs(ids, base_size), lambda runs: F.array_join(F.transform(runs, one), ""))
