"""From raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result
is written as Parquet and read again as the next one's ``docs``.  Every stage
works on all rows that its predecessor kept.

1. language: documents whose language is rejected or undetermined go;
2. near_duplicates: of each class of near duplicates the row with the least id
   stays, those without an id last; texts that share an id are compared like
   others. Of rows with the same id and text one stays; rows without id and
   words all stay;
3. decontaminate: documents that contain a benchmark window go;
4. personal_data: spans of personal data are masked, ``n_chars`` follows;
5. encode: every text becomes token ids; the id, ``lang`` and ``source`` (where
   the documents have them) go along.

Defined results: null, empty and letterless texts have no language and go in the
first stage; texts are processed whole, however long; repeated rows are one
document after the second stage; empty tables give empty results; extra columns
stay through the first four stages, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, dart_minhash, decontaminate, langid_kn, pii_crf
from millrace.llm.common import packed, staged, table

#: A character that makes a word of the near duplicates' shingles.
WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid_kn.identify(packed(docs, "doc_id", "text"), langid_kn.fit(docs), carry=("row",))
    return found.where("accepted").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    wordless = F.col("text").isNull() | ~F.col("text").rlike(WORD)
    aside = F.col("doc_id").isNull() & wordless
    placed = dart_minhash.placed_rows(docs.where(~aside), "doc_id", "text", carry=True)
    first = F.min(F.struct(F.col("id").isNull(), "id", "place")).alias("m")
    stay = dart_minhash.classes(placed.drop("row")).groupBy("class").agg(first).select("m.place")
    return placed.join(stay, "place", "left_semi").dropDuplicates(["place"]).select("row.*").unionByName(docs.where(aside))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_documents(packed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), carry=("row",))
    return found.where("not contaminated").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_crf.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=tuple(c for c in ("lang", "source") if c in docs.columns))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontamination),
    ("personal_data", personal_data),
    ("encode", encode),
]

#: A character model and loopy message passing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
