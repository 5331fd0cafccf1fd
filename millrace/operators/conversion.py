"""From paired sample lists and transcripts to manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import duration_seconds

# Splits that are kept, under their new names.
SPLIT_NAMES = {"train": "train", "dev": "validation"}


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)/*$", 1), r"(.)\.[^.]+$", "$1")


def clip_id(split: Column, path: Column, prefix: str = "omni") -> Column:
    return F.concat(F.lit(f"{prefix}_"), split, F.lit("_"), stem(path))


def zipped(samples: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Both sides joined on (``split``, ``ordinal``); different counts in a split are an error."""
    counts = samples.groupBy("split").agg(F.count("*").alias("n")).join(transcripts.groupBy("split").agg(F.count("*").alias("m")), "split", "full")
    even = counts.select("split", F.when(F.col("n").eqNullSafe(F.col("m")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("rows and transcripts differ in number: "), "split"))).alias("even"))
    return samples.join(transcripts, ["split", "ordinal"]).join(F.broadcast(even), "split").where("even").drop("even")


def convert(samples: DataFrame, transcripts: DataFrame, speakers: DataFrame, audio: DataFrame, audio_root: str, sample_rate: int, source: str) -> DataFrame:
    """Manifest rows of the kept splits.

    ``samples``: split, ordinal, relpath, num_samples; ``transcripts``: split,
    ordinal, text; ``speakers``: ordinal, names (the first one counts, by the
    ordinal before rows without audio are dropped); ``audio``: relpath of
    files that exist.
    """
    names = F.create_map(*(F.lit(x) for kv in SPLIT_NAMES.items() for x in kv))
    kept = lambda df: df.where(F.col("split").isin(*SPLIT_NAMES))
    rows = zipped(kept(samples), kept(transcripts)).join(audio.select("relpath").distinct(), "relpath", "left_semi")
    rows = rows.join(speakers.select("ordinal", F.get("names", F.lit(0)).alias("speaker")), "ordinal", "left")
    return rows.select(
        clip_id(F.col("split"), F.col("relpath")).alias("clip_id"), "text", F.element_at(names, F.col("split")).alias("split"),
        F.concat(F.lit(audio_root.rstrip("/") + "/"), "relpath").alias("audio_path"),
        duration_seconds(F.col("num_samples"), F.lit(sample_rate)).alias("duration_seconds"),
        F.lit(sample_rate).alias("sample_rate"), "speaker", F.lit(source).alias("source"),
    )


def missing_audio(samples: DataFrame, audio: DataFrame) -> DataFrame:
    """Rows whose audio file isn't there, by split."""
    return samples.join(audio.select("relpath").distinct(), "relpath", "left_anti").groupBy("split").agg(F.count("*").alias("missing"))
