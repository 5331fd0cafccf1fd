"""Ordered first-failure validation of clips and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import tokens
from millrace.functions.text import SPACE, let

# Limits of a valid clip.
MOST_CHARS, LEAST_CHARS = 500, 1
LEAST_SECONDS, MOST_SECONDS = 0.3, 30.0
SAMPLE_RATE = 24_000


def reason(ids: Column | None = None, vocab_size: int | None = None, found: Column | None = None, sample_rate: int | None = SAMPLE_RATE, normalized: Column | None = None, base_size: int | None = None) -> Column:
    """The first rule a manifest row breaks; null for a valid row.

    ``found`` says whether the audio file exists (null: not checked);
    ``normalized`` is the text after normalising, null where that failed;
    ``ids`` are the text's token ids, null where the tokenizer failed; with
    ``base_size`` each id must belong to just one of the two parts.  Texts are
    measured as they come, in code points.
    """
    text, c = F.col("text"), F.col
    checks = [
        (c("audio_path").isNull() | (c("audio_path") == ""), F.lit("missing_audio_path")),
        (~found if found is not None else F.lit(False), F.lit("audio_file_not_found")),
        (text.isNull() | text.rlike(rf"\A{SPACE}*\z"), F.lit("empty_text")),
        (F.length(text) > MOST_CHARS, F.lit("text_too_long")),
        (F.length(text) < LEAST_CHARS, F.lit("text_too_short")),
        (c("duration_seconds") < LEAST_SECONDS, F.lit("audio_too_short")),
        (c("duration_seconds") > MOST_SECONDS, F.lit("audio_too_long")),
        (c("sample_rate") != sample_rate if sample_rate is not None else F.lit(False), F.concat(F.lit("unexpected_sample_rate_"), c("sample_rate").cast("string"))),
    ]
    if normalized is not None:
        checks.append((normalized.isNull(), F.lit("normalize_failed")))
    out = F.when(*checks[0])
    for condition, name in checks[1:]:
        out = out.when(condition, name)
    if ids is None:
        return out

    def by_ids(i: Column) -> Column:
        found = F.when(i.isNull(), "tokenizer_failed").when(F.size(i) == 0, "empty_token_ids")
        if vocab_size is not None:
            found = found.when(~tokens.ids_in_range(i, vocab_size), "invalid_token_id_range")
        if base_size is not None:
            found = found.when(F.exists(i, lambda k: tokens.is_extended(k, base_size) == tokens.is_original(k, base_size)), "vocabulary_collision")
        return found

    return out.otherwise(let(ids, by_ids))


def validate(manifest: DataFrame, place: str | None = None, **checks) -> DataFrame:
    """``clip_id`` (``<unknown>`` where there is none) and ``reason`` of every row; ``place`` is a column of the manifest's order to keep."""
    return manifest.select(F.coalesce("clip_id", F.lit("<unknown>")).alias("clip_id"), reason(**checks).alias("reason"), *([place] if place else []))


def _tally(validated: DataFrame, order: str) -> DataFrame:
    """A row for each reason (null: valid) with its count and first row; the totals beside it come from these few rows."""
    whole = Window.partitionBy()
    by_reason = validated.groupBy("reason").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return by_reason.withColumns({"total": F.sum("n").over(whole), "ok": F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).over(whole)})


def summary(validated: DataFrame, order: str = "clip_id") -> DataFrame:
    """Rows by reason with total and valid counts and where each first appears; most frequent first, ties by first appearance in ``order``."""
    return _tally(validated, order).where("reason is not null").orderBy(F.desc("n"), "first").select("reason", "n", "total", "ok", "first")


def report(validated: DataFrame, order: str = "clip_id") -> DataFrame:
    """The summary as text: ``ok/total samples passed validation.`` and one indented line for each reason."""
    line = F.when(F.col("reason").isNotNull(), F.struct((-F.col("n")).alias("less"), "first", F.format_string("  %s: %d", "reason", "n").alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    head = F.format_string("%d/%d samples passed validation.", F.coalesce(F.max("ok"), F.lit(0)), F.coalesce(F.max("total"), F.lit(0)))
    return _tally(validated, order).agg(F.array_join(F.concat(F.array(head), lines), "\n").alias("report"))


def usable(manifest: DataFrame, **checks) -> DataFrame:
    """The valid rows alone."""
    return manifest.where(reason(**checks).isNull())
