"""Listening-test templates and release gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import RUBRIC

# Gates, averaged rubrics and listeners.
GATES = {"pronunciation": 4.0, "naturalness": 3.8, "english_preservation": 3.8}
AVERAGED = [c for c in RUBRIC if c != "no_severe_artifacts"]
LISTENERS = ("listener_1", "listener_2")


def template(sentences: DataFrame, experiments: list[str], listeners: tuple[str, ...] = LISTENERS) -> DataFrame:
    """A row per sentence, experiment and listener with blank rubric cells.

    Experiments and listeners are short literal lists, so each sentence row is
    exploded in place and nothing is shuffled.
    """
    return (
        sentences.select(F.col("id").alias("sentence_id"), F.coalesce("category", F.lit("")).alias("category"), F.explode(F.array(*map(F.lit, experiments))).alias("experiment_id"))
        .withColumn("listener", F.explode(F.array(*map(F.lit, listeners))))
        .withColumns({c: F.lit("") for c in (*RUBRIC, "notes")})
    )


def summarize(scores: DataFrame) -> DataFrame:
    """Means, artifact counts, failed gates and the verdict of each experiment.

    Rows without a pronunciation score are unscored; an experiment that has
    only such rows stays, with averages of 0.
    """
    scored = F.coalesce(F.col("pronunciation") != "", F.lit(False))
    n = F.count_if(scored)
    totals = scores.groupBy("experiment_id").agg(
        n.alias("n_scored"),
        *((F.coalesce(F.sum(F.when(scored, F.col(c).cast("double"))), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias(c) for c in AVERAGED),
        F.count_if(scored & (F.col("no_severe_artifacts") == "0")).alias("severe_artifact_count"),
    )
    failed = F.filter(F.array(*(F.when(F.col(c) < g, F.lit(c)) for c, g in GATES.items())), lambda x: x.isNotNull())
    out = totals.withColumn("failed_gates", failed)
    return out.withColumn("passes_release_gate", (F.size("failed_gates") == 0) & (F.col("severe_artifact_count") == 0))


def generation_inputs(spark: SparkSession, sentences: DataFrame) -> DataFrame:
    """``id``, ``text`` and ``normalized`` of the evaluation sentences."""
    from millrace.functions.text import normalize

    return sentences.select("id", "text", normalize(F.col("text")).alias("normalized"))
