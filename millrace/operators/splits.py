"""Deterministic splits and totals of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import split_of


def assign_splits(clips: DataFrame, validation_share: float, id_col: str = "clip_id") -> DataFrame:
    """All columns and ``split``; it depends on the id alone, so no order and no shuffle matter."""
    return clips.withColumn("split", split_of(F.col(id_col), validation_share))


def split_counts(assigned: DataFrame) -> DataFrame:
    """Clips by split; both splits are always there."""
    both = assigned.sparkSession.createDataFrame([("train",), ("validation",)], "split string")
    return F.broadcast(both).join(assigned.groupBy("split").agg(F.count("*").alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Hours, clips by split, and clips with a speaker, in number and percent."""
    n = F.count("*")
    return manifest.agg(
        n.alias("clips"),
        F.coalesce(F.sum("duration_seconds") / 3600, F.lit(0.0)).alias("hours"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "validation").alias("validation"),
        F.count_if(F.col("speaker").isNotNull()).alias("with_speaker"),
        (100.0 * F.count_if(F.col("speaker").isNotNull()) / F.greatest(n, F.lit(1))).alias("speaker_percent"),
    )
