"""A keyed cache of clips with a revision, last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the given order; one aggregation, combined before the shuffle."""
    values = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max(F.struct(*order, *(c for c in values if c not in order))).alias("_last"))
    return newest.select(key, *(F.col(f"_last.{c}").alias(c) for c in values))


def upsert(current: DataFrame, new: DataFrame, key: str = "clip_id") -> DataFrame:
    """``current`` with the rows of ``new`` in place of those with their keys."""
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def lookup(samples: DataFrame, cache: DataFrame, revision: str, key: str = "clip_id") -> DataFrame:
    """Samples with their cache rows; a missing key or another revision is an error when its row is read."""
    held = cache.withColumn("_held", F.lit(True))
    joined = samples.join(held, key, "left")
    wrong = (
        F.when(F.col("_held").isNull(), F.raise_error(F.concat(F.lit("not cached: "), F.col(key).cast("string"))))
        .when(~F.col("codec_revision").eqNullSafe(F.lit(revision)), F.raise_error(F.concat(F.lit("cached under another revision: "), F.col(key).cast("string"))))
        .otherwise(F.lit(True))
    )
    return joined.withColumn("_held", wrong).where("_held").drop("_held")


def split_ids(index: DataFrame, split: str) -> DataFrame:
    """Ids of one split in code-point order."""
    return index.where(F.col("split") == split).select("clip_id").orderBy("clip_id")


def payload(index: DataFrame, key: str = "clip_id") -> DataFrame:
    """Each record as JSON without its key: ``key`` and ``record``."""
    return index.select(key, F.to_json(F.struct(*(c for c in index.columns if c != key))).alias("record"))


def renamed_keys(state: Column, part: str = "generator.") -> Column:
    """Map entries whose key holds ``part``, without that part in the key."""
    return F.transform_keys(F.map_filter(state, lambda k, _: F.contains(k, F.lit(part))), lambda k, _: F.replace(k, F.lit(part), F.lit("")))
