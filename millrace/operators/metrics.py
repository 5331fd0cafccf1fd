"""Bookkeeping over training steps, validation losses, parameters and codec checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import arrays, numeric
from millrace.operators.batches import earlier, ranged

#: Schedules that are sent to every task at most.
MOST_SCHEDULES = 10_000


def best_so_far(steps: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """``improved``: whether a value is below all before it; NaN never is.

    Without ``by`` the order is global: each range of rows starts from the least
    value of the ranges before it.
    """
    sound = F.when(~F.isnan(value), F.col(value))
    if by:
        least = F.min(sound).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return steps.withColumn("improved", ~F.isnan(value) & (F.col(value) < F.coalesce(least, F.lit(float("inf")))))
    dealt = ranged(steps, order)
    carried = dealt.groupBy("_part").agg(F.min(sound).alias("_least")).select("_part", F.min("_least").over(earlier()).alias("_carried"))
    inside = F.min(sound).over(Window.partitionBy("_part").orderBy("_inner").rowsBetween(Window.unboundedPreceding, -1))
    least = F.coalesce(F.least(inside, "_carried"), F.lit(float("inf")))
    return dealt.join(F.broadcast(carried), "_part").withColumn("improved", ~F.isnan(value) & (F.col(value) < least)).select(*steps.columns, "improved")


def _before(rows: DataFrame, value: str, order: str, by: tuple[str, ...]) -> DataFrame:
    """The rows with ``_last``, the value of the row before; a range takes it from the last row of the ranges before it."""
    if by:
        return rows.withColumn("_last", F.lag(value).over(Window.partitionBy(*by).orderBy(order)))
    dealt = ranged(rows, order)
    ends = dealt.groupBy("_part").agg(F.max_by(F.struct(F.col(value).alias("v")), "_inner").alias("_end"))
    carried = ends.select("_part", F.last("_end").over(earlier())["v"].alias("_carried"))
    inside = F.lag(value).over(Window.partitionBy("_part").orderBy("_inner"))
    return dealt.join(F.broadcast(carried), "_part").withColumn("_last", F.when(F.col("_inner") > 0, inside).otherwise(F.col("_carried"))).select(*rows.columns, "_last")


def new_steps(steps: DataFrame, step: str, order: str, *by: str) -> DataFrame:
    """Rows whose step is positive and differs from the last positive one before."""
    return _before(steps.where(F.col(step) > 0), step, order, by).where(~F.col(step).eqNullSafe(F.col("_last"))).drop("_last")


def elapsed(steps: DataFrame, ts: str, *by: str) -> DataFrame:
    """``seconds`` since the row before; null for the first."""
    return _before(steps, ts, ts, by).withColumn("seconds", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.unix_micros(F.col("_last").cast("timestamp")) / 1e6).drop("_last")


def mean_of_means(rows: DataFrame, rank: str, value: str) -> DataFrame:
    """The unweighted mean of each rank's mean."""
    return rows.groupBy(rank).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"))


def capped_mean(rows: DataFrame, value: str, *order: str, most: int = 50) -> DataFrame:
    """The mean of the first ``most`` rows in order; 0 for none. The limit is the feature."""
    return rows.orderBy(*order).limit(most).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def micro_batch_means(rows: DataFrame, ordinal: str, value: str, size: int, *by: str) -> DataFrame:
    """The mean of every ``size`` consecutive rows by a 0-based ordinal."""
    return rows.groupBy(*by, F.floor(F.col(ordinal) / size).alias("micro_batch")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def trainable_parameters(parameters: DataFrame) -> DataFrame:
    """Totals of (``name``, ``n``): adapter and embedding parameters are trainable; percent with a guard for none."""
    trainable = F.contains("name", F.lit("lora_")) | F.startswith("name", F.lit("embeddings."))
    total, own = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(trainable, F.col("n"))), F.lit(0))
    return parameters.agg(total.alias("total"), own.alias("trainable"), F.when(total > 0, 100.0 * own / total).otherwise(0.0).alias("percent"))


def codec_tally(samples: DataFrame, codes: str = "codes") -> DataFrame:
    """Samples with codes, those ragged, and those that pass; samples without codes are left aside."""
    present = samples.where(F.size(codes) > 0)
    bad = arrays.ragged(F.col(codes))
    return present.agg(F.count("*").alias("checked"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("passed"))


def audio_check(clips: DataFrame, samples: str, *keep: str) -> DataFrame:
    """Root mean square, finiteness and silence of each clip's samples."""
    x = F.col(samples)
    return clips.select(*keep, arrays.rms(x).alias("rms"), arrays.finite(x).alias("finite"), arrays.silent(x).alias("silent"))


def sentence_count(items: DataFrame, sentences: str = "sentences") -> DataFrame:
    return items.agg(F.coalesce(F.sum(F.size(sentences)), F.lit(0)).alias("n_sentences"))


def weight_spread(weights: DataFrame, values: str) -> DataFrame:
    """Sample standard deviation over all elements of array rows."""
    return weights.select(F.explode(values).alias("x")).agg(F.stddev_samp("x").alias("std"))


def scheduled_rates(steps: DataFrame, schedules: DataFrame) -> DataFrame:
    """``lr`` of each row of (``step``, ``experiment_id``, ``param_group``); a row without a schedule is an error.

    Up to ``MOST_SCHEDULES`` schedules go to every task, so steps stay where they are; more are joined by shuffle.
    """
    known = schedules.withColumn("_known", F.lit(True))
    if schedules.limit(MOST_SCHEDULES + 1).count() <= MOST_SCHEDULES:
        known = F.broadcast(known)
    named = F.concat(F.lit("no schedule for "), F.coalesce("experiment_id", F.lit("null")), F.lit(", "), F.coalesce("param_group", F.lit("null")))
    rate = F.when(F.col("_known"), numeric.learning_rate(F.col("step"))).otherwise(F.raise_error(named))
    return steps.join(known, ["experiment_id", "param_group"], "left").withColumn("lr", rate).select(*steps.columns, "lr")


def capped_steps(steps: DataFrame, step: str, most: int) -> DataFrame:
    """The steps up to a last one. The limit is the feature."""
    return steps.where(F.col(step) <= most)


def preview(rows: DataFrame, *order: str, most: int = 5) -> DataFrame:
    """The first rows in order. The limit is the feature."""
    return rows.orderBy(*order).limit(most)


def last_lines(rows: DataFrame, order: str, most: int = 20) -> DataFrame:
    """The last rows in order, oldest first. The limit is the feature."""
    return rows.orderBy(F.desc(order)).limit(most).orderBy(order)
