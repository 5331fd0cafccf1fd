"""Masked cross-entropy over logits, and the loss of two means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import LABEL_PAD
from millrace.functions.text import let


def cross_entropy(logits: Column, label: Column, ignored: int = LABEL_PAD) -> Column:
    """Log of the sum of exponentials less the label's logit, in doubles; null for an ignored or null label.

    The largest logit is taken out first, so logits of any size don't overflow.  A label that has no logit is an error.
    """
    wide = logits.cast("array<double>")
    spread = lambda most: F.aggregate(wide, F.lit(0.0), lambda total, x: total + F.exp(x - most))
    own = F.when((label >= 0) & (label < F.size(logits)), F.get(logits, label.cast("int")).cast("double")).otherwise(F.raise_error(F.concat(F.lit("no logit for label "), label.cast("string"))))
    return F.when(label != ignored, let(F.array_max(wide), lambda most: most + F.log(spread(most))) - own)


def codebook_entropies(logits: Column, labels: Column, ignored: int = LABEL_PAD) -> Column:
    """The cross-entropies of all codebooks of a place, those of ignored labels left out."""
    pairs = F.zip_with(logits, labels, lambda x, y: cross_entropy(x, y, ignored))
    return F.filter(pairs, lambda x: x.isNotNull())


def masked_loss(rows: DataFrame, low: int, high: int, *by: str, ignored: int = LABEL_PAD) -> DataFrame:
    """Both means and their sum over places of (``token_logits``, ``label``, ``codebook_logits``, ``codebook_labels``).

    ``base_loss`` is over places whose label isn't ignored; ``semantic_loss`` over
    the codebooks of those places alone whose label lies in ``[low, high]``, again
    without ignored labels.  Sums and counts are merged, so places may lie in any
    partition.  A mean over nothing is NaN, and so is a loss with it.
    """
    semantic = F.when(F.col("label").between(low, high), codebook_entropies(F.col("codebook_logits"), F.col("codebook_labels"), ignored))
    each = rows.select(*by, cross_entropy(F.col("token_logits"), F.col("label"), ignored).alias("_base"), semantic.alias("_codes"))
    total = F.aggregate("_codes", F.lit(0.0), lambda s, x: s + x)
    sums = each.groupBy(*by).agg(F.sum("_base").alias("_b"), F.count("_base").alias("n_tokens"), F.sum(total).alias("_s"), F.coalesce(F.sum(F.size("_codes").cast("bigint")), F.lit(0)).alias("n_codes"))
    mean = lambda s, n: F.coalesce(F.try_divide(F.col(s), F.col(n)), F.lit(float("nan")))
    found = sums.select(*by, "n_tokens", "n_codes", mean("_b", "n_tokens").alias("base_loss"), mean("_s", "n_codes").alias("semantic_loss"))
    return found.withColumn("loss", F.col("base_loss") + F.col("semantic_loss"))
