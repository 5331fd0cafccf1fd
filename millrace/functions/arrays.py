"""Padding, trimming and checks of token, code and sample arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paddings and the level below which audio counts as silent.
TOKEN_PAD, LABEL_PAD = 0, -100
SILENT_RMS = 1e-4


def padded_length(longest: Column, multiple: int = 1) -> Column:
    """A length rounded up to a multiple; none is zero."""
    return F.coalesce((F.ceil(longest / multiple) * multiple).cast("int"), F.lit(0))


def pad(ids: Column, length: Column, value: int = TOKEN_PAD) -> Column:
    """Filled on the right up to a length; longer arrays stay."""
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, length: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(length - F.size(ids), F.lit(0))))


def truncate(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def trim_codes(codes: Column, length: Column) -> Column:
    """Every codebook cut to a clip's own length, so that padding doesn't leak."""
    return F.transform(codes, lambda c: F.slice(c, F.lit(1), length))


def ragged(codes: Column) -> Column:
    """Whether codebooks differ in length."""
    return F.exists(codes, lambda c: F.size(c) != F.size(F.get(codes, 0)))


def mono(channels: Column) -> Column:
    """The mean over channels, sample by sample."""
    return F.transform(F.get(channels, 0), lambda _, i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i).cast("double")) / F.size(channels))


def rms(samples: Column) -> Column:
    """Root of the mean square in doubles; null for no samples."""
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.nullif(F.size(samples), F.lit(0)))


def finite(samples: Column) -> Column:
    return F.forall(samples, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def silent(samples: Column) -> Column:
    return F.coalesce(rms(samples) < SILENT_RMS, F.lit(True))


def gather_labels(tokens: Column, labels: Column, low: int, high: int) -> Column:
    """The labels at places whose token lies in ``[low, high]``."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("token"), labels.alias("label")), lambda z: z["token"].between(low, high)), lambda z: z["label"])


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
