"""Sample rates: windowed-sinc resampling as an expression.

Rates reduce to a ratio of small whole numbers, so an output sample has one of
``new`` phases, and each phase is a fixed row of weights over neighbouring input
samples.  The rows are literals of the expression; a sample is one product of a
row with a slice.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let

# Zero crossings on either side of the kernel, and the part of the lower band that it lets through.
ZERO_CROSSINGS, ROLLOFF = 6, 0.99


def ratio(old: int, new: int) -> tuple[int, int]:
    if old <= 0 or new <= 0:
        raise ValueError(f"rates are positive: {old}, {new}")
    common = math.gcd(old, new)
    return old // common, new // common


def phases(old: int, new: int) -> list[tuple[int, list[float]]]:
    """For each phase, where its weights begin relative to the sample at or before it, and the weights; those at zero are left out.

    A weight is a sinc of the lower band under a Hann window, at the distance in
    time between the output sample and the input sample.
    """
    old, new = ratio(old, new)
    band = min(old, new) * ROLLOFF
    reach = math.ceil(ZERO_CROSSINGS * old / band)
    at = np.arange(-reach, reach + old)
    rows = []
    for phase in range(new):
        t = (at / old - phase / new) * band
        inside = np.flatnonzero(np.abs(t) < ZERO_CROSSINGS)
        t = t[inside]
        weights = np.sinc(t) * np.cos(t * np.pi / ZERO_CROSSINGS / 2) ** 2 * band / old
        rows.append((int(at[inside[0]]), weights.tolist()))
    return rows


def resampled_length(length: Column, old: int, new: int) -> Column:
    old, new = ratio(old, new)
    return F.ceil(length.cast("bigint") * new / F.lit(old)).cast("int")


def resampled(samples: Column, old: int, new: int) -> Column:
    """Samples at another rate, as doubles: ceil(length * new / old) of them; silence stands before and behind. Null stays null."""
    if ratio(old, new) == (1, 1):
        return samples.cast("array<double>")
    step, count = ratio(old, new)
    rows = phases(old, new)
    before = max(0, -min(first for first, _ in rows))
    behind = max(first + len(weights) for first, weights in rows) + step
    # literals, folded once
    firsts = F.expr("array(" + ",".join(str(first + before + 1) for first, _ in rows) + ")")
    weights = F.expr("array(" + ",".join("array(" + ",".join(f"{w!r}D" for w in row) + ")" for _, row in rows) + ")")
    silence = lambda n: F.array_repeat(F.lit(0.0), n)

    def filtered(padded: Column) -> Column:
        def sample(j: Column) -> Column:
            row, begin = F.get(weights, j % count), F.get(firsts, j % count) + F.floor(j / count).cast("int") * step
            return F.aggregate(F.zip_with(F.slice(padded, begin, F.size(row)), row, lambda x, w: x * w), F.lit(0.0), lambda total, x: total + x)

        n = resampled_length(F.size(samples), old, new)
        return F.when(n <= 0, F.slice(silence(1), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), sample))

    whole = let(F.concat(silence(before), samples.cast("array<double>"), silence(behind)), filtered)
    return F.when(samples.isNotNull(), whole)
