"""Hash splits, size estimates, rates and the learning-rate schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates, sizes and reservations used in planning.
AUDIO_BYTES_PER_SECOND = 24_000 * 2 * 1.05
TOKENS_HZ, TOKEN_BYTES, STREAMS = 75, 2, 5
MODEL_BYTES, OVERHEAD_BYTES = 4 * 1024**3, 2 * 1024**3
SPLIT_BUCKETS = 10_000
SENTENCE_TOKENS = 20


def split_of(clip_id: Column, validation_share: float) -> Column:
    """``train`` or ``validation`` by the first 32 bits of the id's SHA-256; the threshold is truncated."""
    bucket = F.conv(F.substring(F.sha2(clip_id, 256), 1, 8), 16, 10).cast("bigint") % SPLIT_BUCKETS
    return F.when(bucket < int(validation_share * SPLIT_BUCKETS), "validation").otherwise("train")


def audio_bytes(seconds: Column, rate: float = AUDIO_BYTES_PER_SECOND) -> Column:
    return (seconds * F.lit(float(rate))).cast("bigint")


def semantic_bytes(seconds: Column, hz: float = TOKENS_HZ, token_bytes: int = TOKEN_BYTES, streams: int = STREAMS) -> Column:
    return (seconds * F.lit(float(hz)) * token_bytes * streams).cast("bigint")


def available_bytes(total: int, model: int = MODEL_BYTES, overhead: int = OVERHEAD_BYTES) -> int:
    """What a shard may use; raises if reservations leave nothing."""
    left = total - model - overhead
    if left <= 0:
        raise ValueError(f"a budget of {total} bytes leaves nothing beside {model} and {overhead}")
    return left


def duration_seconds(samples: Column, rate: Column) -> Column:
    """Samples over rate as a double, rounded to three places by its exact binary value.

    The quotient lies on the same side of a midpoint as the fraction, unless the
    fraction is a midpoint.  Then the double's 53 bits are compared with the
    midpoint in whole numbers, and a true tie goes to the even place.
    """
    n, r = samples.cast("bigint"), rate.cast("bigint")
    quotient = n.cast("double") / r.cast("double")
    below = ((n * 1000 - F.pmod(n * 1000, r)) / r).cast("bigint")
    left = F.pmod(n * 1000, r) * 2 - r
    shift = (53 - F.floor(F.log2(quotient))).cast("int")
    whole = lambda c: c.cast("decimal(20,0)")
    bits = whole((quotient * F.pow(F.lit(2.0), shift)).cast("bigint")) * 2000
    middle = whole(below * 2 + 1) * whole(F.call_function("shiftleft", F.lit(1).cast("bigint"), shift))
    # below two milliseconds the shift would pass 62; both midpoints there round up
    up = F.when(left != 0, left > 0).when(quotient < 0.002, True).when(bits != middle, bits > middle).otherwise(below % 2 == 1)
    return F.when(up, below + 1).otherwise(below) / 1000


def byte_rate(bytes_: Column, seconds: Column) -> Column:
    """Aggregate: measured bytes a second, 0 where no seconds were measured."""
    return F.coalesce(F.try_divide(F.sum(bytes_).cast("double"), F.sum(seconds)), F.lit(0.0))


def learning_rate(step: Column) -> Column:
    """Warm-up, plateau, decay and floor by the columns of a schedule row; each stage includes its last step."""
    c = F.col
    warm = c("start_lr") + (step / c("warmup_end")) * (c("peak_lr") - c("start_lr"))
    share = F.when(c("decay_end") > c("stable_end"), (step - c("stable_end")) / (c("decay_end") - c("stable_end"))).otherwise(1.0)
    return (
        F.when(step <= 0, F.when(c("warmup_end") > 0, c("start_lr")).otherwise(c("peak_lr")))
        .when(step <= c("warmup_end"), warm)
        .when(step <= c("stable_end"), c("peak_lr"))
        .when(step <= c("decay_end"), c("peak_lr") + share * (c("end_lr") - c("peak_lr")))
        .otherwise(c("end_lr"))
    )


def check_schedule(warmup_end: int, stable_end: int, decay_end: int) -> None:
    if not 0 <= warmup_end <= stable_end <= decay_end:
        raise ValueError("stage ends must not fall")


def due(step: Column, every: int) -> Column:
    """Whether a periodic action is due; never at step 0."""
    return (step > 0) & (step % every == 0)


def log_due(step: Column, every: int) -> Column:
    return (step % every == 0) | (step == 1)


def sentences_per_item(max_length: int) -> int:
    return max_length // SENTENCE_TOKENS


def effective_batch(per_device: int, accumulation: int, devices: int) -> int:
    return per_device * accumulation * devices


def sessions_needed(steps: int, seconds_per_step: float, usable_seconds: float) -> float:
    return steps * seconds_per_step / usable_seconds


def rank_seed(seed: int, rank: int) -> int:
    return seed + rank
