"""Batches of padded token arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from millrace.functions import arrays
from millrace.functions.text import let
from millrace.operators.staging import staged


def earlier() -> WindowSpec:
    """The parts before one; a window over one row a part."""
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def batch_number(order: Column, size: int) -> Column:
    """Number of a fixed-size batch from a 0-based ordinal."""
    return F.floor(order / size).cast("bigint")


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``_part`` and ``_inner``, their range and their place in it.

    They are written once: a second reading of the exchange could draw other
    range bounds, and so other places.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(dealt.withColumns({"_part": F.spark_partition_id(), "_inner": F.monotonically_increasing_id() % (1 << 33)}), "ranges")


def ordinals(rows: DataFrame, *order: str, by: tuple[str, ...] = (), name: str = "ordinal") -> DataFrame:
    """A 0-based row number in the given order.

    Without ``by`` the order is global: rows are dealt by ranges and sorted,
    numbered inside each part, and shifted by the sizes of the parts before it,
    so no task sees more than its own part.
    """
    if by:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    dealt = ranged(rows, *order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier()), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inner")).select(*rows.columns, name)


def pad_batches(rows: DataFrame, batch: str, ids: str, labels: str, multiple: int = 1, most: int | None = None) -> DataFrame:
    """Every row with ``input_ids``, ``labels`` and ``attention_mask`` padded to its batch's length.

    The longest row of each batch is one number a batch; rows themselves are
    not gathered.
    """
    if most is not None:
        rows = rows.withColumns({ids: arrays.truncate(F.col(ids), most), labels: arrays.truncate(F.col(labels), most)})
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    length = arrays.padded_length(F.col("_longest"), multiple)
    joined = rows.join(longest, batch).withColumn("padded_length", length)
    n = F.col("padded_length")
    return joined.withColumns({
        "input_ids": arrays.pad(F.col(ids), n),
        "padded_labels": arrays.pad(F.col(labels), n, arrays.LABEL_PAD),
        "attention_mask": arrays.attention_mask(F.col(ids), n),
    }).drop("_longest")


def collated(rows: DataFrame, batch: str, collate: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each batch through a collating function of the caller's; a batch is as large as its batch number makes it."""
    return rows.groupBy(batch).applyInPandas(collate, schema)


#: Rounds of the permutation, its two primes, and walks at most before it gives up.
_ROUNDS, _PRIMES, _WALKS = 6, (2**31 - 1, 2**31 - 19), 64


def permutation_keys(n: int, seed: int, epoch: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Both sides of a grid that just holds ``n`` places, and three numbers below 2^31 for each round."""
    side = math.isqrt(max(n, 1) - 1) + 1
    keys = []
    for k in range(_ROUNDS):
        digest = hashlib.sha256(f"{seed}:{epoch}:{k}".encode()).digest()
        keys.append(tuple(int.from_bytes(digest[8 * i : 8 * i + 8], "big") % (_PRIMES[0] - 1) + 1 for i in range(3)))
    return side, -(-max(n, 1) // side), keys


def shuffled_place(ordinal: Column, n: int, seed: int = 0, epoch: int = 0) -> Column:
    """The place of a 0-based ordinal in a permutation of ``n`` rows that depends on seed and epoch alone.

    A Feistel network over a grid: in turn one coordinate moves by a hash of the
    other, so every step can be undone and no two ordinals share a place.  The grid
    has at most one row more than there are places; what lands there walks on.
    Nothing is sorted or shuffled.
    """
    rows, columns, keys = permutation_keys(n, seed, epoch)
    beyond = rows * columns - n

    def drawn(x: Column, key: tuple[int, int, int]) -> Column:
        a, b, c = (F.lit(k).cast("bigint") for k in key)
        return (x * a + b) % _PRIMES[0] * c % _PRIMES[1]

    def once(x: Column) -> Column:
        def turn(k: int) -> Callable[[Column], Column]:
            def turned(state: Column) -> Column:
                left, right = state["left"], state["right"]
                moved = ((left + drawn(right, keys[k])) % rows, right) if k % 2 == 0 else (left, (right + drawn(left, keys[k])) % columns)
                return F.struct(moved[0].alias("left"), moved[1].alias("right"))

            return turned

        at = F.struct(((x - x % columns) / columns).cast("bigint").alias("left"), (x % columns).alias("right"))
        for k in range(_ROUNDS):
            at = let(at, turn(k))
        return let(at, lambda state: state["left"] * columns + state["right"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(beyond + 1, _WALKS))), F.lit(n).cast("bigint"), lambda x, i: F.when((i > 1) & (x < n), x).otherwise(once(F.when(i == 1, ordinal.cast("bigint")).otherwise(x))))
    return let(walk, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("no place after so many walks"))))


def rank_shares(rows: DataFrame, ordinal: str, n: int, ranks: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """The rows with ``rank`` and ``step``, their turn within the rank; every rank gets ceil(n / ranks) rows.

    Places of an epoch go round the ranks; behind the last one the first ones come
    again until all ranks have as many.  ``ordinal`` numbers the ``n`` rows from 0.
    """
    total = -(-n // ranks) * ranks
    place = shuffled_place(F.col(ordinal), n, seed, epoch) if n else F.lit(0).cast("bigint")
    placed = rows.withColumn("_place", place).withColumn("_place", F.explode(F.sequence("_place", F.lit(max(total - 1, 0)).cast("bigint"), F.lit(max(n, 1)).cast("bigint"))))
    return placed.withColumns({"rank": (F.col("_place") % ranks).cast("int"), "step": F.floor(F.col("_place") / ranks).cast("bigint")}).drop("_place")


def rank_rows(rows: DataFrame, key: str, ranks: int, rank: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """One rank's share of the rows, disjoint from all others; it changes with the epoch."""
    return rows if ranks <= 1 else rows.where(F.pmod(F.xxhash64(key, F.lit(seed + epoch)), F.lit(ranks)) == rank)


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """Rows in an order that depends on seed and epoch alone."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed + epoch)), key)
