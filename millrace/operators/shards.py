"""Size-budgeted shards of clips and the progress over them.

Packing is next-fit over clips in the order of their id's SHA-256: a shard
closes when the next clip would exceed the budget.  Where a shard ends follows
from where it began, so the order is a chain.  It is cut into range parts that
hold more than a budget each, and three things are found for all parts at once:

1. inside a part, by pointer doubling over a search in running sums, where a chain
   that enters at a clip leaves: how many shards it begins, and what the last has used;
2. from that, where it enters the next part.  A chain enters among the first clips
   of a budget, so a part hands on few rows;
3. the entries of the one chain that begins at the first clip, by binary lifting:
   links over 2^k parts are joined from links over half as many, and known entries
   double with each level.

Then every part numbers its own clips from its entry.  Nothing but counts reaches
the driver, and the number of jobs grows with the logarithm of that of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numeric import AUDIO_BYTES_PER_SECOND, audio_bytes
from millrace.operators.staging import scratch, staged

#: Clips of one range part at most, on average, and budgets that it holds at least, on average.
PARTITION_CLIPS, BUDGETS = 1_000_000, 4


def stable_order(clips: DataFrame, id_col: str = "clip_id") -> DataFrame:
    """Rows by the SHA-256 of their id, ties by id."""
    return clips.orderBy(F.sha2(id_col, 256), id_col)


def plan_shards(clips: DataFrame, budget: int, rate: float = AUDIO_BYTES_PER_SECOND, path: str | None = None, partition_clips: int = PARTITION_CLIPS) -> DataFrame:
    """``clip_id``, ``bytes`` and ``shard`` of every clip of (``clip_id``, ``duration_seconds``).

    A clip above the whole budget is an error.  ``path`` is a folder all
    executors reach, where the sized clips are kept meanwhile; it defaults
    to one below ``spark.checkpoint.dir``.
    """
    spark = clips.sparkSession
    sized = clips.select("clip_id", audio_bytes(F.col("duration_seconds"), rate).alias("bytes"), F.sha2("clip_id", 256).alias("hash"))
    sized = sized.withColumn("bytes", F.when(F.col("bytes") <= budget, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("a clip exceeds the shard budget: "), "clip_id"))))
    sized = staged(sized, "clips", path or scratch(spark, "shards"))
    count, total = sized.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(1, min(-(-count // partition_clips), total // (BUDGETS * budget)))
    # the hash is uniform, so its first digits cut the order into even parts; each but the last must close a shard
    while parts > 1 and sized.groupBy(_part(parts).alias("part")).agg(F.sum("bytes").alias("b")).where((F.col("part") < parts - 1) & (F.col("b") > budget)).count() < parts - 1:
        parts //= 2
    cut = sized.withColumn("part", _part(parts))
    dealt = lambda rows: rows.repartition(parts, "part").sortWithinPartitions("part", "hash", "clip_id")
    entries = _entries(dealt(cut), parts, budget) if parts > 1 else spark.createDataFrame([(0, 0, 0)], "part int, entry bigint, shard int")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            sizes, entry, shard = rows["bytes"].to_numpy(), rows["entry"][0].as_py(), rows["shard"][0].as_py()
            begins = np.zeros(len(sizes), np.int32)
            if entry is not None:
                begins[[entry, *(entry + np.array(next_fit(sizes[entry:], budget), np.int64))]] = 1
            found = (shard - 1 + np.cumsum(begins)).astype(np.int32)
            for batch in pa.table([rows["clip_id"], rows["bytes"], pa.array(found)], ["clip_id", "bytes", "shard"]).to_batches(max_chunksize=1 << 16):
                yield batch

    return dealt(cut.join(entries, "part")).select("part", "clip_id", "bytes", "entry", "shard").mapInArrow(number, f"clip_id {dict(clips.dtypes)['clip_id']}, bytes bigint, shard int")


def _part(parts: int) -> Column:
    return F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") * parts / (1 << 32)).cast("int")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one part after another, from a task that has them in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[-1].column("part")[0].as_py() != parts[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def chains(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """For each clip at which a shard could begin: how many shards begin from it on, and what the last of them uses."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    follows = np.searchsorted(ends, begins + budget, side="right")
    here = np.arange(len(sizes))
    jump, steps = np.where(follows < len(sizes), follows, here), (follows < len(sizes)).astype(np.int64)
    while not np.array_equal(further := jump[jump], jump):
        steps, jump = steps + steps[jump], further
    return steps + 1, (ends[-1] if len(ends) else 0) - begins[jump]


def _entries(ordered: DataFrame, parts: int, budget: int) -> DataFrame:
    """Where the chain enters each part (null: nowhere), and the shard that begins there."""

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            part, sizes = rows["part"][0].as_py(), rows["bytes"].to_numpy()
            begun, used = chains(sizes, budget)
            ends = np.cumsum(sizes)
            # a chain enters at the first clip that the open shard can't take
            at = np.flatnonzero(ends - sizes <= budget) if part else np.arange(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), *(pa.array(x[at].astype(np.int64)) for x in (np.arange(len(sizes)), ends, begun, used))], ["part", "entry", "end", "n", "used"])

    found = staged(ordered.select("part", "bytes").mapInArrow(exits, "part int, entry bigint, end bigint, n bigint, used bigint"), "exits")
    # of the entries of the next part, the first whose end exceeds what is left in the open shard
    leaving = found.select((F.col("part") + 1).alias("part"), (F.lit(budget) - F.col("used")).alias("value"), F.lit(1).alias("kind"), F.col("entry").alias("from"), "n", F.lit(None).cast("bigint").alias("entry")).where(F.col("part") < parts)
    entering = found.select("part", F.col("end").alias("value"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("from"), F.lit(None).cast("bigint").alias("n"), "entry")
    order = Window.partitionBy("part").orderBy(F.desc("value"), F.desc("kind"), F.desc("entry")).rowsBetween(Window.unboundedPreceding, 0)
    met = leaving.unionByName(entering).withColumn("to", F.last("entry", ignorenulls=True).over(order)).where("kind = 1")
    links = [staged(met.select((F.col("part") - 1).alias("part"), F.col("from").alias("entry"), "to", "n"), "links")]
    while 1 << len(links) < parts:
        reach, half = 1 << len(links), links[-1]
        onward = half.select((F.col("part") - reach // 2).alias("part"), F.col("entry").alias("to"), F.col("to").alias("onward"), F.col("n").alias("more"))
        links.append(staged(half.where(F.col("part") % reach == 0).join(onward, ["part", "to"]).select("part", "entry", F.col("onward").alias("to"), (F.col("n") + F.col("more")).alias("n")), "links"))
    known = ordered.sparkSession.createDataFrame([(0, 0, 0)], "part int, entry bigint, shard int")
    for k in reversed(range(len(links))):
        reached = known.join(links[k], ["part", "entry"]).select((F.col("part") + (1 << k)).alias("part"), F.col("to").alias("entry"), (F.col("shard") + F.col("n")).cast("int").alias("shard"))
        known = staged(known.unionByName(reached), "entries")
    return known


def next_fit(sizes: np.ndarray, budget: int) -> list[int]:
    """Places where a new shard begins behind the first, which begins at the first clip."""
    ends = np.cumsum(sizes)
    starts: list[int] = []
    at = base = 0
    while (at := int(np.searchsorted(ends, base + budget, side="right"))) < len(sizes):
        starts.append(at)
        base = int(ends[at] - sizes[at])
    return starts


def shard_table(planned: DataFrame) -> DataFrame:
    """``index``, ``n_clips`` and ``total_audio_bytes`` of each shard."""
    return planned.groupBy(F.col("shard").alias("index")).agg(F.count("*").alias("n_clips"), F.sum("bytes").alias("total_audio_bytes"))


def shard_clips(planned: DataFrame) -> DataFrame:
    """Shards with their clip ids in order; an id list is as long as the budget allows."""
    return planned.groupBy(F.col("shard").alias("index")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.sha2("clip_id", 256).alias("h"), "clip_id"))), lambda x: x["clip_id"]).alias("clip_ids"), F.sum("bytes").alias("total_audio_bytes"))


def shard_samples(shards: DataFrame, samples: DataFrame, splits: DataFrame) -> DataFrame:
    """The samples of each shard, in the shard's order, with their split; ids without a sample or a split fall out.

    ``shards``: index, clip_ids; ``samples``: clip_id and more; ``splits``: clip_id, split.
    """
    ids = shards.select("index", F.posexplode("clip_ids").alias("place", "clip_id"))
    return ids.join(samples, "clip_id").join(splits.select("clip_id", "split"), "clip_id")


def pending(shards: DataFrame, progress: DataFrame) -> DataFrame:
    """Shards that are not complete. ``progress``: ``shard_index``."""
    return shards.join(progress.select(F.col("shard_index").alias("index")), "index", "left_anti")


def complete(progress: DataFrame, done: DataFrame) -> DataFrame:
    """Progress with more shards added; adding twice changes nothing. In order of the index."""
    return progress.select("shard_index").unionByName(done.select("shard_index")).distinct().orderBy("shard_index")
