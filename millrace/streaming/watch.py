"""Structured Streaming: new steps, resumable shards, count batches, a sink that never queues."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery


def folder_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def new_steps(stream: DataFrame, key: str, step: str, order: str) -> DataFrame:
    """Each positive step that differs from the key's last one, across batches and restarts."""
    kind, key_kind, order_kind = (dict(stream.dtypes)[c] for c in (step, key, order))

    def act(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        rows = rows[rows[step] > 0]
        before = rows[step].shift(1)
        if len(rows):
            before.iloc[0] = last if last is not None else -1
            out = rows[rows[step] != before]
            state.update((int(rows[step].iloc[-1]),))
            yield out[[key, step, order]]

    return stream.select(key, step, order).groupBy(key).applyInPandasWithState(act, f"{key} {key_kind}, {step} {kind}, {order} {order_kind}", "last bigint", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there now and stop; a restart from the checkpoint goes on behind it."""
    query = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def watch(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None], every: str = "15 seconds") -> StreamingQuery:
    """Poll at an interval until stopped."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def idempotent(path: str) -> Callable[[DataFrame, int], None]:
    """A sink in which a batch that runs again replaces itself: at least once, without doubles."""

    def act(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return act


class SkipIfBusy:
    """Runs one job at a time in the background; while it runs, further calls are dropped, not queued."""

    def __init__(self, job: Callable[..., None]):
        self.job, self.thread, self.errors = job, None, []

    def __call__(self, *args) -> bool:
        if self.thread is not None and self.thread.is_alive():
            return False

        def guarded() -> None:
            try:
                self.job(*args)
            except Exception as e:  # a failed upload must not end the run
                self.errors.append(e)

        self.thread = threading.Thread(target=guarded, daemon=True)
        self.thread.start()
        return True

    def wait(self) -> None:
        if self.thread is not None:
            self.thread.join()


def count_batches(stream: DataFrame, key: str, value: str, size: int, order: str) -> DataFrame:
    """The mean of every ``size`` values of a key; what is left waits for more.

    Values of a trigger count in the order of ``order``, those of later triggers
    behind them, so a run that starts again gives the same means.
    """
    kinds = dict(stream.dtypes)

    def act(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for v in pd.concat(list(batches)).sort_values(order, kind="stable")[value].astype(float):
            n, total = n + 1, total + v
            if n == size:
                out.append((k[0], number, total / size))
                number, n, total = number + 1, 0, 0.0
        state.update((number, n, total))
        yield pd.DataFrame(out, columns=[key, "micro_batch", "mean"])

    return stream.select(*dict.fromkeys([key, value, order])).groupBy(key).applyInPandasWithState(act, f"{key} {kinds[key]}, micro_batch bigint, mean double", "number bigint, n bigint, total double", "append", GroupStateTimeout.NoTimeout)


def cycled(spark: SparkSession, rows: DataFrame, rounds: int) -> DataFrame:
    """The rows ``rounds`` times with their round."""
    return rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))) if rounds > 0 else rows.withColumn("round", F.lit(0)).limit(0)


def endless(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The rows again and again as an unbounded stream: one round for each batch, until the query stops.

    The source emits one number for each batch; a round is the join of that one row with the table.
    """
    rounds = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return rounds.select(F.col("value").alias("round")).join(rows)
