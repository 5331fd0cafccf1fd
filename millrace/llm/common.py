"""Helpers that the operators of this subpackage share.

Work folders live below ``spark.checkpoint.dir``: it is the one folder that
the driver and all executors see.  Only when the session leaves it unset and
runs in one process (as in tests) is a temporary folder made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows per Arrow batch are left to the session; texts are handled one by one.
_SWEPT: set[str] = set()
#: Where the tables of ``staged`` lie.
_STAGED: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder; swept when the driver ends."""
    top = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    if top not in _SWEPT:
        _SWEPT.add(top)
        atexit.register(_sweep, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by now; the folder is scratch space
        pass


#: Tasks for each core that write a table of ids.
TASKS_PER_CORE = 4


def staged(df: DataFrame, name: str, light: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again.

    This cuts the lineage at a table that outlives any executor.  A ``light``
    table (ids after a shuffle) is written by a few tasks for each core of the
    cluster, however many shuffle partitions there are; each task takes its
    partitions one after another.
    """
    spark = df.sparkSession
    if light:
        df = df.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    path = work_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _STAGED[id(table)] = (weakref.ref(table), path)
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that no frame will read any more; others are left as they are."""
    for table in tables:
        ref, path = _STAGED.pop(id(table), (None, ""))
        if ref is not None and ref() is table:
            _sweep(table.sparkSession, path)


def spread(spark: SparkSession, units: int, per_task: int) -> int:
    """Tasks for so many units of work: enough for every core, and for ``per_task`` units each at most."""
    return max(1, min(int(units), spark.sparkContext.defaultParallelism), -(-int(units) // per_task))


def schema_with(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The fields of these columns of ``df``, and those of a DDL string."""
    return T.StructType([*df.select(*(F.col(f"`{c}`") for c in names)).schema, *T.StructType.fromDDL(more)])


def packed(df: DataFrame, *columns: str) -> DataFrame:
    """These columns beside ``row``, which holds all of them; so no column of a table can clash with an operator's."""
    return df.select(*(F.col(f"`{c}`") for c in columns), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make`` runs once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that extra ones never reach an operator."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
