"""Tables written once to the folder that driver and executors share, and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this driver's scratch tables; they go when it ends.
_TOPS: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; a session of one process (as in tests) may leave that unset.

    What lies there is removed when the driver ends, for results may read it until then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    top = f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if top not in _TOPS:
        _TOPS.add(top)
        atexit.register(swept, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def swept(spark: SparkSession, top: str) -> None:
    """Remove a folder of scratch tables, if the session is still there to do it."""
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(top)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by now
        pass
    _TOPS.discard(top)


def staged(rows: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows as they came out once: what reads them twice sees the same places and partitions."""
    path = path or scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
