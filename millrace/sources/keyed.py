"""A keyed table that grows by small saves: a base, the rows saved since, and a list of both.

A save writes its own rows alone, as a table of its own, and then replaces the list
in one move of the store.  Reading takes from base and saves the newest row of each
key.  When the saves hold more than a share of the base, the next save writes a new
base.  Tables are never changed: a reader that began with one list keeps its version
until ``vacuum`` removes what the present list doesn't name.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.cache import last_by_key
from millrace.sources.files import exists, hadoop_path
from millrace.sources.sinks import write_document

#: Rows of all saves, in parts of those of the base, from which on they are merged.
SHARE = 0.5


def _listed(spark: SparkSession, path: str) -> dict:
    """The present list: its version, and each table with its number and rows; the first is the base."""
    name = f"{path}/tables.json"
    if not exists(spark, name):
        return {"version": 0, "tables": []}
    return json.loads("\n".join(r[0] for r in spark.read.text(name, wholetext=True).collect()))


def save(spark: SparkSession, rows: DataFrame, path: str, key: str, *order: str, share: float = SHARE) -> dict:
    """Add rows, each in place of an earlier one with its key; returns the new list.

    Of rows that share a key the last by ``order`` counts; without an order keys are expected to differ.
    """
    listed = _listed(spark, path)
    version = listed["version"] + 1
    rows = last_by_key(rows, key, *order) if order else rows
    name = f"{version:08d}-{uuid.uuid4().hex[:8]}"
    rows.sortWithinPartitions(key).write.parquet(f"{path}/{name}")
    tables = [*listed["tables"], {"name": name, "number": version, "rows": spark.read.parquet(f"{path}/{name}").count()}]
    if len(tables) > 1 and sum(t["rows"] for t in tables[1:]) > share * tables[0]["rows"]:
        base = f"{version:08d}-base-{uuid.uuid4().hex[:8]}"
        _merged(spark, path, tables, key).sortWithinPartitions(key).write.parquet(f"{path}/{base}")
        tables = [{"name": base, "number": version, "rows": spark.read.parquet(f"{path}/{base}").count()}]
    listed = {"version": version, "tables": tables}
    write_document(spark, f"{path}/tables.json", listed)
    return listed


def _merged(spark: SparkSession, path: str, tables: list[dict], key: str) -> DataFrame:
    """The newest row of each key; columns that a table lacks are null in its rows."""
    rows = None
    for t in tables:
        part = spark.read.parquet(f"{path}/{t['name']}").withColumn("_number", F.lit(t["number"]).cast("bigint"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.drop("_number") if len(tables) == 1 else last_by_key(rows, key, "_number").drop("_number")


def load(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The table as of the present list; None before the first save. A filter on the key reaches the files of every part."""
    tables = _listed(spark, path)["tables"]
    return _merged(spark, path, tables, key) if tables else None


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove tables that the present list doesn't name; how many there were. Readers of earlier versions must be done."""
    named = {t["name"] for t in _listed(spark, path)["tables"]} | {"tables.json"}
    folder, store = hadoop_path(spark, path)
    old = [s.getPath() for s in store.listStatus(folder) if s.isDirectory() and s.getPath().getName() not in named]
    for p in old:
        store.delete(p, True)
    return len(old)
