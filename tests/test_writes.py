"""Writes verified by content, and keyed tables that grow by saves."""

import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from millrace.sources import keyed, sinks

KIND = "id int, name string, x double, tags array<string>, m map<string,int>, at timestamp"
ROWS = [(i, f"n{i % 7}" if i % 5 else None, i / 3 if i % 4 else None, ["a", None] if i % 3 else None, {"k": i}, datetime.datetime(2024, 1, 1 + i % 9)) for i in range(60)]


def digest(df):
    return df.agg(*sinks.content_digest(df)).first().asDict()


def test_digests_ignore_order_and_see_every_change(spark):
    df = spark.createDataFrame(ROWS, KIND)
    whole = digest(df)
    assert digest(df.orderBy(F.rand(3)).repartition(7)) == whole
    observed = Observation()
    df.repartition(3).observe(observed, *sinks.content_digest(df)).write.format("noop").mode("overwrite").save()
    assert observed.get == whole
    one = [(*r[:1], "other", *r[2:]) if r[0] == 7 else r for r in ROWS]
    null = [(*r[:2], None, *r[3:]) if r[0] == 9 else r for r in ROWS]
    inner = [(*r[:4], {"k": -1}, r[5]) if r[0] == 9 else r for r in ROWS]
    names = {r[0]: r[1] for r in ROWS}
    swapped = [(r[0], names[{1: 2, 2: 1}.get(r[0], r[0])], *r[2:]) for r in ROWS]
    lost, twice = ROWS[:-1], [*ROWS[:-1], ROWS[0]]
    for other, columns in ((one, {"column name"}), (null, {"column x"}), (inner, {"column m"}), (swapped, set()), (lost, None), (twice, None)):
        found = digest(spark.createDataFrame(other, KIND))
        odd = {k for k in whole if found[k] != whole[k]}
        assert {"whole rows", "whole rows, mixed"} <= odd
        assert columns is None or odd - {"whole rows", "whole rows, mixed"} == columns
    empty = digest(spark.createDataFrame([], KIND))
    assert empty["rows"] == 0 and empty["whole rows"] == "0"


def test_verified_writes(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KIND)
    path = f"{tmp_path}/t"
    sinks.verified(df, path)
    assert digest(spark.read.parquet(path)) == digest(df)
    names = {r[0]: r[1] for r in ROWS}
    bad = spark.createDataFrame([(r[0], names[{1: 2, 2: 1}.get(r[0], r[0])], *r[2:]) for r in ROWS], KIND)
    with pytest.raises(ValueError, match="other content"):
        sinks.check_content(bad, df.columns, digest(df))
    with pytest.raises(ValueError, match="59 read back"):
        sinks.check_content(df.where("id <> 3"), df.columns, digest(df))
    with pytest.raises(ValueError, match="columns lost"):
        sinks.check_content(df.drop("x"), df.columns, digest(df))


def test_saves_write_their_own_rows_and_merge(spark, tmp_path):
    path, want = f"{tmp_path}/k", {}
    assert keyed.load(spark, path, "k") is None
    sizes = []
    for n in range(9):
        rows = [(k, n * 100 + k, n) for k in range(n, 40 if n == 0 else n + 4)] + [(n, -1, n - 1)]
        want |= {k: v for k, v, _ in rows if v >= 0}
        listed = keyed.save(spark, spark.createDataFrame(rows, "k int, v int, at int"), path, "k", "at")
        sizes.append([t["rows"] for t in listed["tables"]])
        assert {r.k: r.v for r in keyed.load(spark, path, "k").collect()} == want
    assert sizes[0] == [40] and sizes[1] == [40, 4] and sizes[5] == [40, 4, 4, 4, 4, 4] and sizes[6] == [40]


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = f"{tmp_path}/k"
    rows = lambda v, n=10: spark.createDataFrame([(k, v) for k in range(n)], "k int, v int")
    keyed.save(spark, rows(0), path, "k")
    first = keyed.load(spark, path, "k")
    keyed.save(spark, rows(1, 2), path, "k")
    second = keyed.load(spark, path, "k")
    keyed.save(spark, rows(2), path, "k")  # merges into a new base
    assert {r.v for r in first.collect()} == {0}
    assert sorted(r.v for r in second.collect()) == [0] * 8 + [1, 1]
    assert {r.v for r in keyed.load(spark, path, "k").collect()} == {2}
    assert keyed.vacuum(spark, path) == 3 and keyed.vacuum(spark, path) == 0
    assert {r.v for r in keyed.load(spark, path, "k").collect()} == {2}
    keyed.save(spark, spark.createDataFrame([(3, 9, "w")], "k int, v int, more string"), path, "k")
    assert {(r.v, r.more) for r in keyed.load(spark, path, "k").where("k in (3, 4)").collect()} == {(9, "w"), (2, None)}
