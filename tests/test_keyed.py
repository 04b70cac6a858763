"""The keyed table: only touched buckets are written, and updates switch at once."""

import os

import pytest
from pyspark.sql import functions as F

from edspark.sources import keyed


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{path}/data") for f in names
            if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "results")
    keyed.create(spark.range(500).select("id", (F.col("id") % 7).alias("v"), F.lit("a").alias("s")), path, "id", buckets=16)
    return path


def rows(spark, path, **more):
    return {r.id: (r.v, r.s) for r in keyed.read(spark, path, **more).collect()}


def test_update_touches_its_buckets_only(spark, table):
    before, old = files(table), rows(spark, table)
    new = spark.createDataFrame([(3, 70, "b"), (9999, 80, "c")], "id long, v long, s string")
    touched = keyed.update(spark, table, new)
    after = files(table)
    assert 1 <= len(touched) <= 2 and all(after[f] == t for f, t in before.items())
    assert {f.split("__bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == {str(b) for b in touched}
    assert rows(spark, table) == {**old, 3: (70, "b"), 9999: (80, "c")}
    assert rows(spark, table, number=0) == old
    # The same update again leaves the same rows.
    assert keyed.update(spark, table, new.select("s", "v", "id")) == touched
    assert rows(spark, table) == {**old, 3: (70, "b"), 9999: (80, "c")}


def test_two_updates_of_a_key_are_refused_or_ordered(spark, table):
    new = spark.createDataFrame([(3, 1, "b"), (3, 2, "c"), (4, 5, "d")], "id long, v long, s string")
    with pytest.raises(keyed.UpdateRefused):
        keyed.update(spark, table, new)
    keyed.update(spark, table, new, order="v")
    assert rows(spark, table)[3] == (2, "c") and rows(spark, table)[4] == (5, "d") and len(rows(spark, table)) == 500
    with pytest.raises(keyed.UpdateRefused):
        keyed.update(spark, table, new.withColumn("v", F.lit(1).cast("long")), order="v")
    for bad in (new.filter("id = 4").drop("s"), spark.createDataFrame([(None, 1, "x")], "id long, v long, s string")):
        with pytest.raises(keyed.UpdateRefused):
            keyed.update(spark, table, bad)


def test_the_second_of_two_concurrent_updates_is_refused(spark, table):
    number, manifest = keyed._latest(spark, table)
    keyed.update(spark, table, spark.createDataFrame([(1, 1, "x")], "id long, v long, s string"))
    with pytest.raises(keyed.UpdateRefused):
        keyed._switch(spark, table, number + 1, manifest)
    assert rows(spark, table)[1] == (1, "x")
    assert not [f for f in os.listdir(f"{table}/manifest") if f.startswith("_")]


def test_empty_tables_and_updates(spark, tmp_path):
    path = str(tmp_path / "none")
    keyed.create(spark.createDataFrame([], "id long, v long"), path, "id", buckets=4)
    assert keyed.read(spark, path).count() == 0
    assert keyed.update(spark, path, spark.createDataFrame([], "id long, v long")) == []
    keyed.update(spark, path, spark.createDataFrame([(1, 2)], "id long, v long"))
    assert [tuple(r) for r in keyed.read(spark, path).collect()] == [(1, 2)]
    with pytest.raises(keyed.UpdateRefused):
        keyed.create(spark.createDataFrame([], "id long, v long"), path, "id")
