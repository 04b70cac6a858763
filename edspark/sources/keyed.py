"""A keyed table that is updated bucket by bucket.

Rows lie in a fixed number of buckets by the hash of their key.  An update
reads and writes only the buckets that its keys fall into; their new files
stand beside the old ones, and a manifest with the next number names the
files of every bucket.  Making that manifest is the switch: readers see the
table before or after an update, never between, and of two updates that began
from the same state the second is refused.

    <path>/data/<update>/__bucket=<b>/...   rows
    <path>/manifest/<number>.json           bucket -> folder, from 0
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edspark.sources.fixed_width import path_exists

BUCKET = "__bucket"


class UpdateRefused(RuntimeError):
    """The update can't be applied; the table is as it was."""


def _manifest_folder(path: str) -> str:
    return f"{path.rstrip('/')}/manifest"


def _latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest manifest."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_manifest_folder(path))
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    numbers = [int(n[:-5]) for n in (f.getPath().getName() for f in found) if n.endswith(".json") and n[:-5].isdigit()]
    number = max(numbers)
    text = spark.read.text(f"{_manifest_folder(path)}/{number}.json", wholetext=True).first()[0]
    return number, json.loads(text)


def _switch(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Make the manifest ``number``: written aside, then renamed, which fails
    if another update made it first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside = jvm.org.apache.hadoop.fs.Path(f"{_manifest_folder(path)}/_{uuid.uuid4().hex}")
    target = jvm.org.apache.hadoop.fs.Path(f"{_manifest_folder(path)}/{number}.json")
    files = aside.getFileSystem(conf)
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(aside).toUri(), conf)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(target), none)
    except Exception as e:
        files.delete(aside, False)
        raise UpdateRefused(f"another update came first: {target.getName()}") from e


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str) -> str:
    """Write bucketed rows into a folder of their own, whose name is returned;
    a large bucket is split over tasks."""
    name = uuid.uuid4().hex
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/data/{name}")
    return name


def _numbers(rows: DataFrame) -> list[int]:
    """The buckets that occur: at most as many as the table has."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def _checked(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: of several, the one of highest ``order`` (its ties are
    refused); without an order, a key that repeats is refused, as is a null."""
    column = F.col(f"`{key}`")
    if order is not None:
        cols = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        top = rows.groupBy(column.alias("__key")).agg(F.max_by(cols, F.col(f"`{order}`")).alias("r"), F.max(f"`{order}`").alias("o"))
        last = F.col(f"`{order}`").eqNullSafe(F.col("o"))
        tied = rows.join(top.select("__key", "o"), column.eqNullSafe(F.col("__key"))).filter(last).groupBy("__key").count().filter("count > 1")
        bad = tied
        rows = top.select("r.*")
    else:
        bad = rows.groupBy(column.alias("__key")).count().filter("count > 1")
    if not bad.isEmpty():
        raise UpdateRefused(f"a value of {key} stands more than once")
    if not rows.filter(column.isNull()).isEmpty():
        raise UpdateRefused(f"{key} is null")
    return rows


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Make the table; keys must be unique and not null."""
    spark = rows.sparkSession
    if path_exists(spark, _manifest_folder(path)):
        raise UpdateRefused(f"{path} is a table already")
    held = _bucketed(_checked(rows, key, None), key, buckets)
    name = _write(held, path)
    there = _numbers(spark.read.parquet(f"{path}/data/{name}")) if not held.isEmpty() else []
    _switch(spark, path, 0, {"key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": {str(b): [name] for b in there}})


def _read(spark: SparkSession, path: str, manifest: dict, only: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    folders = [f"{path.rstrip('/')}/data/{name}/{BUCKET}={b}" for b, names in manifest["folders"].items()
               if only is None or int(b) in only for name in names]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as it is now, or was at manifest ``number``."""
    last, manifest = _latest(spark, path)
    if number is not None and number != last:
        manifest = json.loads(spark.read.text(f"{_manifest_folder(path)}/{number}.json", wholetext=True).first()[0])
    return _read(spark, path, manifest)


def update(spark: SparkSession, path: str, rows: DataFrame, order: str | None = None) -> list[int]:
    """Replace the rows of the given keys and add new ones; returns the
    buckets that were written.  ``rows`` has the table's columns.  The same
    update again leaves the same rows."""
    number, manifest = _latest(spark, path)
    key = manifest["key"]
    names = T.StructType.fromJson(json.loads(manifest["schema"])).fieldNames()
    if set(rows.columns) != set(names):
        raise UpdateRefused(f"columns {sorted(rows.columns)} are not the table's {sorted(names)}")
    rows = _checked(rows.select(*[F.col(f"`{c}`") for c in names]), key, order)
    fresh = _bucketed(rows, key, manifest["buckets"])
    touched = _numbers(fresh)
    if not touched:
        return []
    old = _read(spark, path, manifest, touched)
    kept = old.join(rows.select(F.col(f"`{key}`").alias("__key")), F.col(f"`{key}`") == F.col("__key"), "left_anti")
    name = _write(_bucketed(kept, key, manifest["buckets"]).unionByName(fresh), path)
    folders = {**manifest["folders"], **{str(b): [name] for b in touched}}
    _switch(spark, path, number + 1, {**manifest, "folders": folders})
    return touched
