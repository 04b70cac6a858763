"""File sources and sinks: CSV with a fixed schema (S3/S4), vector columns
(S6/S7), float32 blobs, metric reports (S11) and keyed merges (S10)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edspark import schemas as S


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column; written in parallel, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S3: header CSV with an explicit schema (no inference pass)."""
    return spark.read.option("header", True).schema(schema).csv(path)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors stay an ``array<float>`` column in parquet, keyed by id."""
    df.write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _spans(array: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    """Offsets of an Arrow list or binary array from its first value on, and
    its validity bits (rebuilt, so that a sliced array starts at bit 0)."""
    valid = pa.array(np.ones(0, bool)) if not len(array) else array.is_valid()
    return np.asarray(array.offsets if hasattr(array, "offsets") else _binary_offsets(array), np.int64), valid.buffers()[1]


def _binary_offsets(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]


@F.arrow_udf(T.BinaryType())
def _encode_f32(vectors: pa.Array) -> pa.Array:
    """A whole batch at once: the values' buffer is the blobs' buffer."""
    at, valid = _spans(vectors)
    values = np.ascontiguousarray(vectors.values.to_numpy(zero_copy_only=False).astype("<f4"))
    return pa.Array.from_buffers(pa.binary(), len(vectors), [valid, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(values)])


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _decode_f32(blobs: pa.Array) -> pa.Array:
    at, valid = _spans(blobs)
    data = blobs.buffers()[2]
    values = np.frombuffer(data, "<f4", int(at[-1]) // 4) if data is not None and len(at) else np.zeros(0, "<f4")
    lists = pa.ListArray.from_buffers(pa.list_(pa.float32()), len(blobs),
                                      [valid, pa.py_buffer((at // 4).astype(np.int32))], children=[pa.array(values, pa.float32())])
    return lists


def vector_to_blob(vec) -> Column:
    """``array<float>`` -> little-endian float32 bytes (Arrow-batched)."""
    return _encode_f32(F.col(vec) if isinstance(vec, str) else vec)


def blob_to_vector(blob) -> Column:
    """float32 bytes -> ``array<float>`` (Arrow-batched)."""
    return _decode_f32(F.col(blob) if isinstance(blob, str) else blob)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metrics report sink as JSON lines."""
    metrics.write.mode(mode).json(path)


def metrics_report_lines(metrics: DataFrame) -> DataFrame:
    """S11 text form: the evaluation report as ordered lines (title,
    underline, intervention share with one decimal, three rates with two).
    ``metrics`` is the one-row frame of ``decisions.hybrid_metrics``."""
    def pct(col, digits):
        return F.concat(F.format_number(F.col(col), digits).alias("x"), F.lit("%"))

    lines = F.array(F.lit(S.REPORT_TITLE), F.lit("=" * len(S.REPORT_TITLE)),
                    *[F.concat(F.lit(label), pct(col, digits)) for label, col, digits in S.REPORT_LINES])
    return metrics.select(F.posexplode(lines).alias("line_no", "value"))


def write_report(lines: DataFrame, path: str) -> None:
    """Write the report lines, in order, as one text file."""
    lines.orderBy("line_no").select("value").coalesce(1).write.mode("overwrite").text(path)


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Batch append of new visit / result / token rows (idempotency is
    the caller's: append each batch once, or overwrite its partition)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_by_day(df: DataFrame, path: str, ts_col: str, mode: str = "append") -> None:
    """Store a time-stamped table partitioned by day, so a dashboard window
    (``ts >= now - h``) prunes whole day folders as well as row groups."""
    # Range partitioning on (day, time) keeps each day in few files while a
    # very busy day is still split over several writer tasks.
    (df.withColumn("day", F.to_date(F.col(ts_col)))
       .repartitionByRange("day", ts_col)
       .write.mode(mode).partitionBy("day").parquet(path))


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Store a table bucketed and sorted by ``key`` at ``path`` and register
    it in the catalog.  Tables joined on the same key with the same bucket
    count join without a shuffle (results, appointments and tokens on
    ``appointment_id`` for the triage log)."""
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
       .option("path", path).saveAsTable(table))


def keyed_merge(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Late update of existing rows by key.  Rows of ``updates`` whose key
    is absent in ``base`` are ignored; a null update keeps the old value.
    ``updates`` must hold at most one row per key."""
    upd = updates.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    merged = base.join(upd, key, "left")
    return merged.select(
        *[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
          for c in base.columns]
    )

