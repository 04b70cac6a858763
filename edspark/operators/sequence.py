"""Dense 1-based sequence numbers in a total order, without a one-task window.

``row_number() over (order by ...)`` with no (or a low-cardinality) partition
key runs in a single task per group.  Here the rows are range-partitioned on
(group, order), numbered locally inside each partition, and shifted by the
row counts of the earlier partitions of the same group.  The offset table has
one row per (group, partition) that holds rows; it is counted, and broadcast
only up to ``BROADCAST_ROWS``.

The range-partitioned stage is read twice (local numbers and block totals).
Range bounds come from sampling, so two evaluations could disagree; the stage
is therefore written once with a reliable ``checkpoint()`` into the shared
checkpoint folder, which also keeps the result stable when executors are lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edspark.session import ensure_checkpoint_dir

#: Offset rows (some 30 bytes each) up to which the offset table is broadcast.
BROADCAST_ROWS = 500_000
_PID_SHIFT = 1 << 33  # monotonically_increasing_id = (partition id << 33) + row index


def _partitions(spark) -> int:
    """Shuffle partition count from the session (non-numeric settings fall
    back to the default parallelism)."""
    value = spark.conf.get("spark.sql.shuffle.partitions", None)
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return spark.sparkContext.defaultParallelism


def small_side(offsets: DataFrame) -> DataFrame:
    """The offset table, written once and broadcast only if its counted size
    allows; else the join shuffles."""
    offsets = offsets.checkpoint(eager=True)
    return F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets


def ordered_sequence(df: DataFrame, order_cols: Sequence[Column | str], group_cols: Sequence[str] = (),
                     name: str = "seq", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = position of each row inside its group in ``order_cols``
    order (1-based).  ``order_cols`` must make the order total (end with a
    key).  Meant for few, large groups (global order, per level, per colour);
    for many small groups a plain ``row_number`` window is the right tool."""
    spark = df.sparkSession
    n = num_partitions or _partitions(spark)
    keys = [F.col(g).asc_nulls_first() for g in group_cols] + [
        F.col(c) if isinstance(c, str) else c for c in order_cols]
    staged = (df.repartitionByRange(n, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__local", F.monotonically_increasing_id()
                          - F.col("__pid").cast("bigint") * F.lit(_PID_SHIFT)))
    ensure_checkpoint_dir(spark)
    staged = staged.checkpoint(eager=True)
    blocks = staged.groupBy(*group_cols, "__pid").agg(
        F.min("__local").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("__pid")
    blocks = blocks.withColumn(
        "__offset", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = blocks.select(*[F.col(g).alias(f"__g_{g}") for g in group_cols], F.col("__pid").alias("__bpid"),
                      "__first", "__offset")
    cond = reduce(lambda a, c: a & c,
                  [staged[g].eqNullSafe(b[f"__g_{g}"]) for g in group_cols],
                  staged["__pid"] == b["__bpid"])
    joined = staged.join(small_side(b), cond, "inner")
    seq = F.col("__offset") + F.col("__local") - F.col("__first") + F.lit(1)
    drop = ["__pid", "__local", "__bpid", "__first", "__offset"] + [f"__g_{g}" for g in group_cols]
    return joined.withColumn(name, seq.cast("bigint")).drop(*drop)


def running_sum(df: DataFrame, value: Column | str, order_cols: Sequence[Column | str],
                group_cols: Sequence[str] = (), name: str = "running", num_partitions: int | None = None) -> DataFrame:
    """Cumulative sum of ``value`` inside each group in ``order_cols`` order
    (rows up to and including the current one).  Same plan shape as
    :func:`ordered_sequence`: range partitions, local sums per
    (group, partition), plus the totals of the earlier partitions."""
    spark = df.sparkSession
    n = num_partitions or _partitions(spark)
    v = F.col(value) if isinstance(value, str) else value
    orders = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [F.col(g).asc_nulls_first() for g in group_cols] + orders
    staged = df.repartitionByRange(n, *keys).withColumn("__pid", F.spark_partition_id()).withColumn("__v", v)
    ensure_checkpoint_dir(spark)
    staged = staged.checkpoint(eager=True)
    wl = Window.partitionBy(*group_cols, "__pid").orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    local = staged.withColumn("__local", F.sum("__v").over(wl))
    blocks = staged.groupBy(*group_cols, "__pid").agg(F.sum("__v").alias("__tot"))
    w = (Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()).orderBy("__pid")
    blocks = blocks.withColumn(
        "__offset", F.coalesce(F.sum("__tot").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = blocks.select(*[F.col(g).alias(f"__g_{g}") for g in group_cols], F.col("__pid").alias("__bpid"), "__offset")
    cond = reduce(lambda a, c: a & c,
                  [local[g].eqNullSafe(b[f"__g_{g}"]) for g in group_cols],
                  local["__pid"] == b["__bpid"])
    joined = local.join(small_side(b), cond, "inner")
    drop = ["__pid", "__v", "__local", "__bpid", "__offset"] + [f"__g_{g}" for g in group_cols]
    return joined.withColumn(name, F.col("__offset") + F.col("__local")).drop(*drop)


_OPEN = 1 << 60  # an open bound


def _then(f: tuple, g: tuple) -> tuple:
    """``g`` after ``f`` of functions x -> min(high, max(low, x + step)),
    given as (step, low, high): such functions compose to one of their kind."""
    (step, low, high), (more, least, most) = f, g
    bound = lambda x: np.minimum(most, np.maximum(least, x + more))
    return step + more, bound(low), bound(high)


def _prefixes(step: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """Composition of all functions up to each place, by doubling the reach."""
    out, reach = (step, low, high), 1
    while reach < len(step):
        later = _then(tuple(x[:-reach] for x in out), tuple(x[reach:] for x in out))
        out = tuple(np.concatenate((x[:reach], y)) for x, y in zip(out, later, strict=True))
        reach *= 2
    return out


def clamped_sum(df: DataFrame, value: Column | str, low: Column | int, high: Column | int, order_cols: Sequence[Column | str],
                group_cols: Sequence[str] = (), start: int = 0, name: str = "running", num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` inside each group in ``order_cols`` order that
    is held between ``low`` and ``high`` at every row, from ``start``; adds
    ``name`` (after the row), ``name_before`` and ``name_held`` (whether the
    bounds changed the row's step).

    Each row is a function x -> min(high, max(low, x + value)), and such
    functions compose to one of three numbers.  So, as in :func:`running_sum`,
    every range partition is folded by itself, the few folded ones of a group
    are applied in order, and each row's result follows from its partition's
    start; no task holds a group."""
    spark = df.sparkSession
    n = num_partitions or _partitions(spark)
    keys = [F.col(g).asc_nulls_first() for g in group_cols] + [F.col(c) if isinstance(c, str) else c for c in order_cols]
    own = {"__step": F.col(value) if isinstance(value, str) else value, "__low": low, "__high": high}
    rows = df.select("*", *[(v if isinstance(v, Column) else F.lit(v)).cast("bigint").alias(k) for k, v in own.items()],
                     F.xxhash64(*group_cols, F.lit(0)).alias("__group"))
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__pid", F.spark_partition_id())
    rows = rows.withColumn("__place", F.monotonically_increasing_id())
    found = T.StructType([*rows.schema.fields, *[T.StructField(f"__{c}", T.LongType()) for c in ("d", "l", "h")]])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The function of all earlier rows of the group in the partition."""
        held: dict = {"group": None, "f": (0, -_OPEN, _OPEN)}
        for batch in batches:
            group, step, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__group", "__step", "__low", "__high"))
            out = [np.empty(len(group), np.int64) for _ in range(3)]
            cuts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)])) if len(group) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if group[a] != held["group"]:
                    held = {"group": group[a], "f": (0, -_OPEN, _OPEN)}
                upto = _then(held["f"], _prefixes(step[a:b], low[a:b], high[a:b]))
                for x, first, rest in zip(out, held["f"], upto, strict=True):
                    x[a], x[a + 1:b] = first, rest[:-1]
                held["f"] = tuple(int(x[-1]) for x in upto)
            arrays = [*batch.columns, *[pa.array(x) for x in out]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "__d", "__l", "__h"])

    ensure_checkpoint_dir(spark)
    staged = rows.mapInArrow(fold, found).checkpoint(eager=True)
    last = F.max_by(F.struct("__d", "__l", "__h", "__step", "__low", "__high"), "__place").alias("f")
    blocks = staged.groupBy("__group", "__pid").agg(last).select("__group", "__pid", "f.*")

    def starts(part: pd.DataFrame) -> pd.DataFrame:
        """One group's folded partitions, in order: at most one a partition."""
        part, x, out = part.sort_values("__pid"), start, []
        for r in part.drop(columns=["__group", "__pid"]).itertuples(index=False, name=None):
            out.append(x)
            x = min(r[2], max(r[1], x + r[0]))
            x = min(r[5], max(r[4], x + r[3]))
        return pd.DataFrame({"__bgroup": part["__group"], "__bpid": part["__pid"], "__start": out})

    blocks = blocks.groupBy("__group").applyInPandas(starts, "__bgroup bigint, __bpid int, __start bigint")
    joined = staged.join(small_side(blocks), (F.col("__group") == F.col("__bgroup")) & (F.col("__pid") == F.col("__bpid")))
    before = F.least("__h", F.greatest("__l", F.col("__start") + F.col("__d")))
    joined = joined.withColumn(f"{name}_before", before)
    after = F.least("__high", F.greatest("__low", F.col(f"{name}_before") + F.col("__step")))
    joined = joined.withColumn(name, after).withColumn(f"{name}_held", F.col(name) != F.col(f"{name}_before") + F.col("__step"))
    return joined.drop(*own, "__group", "__pid", "__place", "__d", "__l", "__h", "__bgroup", "__bpid", "__start")
