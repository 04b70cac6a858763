"""Sharding by jump consistent hashing.

The shard of a row depends on its key and the number of shards only; there is
no ring table to keep.  Appending a shard moves about one row in (shards + 1),
and only into the new shard (J. Lamping and E. Veach, "A Fast, Minimal Memory,
Consistent Hash Algorithm", 2014).

Rows get gapless slots inside their shard, in the order of the key's hash and
without one task per shard: a shard's range of hashes is cut into blocks, the
(shard, block) pairs are sorted by themselves, and their row counts give each
its first slot.  Equal rows are counted before they are shuffled and spread
out again at the end, in chunks of ``COPIES`` that are dealt over all tasks.

Defined cases: a null key is hashed as one key of its own; a null text is
empty; rows with equal keys go to one shard, where ties are ordered by their
size and text checksum, and equal rows get different slots; an empty table
gives no row; further columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edspark.llm.common import session_partitions, stored, text_of

#: Multiplier of the linear congruential generator of the published method.
JUMP_MULTIPLIER = 2862933555777941757
#: Copies of one row that are spread out in one step.
COPIES = 1 << 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard (0 to shards - 1) of every 64-bit key; all keys of a batch jump
    together until the last has landed."""
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    open_ = np.arange(len(state)) if shards > 0 else np.array([], int)
    with np.errstate(over="ignore"):
        while len(open_):
            at[open_] = ahead[open_]
            state[open_] = state[open_] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
            draw = (state[open_] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[open_] = ((at[open_] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            open_ = open_[ahead[open_] < shards]
    return at


def jump_hash(key: Column, shards: int) -> Column:
    """Column form of :func:`jump` over a 64-bit key (Arrow batches)."""

    @F.pandas_udf("int")
    def land(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return land(key)


def key_hash(key: Column) -> Column:
    """64-bit hash of a key: the first 16 hexadecimal digits of the MD5 of
    its text, so that other systems can compute it too."""
    digits = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def shard(docs: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """One row per document: the key, ``size`` (UTF-8 bytes of the text and
    16), ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` (its shard if
    one more is appended).

    About ``blocks`` pieces of each shard are numbered by themselves (the
    default grows with the session's shuffle partitions); the result does
    not depend on it."""
    bits = max(1, min(20, (blocks or 4 * session_partitions(docs.sparkSession) // shards).bit_length()))
    key, text = F.col(f"`{key_col}`"), F.encode(text_of(f"`{text_col}`"), "UTF-8")
    rows = docs.select(key.alias("key"), key_hash(key).alias("h"), (F.length(text) + 16).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = rows.groupBy("h", "key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("*", jump_hash(F.col("h"), shards).alias("shard"), jump_hash(F.col("h"), shards + 1).alias("grown_shard"),
                       F.shiftright("h", 64 - bits).alias("block"))
    # Read twice, for the counts and for the rows: written once.
    rows = stored(rows, "shards")
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("shard", "block").agg(F.sum("n").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "block").orderBy("h", "key", "size", "text_crc32").rowsBetween(
        Window.unboundedPreceding, 0)
    out = rows.withColumn("upto", F.sum("n").over(inside)).join(first, ["shard", "block"])
    out = out.withColumn("end", F.col("first") + F.col("upto"))
    # The copies of one row come back in chunks, dealt over all tasks.
    chunks = F.sequence(F.col("end") - F.col("n"), F.col("end") - 1, F.lit(COPIES).cast("bigint"))
    out = out.select("*", F.explode(chunks).alias("from")).repartition(session_partitions(docs.sparkSession), "shard", "from")
    upto = F.least(F.col("from") + COPIES, F.col("end")) - 1
    return out.select(F.col("key").alias(key_col), "size", "text_crc32", "shard",
                      F.explode(F.sequence("from", upto)).alias("slot"), "grown_shard")
