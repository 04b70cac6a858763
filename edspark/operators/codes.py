"""Diagnosis code text.

Codes are exploded with their position, looked up in the dictionary (raw
code first, then the dotted form ``c[:3].c[3:]``, else the code itself) and
re-joined in order; the regroup carries the row's columns, so there is
no self-join.  The dictionary joins are plain equi-joins, so Catalyst /
AQE broadcast the dictionary only when its measured size allows and fall back
to a (skew-split) sort-merge join otherwise; the regroup is per input row, so
no group is larger than one line's codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edspark.functions.text import UNKNOWN, split_words


def describe_codes(df: DataFrame, dictionary: DataFrame, text_col: str = "Chief_complain",
                   out_col: str = "Chief_complain_text", key: str | None = None) -> DataFrame:
    """Add ``out_col``: every whitespace-separated code of ``text_col``
    replaced by its description; null text -> "Unknown".  ``key`` must be
    unique per row; without one a per-row id is generated for this plan."""
    k = key or "__row"
    base = df if key else df.withColumn(k, F.monotonically_increasing_id())
    carry = [c for c in df.columns if c != k]
    words = base.select(k, *carry, F.posexplode_outer(split_words(text_col)).alias("__pos", "__code"))
    # One row per undotted code: an entry in the raw form before one in the
    # dotted form, then the smallest description.
    entry = dictionary.select(F.col("code").alias("__c"), F.col("description").alias("__d"))
    bare = F.when(F.col("__c").rlike(r"^.{3}\.."), F.concat(F.substring("__c", 1, 3), F.substring("__c", 5, 1 << 30))).otherwise(F.col("__c"))
    entry = entry.filter(F.col("__d").isNotNull()).groupBy(bare.alias("__bare")).agg(
        F.min(F.struct((F.col("__c") != bare).alias("dotted"), F.col("__d").alias("d")))["d"].alias("__d"))
    looked = words.join(entry, words["__code"] == entry["__bare"], "left")
    desc = F.coalesce(F.col("__d"), F.col("__code"))
    grouped = looked.groupBy(k, *carry).agg(
        F.collect_list(F.struct(F.col("__pos"), desc.alias("d"))).alias("__parts"))
    text = F.array_join(F.transform(F.array_sort(F.filter("__parts", lambda s: s["d"].isNotNull())),
                                    lambda s: s["d"]), " ")
    out = grouped.withColumn(out_col, F.when(F.col(text_col).isNull(), F.lit(UNKNOWN)).otherwise(text)).drop("__parts")
    return out if key else out.drop(k)
