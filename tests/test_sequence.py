"""The distributed sequence and running-sum helpers equal the plain
window forms, including when one key holds most of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from edspark.operators.sequence import ordered_sequence, running_sum


def _data(spark, n=5000):
    # group "hot" holds ~60 % of the rows; scores repeat so ties need the key
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 5 < 3, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") * 7919 % 101)).alias("score"),
        (F.col("id") % 3 - 1).alias("delta"))


def test_ordered_sequence_matches_row_number(spark):
    df = _data(spark)
    order = [F.desc_nulls_last("score"), F.asc("id")]
    got = ordered_sequence(df, order, ["g"], name="seq", num_partitions=6).select("id", "seq")
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy(*order))).select("id", "seq")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    glob = ordered_sequence(df, order, name="seq", num_partitions=6).select("id", "seq")
    wglob = df.withColumn("seq", F.row_number().over(Window.orderBy(*order))).select("id", "seq")
    assert glob.exceptAll(wglob).count() == 0


def test_running_sum_matches_window(spark):
    df = _data(spark)
    got = running_sum(df, "delta", [F.col("id")], ["g"], name="run", num_partitions=5).select("id", "run")
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("delta").over(w)).select("id", "run")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
