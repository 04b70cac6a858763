"""The bracketed exact median equals the sorted exact median, with ties,
even/odd counts, a dominant group and single-row groups."""

from pyspark.sql import functions as F

from edspark.operators.features import median_by, sorted_median_by


def test_median_by_matches_sorted(spark):
    df = spark.range(20001).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string")))
        .alias("g"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") * 7919 % 1000) / 10.0).alias("v"))
    df = df.unionByName(spark.createDataFrame([("single", 4.5), ("pair", 1.0), ("pair", 2.0), ("ties", 3.0),
                                               ("ties", 3.0), ("ties", 3.0)], "g string, v double"))
    want = {r.g: r.median_v for r in sorted_median_by(df.filter(F.col("v").isNotNull()), "g", "v").collect()}

    for acc in (50, 100_000):
        got = {r.g: r.median_v for r in median_by(df, "g", "v", accuracy=acc).collect()}
        assert got == want, acc
    assert got == want
    assert got["single"] == 4.5 and got["pair"] == 1.5 and got["ties"] == 3.0
