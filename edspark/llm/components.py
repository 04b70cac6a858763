"""Connected components by alternating large-star and small-star steps
(R. Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Edges live in tables only; a step is a grouped minimum (combined before the
shuffle) and an equi-join, whose hot keys Spark can split.  Every round is
written to the shared folder, so lineage stays short and a lost executor
costs a stage, not the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edspark.llm.common import stored


def _digest(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and an order-free checksum."""
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
    return row["n"], row["s"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an undirected edge table (a, b);
    label is the smallest node of its component.  Loops and repeated edges
    are harmless; an edge with a null end is no edge."""
    e = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    seen = _digest(e)
    while seen[0]:
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a != b").distinct(), "large-star")
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        e = stored(small.filter("a != b").distinct(), "small-star")
        now = _digest(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
