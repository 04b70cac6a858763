"""Vitals history per patient.

Per-patient work is either a partial aggregate (``max_by``/``min_by``, which
combine map-side and so tolerate a hot patient) or a top-N per patient, which
Spark limits in every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edspark.functions.vitals import first_truthy, parse_vitals
from edspark.operators.sequence import clamped_sum, running_sum
from edspark.schemas import SPARKLINE_RULES


def vitals_points(readings: DataFrame, key: str = "reading_id", patient: str = "patient_id",
                  ts: str = "ts", vitals: str = "vitals") -> DataFrame:
    """One point per reading with the service's key normalisation (P17):
    HR or Pulse, RR or Resp, O2Sat or O2_Sat, zero falling through."""
    v = parse_vitals(vitals)
    return readings.select(
        F.col(key).alias("reading_id"), F.col(patient).alias("patient_id"), F.col(ts).alias("ts"),
        v.alias("__v"),
    ).select(
        "reading_id", "patient_id", "ts",
        first_truthy(F.col("__v.HR"), F.col("__v.Pulse")).alias("hr"),
        F.col("__v.SBP").alias("sbp"),
        first_truthy(F.col("__v.RR"), F.col("__v.Resp")).alias("rr"),
        first_truthy(F.col("__v.O2Sat"), F.col("__v.O2_Sat")).alias("o2_sat"),
    )


def vitals_history(points: DataFrame, n: int = 20) -> DataFrame:
    """The latest ``n`` points per patient (ties broken by reading id),
    with ``recency`` 1 for the latest; callers that show it sort it."""
    # Spark keeps each task's best n of a patient before the shuffle.
    w = Window.partitionBy("patient_id").orderBy(F.desc("ts"), F.desc("reading_id"))
    return points.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def _long(points: DataFrame) -> DataFrame:
    return (points.unpivot(["patient_id", "reading_id", "ts"], ["hr", "sbp", "o2_sat"], "vital", "value")
            .filter(F.col("value").isNotNull()))


def sparkline_stats(history: DataFrame) -> DataFrame:
    """Per patient and vital over the history points: number of
    points, latest value and its warning flag, min/max, and the chart domain
    padded by 10 % of the span (5 when the span is 0)."""
    long = _long(history)
    order = F.struct("ts", "reading_id")
    agg = long.groupBy("patient_id", "vital").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.max_by("value", order).alias("latest"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"))
    rules = history.sparkSession.createDataFrame(
        [("o2_sat" if v == "o2sat" else v, op, lim) for v, op, lim in SPARKLINE_RULES],
        "vital string, op string, threshold double")
    pad = (F.col("max_value") - F.col("min_value")) * 0.1
    pad = F.when(pad == 0, F.lit(5.0)).otherwise(pad)
    warn = (F.when(F.col("op") == ">", F.col("latest") > F.col("threshold"))
            .when(F.col("op") == "<", F.col("latest") < F.col("threshold")))
    return agg.join(F.broadcast(rules), "vital", "left").select(
        "patient_id", "vital", "n_points", "latest",
        F.coalesce(warn, F.lit(False)).alias("warning"),
        "min_value", "max_value", (F.col("min_value") - pad).alias("domain_lo"),
        (F.col("max_value") + pad).alias("domain_hi"))


def vital_trend(points: DataFrame) -> DataFrame:
    """First and last value per patient and vital (by time), the change,
    its direction and how many step-to-step rises there were.  Steps need a
    patient's points in order: a sort by patient, vital and time, which spills
    rather than gather a patient."""
    order_by = Window.partitionBy("patient_id", "vital").orderBy("ts", "reading_id")
    long = _long(points).withColumn("__rise", (F.col("value") > F.lag("value").over(order_by)).cast("int"))
    order = F.struct("ts", "reading_id")
    return long.groupBy("patient_id", "vital").agg(
        F.min_by("value", order).alias("first_value"),
        F.max_by("value", order).alias("last_value"),
        F.count(F.lit(1)).alias("n_points"),
        F.coalesce(F.sum("__rise"), F.lit(0)).alias("n_rises"),
    ).select(
        "patient_id", "vital", "first_value", "last_value", "n_points", "n_rises",
        (F.col("last_value") - F.col("first_value")).alias("change"),
        F.when(F.col("last_value") > F.col("first_value"), "rising")
         .when(F.col("last_value") < F.col("first_value"), "falling").otherwise("flat").alias("trend"))


def occupancy_running(moves: DataFrame, area: str = "area", delta: str = "delta", ts: str = "ts",
                      key: str = "move_id") -> DataFrame:
    """Running occupancy per area over a log of +1/-1 moves, in time order
    (ties by key).  Distributed: no single task holds one area."""
    return running_sum(moves, delta, [F.col(ts), F.col(key)], [area], name="occupancy")


def occupancy_capped(moves: DataFrame, capacity: Column, area: str = "area", delta: str = "delta", ts: str = "ts",
                     key: str = "move_id") -> DataFrame:
    """W8 under capacity: running occupancy per area that never passes the
    area's ``capacity`` nor falls below zero.  ``admitted`` is false for an
    arrival that found the area full; a later discharge frees a place."""
    out = clamped_sum(moves, delta, 0, capacity, [F.col(ts), F.col(key)], [area], name="occupancy")
    refused = (F.col(delta) > 0) & F.col("occupancy_held")
    return out.withColumn("admitted", F.when(F.col(delta) > 0, ~refused)).drop("occupancy_before", "occupancy_held")
