"""Structured Streaming forms of the live dashboard.

Operators take and return streaming DataFrames.  ``run_available_now``
drives one to completion with ``trigger(availableNow=True)`` into a new folder
of the shared checkpoint directory, with the stream's checkpoint next to its
output, and returns the written result as a batch DataFrame.  ``start_refresh``
takes caller-chosen output and checkpoint paths, so a restarted job that
reuses them resumes from its last committed batch.  The feed is kept as
append-only logs; the first event of a key, the queue and the attributions are
read from them, so a stream holds no state that grows with the keys and never
rewrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edspark.functions import rules as R
from edspark.functions.once import once
from edspark.functions.vitals import first_truthy, parse_vitals
from edspark.schemas import EVENT_SCHEMA
from edspark.session import scratch_dir


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """The event feed as a stream over the files of ``folder`` that match
    ``pattern`` (any file or message source works the same way); event time
    is a session-zone ``timestamp``."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def new_patient_events(visits: DataFrame) -> DataFrame:
    """The ``new_patient`` event of each assessed visit: vitals
    struct with key aliases (HR = Pulse or HR, RR = Resp or RR), complaint
    cut to 100 characters, queue token, attribution not yet ready, plus its
    JSON text, in which keys without a value are null."""
    visits = once(visits, __v=parse_vitals("vitals"))
    v = F.col("__v")
    vitals = F.struct(v["SBP"].alias("SBP"), first_truthy(v["Pulse"], v["HR"]).alias("HR"),
                      first_truthy(v["Resp"], v["RR"]).alias("RR"), v["O2Sat"].alias("O2Sat"))
    complaint = F.col("chief_complaint") if "chief_complaint" in visits.columns else F.lit(None).cast("string")
    token = F.col("token") if "token" in visits.columns else F.lit(None).cast("string")
    ev = visits.select(
        F.lit("new_patient").alias("event_type"), "appointment_id", "patient_id", "ts", token.alias("token"), "triage_level",
        R.priority_score("triage_level", "ts").alias("priority_score"), "action",
        vitals.alias("vitals"), F.substring(complaint, 1, 100).alias("chief_complaint"),
        F.lit(False).alias("shap_ready"))
    return once(ev, payload=F.to_json(F.struct(*[c for c in ev.columns if c != "ts"]), {"ignoreNullFields": "false"}))


def first_per_key(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """First event per key by event time (a partial aggregate)."""
    cols = [c for c in events.columns if c != key]
    first = F.min_by(F.struct(*cols), F.struct(F.col(ts), *[F.col(c) for c in cols if c != ts]))
    return events.groupBy(key).agg(first.alias("__f")).select(key, "__f.*")


def queue_positions(queue: DataFrame, score: str = "priority_score", key: str = "appointment_id") -> DataFrame:
    """The queue's order, highest score first, as ``queue_position`` from 1."""
    from edspark.operators.sequence import ordered_sequence

    return ordered_sequence(queue, [F.desc_nulls_last(score), F.asc(key)], name="queue_position")


def live_feed(arrivals: DataFrame, ready: DataFrame) -> DataFrame:
    """The feed from its two logs: the first arrival of an appointment and
    its latest ``shap_ready`` event, whichever of them came first."""
    first = first_per_key(arrivals, "appointment_id")
    last = ready.groupBy(F.col("ready_id").alias("appointment_id")).agg(
        F.max_by(F.struct("ready_ts", "top_features"), "ready_ts").alias("r"))
    return first.join(last, "appointment_id", "left").select(
        "appointment_id", "ts", "triage_level", F.col("r.ready_ts").alias("ready_ts"), F.col("r").isNotNull().alias("shap_ready"),
        F.col("r.top_features").alias("top_features"))


def dedupe_within_watermark(stream: DataFrame, key: str, delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """E2 bounded-state variant: drop repeats of a key seen within the
    watermark delay (state expires with the watermark)."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def severity_alerts(visits: DataFrame) -> DataFrame:
    """Stateless: one alert per arrival with level <= 3."""
    return (visits.withColumn("severity", R.arrival_severity("triage_level"))
            .filter(F.col("severity").isNotNull())
            .select("appointment_id", "ts", "triage_level", "severity"))


def hourly_arrivals(visits: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Arrivals per tumbling clock hour, for update mode.  The watermark
    is the latest event time seen less ``delay``.  A row counts unless its
    hour had ended before the watermark with which the micro-batch before its
    own began (Spark holds late rows against that one)."""
    w = visits.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("count"))
    return w.select(F.col("window.start").alias("hour_start"), F.col("window.end").alias("hour_end"), "count")


def late_rows(deliveries: DataFrame, delay: str, ts: str = "ts", batch: str = "batch") -> DataFrame:
    """The rows of a recorded feed (``batch``: the number of the
    micro-batch that brought a row, from 0) with ``refused``: whether a
    watermarked operator drops them.  A row is held against the watermark
    with which the micro-batch before its own began: the latest event time,
    in milliseconds, of all earlier ones, less ``delay``."""
    per = deliveries.groupBy(F.col(batch).alias("b")).agg(F.max(ts).alias("latest"))
    seen = F.max(F.date_trunc("millisecond", "latest")).over(Window.orderBy("b").rangeBetween(Window.unboundedPreceding, -2))
    per = per.withColumn("held", seen - F.expr(f"INTERVAL {delay}"))  # one row a micro-batch
    out = deliveries.join(F.broadcast(per.select("b", "held")), F.col(batch) == F.col("b"))
    return out.withColumn("refused", F.coalesce(F.col(ts) <= F.col("held"), F.lit(False))).drop("b", "held")


def latest_update(log: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """The value of the last micro-batch that wrote a key."""
    return log.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def attribution_join(arrivals: DataFrame, ready: DataFrame, bound: str = "1 hour", delay: str = "2 hours",
                     how: str = "inner") -> DataFrame:
    """Attach a later ``shap_ready`` event to its arrival (same
    appointment, ready time within ``bound`` after arrival); both sides
    watermarked so join state is bounded.  With ``how='leftOuter'`` arrivals
    without attribution are emitted once the watermark passes them."""
    a = arrivals.withWatermark("ts", delay).alias("a")
    r = ready.withWatermark("ready_ts", delay).alias("r")
    cond = ((F.col("a.appointment_id") == F.col("r.ready_id"))
            & (F.col("r.ready_ts") >= F.col("a.ts"))
            & (F.col("r.ready_ts") <= F.col("a.ts") + F.expr(f"INTERVAL {bound}")))
    return a.join(r, cond, how).select("a.appointment_id", "a.ts", "a.triage_level", "r.ready_ts",
                                       F.col("r.ready_ts").isNotNull().alias("shap_ready"))


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Start queries with their state in RocksDB, outside the heap, unless the
    session names a provider itself; the session is left as it was (a started
    query keeps the settings it began with)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    named = bool(spark.conf.get(key, ""))
    if not named:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if not named:
            spark.conf.unset(key)


def _sink(path: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Every micro-batch has a folder of its own, which a replay overwrites."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def start_refresh(stream: DataFrame, path: str, checkpoint: str, seconds: int = 60, mode: str = "append"):
    """The dashboard refresh as a processing-time trigger (60 s for the
    log, 300 s for attribution aggregates); returns the running query."""
    with _state_store(stream.sparkSession):
        return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
                .foreachBatch(_sink(path)).trigger(processingTime=f"{int(seconds)} seconds").start())


def run_available_now(stream: DataFrame, label: str, mode: str = "append",
                      transform: Callable[[DataFrame], DataFrame] | None = None, keep_batch: bool = False) -> DataFrame:
    """E7 in tests: process everything available, append each micro-batch to
    parquet under the shared checkpoint folder, return what was written as a
    batch DataFrame (with ``batch_id`` if ``keep_batch``)."""
    from edspark.sources.fixed_width import path_exists

    spark = stream.sparkSession
    out = scratch_dir(spark, f"stream-{label}")
    data = f"{out}/data"
    with _state_store(spark):
        q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint")
             .foreachBatch(_sink(data, transform)).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    schema = transform(stream).schema if transform else stream.schema
    if not path_exists(spark, data):
        found = spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0))
    else:
        found = spark.read.option("basePath", data).parquet(data)
    return found if keep_batch else found.drop("batch_id")
