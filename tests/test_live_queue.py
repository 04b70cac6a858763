"""The queue as keyed state, late rows and repeats, over several micro-batches."""

import itertools
import os
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from edspark.streaming import arrivals as st
from edspark.streaming import live_queue as lq

COLUMNS = ["appointment_id", "event_id", "ts_text", "kind", "patient_id", "triage_level"]


def feed(spark, folder, batches):
    """A stream that brings one list of rows a micro-batch."""
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "appointment_id bigint, event_id bigint, ts_text string, kind string, patient_id bigint, "
                                         "triage_level int").withColumn("ts", F.col("ts_text").cast("timestamp")).drop("ts_text")
        df.coalesce(1).write.parquet(f"{folder}/{i}")
        for name in os.listdir(f"{folder}/{i}"):
            os.utime(f"{folder}/{i}/{name}", (time.time() - 1000 + i,) * 2)
    return spark.readStream.schema("appointment_id bigint, event_id bigint, kind string, patient_id bigint, triage_level int, ts timestamp").option(
        "maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_order_of_events_does_not_matter():
    rows = [(30, 5, lq.ARRIVAL, 1, 2), (20, 6, lq.ARRIVAL, 1, 3), (20, 4, lq.ARRIVAL, 1, 4), (10, 7, lq.READY, 1, 1),
            (10, 8, lq.READY, 1, 1), (50, 9, lq.DISCHARGE, 1, 1)]
    seen = set()
    for order in itertools.permutations(rows):
        state = dict.fromkeys(lq.FIELDS)
        for r in (*order, order[0]):  # the first event comes again
            state = lq._merge(state, [Row(ts_us=r[0], event_id=r[1], kind=r[2], patient_id=r[3], triage_level=r[4])])
        seen.add(tuple(state.values()))
    assert seen == {(20, 4, 1, 4, 10, 8, 50, None)}


def test_queue_over_micro_batches(spark, tmp_path):
    """Late and early attributions, discharge, a stay that ends, a row that
    is too late, and a visit that comes back after its stay."""
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [
        [(1, 1, day(1), "arrival", 7, 2), (2, 2, day(1, 1), "arrival", 8, 3), (3, 3, day(1, 2), "ready", 9, 1), (5, 9, day(1, 3), "arrival", 4, 5)],
        [(3, 4, day(1, 1), "arrival", 9, 1), (2, 5, day(2), "ready", 8, 3), (1, 1, day(1), "arrival", 7, 2)],
        [(2, 6, day(3), "discharge", 8, 3), (4, 7, day(9), "arrival", 6, 4)],
        [(6, 8, day(9, 1), "arrival", 5, 5), (7, 10, day(1, 5), "arrival", 5, 5)],  # held against 1 January 22:00: the last is refused
        [(8, 11, day(20), "arrival", 4, 1)],
        [(9, 12, day(20, 1), "arrival", 4, 1)],
        [(5, 13, day(20, 2), "arrival", 4, 1)],
    ]
    stream = feed(spark, str(tmp_path / "feed"), batches)
    log = st.run_available_now(lq.queue_changes(stream, "10 days", "2 hours"), "live", mode="update", keep_batch=True)
    log = log.checkpoint()
    # After four micro-batches nobody's stay is over.
    early = {r.appointment_id: (r.queue_position, r.shap_ready) for r in lq.waiting_queue(log.filter("batch_id < 4")).collect()}
    assert early == {3: (1, True), 1: (2, False), 4: (3, False), 5: (5, False), 6: (4, False)}
    states = {r.appointment_id: r.status for r in lq.latest_state(log).collect()}
    # Visit 8 moved the watermark past all earlier stays; then visit 5 came anew.
    assert {k for k, v in states.items() if v == lq.WAITING} == {5, 8, 9}
    assert {k for k, v in states.items() if v == lq.LEFT} == {1, 2, 3, 4, 6}  # 7 was refused
    # Repeats change nothing: one change a visit and event that told something new.
    assert log.filter("appointment_id = 1 and batch_id < 4").count() == 1


def test_state_equals_the_batch_result(spark, tmp_path):
    events = [(i // 4, i, f"2024-02-{1 + i * 7 % 20:02d} {i % 24:02d}:30:00", ["arrival", "ready", "arrival", "discharge"][i % 4 if i % 8 > 3 else i % 3],
               i % 5, 1 + i % 5) for i in range(96)]
    batches = [[e for e in events if e[1] % 3 == b] + [e for e in events if e[1] % 3 == b - 1 and e[1] % 5 == 0] for b in range(3)]
    stream = feed(spark, str(tmp_path / "feed"), batches)
    log = st.run_available_now(lq.queue_changes(stream, "8 days", "30 days"), "same", mode="update", keep_batch=True)
    rows = spark.createDataFrame(events, "appointment_id bigint, event_id bigint, ts_text string, kind string, patient_id bigint, triage_level int")
    rows = rows.withColumn("ts", F.col("ts_text").cast("timestamp"))
    watermark = rows.agg(F.max("ts") - F.expr("INTERVAL 30 days")).scalar()
    want = lq.queue_of(rows, watermark, "8 days")
    cols = want.columns
    got = sorted(map(tuple, lq.waiting_queue(log).select(*cols).collect()), key=str)
    assert got and got == sorted(map(tuple, want.collect()), key=str)


def test_late_rows_follow_the_watermark(spark):
    rows = spark.createDataFrame([(0, "2024-01-01 12:00:00.0009"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 10:00:00"),
                                  (2, "2024-01-01 10:00:00.001"), (2, "2024-01-01 09:00:00"), (3, "2024-01-01 09:00:00")],
                                 "batch int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = [r.refused for r in st.late_rows(rows, "2 hours").orderBy("batch", "t").collect()]
    assert got == [False, False, True, True, False, True]


def test_state_store_setting_is_left_as_it_was(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, "")
    with st._state_store(spark):
        assert spark.conf.get(key).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(key, "") == before
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with st._state_store(spark):
            assert spark.conf.get(key).endswith("HDFSBackedStateStoreProvider")
    finally:
        spark.conf.unset(key)


def test_a_feed_has_repeats_and_disorder(spark):
    from edspark.sources import fixtures as fx

    rows = fx.feed_deliveries(spark, "/root/testdata/sf0.001")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"), F.countDistinct("appointment_id").alias("visits"),
                 F.countDistinct("batch").alias("batches")).first()
    assert n.n > n.events > 2 * n.visits and n.batches == fx.FEED_BATCHES
    assert 0 < st.late_rows(rows, "2 hours").filter("refused").count() < n.n / 4


