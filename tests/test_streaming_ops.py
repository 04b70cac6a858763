"""Decision helpers on column patterns and the bounded-state stream variants."""

import pytest
from pyspark.sql import functions as F

from edspark.operators.decisions import hybrid_decisions, policy_observation, prob_array
from edspark.sources.fixtures import triage_stream
from edspark.streaming import arrivals as st

SF = "/root/testdata/sf0.001"


def test_prob_columns_and_defaults(spark):
    df = spark.createDataFrame([(1, 0.1, 0.7, 0.2, 2)], "row_id int, prob_class_0 double, prob_class_1 double, "
                                                         "prob_class_2 double, policy_action int")
    d = hybrid_decisions(prob_array(df)).first()
    assert (d.ESI, d.Sup_Pred, d.Sup_Conf, d.Final_Action, d.Source) == (3, 2, 0.7, 2, "Supervised")
    none = prob_array(spark.createDataFrame([(1,)], "row_id int")).first().probs
    assert none == [0.2] * 5
    obs = policy_observation(prob_array(df)).first().observation
    assert len(obs) == 22 and obs[5] == 0.5
    assert obs[16:22] == pytest.approx([0.1, 0.2, 10 / 30, 0.25, 0.5, 0.5], rel=1e-6)


def test_watermark_dedupe_and_left_outer_join(spark):
    ev = st.read_events(spark, SF, "events.parquet")
    dd = st.run_available_now(st.dedupe_within_watermark(ev.select("user_id", "ts"), "user_id", "1 hour"), "dd")
    total = spark.read.parquet(f"{SF}/events.parquet")
    assert 0 < dd.count() <= total.count()
    arrivals = triage_stream(st.read_events(spark, SF, "events.parquet"))
    ready = (st.read_events(spark, SF, "events.parquet").filter(F.col("event_type") == "view")
             .select(F.col("event_id").alias("ready_id"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ready_ts")))
    out = st.run_available_now(st.attribution_join(arrivals, ready, how="leftOuter"), "lo")
    n_view = total.filter("event_type = 'view'").count()
    assert out.filter("shap_ready").count() == n_view
    assert out.count() <= total.count()


def _event_files(spark, tmp_path, batches):
    """One file per batch, read one file a micro-batch in order of time."""
    import os
    import time

    folder = str(tmp_path / "events")
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "appointment_id long, ts_text string").select(
            "appointment_id", F.col("ts_text").cast("timestamp").alias("ts"))
        df.coalesce(1).write.parquet(f"{folder}/b{i}")
        (part,) = [f for f in os.listdir(f"{folder}/b{i}") if f.endswith(".parquet")]
        os.rename(f"{folder}/b{i}/{part}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema("appointment_id long, ts timestamp").option("maxFilesPerTrigger", 1).option(
        "pathGlobFilter", "*.parquet").parquet(folder)


def test_hourly_counts_with_late_rows(spark, tmp_path):
    """A late row counts while its hour is after the watermark, and not once
    the hour ended before it; the last hour is present."""
    feed = _event_files(spark, tmp_path, [
        [(1, "2024-01-01 10:10:00"), (2, "2024-01-01 12:00:00")],
        [(3, "2024-01-01 10:50:00"), (4, "2024-01-01 18:30:00")],  # watermark 10:00: in time
        [(5, "2024-01-01 10:55:00"), (6, "2024-01-01 18:40:00")],  # the batch before began with 10:00: in time
        [(7, "2024-01-01 10:58:00"), (8, "2024-01-01 18:50:00")],  # the batch before began with 16:30: too late
    ])
    log = st.run_available_now(st.hourly_arrivals(feed), "late", mode="update", keep_batch=True)
    got = {str(r.hour_start): r["count"] for r in st.latest_update(log, ["hour_start"]).collect()}
    assert got == {"2024-01-01 10:00:00": 3, "2024-01-01 12:00:00": 1, "2024-01-01 18:00:00": 3}


def test_first_event_wins_and_queue_order(spark):
    ev = spark.createDataFrame([(1, "2024-01-01 10:00:00", 5), (1, "2024-01-01 09:00:00", 7), (2, "2024-01-01 08:00:00", 9),
                                (3, "2024-01-01 08:00:00", None)], "appointment_id long, ts string, priority_score long")
    q = {r.appointment_id: (r.priority_score, r.queue_position) for r in st.queue_positions(st.first_per_key(ev, "appointment_id")).collect()}
    assert q == {2: (9, 1), 1: (7, 2), 3: (None, 3)}


def test_feed_attaches_early_and_late_attributions(spark):
    a = spark.createDataFrame([(1, "t1", 2), (2, "t1", 3), (3, "t1", 4)], "appointment_id long, ts string, triage_level int")
    r = spark.createDataFrame([(1, "t0", [("SBP", 1.0)]), (2, "t9", []), (2, "t5", [("HR", 2.0)]), (9, "t1", [])],
                              "ready_id long, ready_ts string, top_features array<struct<feature:string,impact:double>>")
    got = {x.appointment_id: (x.shap_ready, x.ready_ts) for x in st.live_feed(a, r).collect()}
    assert got == {1: (True, "t0"), 2: (True, "t9"), 3: (False, None)}


def test_payload_keeps_keys_without_a_value(spark):
    import json

    v = spark.createDataFrame([(1, 2, "2024-01-01 00:00:00", 3, None, "not json")],
                              "appointment_id long, patient_id long, ts string, triage_level int, action string, vitals string")
    p = json.loads(st.new_patient_events(v.withColumn("ts", F.col("ts").cast("timestamp"))).first().payload)
    assert list(p) == ["event_type", "appointment_id", "patient_id", "token", "triage_level", "priority_score", "action", "vitals",
                       "chief_complaint", "shap_ready"]
    assert p["token"] is None and p["vitals"] == {"SBP": None, "HR": None, "RR": None, "O2Sat": None}
