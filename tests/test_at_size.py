"""What a task writes, sorts or holds stays the same size as the tables grow."""

import os

import numpy as np
from pyspark.sql import functions as F

from edspark.functions.text import WHITESPACE, clean_num
from edspark.operators import tree_attribution as ta
from edspark.sources import fixed_width as fw
from edspark.sources import fixtures as fx
from edspark.streaming import arrivals as st
from edspark.streaming import live_queue as lq

SF = "/root/testdata/sf0.001"


def _files(path):
    return [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith("part-")]


def test_visit_files_are_small_and_hold_every_line(spark, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_A_FILE", 500)
    monkeypatch.setattr(fx, "_LINE_FILES", {})
    lines = fx.raw_lines(spark, SF).cache()
    path = fx.raw_line_files(spark, SF)
    read = spark.read.text(path)
    assert read.exceptAll(lines).isEmpty() and read.count() == lines.count()
    plain = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0]
    assert sum(map(os.path.getsize, _files(path))) < plain / 3
    assert max(spark.read.text(f).count() for f in _files(path)) <= 500


def test_more_lines_are_sorted_into_more_files(spark, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_A_FILE", 500)
    monkeypatch.setattr(fx, "_ORDERED_FILES", {})
    path = fx.ordered_line_files(spark, SF)
    n = fx.raw_lines(spark, SF).count()
    assert len(_files(path)) >= n / 500 > 4
    got = [r.value for r in fw.number_rows(spark.read.text(path)).orderBy("row_id").collect()]
    assert len(got) == n and got == sorted(got)


def test_a_delivery_of_several_files_is_one_micro_batch(spark, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_A_FILE", 10)
    monkeypatch.setattr(fx, "_FEED_FILES", {})
    path, files = fx.feed_files(spark, SF)
    assert files > 1 and {len(_files(f"{path}/{b}")) for b in range(fx.FEED_BATCHES)} == {files}
    log = st.run_available_now(fx.feed_stream(spark, SF), "several-files", keep_batch=True)
    assert log.filter("batch_id != batch").isEmpty()
    want = fx.feed_deliveries(spark, SF)
    assert log.drop("batch_id").exceptAll(want).isEmpty() and log.count() == want.count()


def test_small_deliveries_are_filled_up_with_empty_files(spark, monkeypatch):
    rows = fx.feed_deliveries(spark, SF).filter("event_id = 1 or batch = 3")
    monkeypatch.setattr(fx, "ROWS_A_FILE", 10)
    monkeypatch.setattr(fx, "_FEED_FILES", {})
    monkeypatch.setattr(fx, "feed_deliveries", lambda *_: rows)
    path, files = fx.feed_files(spark, SF)
    assert {len(_files(f"{path}/{b}")) for b in range(fx.FEED_BATCHES)} == {files}
    log = st.run_available_now(fx.feed_stream(spark, SF), "filled-up", keep_batch=True)
    assert log.filter("batch_id != batch").isEmpty() and log.count() == rows.count()


def test_visits_of_one_bucket_keep_their_own_state_and_end(spark, tmp_path):
    """Stays of three visits end at, before and after the watermark."""
    rows = [[(1, 1, 0), (2, 2, 60), (3, 3, 120), (None, 4, 30)], [(4, 5, 86_400 + 60)], [(5, 6, 86_400 + 61)], [(2, 7, 86_400 + 62)]]
    path = str(tmp_path / "feed")
    for i, some in enumerate(rows):
        df = spark.createDataFrame(some, "appointment_id bigint, event_id bigint, s int").select(
            "appointment_id", "event_id", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts"), F.lit(lq.ARRIVAL).alias("kind"),
            F.lit(1).cast("bigint").alias("patient_id"), F.lit(1).alias("triage_level"))
        df.coalesce(1).write.parquet(f"{path}/{i}")
        for f in _files(f"{path}/{i}"):
            os.utime(f, (1_700_000_000 + i,) * 2)
    stream = spark.readStream.schema("appointment_id bigint, event_id bigint, ts timestamp, kind string, patient_id bigint, triage_level int").option(
        "maxFilesPerTrigger", 1).parquet(f"{path}/*")
    log = st.run_available_now(lq.queue_changes(stream, "1 day", "0 seconds", buckets=1), "bucket", mode="update", keep_batch=True).checkpoint()
    left = {(r.appointment_id, r.batch_id) for r in log.filter("status = 'left'").collect()}
    # The watermark of a micro-batch comes from those before it: 86,460 s in the third, when 1, the nameless and 2 leave.
    assert left == {(1, 2), (None, 2), (2, 2)}
    # Visit 2 came again after its stay.
    assert {r.appointment_id for r in lq.latest_state(log).filter("status = 'waiting'").collect()} == {2, 3, 4, 5}


def test_a_condition_is_tested_once_for_all_leaves_below_it(monkeypatch):
    node = lambda left, right, f, n, v: {"left": left, "right": right, "feature": f, "count": n, "value": v, "near": ("le", 0.5), "far": ("gt", 0.5)}
    nodes = {0: node(1, 2, 0, 8, 0), 1: node(3, 4, 1, 4, 0), 2: node(5, 6, 1, 4, 0), **{i: node(-1, -1, None, 2, i) for i in (3, 4, 5, 6)}}
    leaves = [leaf for leaf, _ in ta._leaves(nodes, 1.0)]
    tested, met = [], ta._met
    monkeypatch.setattr(ta, "_met", lambda x, tests: tested.append(tests) or met(x, tests))
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    got = ta.contributions(ta.TreeModel(leaves, 4.5, 2), x)
    assert np.allclose(got.sum(axis=1), np.array([3, 4, 5, 6]) - 4.5)
    assert len(tested) == 4 < sum(len(leaf.features) for leaf in leaves)


def test_numbers_are_parsed_without_a_trim(spark):
    texts = ["", " ", "12", " 12", "12\t", "\x1c7\x1f", "\x0b8\x0c\n", "-9", "+9", "1 2", "1.5", "12a", " 12", "٣", None, "000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean_num("t").alias("n"))
    strip = lambda t: t.strip(WHITESPACE) if t is not None else ""
    assert [r.n for r in df.collect()] == [float(s) if (s := strip(t)).isascii() and s.isdigit() else None for t in texts]
    assert "trim" not in df._jdf.queryExecution().optimizedPlan().toString()
