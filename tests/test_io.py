"""Sinks and sources: append, metrics report, keyed merge, blob codec."""

from pyspark.sql import functions as F

from edspark.session import scratch_dir
from edspark.sources import files as io


def test_append_and_metrics(spark):
    path = scratch_dir(spark, "append")
    df = spark.range(10).withColumn("day", (F.col("id") % 2).cast("int"))
    io.append_rows(df, path, ["day"])
    io.append_rows(df, path, ["day"])
    assert spark.read.parquet(path).count() == 20
    mpath = scratch_dir(spark, "metrics")
    io.write_metrics(spark.createDataFrame([(1.5, 2.0)], "critical_miss_rate double, accuracy double"), mpath)
    assert spark.read.json(mpath).first().accuracy == 2.0


def test_keyed_merge(spark):
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    upd = spark.createDataFrame([(2, "B"), (3, None), (9, "Z")], "k int, v string")
    got = sorted(tuple(r) for r in io.keyed_merge(base, upd, "k", ["v"]).collect())
    assert got == [(1, "a"), (2, "B"), (3, "c")]


def test_blob_codec_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.25, 0.0],), (None,)], "v array<float>")
    out = df.select(io.blob_to_vector(io.vector_to_blob("v")).alias("w"), F.length(io.vector_to_blob("v")).alias("n"))
    rows = out.collect()
    assert rows[0].w == [1.5, -2.25, 0.0] and rows[0].n == 12 and rows[1].w is None


def test_processing_time_trigger(spark):
    from edspark.streaming.arrivals import read_events, start_refresh

    out = scratch_dir(spark, "refresh")
    from edspark.sources.fixtures import triage_stream

    q = start_refresh(triage_stream(read_events(spark, "/root/testdata/sf0.001", "events.parquet")),
                      f"{out}/data", f"{out}/ckpt", seconds=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(f"{out}/data").count() == spark.read.parquet(
        "/root/testdata/sf0.001/events.parquet").count()


def test_encoder_plugin(spark):
    from edspark.operators.features import encode_texts

    def factory():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]

    df = spark.createDataFrame([(1, "chest pain"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: r.embedding for r in encode_texts(df, "t", factory).collect()}
    assert got[1] == [10.0, 1.0] and got[2] == [17.0, 1.0] and got[3] == [17.0, 1.0]


def test_first_n_rows_alignment(spark):
    from edspark.operators.decisions import fairness_input

    orig = spark.createDataFrame([(i, 30.0, float(i % 5 + 1)) for i in range(10)], "row_id long, Age double, ESI double")
    res = spark.createDataFrame([(i, 3, 1, False) for i in range(7)],
                                "row_id long, ESI int, Final_Action int, Is_Critical_Miss boolean")
    assert fairness_input(orig, res).count() == 7
    assert fairness_input(orig, res, n=4).count() == 4


def test_day_partitions_are_pruned(spark):
    from edspark.sources import fixtures as fx

    path = scratch_dir(spark, "results-by-day")
    io.write_by_day(fx.triage_results(spark, "/root/testdata/sf0.001"), path, "created_at", mode="overwrite")
    df = spark.read.parquet(path).filter((F.col("day") >= "2024-01-29") & (F.col("created_at") >= "2024-01-29 06:00:00"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-29" in plan
    assert df.count() == fx.triage_results(spark, "/root/testdata/sf0.001").filter(
        F.col("created_at") >= "2024-01-29 06:00:00").count()


def test_visits_csv_round_trip_with_fixed_schema(spark):
    from edspark.schemas import LAYOUT_A, VISIT_SCHEMA
    from edspark.sources import fixed_width as fw
    from edspark.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    visits = fw.union_years({2022: fw.read_fixed(spark, fx.raw_line_files(spark, sf), LAYOUT_A)})
    path = scratch_dir(spark, "visits-csv")
    io.write_csv(visits, path)
    back = io.read_csv(spark, path, VISIT_SCHEMA)
    assert back.schema == VISIT_SCHEMA
    assert back.exceptAll(visits.select(*VISIT_SCHEMA.fieldNames())).count() == 0
    assert back.count() == visits.count()


def test_inference_fallback(spark):
    from edspark import schemas as S
    from edspark.operators.decisions import hybrid_decisions

    df = spark.createDataFrame([(1, None, 4, 2)], "row_id int, probs array<double>, acuity int, policy_action int")
    d = hybrid_decisions(df).first()
    assert (d.Sup_Pred, d.Sup_Conf) == (S.FALLBACK_LEVEL, S.FALLBACK_CONFIDENCE)
    assert d.Source == "RL_Agent" and d.Final_Action == 2


def test_metrics_text_report(spark):
    from edspark.operators.decisions import hybrid_decisions, hybrid_metrics
    from edspark.sources import fixtures as fx

    m = hybrid_metrics(hybrid_decisions(fx.decisions_input(spark, "/root/testdata/sf0.001")))
    path = scratch_dir(spark, "report")
    io.write_report(io.metrics_report_lines(m), path)
    text = [r.value for r in spark.read.text(path).collect()]
    row = m.first()
    assert text[0] == "Hybrid System Evaluation Report" and set(text[1]) == {"="}
    assert text[2] == f"RL Interventions: {row.rl_intervention_pct:.1f}%"
    assert text[5] == f"Overall Accuracy: {row.accuracy:.2f}%"


def test_orphan_split_and_flag_agree(spark):
    from edspark.operators.handoff import flag_patient_exists, orphan_visits

    visits = spark.createDataFrame([(1, 10), (2, 11), (3, 99), (4, None)], "reading_id int, patient_id int")
    patients = spark.createDataFrame([(10,), (11,), (11,)], "patient_id int")
    valid, rejected = orphan_visits(visits, patients)
    flagged = flag_patient_exists(visits, patients)
    assert sorted(r.reading_id for r in valid.collect()) == [1, 2]
    assert sorted(r.reading_id for r in rejected.collect()) == [3, 4]
    assert sorted((r.reading_id, r.patient_exists) for r in flagged.collect()) == [
        (1, True), (2, True), (3, False), (4, False)]
