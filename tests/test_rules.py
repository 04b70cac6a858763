"""Value-level rule tests; the input cases and expected values are fixed values (FIXTURES.md)."""

import json

import pytest
from pyspark.sql import functions as F

from edspark import schemas as S
from edspark.functions import rules as R
from edspark.functions import text as X
from edspark.functions import vitals as V
from edspark.operators import attribution as att


def _sanitized(spark, payload):
    df = spark.createDataFrame([(json.dumps(payload),)], "v string")
    return df.select(V.sanitize_vitals(V.parse_vitals("v")).alias("s")).select("s.*").first().asDict()


@pytest.mark.parametrize("given,expect", [
    ({"Pulse": 110}, (110, 130, 78, 98, 45)),
    ({"SBP": 180, "DBP": 110, "O2Sat": 97}, (82, 180, 110, 97, 45)),
    ({}, (82, 130, 78, 98, 45)),
    ({"Age": 78}, (82, 130, 78, 98, 78)),
    ({"Pulse": 0, "SBP": 60}, (82, 60, 78, 98, 45)),
    ({"Pulse": 90, "SBP": 300, "DBP": 180}, (90, 300, 180, 98, 45)),
    ({"Pulse": 140, "SBP": 80, "O2Sat": 50}, (140, 80, 78, 50, 45)),
    ({"Pulse": -10, "SBP": -50}, (82, 130, 78, 98, 45)),
    ({"Age": 150, "Pulse": 70, "SBP": 120}, (70, 120, 78, 98, 120)),
    ({"Pulse": 0, "SBP": 0, "DBP": 0, "O2Sat": 0}, (82, 130, 78, 98, 45)),
])
def test_sanitize_cases(spark, given, expect):
    s = _sanitized(spark, given)
    assert (s["Pulse"], s["SBP"], s["DBP"], s["O2Sat"], s["Age"]) == expect


def test_sanitize_keeps_temp_and_bad_json(spark):
    assert _sanitized(spark, {"Pulse": 130, "SBP": 90, "Temp": 108})["Temp"] == 108
    df = spark.createDataFrame([("not json",), (None,), ("[1, 2]",)], "v string")
    rows = df.select(V.sanitize_vitals(V.parse_vitals("v")).alias("s")).select("s.Pulse").collect()
    assert [r[0] for r in rows] == [82.0, 82.0, 82.0]


def test_walkin_arrival_mode(spark):
    df = spark.createDataFrame([("Walk-in",), ("Ambulance",), ("Spaceship",), (None,)], "m string")
    got = [r[0] for r in df.select(V.arrival_mode_code("m")).collect()]
    assert got == [3.0, 1.0, 3.0, 3.0]


def test_first_truthy_vs_first_present(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (2.0, 5.0)], "a double, b double")
    rows = df.select(V.first_truthy("a", "b"), V.first_present("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(5.0, 0.0), (5.0, 5.0), (2.0, 2.0)]


TRAJECTORY = [  # pulse, sbp, o2, expected rounded shock index, trend, alert count
    (80, 120, 98, 0.67, "stable", 0),
    (95, 115, 97, 0.83, "deteriorating", 0),
    (110, 105, 95, 1.05, "deteriorating", 1),
    (125, 95, 93, 1.32, "deteriorating", 2),
    (140, 85, 90, 1.65, "deteriorating", 4),
]


def test_trajectory_shock_trend_alerts(spark):
    df = spark.createDataFrame([(float(p), float(s), float(o)) for p, s, o, *_ in TRAJECTORY],
                               "hr double, sbp double, o2 double")
    si = V.shock_index("hr", "sbp", 2)
    out = df.select(si.alias("si")).withColumn("trend", R.trend_status("si"))
    out = out.join(df.withColumn("si", si), "si").select(
        "si", "trend", F.size(R.alert_messages(F.lit("P"), "si", "hr", "sbp", "o2")).alias("n"))
    got = sorted((r.si, r.trend, r.n) for r in out.collect())
    assert got == sorted((e, t, n) for *_, e, t, n in TRAJECTORY)


def test_alert_text_and_order(spark):
    df = spark.createDataFrame([(140.0, 85.0, 90.0)], "hr double, sbp double, o2 double")
    msgs = df.select(R.alert_messages(F.lit("Ann Lee"), V.shock_index("hr", "sbp", 2), "hr", "sbp", "o2")).first()[0]
    assert msgs[0] == "⚠️ Ann Lee: Critical Shock Index (1.65)"
    assert msgs[1].endswith("Tachycardia (HR 140)")
    assert msgs[2].endswith("Hypotension (SBP 85)")
    assert msgs[3].endswith("Hypoxia (O2 90%)")


def test_shock_rounding_follows_binary_value(spark):
    df = spark.createDataFrame([(82.0, 80.0), (200.0, 80.0), (0.0, 80.0), (80.0, 0.0)], "hr double, sbp double")
    got = [r[0] for r in df.select(V.shock_index("hr", "sbp", 2)).collect()]
    assert got == [1.02, 2.5, None, None]


def test_state_vector(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.4, 0.2, 0.1], 98.0, 120.0, 3), ([0.1, 0.2, 0.4, 0.2, 0.1], 85.0, 80.0, 3)],
                               "p array<double>, o2 double, sbp double, q int")
    risk = R.risk_score("o2", "sbp")
    v = df.select(R.state_vector("p", risk, R.queue_occupancy("q"), F.lit(0.5), F.lit(0.25)).alias("v")).collect()
    for row, r in zip(v, (0.1, 0.9)):
        vec = row.v
        assert len(vec) == 22
        assert vec[5] == pytest.approx(r)
        assert vec[16:20] == pytest.approx([0.6, 0.0, 0.2, 0.2])
        assert all(0 <= x <= 1 for x in vec[20:])


def test_token_text_does_not_cut(spark):
    df = spark.createDataFrame([(1, 7), (5, 12345), (9, 3)], "lvl int, seq int")
    assert [r[0] for r in df.select(R.token_text("lvl", "seq")).collect()] == ["RED-0007", "BLU-12345", "UNK-0003"]


def test_clean_complaint(spark):
    long_text = "Patient reports " + "pain " * 1000
    df = spark.createDataFrame([("",), ("  a ",), (None,), (long_text,), ("chest pain",)], "t string")
    got = [r[0] for r in df.select(X.clean_complaint("t")).collect()]
    assert got[:3] == ["General complaint"] * 3
    assert got[3] == long_text and got[4] == "chest pain"
    assert [len(r[0]) for r in df.select(X.cut_complaint(X.clean_complaint("t"))).collect()][3] == 5000


def test_clean_num_and_codes(spark):
    df = spark.createDataFrame([(" 42 ",), ("-9",), ("  ",), ("4a",)], "s string")
    assert [r[0] for r in df.select(X.clean_num("s")).collect()] == [42.0, None, None, None]
    df = spark.createDataFrame([("xx A123 B45C9 z12 Q99999",), ("none here",)], "s string")
    got = [r[0] for r in df.select(X.join_codes(X.extract_codes("s"))).collect()]
    assert got == ["A123 B45 Q9999", "Unknown"]


def test_attribution_class_mean_probe(spark):
    nested = spark.createDataFrame([([[1.0, -2.0], [3.0, 4.0]],)], "payload array<array<double>>")
    flat = spark.createDataFrame([([0.5, -0.5],)], "payload array<double>")
    a = att.mean_abs_by_position(nested, nesting=2).select("pos", "importance")
    b = att.mean_abs_by_position(flat).select("pos", "importance")
    both = a.unionByName(b).groupBy("pos").agg(F.avg("importance").alias("m")).orderBy("pos")
    assert [r.m for r in both.collect()] == pytest.approx([1.25, 0.75])


def test_record_top_features(spark):
    # |v| ties are broken by the later position first, as the reference's argsort does.
    df = spark.createDataFrame([(1, [0.1, -0.9, 0.5, 0.9])], "row_id int, payload array<double>")
    rows = att.record_top_features(df, 3).orderBy("rank").collect()
    assert [(r.feature, r.impact) for r in rows] == [("Resp", 0.9), ("Temp", -0.9), ("Pulse", 0.5)]


def test_decision_rewards(spark):
    cases = [(0, 1, False, -500), (0, 3, False, -1), (3, 4, False, -20), (3, 2, True, -30), (1, 5, False, 15),
             (1, 3, False, -500), (1, 4, True, -15), (2, 2, False, 15), (2, 1, False, -500), (2, 5, True, -50),
             (4, 1, False, -5)]
    df = spark.createDataFrame([c[:3] for c in cases], "a int, y int, full boolean")
    got = [r[0] for r in df.select(R.decision_reward("a", "y", "full")).collect()]
    assert got == [c[3] for c in cases]


def test_routing(spark):
    df = spark.createDataFrame([(0.9, 1, 0), (0.5, 1, 0), (0.9, 3, 4), (0.7, 5, 4)], "c double, lvl int, pol int")
    got = [tuple(r) for r in df.select(R.route_action("c", "lvl", "pol"), R.route_source("c", "lvl")).collect()]
    assert got == [(3, "Supervised"), (0, "RL_Agent"), (4, "RL_Agent"), (1, "Supervised")]


def test_kiosk_defaults(spark):
    df = spark.createDataFrame([(0.0, None, 0.0, 4.0)], "a double, hr double, t double, p double")
    k = df.select(V.kiosk_vitals("a", "hr", "t", "p").alias("k")).select("k.*").first().asDict()
    assert (k["Age"], k["Pulse"], k["HR"], k["Temp"], k["Resp"], k["SBP"], k["DBP"], k["O2Sat"]) == (
        30.0, 80.0, 80.0, 98.6, 16.0, 120.0, 80.0, 98.0)


def test_wait_text_and_bands(spark):
    df = spark.createDataFrame([(25, 3), (0, 1), (None, 9), (None, 4)], "m int, lvl int")
    got = [r[0] for r in df.select(R.wait_text("m", "lvl")).collect()]
    assert got == ["Estimated wait: 25 minutes", S.WAIT_ESTIMATES[1], S.WAIT_TEXT_DEFAULT, S.WAIT_ESTIMATES[4]]
    df = spark.createDataFrame([(1,), (7,), (12,), (20,)], "n int")
    assert [r[0] for r in df.select(R.bed_band(R.bed_load("n"))).collect()] == ["green", "yellow", "red", "red"]


def test_rounding_equals_python(spark):
    """Every heart rate over every pressure, and exact halves, against
    Python's own round."""
    from edspark.functions.rules import round_half_even

    grid = [(h / s,) for h in range(20, 260) for s in range(40, 260)]
    grid += [(x,) for x in (0.125, 0.375, 2.5, 0.25, 0.05, -0.175, -0.125, 1e15, 0.0, 1e-9, 123456.785, 4.35, 0.145)]
    df = spark.createDataFrame(grid, "x double")
    got = df.select("x", round_half_even("x", 2).alias("a"), round_half_even("x", 1).alias("b")).collect()
    assert all(r.a == round(r.x, 2) and r.b == round(r.x, 1) for r in got)
    assert [round(21 / 120, 2), round(60 / 96, 2)] == [0.17, 0.62]


def test_attribution_payload_forms(spark):
    rows = [("[1, -2.5]", [1.0, -2.5]), ("[[1, 2], [3, 4]]", [2.0, 3.0]), (" [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]", [3.0, 4.0, 5.0, 6.0]),
            ("", None), ("[]", None), ("[[]]", None), ("not json", None), ("{}", None), (None, None), ("[[1, 2], [3]]", None), ("[1, null]", None)]
    df = spark.createDataFrame(list(enumerate(t for t, _ in rows)), "i int, t string")
    got = [r.v for r in df.select("i", att.payload_values("t").alias("v")).orderBy("i").collect()]
    assert got == [v for _, v in rows]


def test_confusion_matrix_without_a_known_action(spark):
    from edspark.operators.decisions import confusion_matrix

    df = spark.createDataFrame([(1, 3), (1, 3), (1, 2), (4, 99)], "ESI int, Final_Action int")
    rows = confusion_matrix(df).collect()
    assert [r.ESI for r in rows] == [1] and sum(list(rows[0])[1:]) == pytest.approx(1)


def test_code_dictionary_with_repeats(spark):
    from edspark.operators.codes import describe_codes

    d = spark.createDataFrame([("A123", "raw"), ("A12.3", "dotted"), ("B10.1", "b"), ("B10.1", "a")], "code string, description string")
    v = spark.createDataFrame([(1, "A123 B101 Z999"), (2, None)], "i int, Chief_complain string")
    got = {r.i: r.Chief_complain_text for r in describe_codes(v, d, key="i").collect()}
    assert got == {1: "raw a Z999", 2: "Unknown"}


def test_large_keys_do_not_overflow(spark):
    from edspark.operators.features import seeded_sample, stratified_folds

    df = spark.createDataFrame([(6_000_000_000 + i, i % 2) for i in range(20)], "k long, y int")
    assert stratified_folds(df, "y", "k", 2).groupBy("y", "fold").count().count() == 4
    assert seeded_sample(df, "k", 5, 42).count() == 5


def test_one_hot_beyond_a_thousand_categories(spark):
    from edspark.operators.features import fit_categories, one_hot

    df = spark.range(3000).select((F.col("id") % 1500).cast("double").alias("c"), "id")
    df = df.unionByName(spark.createDataFrame([(None, 9999)], "c double, id long"))
    out = {r.id: r.c_onehot for r in one_hot(df, "c", keep=["id"]).collect()}
    assert out[1499].size == 1500 and out[1499].indices.tolist() == [1499] and out[9999].indices.tolist() == [0]
    new = spark.createDataFrame([(77777.0, 1)], "c double, id long")
    assert one_hot(new, "c", keep=["id"], categories=fit_categories(df, "c")).first().c_onehot.numNonzeros() == 0


def test_stacked_classifier_with_three_labels(spark):
    from pyspark.ml.feature import VectorAssembler

    from edspark.operators.features import fit_stacked_classifier, predict_stacked

    df = spark.range(90).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("double").alias("label"),
                                (F.col("id") % 3 + F.rand(1) * 0.1).alias("a"), F.rand(2).alias("b"))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).cache()
    base, meta = fit_stacked_classifier(df)
    got = predict_stacked(df, base, meta).select("label", "probs", "level").collect()
    assert all(len(r.probs) == 3 and abs(sum(r.probs) - 1) < 1e-6 for r in got)
    assert sum(r.level - 1 == r.label for r in got) > 80


def test_vector_blobs(spark):
    import struct

    from edspark.sources.files import blob_to_vector, vector_to_blob

    vs = [[1.0, -2.5], None, [], [3.0], None, [float(i) for i in range(300)]]
    df = spark.createDataFrame(list(enumerate(vs)), "i int, v array<float>").coalesce(1)
    got = df.select("i", vector_to_blob("v").alias("b"), "v").select("i", "b", blob_to_vector("b").alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == vs
    assert [r.b for r in got] == [None if v is None else bytearray(struct.pack(f"<{len(v)}f", *v)) for v in vs]


def test_level_labels_have_a_default(spark):
    from edspark.functions.text import level_label

    got = [r[0] for r in spark.createDataFrame([(1,), (5,), (7,), (None,)], "n int").select(level_label("n")).collect()]
    assert got == ["RED (Resuscitation)", "BLUE (Non-Urgent)", "Level 7", None]


def test_canonical_keys_win_and_others_are_copied(spark):
    from edspark.functions import vitals as V

    df = spark.createDataFrame([('{"SBP": 900, "patient_id": 7}',)], "t string")
    raw = F.from_json("t", "map<string,double>")
    m = df.select(V.merge_vitals_map(raw, V.sanitize_vitals(V.parse_vitals("t"))).alias("m")).first().m
    assert (m["SBP"], m["patient_id"], m["HR"], len(m)) == (300.0, 7.0, 82.0, 11)
