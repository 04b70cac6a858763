"""Named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame built
from the test tables through the library's operators.  Column names match the
DuckDB oracle in :mod:`edspark.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edspark.operators import dashboard as dash
from edspark.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = fx.AS_OF
DAY = "2024-01-30"  # "today" of the KPI cards: the last day of the fixture month
WINDOW_HOURS = 168  # the dashboard slider maximum
MONTH_HOURS = 720  # the whole fixture month, used by the charts


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _log(spark: SparkSession, d: str, hours: int = MONTH_HOURS, order: bool = False) -> DataFrame:
    return dash.triage_log(fx.triage_results(spark, d), fx.appointments(spark, d), fx.priority_tokens(spark, d),
                           AS_OF, hours=hours, order=order)


LOG_COLUMNS = ["id", "appointment_id", "triage_level", "confidence", "rl_action", "timestamp", "arrival_time",
               "status", "token_number", "priority_score", "estimated_wait_minutes", "heart_rate", "sbp", "o2sat",
               "shock_index", "hour", "date"]


# ---- dashboard ---------------------------------------------------------------

@query("triage_log_window")
def q_triage_log_window(spark, d):
    return _log(spark, d, WINDOW_HOURS, order=True).select(*LOG_COLUMNS)


@query("arrivals_by_hour")
def q_arrivals_by_hour(spark, d):
    return dash.arrivals_by_hour(_log(spark, d))


@query("level_distribution")
def q_level_distribution(spark, d):
    return dash.level_distribution(_log(spark, d))


@query("action_distribution")
def q_action_distribution(spark, d):
    return dash.action_distribution(_log(spark, d))


@query("wait_by_level")
def q_wait_by_level(spark, d):
    return dash.wait_by_level(_log(spark, d))


@query("daily_drift")
def q_daily_drift(spark, d):
    return dash.daily_drift(_log(spark, d))


@query("queue_stats")
def q_queue_stats(spark, d):
    return dash.queue_stats(fx.appointments(spark, d), DAY)


@query("kpi_cards")
def q_kpi_cards(spark, d):
    return dash.kpi_cards(_log(spark, d), fx.appointments(spark, d), DAY)


@query("confidence_histogram")
def q_confidence_histogram(spark, d):
    return dash.confidence_histogram(_log(spark, d))


@query("queue_wait")
def q_queue_wait(spark, d):
    return dash.queue_wait(fx.appointments(spark, d), AS_OF)


@query("recent_results")
def q_recent_results(spark, d):
    return dash.recent_results(_log(spark, d))


@query("shock_bands")
def q_shock_bands(spark, d):
    return dash.shock_bands(_log(spark, d))


@query("scatter_range")
def q_scatter_range(spark, d):
    return dash.scatter_range(_log(spark, d))


# ---- vitals history ------------------------------------------------------------

from edspark.operators import history as hist  # noqa: E402


def _points(spark, d):
    return hist.vitals_points(fx.vitals_readings(spark, d))


@query("vitals_history")
def q_vitals_history(spark, d):
    return hist.vitals_history(_points(spark, d), 20).orderBy("patient_id", "ts", "reading_id")


@query("vital_latest_warning")
def q_vital_latest_warning(spark, d):
    s = hist.sparkline_stats(hist.vitals_history(_points(spark, d), 20))
    return s.select("patient_id", "vital", "n_points", "latest", "warning")


@query("vital_ranges")
def q_vital_ranges(spark, d):
    s = hist.sparkline_stats(hist.vitals_history(_points(spark, d), 20))
    return s.select("patient_id", "vital", "min_value", "max_value", "domain_lo", "domain_hi")


@query("vital_trend")
def q_vital_trend(spark, d):
    return hist.vital_trend(_points(spark, d))


@query("occupancy_running")
def q_occupancy_running(spark, d):
    return hist.occupancy_running(fx.bed_moves(spark, d)).select("move_id", "ts", "area", "delta", "occupancy")


# ---- queue and hand-off --------------------------------------------------------

from edspark.operators import handoff as ho  # noqa: E402


def _handoff(spark, d):
    return ho.handoff_patients(fx.appointments(spark, d), fx.triage_results(spark, d), fx.patients(spark, d),
                               fx.priority_tokens(spark, d), AS_OF)


HANDOFF_COLUMNS = ["appointment_id", "patient_id", "patient_name", "token", "triage_level", "chief_complaint",
                   "vitals_summary", "shock_index", "time_in_ed", "action", "trend_status", "alerts"]


@query("active_queue")
def q_active_queue(spark, d):
    return ho.active_queue(fx.appointments(spark, d), fx.triage_results(spark, d), fx.patients(spark, d),
                           fx.priority_tokens(spark, d))


@query("handoff_patients")
def q_handoff_patients(spark, d):
    return _handoff(spark, d).orderBy(*ho.queue_order()).select(*HANDOFF_COLUMNS, "priority_score")


@query("handoff_alerts")
def q_handoff_alerts(spark, d):
    return ho.handoff_alerts(_handoff(spark, d))


@query("handoff_summary")
def q_handoff_summary(spark, d):
    return ho.handoff_summary(_handoff(spark, d))


@query("watch_list")
def q_watch_list(spark, d):
    w = ho.watch_list(_handoff(spark, d)).orderBy(*ho.queue_order())
    return w.select("appointment_id", "patient_name", "triage_level", "trend_status", "priority_score")


@query("result_detail")
def q_result_detail(spark, d):
    keys = fx.appointments(spark, d).filter(F.col("status") == "IN_PROGRESS")
    out = ho.result_detail(fx.triage_results(spark, d), keys)
    top = F.get("top_features", F.lit(0))
    return out.withColumns({"n_top": F.size("top_features"), "top_feature": top["feature"], "top_impact": top["impact"]}).drop("top_features")


@query("patient_appointments")
def q_patient_appointments(spark, d):
    return ho.patient_appointments(fx.appointments(spark, d), fx.patients(spark, d))


@query("orphan_visits")
def q_orphan_visits(spark, d):
    visits = fx.vitals_readings(spark, d).select("reading_id", "patient_id")
    return ho.flag_patient_exists(visits, fx.patients(spark, d))


# ---- decisions and audit -------------------------------------------------------

from edspark.operators import decisions as dec  # noqa: E402


def _decisions(spark, d):
    return dec.hybrid_decisions(fx.decisions_input(spark, d))


@query("hybrid_decision")
def q_hybrid_decision(spark, d):
    return _decisions(spark, d)


@query("decision_flags")
def q_decision_flags(spark, d):
    return dec.decision_flags(_decisions(spark, d))


@query("hybrid_metrics")
def q_hybrid_metrics(spark, d):
    return dec.hybrid_metrics(_decisions(spark, d))


@query("confusion_matrix")
def q_confusion_matrix(spark, d):
    return dec.confusion_matrix(_decisions(spark, d))


@query("action_by_source")
def q_action_by_source(spark, d):
    return dec.action_by_source(_decisions(spark, d))


@query("safety_split")
def q_safety_split(spark, d):
    return dec.safety_split(_decisions(spark, d))


@query("action_labels")
def q_action_labels(spark, d):
    from edspark import schemas as S
    from edspark.functions.rules import code_map

    named = dec.action_names(_decisions(spark, d))
    return named.select("row_id", "Final_Action", "Action_Name",
                        F.coalesce(code_map(S.BATCH_ACTIONS)[F.col("Final_Action")], F.lit("Unknown")).alias("env_name"),
                        dec.service_action_label(F.col("Final_Action")).alias("service_label"))


@query("fairness_input")
def q_fairness_input(spark, d):
    f = dec.fairness_input(fx.audit_visits(spark, d), _decisions(spark, d))
    return f.select("row_id", "Age", "ESI", "Age_Group", "Gender_Label", "Race_Label", "Final_Action",
                    "Is_Critical_Miss")


@query("fairness_rates")
def q_fairness_rates(spark, d):
    return dec.fairness_rates(dec.fairness_input(fx.audit_visits(spark, d), _decisions(spark, d)))


@query("decision_cost")
def q_decision_cost(spark, d):
    return dec.cost_by_policy(dec.decision_cost(_decisions(spark, d)))


@query("policy_table")
def q_policy_table(spark, d):
    return dec.policy_table(dec.decision_cost(_decisions(spark, d)))


@query("decision_cost_flow")
def q_decision_cost_flow(spark, d):
    """M22 with discharges: areas fill, refuse, and become free again."""
    costed = dec.decision_cost(_decisions(spark, d), discharges=fx.discharges(spark, d))
    return costed.groupBy("Source", "Final_Action").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if("area_full").alias("refused"), F.sum("reward").alias("total_reward"))


@query("policy_table_flow")
def q_policy_table_flow(spark, d):
    """L7 over decisions whose areas are freed by discharges."""
    return dec.policy_table(dec.decision_cost(_decisions(spark, d), discharges=fx.discharges(spark, d)))


@query("policy_fitted_q")
def q_policy_fitted_q(spark, d):
    """L7 by fitted Q iteration over episodes of a hundred decisions."""
    costed = dec.decision_cost(_decisions(spark, d), discharges=fx.discharges(spark, d))
    q = dec.fitted_q(dec.logged_transitions(costed, ["Sup_Pred", "area_full"]))
    return q.select("state.Sup_Pred", "state.area_full", F.col("action").alias("Final_Action"), F.col("n").alias("support"),
                    F.round("value", 5).alias("value"), "best")


# ---- ingest --------------------------------------------------------------------

from edspark.operators.codes import describe_codes  # noqa: E402
from edspark.schemas import LAYOUT_A, LAYOUT_B  # noqa: E402
from edspark.sources import fixed_width as fw  # noqa: E402


def _lines(spark, d, status=None):
    return fx.raw_line_files(spark, d, status)


@query("fixed_width_parse")
def q_fixed_width_parse(spark, d):
    return fw.read_fixed(spark, _lines(spark, d), LAYOUT_A)


@query("fixed_width_parse_b")
def q_fixed_width_parse_b(spark, d):
    return fw.read_fixed(spark, _lines(spark, d), LAYOUT_B)


@query("valid_esi")
def q_valid_esi(spark, d):
    return fw.valid_esi(fw.read_fixed(spark, _lines(spark, d), LAYOUT_A))


@query("union_years")
def q_union_years(spark, d):
    """Yearly files tagged with their year; the 2020 path does not
    exist and is skipped."""
    from edspark.session import scratch_dir

    paths = {2020: scratch_dir(spark, "missing-year"), 2021: _lines(spark, d, "F"), 2022: _lines(spark, d, "O")}
    return fw.valid_esi(fw.read_years(spark, paths))


@query("year_counts")
def q_year_counts(spark, d):
    return q_union_years(spark, d).groupBy("Year").agg(F.count(F.lit(1)).alias("count"))


@query("diagnosis_codes")
def q_diagnosis_codes(spark, d):
    from edspark.functions.text import extract_codes, join_codes
    from edspark.schemas import CODES_FROM

    rest = F.substring("value", CODES_FROM + 1, 1 << 30)
    return spark.read.text(_lines(spark, d)).select(extract_codes(rest).alias("codes"),
                                         join_codes(extract_codes(rest)).alias("Chief_complain"))


@query("code_descriptions")
def q_code_descriptions(spark, d):
    visits = fw.read_fixed(spark, _lines(spark, d), LAYOUT_A).select("Chief_complain")
    return describe_codes(visits, fx.code_dictionary(spark, d))


# ---- attribution ---------------------------------------------------------------

from edspark.operators import attribution as att  # noqa: E402


@query("attribution_mean_abs")
def q_attribution_mean_abs(spark, d):
    return att.attribution_mean_abs(fx.attributions(spark, d), 100)


@query("attribution_mean_abs_nested")
def q_attribution_mean_abs_nested(spark, d):
    return att.attribution_mean_abs(fx.nested_attributions(spark, d), 100, nesting=2)


@query("attribution_mean_abs_json")
def q_attribution_mean_abs_json(spark, d):
    """R4/A14 from the JSON column: each row in its own format; empty and bad
    payloads among the latest 100 are skipped."""
    return att.attribution_mean_abs(fx.attribution_texts(spark, d), 100, parse=att.payload_values)


@query("attribution_by_class")
def q_attribution_by_class(spark, d):
    return att.attribution_by_class(fx.nested_attributions(spark, d), 2)


@query("attribution_top")
def q_attribution_top(spark, d):
    return att.attribution_top(att.attribution_mean_abs(fx.attributions(spark, d), 100))


@query("record_top_features")
def q_record_top_features(spark, d):
    return att.record_top_features(fx.attributions(spark, d), 3)


@query("attribution_merge")
def q_attribution_merge(spark, d):
    from edspark.sources.files import keyed_merge

    updates = fx.attributions(spark, d).select(F.col("row_id").alias("appointment_id"),
                                               F.to_json("payload").alias("shap_values"))
    merged = keyed_merge(fx.triage_results(spark, d), updates, "appointment_id", ["shap_values"])
    return merged.select("appointment_id", F.col("shap_values").isNotNull().alias("shap_ready"),
                         F.json_array_length("shap_values").alias("n_values"))


# ---- features and models -------------------------------------------------------

from edspark.operators import features as feat  # noqa: E402


def _visits(spark, d):
    """Parsed valid visits, written once with a reliable checkpoint: the
    fitted-statistics queries read them several times."""
    from edspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return fw.valid_esi(fw.read_fixed(spark, _lines(spark, d), LAYOUT_A)).checkpoint(eager=True)


@query("impute_scale_stats")
def q_impute_scale_stats(spark, d):
    return feat.impute_scale_stats(_visits(spark, d))


@query("impute_scale")
def q_impute_scale(spark, d):
    v = _visits(spark, d)
    return feat.impute_scale(v, feat.impute_scale_stats(v), keep=["ESI"])


@query("one_hot_arrival")
def q_one_hot_arrival(spark, d):
    from pyspark.ml.functions import vector_to_array

    out = feat.one_hot(_visits(spark, d), "ArrivalMode", keep=["ESI"])
    return out.withColumn("ArrivalMode_onehot", vector_to_array("ArrivalMode_onehot"))


@query("label_encode")
def q_label_encode(spark, d):
    return feat.label_encode(_visits(spark, d).select("ESI"), "ESI")


@query("stratified_folds")
def q_stratified_folds(spark, d):
    return feat.stratified_folds(fx.decisions_input(spark, d).select("row_id", "acuity"), "acuity", "row_id", 3)


@query("complaint_features")
def q_complaint_features(spark, d):
    """The tokens of each text, and what all term counts add up to."""
    out = feat.complaint_features(fx.complaints(spark, d), "complaint", "doc_id")
    return out.select("doc_id", "n_tokens", feat.vector_total(out, "term_counts").alias("corpus_terms"))


@query("text_vectors")
def q_text_vectors(spark, d):
    """L5 in dense form, assembled as a model takes it (R5): 768 numbers a
    text, of which the projection makes none longer than the text's unit
    vector, and all of which hold the energy of the directions kept."""
    from pyspark.ml.functions import vector_to_array
    from edspark.operators import text_vectors as tv
    from edspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    texts = fx.complaints(spark, d)
    model = tv.fit(texts, "complaint")
    made = feat.feature_matrix(tv.transform(texts, "complaint", model), [], ["text_vector"])
    z = vector_to_array("features")
    made = made.select("doc_id", F.size(z).alias("n_numbers"), F.aggregate(z, F.lit(0.0), lambda a, v: a + v * v).alias("square"))
    made = made.checkpoint(eager=True)
    kept = made.agg(F.sum("square")).scalar()
    return made.select("doc_id", "n_numbers", (F.col("square") <= 1 + 1e-9).alias("no_longer"), (F.col("square") > 0).alias("has_terms"),
                       (F.abs(kept - F.lit(float(model.energy.sum()))) <= 1e-6 * kept).alias("energy_kept"))


def _training_frame(spark, d, code_features=1 << 18, exact_codes=False):
    """Scaled numeric + one-hot arrival + code text (sparse), keyed by a row id
    fixed once with a reliable checkpoint (the id is reused across jobs).
    Codes are hashed to ``code_features`` slots, or with ``exact_codes`` have
    a slot each, by a fitted table of at most so many codes."""
    from pyspark.ml.feature import CountVectorizer, HashingTF
    from edspark.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    v = fw.valid_esi(fw.read_fixed(spark, _lines(spark, d), LAYOUT_A, row_id="row_id")).checkpoint(eager=True)
    scaled = feat.impute_scale(v, feat.impute_scale_stats(v), keep=["row_id", "ESI", "ArrivalMode", "Chief_complain"])
    oh = feat.one_hot(scaled, "ArrivalMode", keep=[c for c in scaled.columns if c != "ArrivalMode"])
    oh = oh.withColumn("__codes", F.split("Chief_complain", " "))
    if exact_codes:
        tf = CountVectorizer(inputCol="__codes", outputCol="codes_tf", vocabSize=code_features, minDF=1).fit(oh).transform(oh)
    else:
        tf = HashingTF(inputCol="__codes", outputCol="codes_tf", numFeatures=code_features).transform(oh)
    labelled = feat.label_encode(tf, "ESI").withColumn("label", F.col("label").cast("double"))
    return feat.feature_matrix(labelled, feat.NUMERIC, ["ArrivalMode_onehot", "codes_tf"])


@query("feature_matrix")
def q_feature_matrix(spark, d):
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.functions import vector_to_array

    m = _training_frame(spark, d)
    # The dense head of the vector by value; the codes' part by its total.
    head = len(feat.NUMERIC) + 4
    first = VectorSlicer(inputCol="features", outputCol="head", indices=list(range(head))).transform(m)
    return first.withColumn("h", vector_to_array("head")).select(
        "label", *[F.col("h")[i].alias(c) for i, c in enumerate(feat.NUMERIC)], F.slice("h", len(feat.NUMERIC) + 1, 4).alias("arrival"),
        F.size("__codes").alias("n_codes"), feat.vector_total(m, "codes_tf").alias("corpus_codes"))


@query("acuity_classifier")
def q_acuity_classifier(spark, d):
    """Fit the stacked model, save and reload every stage from the
    shared folder, then score the whole frame."""
    from pyspark.ml.classification import LogisticRegressionModel

    from edspark.session import scratch_dir

    # A slot for each code that occurs, none shared.
    train = _training_frame(spark, d, exact_codes=True)
    base, meta = feat.fit_stacked_classifier(train)
    root = scratch_dir(spark, "acuity-model")
    loaded = []
    for i, m in enumerate(base):
        m.save(spark, f"{root}/base{i}")
        loaded.append(type(m).load(spark, f"{root}/base{i}"))
    meta.write().overwrite().save(f"{root}/meta")
    out = feat.predict_stacked(train, loaded, LogisticRegressionModel.load(f"{root}/meta"))
    total = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    return out.select("ESI", F.size("probs").alias("n_classes"), (F.abs(total - 1) < 1e-6).alias("sums_to_one"),
                      (F.get("probs", F.col("level") - 1) == F.col("confidence")).alias("level_has_largest"),
                      F.exists(F.slice("probs", 1, F.greatest(F.col("level") - 1, F.lit(0))),
                               lambda p: p >= F.col("confidence")).alias("earlier_as_large"))


@query("linear_attribution")
def q_linear_attribution(spark, d):
    from pyspark.ml.regression import LinearRegression

    v = _visits(spark, d)
    scaled = feat.impute_scale(v, feat.impute_scale_stats(v), keep=["ESI"])
    x = feat.feature_matrix(scaled, feat.NUMERIC, [])
    model = LinearRegression(featuresCol="features", labelCol="ESI", solver="normal").fit(x)
    means = scaled.agg(*[F.avg(c).alias(c) for c in feat.NUMERIC]).first().asDict()  # eight fitted numbers
    out = att.linear_attribution(model.transform(x), feat.NUMERIC, list(model.coefficients), means)
    expected = float(model.intercept) + sum(float(c) * means[f] for c, f in zip(model.coefficients, feat.NUMERIC))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v)
    return out.select("ESI", F.size("contributions").alias("n_contributions"),
                      (F.abs(total - (F.col("prediction") - F.lit(expected))) < 1e-6).alias("adds_up"))


@query("tree_attribution")
def q_tree_attribution(spark, d):
    """L8 over a fitted forest: contributions that add up to the prediction
    less the mean prediction, none for a feature that no tree splits on, and
    the features in order of mean weight."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    from edspark.operators import tree_attribution as ta

    v = _visits(spark, d)
    scaled = feat.impute_scale(v, feat.impute_scale_stats(v), keep=["ESI"])
    x = feat.feature_matrix(scaled.withColumn("constant", F.lit(1.0)), [*feat.NUMERIC, "constant"], [])
    model = RandomForestRegressor(featuresCol="features", labelCol="ESI", numTrees=8, maxDepth=5, seed=7).fit(x)
    out = ta.tree_attribution(model.transform(x), model)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    gap = F.abs(total - (F.col("prediction") - F.col("contributions_base")))
    return out.select("ESI", F.size("contributions").alias("n_contributions"), (gap < 1e-6).alias("adds_up"),
                      (F.get("contributions", F.lit(len(feat.NUMERIC))) == 0).alias("constant_has_none"),
                      (F.size(vector_to_array("features")) == F.lit(len(ta.slot_names(x)))).alias("all_named"))


# ---- rules over whole tables ---------------------------------------------------

from edspark import schemas as S  # noqa: E402
from edspark.functions import rules as R  # noqa: E402
from edspark.functions.once import once  # noqa: E402
from edspark.functions import text as X  # noqa: E402
from edspark.functions import vitals as V  # noqa: E402
from edspark.operators.sequence import ordered_sequence  # noqa: E402


@query("priority_tokens")
def q_priority_tokens(spark, d):
    """Deterministic tokens: sequence per colour by issue time (levels
    without a colour share one, and its numbers)."""
    t = fx.priority_tokens(spark, d).select("appointment_id", F.when(F.col("appointment_id") % 10 != 0, F.col("triage_level")).otherwise(
        F.col("triage_level") + 4).alias("triage_level"), "issued_at").withColumn("colour", R.token_colour("triage_level"))
    seq = ordered_sequence(t, [F.col("issued_at"), F.col("appointment_id")], ["colour"], name="sequence")
    return seq.select("appointment_id", "triage_level", "sequence",
                      R.token_text("triage_level", "sequence").alias("token"))


@query("priority_score")
def q_priority_score(spark, d):
    a = fx.appointments(spark, d)
    return a.select("appointment_id", R.epoch_minutes("created_at").alias("epoch_minutes"),
                    R.priority_score("triage_level", "created_at").alias("priority_score"))


@query("vitals_json")
def q_vitals_json(spark, d):
    r = fx.vitals_readings(spark, d).withColumn("__v", V.parse_vitals("vitals"))
    return r.select("reading_id",
                    V.first_present(F.col("__v.Pulse"), F.col("__v.HR")).alias("heart_rate"),
                    V.first_truthy(F.col("__v.HR"), F.col("__v.Pulse")).alias("hr_service"),
                    F.col("__v.SBP").alias("sbp"),
                    V.first_present(F.col("__v.O2Sat"), F.col("__v.O2_Sat")).alias("o2sat"))


@query("shock_index")
def q_shock_index(spark, d):
    r = fx.vitals_readings(spark, d).withColumn("__v", V.parse_vitals("vitals"))
    hr = V.first_present(F.col("__v.Pulse"), F.col("__v.HR"))
    return r.select("reading_id", V.shock_index(hr, F.col("__v.SBP")).alias("shock_index"),
                    V.shock_index(hr, F.col("__v.SBP"), 2).alias("shock_index_rounded"))


@query("sanitize_vitals")
def q_sanitize_vitals(spark, d):
    r = (fx.vitals_readings(spark, d).withColumn("__v", V.parse_vitals("vitals"))
         .select("reading_id", V.sanitize_vitals("__v").alias("s")))
    return r.select("reading_id", *[F.col(f"s.{k}").alias(k) for k in S.MEDIAN_VITALS])


@query("canonical_vitals")
def q_canonical_vitals(spark, d):
    """U2 in map form: the sanitised canonical keys win, other keys of the raw
    record are copied through."""
    r = once(fx.vitals_readings(spark, d), __v=V.parse_vitals("vitals"), __m=F.from_json("vitals", "map<string,double>"))
    raw = F.map_concat(F.coalesce("__m", F.create_map().cast("map<string,double>")),
                       F.create_map(F.lit("patient_id"), F.col("patient_id").cast("double"), F.lit("note"), F.lit(1.0)))
    m = once(r.select("reading_id", raw.alias("raw"), V.sanitize_vitals("__v").alias("s")), m=V.merge_vitals_map("raw", "s"))
    return m.select("reading_id", F.size("m").alias("n_keys"), F.col("m")["patient_id"].alias("patient_id"), F.col("m")["note"].alias("note"),
                    F.col("m")["SBP"].alias("SBP"), F.col("m")["HR"].alias("HR"), F.col("m")["PainScale"].alias("PainScale"))


@query("level_labels")
def q_level_labels(spark, d):
    """Chart labels of the levels; one without a label shows its number."""
    t = fx.triage_results(spark, d).select((F.col("esi_level") + F.col("id") % 3).alias("level"))
    return t.groupBy("level").agg(F.count(F.lit(1)).alias("count")).select("level", X.level_label("level").alias("label"), "count")


@query("structured_features")
def q_structured_features(spark, d):
    r = fx.vitals_readings(spark, d).withColumn("__v", V.parse_vitals("vitals"))
    f = V.structured_features(V.sanitize_vitals("__v"), F.col("arrival_mode"))
    return r.select("reading_id", f.alias("f")).select("reading_id", *[F.col(f"f.{c}").alias(c)
                                                                      for c in S.STRUCTURED_COLUMNS])


@query("dedupe_arrivals")
def q_dedupe_arrivals(spark, d):
    """The first reading per appointment (by time, then patient) as a
    partial aggregate."""
    r = fx.vitals_readings(spark, d)
    first = F.min_by(F.struct("patient_id", "ts"), F.struct("ts", "patient_id"))
    return r.groupBy(F.col("reading_id").alias("appointment_id")).agg(first.alias("f")).select("appointment_id", "f.patient_id", "f.ts")


@query("clean_complaint")
def q_clean_complaint(spark, d):
    c = fx.complaints(spark, d)
    full = X.clean_complaint("complaint")
    return c.select("doc_id", full.alias("complaint_clean"), X.cut_complaint(full).alias("complaint_cut"),
                    F.substring("complaint", 1, 100).alias("event_text"))


@query("walkin_dob")
def q_walkin_dob(spark, d):
    return fx.audit_visits(spark, d).select("row_id", R.walkin_dob("Age", fx.as_of()).alias("date_of_birth"))


@query("ed_state_vector")
def q_ed_state_vector(spark, d):
    """The service state of every reading: visit probabilities
    (the fallback ones where the model gave none), vitals risk, queue
    occupancy from the SCHEDULED queue, time of reading."""
    probs = fx.decisions_input(spark, d).select(F.col("row_id").alias("reading_id"), "probs")
    r = fx.vitals_readings(spark, d).join(probs, "reading_id", "left").withColumn("__v", V.parse_vitals("vitals"))
    queue_length = dash.queue_wait(fx.appointments(spark, d), AS_OF).select("queue_length").scalar()
    probs = F.coalesce("probs", F.array(*[F.lit(p) for p in S.FALLBACK_PROBS]))
    risk = R.risk_score(F.col("__v.O2Sat"), F.col("__v.SBP"))
    ta, tb = R.time_features("ts")
    return r.select("reading_id", risk.alias("risk"),
                    R.state_vector(probs, risk, R.queue_occupancy(queue_length), ta, tb).alias("state"))


@query("occupancy_capped")
def q_occupancy_capped(spark, d):
    """W8 under capacity: admissions refused when an area is full, freed by
    discharges."""
    from edspark.operators import history as hist

    return hist.occupancy_capped(fx.bed_moves(spark, d), fx.capacity_of()).select("move_id", "area", "delta", "occupancy", "admitted")


@query("numbered_lines")
def q_numbered_lines(spark, d):
    """Visits with their number in file order, at any split size."""
    v = fw.read_fixed(spark, fx.ordered_line_files(spark, d), LAYOUT_A, row_id="row_id")
    return v.select("row_id", "Age", "Pulse", "ESI", "Chief_complain")


@query("fairness_by_line")
def q_fairness_by_line(spark, d):
    """The fairness audit over visits and results that are aligned
    by file order: lines of the visit files, and decisions written as CSV."""
    from edspark.session import scratch_dir

    visits = fw.read_fixed(spark, fx.ordered_line_files(spark, d), LAYOUT_A, row_id="row_id")
    path = scratch_dir(spark, "audit-csv")
    results = _decisions(spark, d)
    results = results.repartitionByRange(fx.files_for(results, 3), "row_id").sortWithinPartitions("row_id")
    results.select("ESI", "Final_Action", "Is_Critical_Miss").write.option("header", True).csv(path)
    read = spark.read.option("header", True).schema("ESI int, Final_Action int, Is_Critical_Miss boolean").csv(path)
    return dec.fairness_rates(dec.fairness_input(visits, fw.number_rows(read, "row_id")))


@query("occupancy_ratio")
def q_occupancy_ratio(spark, d):
    """Latest running occupancy per area over its capacity."""
    occ = hist.occupancy_running(fx.bed_moves(spark, d))
    last = occ.agg(*[F.coalesce(F.max_by(F.when(F.col("area") == a, F.col("occupancy")),
                                         F.when(F.col("area") == a, F.struct("ts", "move_id"))), F.lit(0)).alias(a)
                     for a in ("waiting", "critical", "bed", "fast_track")])
    ratio = R.occupancy_ratios("waiting", "critical", "bed", "fast_track")
    return last.select("waiting", "critical", "bed", "fast_track", ratio.alias("r")).select(
        "waiting", "critical", "bed", "fast_track", *[F.col("r")[i].alias(f"{a}_ratio") for i, a in enumerate(
            ("waiting", "critical", "bed", "fast_track"))])


@query("visit_status")
def q_visit_status(spark, d):
    return fx.triage_results(spark, d).select("appointment_id", "rl_action", R.visit_status("rl_action").alias("status"))


@query("bed_load")
def q_bed_load(spark, d):
    """Per day, the bed-load fraction of that day's active queue."""
    a = ho.active_appointments(fx.appointments(spark, d))
    n = a.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n_patients"))
    return n.select("day", "n_patients", R.bed_load("n_patients").alias("load"),
                    R.bed_band(R.bed_load("n_patients")).alias("band"))


@query("arrival_severity")
def q_arrival_severity(spark, d):
    t = fx.triage_results(spark, d)
    return t.select("appointment_id", "esi_level", R.arrival_severity("esi_level").alias("severity"))


@query("wait_band")
def q_wait_band(spark, d):
    t = fx.priority_tokens(spark, d)
    return t.select("appointment_id", R.wait_text("estimated_wait_minutes", "triage_level").alias("wait_text"))


@query("input_range_check")
def q_input_range_check(spark, d):
    """Kiosk range rules over visit inputs; the first failing field is
    the reason, missing inputs are not checked."""
    v = fw.read_fixed(spark, _lines(spark, d), LAYOUT_A)
    fields = {"age": "Age", "heart_rate": "Pulse", "temperature": "Temp", "pain": "PainScale"}
    fails = [F.when(F.col(fields[f]).isNotNull() & ~F.col(fields[f]).between(lo, hi), F.lit(f))
             for f, lo, hi in S.INPUT_RANGES]
    reason = F.coalesce(*fails)
    return v.select("Age", "Pulse", "Temp", "PainScale", reason.isNull().alias("valid"), reason.alias("reason"))


@query("kiosk_defaults")
def q_kiosk_defaults(spark, d):
    v = fw.read_fixed(spark, _lines(spark, d), LAYOUT_A)
    k = V.kiosk_vitals("Age", "Pulse", "Temp", "PainScale")
    return v.select(k.alias("k")).select("k.*")


@query("latency_report")
def q_latency_report(spark, d):
    """Per endpoint: n, passed, failed, min, max, mean, exact median,
    sample std (0 when n = 1) and requests per second over the span."""
    log = fx.request_log(spark, d)
    med = feat.exact_medians_by(log, "endpoint", "latency_ms")
    agg = log.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.avg("latency_ms").alias("mean_ms"),
        F.coalesce(F.stddev_samp("latency_ms"), F.lit(0.0)).alias("std_ms"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("__span"))
    return agg.join(med, "endpoint", "left").select(
        "endpoint", "n", "passed", "failed", "min_ms", "max_ms", "mean_ms", "median_ms", "std_ms",
        F.try_divide(F.col("n").cast("double"), F.col("__span")).alias("requests_per_s"))


@query("seeded_sample")
def q_seeded_sample(spark, d):
    """Exactly n rows by a seeded hash order, then drop null targets."""
    a = fx.appointments(spark, d)
    return (feat.seeded_sample(a, "appointment_id", n=1000, seed=42).filter(F.col("triage_level").isNotNull())
            .select("appointment_id", "triage_level"))


@query("arrival_events")
def q_arrival_events(spark, d):
    from edspark.streaming.arrivals import new_patient_events

    t = fx.triage_results(spark, d).select("appointment_id", F.col("esi_level").alias("triage_level"),
                                           F.col("rl_action").alias("action"), "vitals", F.col("created_at").alias("ts"))
    a = fx.appointments(spark, d).select("appointment_id", "patient_id")
    c = fx.complaints(spark, d).select(F.col("doc_id").alias("appointment_id"), F.col("complaint").alias("chief_complaint"))
    k = fx.priority_tokens(spark, d).select("appointment_id", F.col("token_number").alias("token"))
    visits = t.join(a, "appointment_id", "inner").join(c, "appointment_id", "left").join(k, "appointment_id", "left")
    ev = new_patient_events(visits)
    keys = F.array_join(F.json_object_keys("payload"), ",")
    return ev.select("appointment_id", "patient_id", "triage_level", "priority_score", "action",
                     F.col("vitals.SBP").alias("SBP"), F.col("vitals.HR").alias("HR"), F.col("vitals.RR").alias("RR"),
                     F.col("vitals.O2Sat").alias("O2Sat"), "chief_complaint", "shap_ready", "token", keys.alias("payload_keys"),
                     F.array_join(F.json_object_keys(F.get_json_object("payload", "$.vitals")), ",").alias("vitals_keys"),
                     F.get_json_object("payload", "$.token").alias("payload_token"),
                     F.get_json_object("payload", "$.vitals.HR").cast("double").alias("payload_hr"))


# ---- streaming -----------------------------------------------------------------

from edspark.streaming import arrivals as st  # noqa: E402


def _events_stream(spark, d):
    return st.read_events(spark, d, "events.parquet")


@query("stream_arrivals")
def q_stream_arrivals(spark, d):
    ev = st.new_patient_events(fx.triage_stream(_events_stream(spark, d)))
    out = st.run_available_now(ev.select("appointment_id", "triage_level", "priority_score", "payload"), "arrivals")
    return out.select("appointment_id", "triage_level", "priority_score",
                      F.get_json_object("payload", "$.event_type").alias("event_type"),
                      F.get_json_object("payload", "$.token").alias("token"),
                      F.array_join(F.json_object_keys("payload"), ",").alias("payload_keys"))


@query("stream_dedupe")
def q_stream_dedupe(spark, d):
    """Every event is appended to the feed's log; the first event of an
    appointment wins."""
    s = fx.triage_stream(_events_stream(spark, d)).select("appointment_id", "patient_id", "ts")
    return st.first_per_key(st.run_available_now(s, "dedupe"), "appointment_id")


@query("stream_queue")
def q_stream_queue(spark, d):
    """The first event of every appointment with its place in the queue."""
    v = fx.triage_stream(_events_stream(spark, d)).select(
        "appointment_id", "patient_id", "ts", "triage_level", R.priority_score("triage_level", "ts").alias("priority_score"))
    return st.queue_positions(st.first_per_key(st.run_available_now(v, "queue"), "appointment_id"))


@query("stream_alerts")
def q_stream_alerts(spark, d):
    return st.run_available_now(st.severity_alerts(fx.triage_stream(_events_stream(spark, d))), "alerts")


@query("stream_hourly")
def q_stream_hourly(spark, d):
    """E6 in update mode: each micro-batch appends the hours it changed, the
    latest count of an hour holds."""
    log = st.run_available_now(st.hourly_arrivals(fx.triage_stream(_events_stream(spark, d))), "hourly", mode="update",
                               keep_batch=True)
    return st.latest_update(log, ["hour_start", "hour_end"])


def _ready_stream(spark, d):
    """``shap_ready`` events of the feed, with the record's top features."""
    ready = _events_stream(spark, d).filter(F.col("event_type") == "view").select(
        F.col("event_id").alias("ready_id"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ready_ts"))
    emb = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("ready_id"), att.top_features(F.col("embedding").cast("array<double>"), 3).alias("top_features"))
    return ready.join(emb, "ready_id", "left")


@query("stream_attribution_join")
def q_stream_attribution_join(spark, d):
    """E3 as a bounded stream-stream join: ready within the hour."""
    arrivals = fx.triage_stream(_events_stream(spark, d))
    ready = _ready_stream(spark, d).select("ready_id", "ready_ts")
    return st.run_available_now(st.attribution_join(arrivals, ready), "attribution")


@query("stream_attribution_left")
def q_stream_attribution_left(spark, d):
    """E3 complete: arrivals and ready events are appended to their logs, and
    every arrival shows its attribution, however early or late it came."""
    arrivals = st.run_available_now(
        fx.triage_stream(_events_stream(spark, d)).select("appointment_id", "ts", "triage_level"), "feed-arrivals")
    ready = st.run_available_now(_ready_stream(spark, d), "feed-ready")
    out = st.live_feed(arrivals, ready)
    top = F.get("top_features", F.lit(0))
    return out.withColumns({"top_feature": top["feature"], "top_impact": top["impact"]}).drop("top_features")


from edspark.streaming import live_queue as lq  # noqa: E402

FEED_DELAY = "2 hours"


@query("feed_first_events")
def q_feed_first_events(spark, d):
    """E2/U3 over a feed with repeats, out of order, in several micro-batches:
    the first event of a visit by event time."""
    log = st.run_available_now(fx.feed_stream(spark, d).drop("batch"), "feed-first")
    return st.first_per_key(log, "appointment_id")


@query("feed_dedupe")
def q_feed_dedupe(spark, d):
    """E2 with bounded state: repeats within the watermark are dropped, and
    rows older than it refused."""
    s = st.dedupe_within_watermark(fx.feed_stream(spark, d), "event_id", FEED_DELAY)
    return st.run_available_now(s.select("event_id", "appointment_id", "ts", "kind"), "feed-dedupe")


@query("feed_hourly")
def q_feed_hourly(spark, d):
    """E6 with late rows: counts by hour of all deliveries that are in time."""
    log = st.run_available_now(st.hourly_arrivals(fx.feed_stream(spark, d), FEED_DELAY), "feed-hourly", mode="update", keep_batch=True)
    return st.latest_update(log, ["hour_start", "hour_end"])


@query("feed_late_rows")
def q_feed_late_rows(spark, d):
    """The recorded feed with the rows that a watermark refuses."""
    rows = st.late_rows(fx.feed_deliveries(spark, d), FEED_DELAY)
    return rows.groupBy("batch", "kind").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("refused").alias("n_refused"),
                                             F.min(F.when(~F.col("refused"), F.col("ts"))).alias("first_taken"))


@query("feed_live_queue")
def q_feed_live_queue(spark, d):
    """E3/E4 as keyed state: arrivals, late or early attributions, discharges
    and a timer for the longest stay, kept up to date over all micro-batches."""
    log = st.run_available_now(lq.queue_changes(fx.feed_stream(spark, d), "20 days", FEED_DELAY), "feed-queue", mode="update",
                               keep_batch=True)
    return lq.waiting_queue(log)


# ---- file sources and sinks ----------------------------------------------------

from edspark.sources import files as io  # noqa: E402


@query("csv_roundtrip")
def q_csv_roundtrip(spark, d):
    """Decisions written as header CSV to the shared folder and read
    back with the fixed schema (no inference pass)."""
    from edspark.session import scratch_dir

    path = scratch_dir(spark, "decisions-csv")
    io.write_csv(_decisions(spark, d), path)
    return io.read_csv(spark, path, S.DECISION_SCHEMA)


@query("keyed_update")
def q_keyed_update(spark, d):
    """Results stored by key, then two updates that read and write only
    the buckets of their keys; of two updates of a key the later one holds."""
    from edspark.session import scratch_dir
    from edspark.sources import keyed

    path = scratch_dir(spark, "results-by-key")
    r = fx.triage_results(spark, d).select("appointment_id", "esi_level", "rl_action", "created_at")
    keyed.create(r, path, "appointment_id", buckets=32)
    late = r.filter(F.col("appointment_id") % 2500 == 17)
    first = late.withColumn("rl_action", F.lit("Assign to Bed"))
    second = late.withColumns({"esi_level": F.lit(1), "created_at": F.col("created_at") + F.expr("INTERVAL 1 HOUR")})
    keyed.update(spark, path, first.unionByName(second), order="created_at")
    keyed.update(spark, path, r.filter("appointment_id = 3").withColumn("appointment_id", F.lit(-1).cast("bigint")))
    return keyed.read(spark, path)


@query("vector_roundtrip")
def q_vector_roundtrip(spark, d):
    """Vectors encoded to float32 blobs (Arrow-batched), stored in
    parquet keyed by id, read back and decoded."""
    from edspark.session import scratch_dir

    path = scratch_dir(spark, "vectors")
    emb = fx.table(spark, d, "embeddings").select("vec_id", io.vector_to_blob("embedding").alias("blob"))
    io.write_vectors(emb, path)
    back = io.read_vectors(spark, path)
    return back.select("vec_id", io.blob_to_vector("blob").alias("embedding"), F.length("blob").alias("n_bytes"))


@query("triage_log_sql")
def q_triage_log_sql(spark, d):
    """S5 in SQL form: the bindings as temporary views and the parameterised
    statement with named arguments."""
    fx.triage_results(spark, d).createOrReplaceTempView("triage_results")
    fx.appointments(spark, d).createOrReplaceTempView("appointments")
    fx.priority_tokens(spark, d).createOrReplaceTempView("priority_tokens")
    return dash.sql_triage_log(spark, WINDOW_HOURS, AS_OF).drop("shap_values", "vitals")


@query("parse_report")
def q_parse_report(spark, d):
    return fw.parse_report(fw.read_fixed(spark, _lines(spark, d), LAYOUT_A))


@query("hourly_series")
def q_hourly_series(spark, d):
    return dash.hourly_series(_log(spark, d))


@query("hybrid_report")
def q_hybrid_report(spark, d):
    """The evaluation report lines over all decisions."""
    return io.metrics_report_lines(dec.hybrid_metrics(_decisions(spark, d)))
