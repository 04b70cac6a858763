"""Live queue and shift hand-off (J4, J8, P7, P9, P18, W2, W3, W5, T2, X7, X8,
M14-M17, M25, D2, A17).

The reference walks active appointments in a Python loop with lazy loads per
row; here it is two key joins and column rules, and the report's three parts
are three DataFrames (patients, alerts, one summary row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edspark import schemas as S
from edspark.functions import rules as R
from edspark.functions.once import once
from edspark.functions.text import full_name
from edspark.functions.vitals import first_truthy, parse_vitals, shock_index
from edspark.operators.sequence import ordered_sequence
from edspark.schemas import ALERT_CAP, WATCH_NAMES

ACTIVE = ["SCHEDULED", "IN_PROGRESS"]


def queue_order() -> list[Column]:
    """Highest priority first, nulls last, ties by appointment id."""
    return [F.desc_nulls_last("priority_score"), F.asc("appointment_id")]


def active_appointments(appointments: DataFrame) -> DataFrame:
    """Visits still in the department."""
    return appointments.filter(F.col("status").isin(*ACTIVE))


def active_queue(appointments: DataFrame, results: DataFrame, patients: DataFrame,
                 tokens: DataFrame) -> DataFrame:
    """Active visits with token, action, attribution-ready
    flag, patient name (null when the patient is missing) and queue position."""
    a = active_appointments(appointments).select(
        "appointment_id", "patient_id", "triage_level", "priority_score", "status")
    r = results.select("appointment_id", "rl_action", F.col("shap_values").isNotNull().alias("__shap"))
    p = patients.select("patient_id", full_name("first_name", "last_name").alias("patient_name"))
    t = tokens.select("appointment_id", F.col("token_number").alias("token"))
    q = (a.join(r, "appointment_id", "left").join(t, "appointment_id", "left").join(p, "patient_id", "left")
         .select("appointment_id", "token", "triage_level", "priority_score", "status",
                 F.col("rl_action").alias("action"),
                 F.coalesce(F.col("__shap"), F.lit(False)).alias("shap_ready"), "patient_name"))
    return ordered_sequence(q, queue_order(), name="queue_position")


def handoff_patients(appointments: DataFrame, results: DataFrame, patients: DataFrame, tokens: DataFrame,
                     as_of) -> DataFrame:
    """Per active visit with a known patient: level (0/null -> 5), minutes in
    the department, vitals summary, rounded shock index, trend and the
    ordered alert texts."""
    now = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    a = active_appointments(appointments).select(
        "appointment_id", "patient_id", "triage_level", "priority_score", "created_at")
    r = results.select("appointment_id", "rl_action", "vitals")
    p = patients.select("patient_id", full_name("first_name", "last_name").alias("patient_name"))
    t = tokens.select("appointment_id", "token_number")
    base = a.join(p, "patient_id", "inner").join(r, "appointment_id", "left").join(t, "appointment_id", "left")
    base = once(base, __v=parse_vitals("vitals"))
    v = F.col("__v")
    has_vitals = F.col("vitals").isNotNull() & (F.col("vitals") != "")
    hr = F.when(has_vitals, first_truthy(v["HR"], v["Pulse"]))
    rr = F.when(has_vitals, first_truthy(v["RR"], v["Resp"]))
    x = base.select(
        "appointment_id", "patient_id", "patient_name", "priority_score", "created_at",
        F.coalesce(F.col("token_number"), F.lit("N/A")).alias("token"),
        F.coalesce(F.nullif(F.col("triage_level"), F.lit(0)), F.lit(5)).alias("triage_level"),
        F.coalesce(F.nullif(F.col("rl_action"), F.lit("")), F.lit("Assessment pending")).alias("chief_complaint"),
        F.col("rl_action").alias("action"),
        has_vitals.alias("__has"),
        hr.alias("hr"), F.when(has_vitals, v["SBP"]).alias("sbp"),
        F.when(has_vitals, v["O2Sat"]).alias("o2"), rr.alias("rr"))
    return once(x, shock_index=shock_index("hr", "sbp", 2)).select(
        "appointment_id", "patient_id", "patient_name", "token", "triage_level", "chief_complaint",
        R.vitals_summary("hr", "sbp", "o2", "rr", "__has").alias("vitals_summary"),
        "shock_index",
        F.when(F.col("created_at").isNotNull(), R.minutes_between("created_at", now)).alias("time_in_ed"),
        "action", "priority_score", "hr", "sbp", "o2",
    ).withColumn("trend_status", R.trend_status("shock_index")).withColumn(
        "alerts", R.alert_messages("patient_name", "shock_index", "hr", "sbp", "o2"))


def handoff_alerts(hp: DataFrame, cap: int = ALERT_CAP) -> DataFrame:
    """The first ``cap`` alerts in queue order, then rule order."""
    # posexplode_outer + a filter on the generated column: the inferred
    # "non-empty array" predicate of posexplode would otherwise be pushed
    # below the joins and re-derive the alerts there.
    ex = (hp.select("appointment_id", "priority_score", F.posexplode_outer("alerts").alias("rule_pos", "alert"))
          .filter(F.col("alert").isNotNull()))
    return (ex.orderBy(*queue_order(), F.asc("rule_pos")).limit(cap)
            .select("appointment_id", "rule_pos", "alert"))


def watch_list(hp: DataFrame) -> DataFrame:
    """Level <= 2 or deteriorating; :func:`queue_order` shows it in order."""
    return hp.filter((F.col("triage_level") <= 2) | (F.col("trend_status") == "deteriorating"))


def handoff_summary(hp: DataFrame, names: int = WATCH_NAMES) -> DataFrame:
    """One row with counts per band, mean minutes in the
    department (1 decimal), and the summary sentence naming the first
    ``names`` deteriorating patients in queue order."""
    counts = hp.agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count_if(F.col("triage_level") <= 2).alias("critical_count"),
        F.count_if(F.col("triage_level") == 3).alias("urgent_count"),
        F.count_if(F.col("triage_level") > 3).alias("stable_count"),
        R.round_half_even(F.avg("time_in_ed"), 1).alias("avg_wait_minutes"))
    # Top ``names`` by (deteriorating first, queue order), then keep the
    # deteriorating ones: equal to filtering first, but the trend stays a sort
    # key of one top-k instead of a predicate pushed below the joins.
    det = F.col("trend_status") == "deteriorating"
    first = (hp.orderBy(det.desc(), *queue_order()).limit(names).filter(det)
             .agg(F.collect_list(F.struct(
                 F.col("priority_score").isNull().alias("k0"), (-F.col("priority_score")).alias("k1"),
                 F.col("appointment_id").alias("k2"), F.col("patient_name").alias("name"))))).scalar()
    counts = counts.withColumn("__w", F.coalesce(first, F.array()))
    watch = F.array_join(F.transform(F.array_sort("__w"), lambda s: s["name"]), ", ")

    def part(col, text):
        return F.when(F.col(col) > 0, F.format_string(text, F.col(col)))

    parts = F.concat_ws(". ", part("critical_count", S.SUMMARY_CRITICAL),
                        part("urgent_count", S.SUMMARY_URGENT),
                        part("stable_count", S.SUMMARY_STABLE))
    base = F.when(parts == "", F.lit(S.SUMMARY_EMPTY)).otherwise(F.concat(parts, F.lit(".")))
    summary = F.when(F.size("__w") > 0, F.concat(base, F.lit(S.SUMMARY_WATCH), watch, F.lit("."))).otherwise(base)
    return counts.select(
        "total_patients", "critical_count", "urgent_count", "stable_count", "avg_wait_minutes",
        summary.alias("summary"))


def result_detail(results: DataFrame, keys: DataFrame) -> DataFrame:
    """Set-based point lookup: for each requested appointment id,
    its result (``found``; nulls if there is none) with the service's rounded
    shock index, top five features and ISO time."""
    from edspark.operators.attribution import top_features, with_payload_values

    v = F.col("__v")
    hr = first_truthy(v["Pulse"], v["HR"])
    asked = keys.select("appointment_id").distinct()
    joined = asked.join(results.withColumn("found", F.lit(True)), "appointment_id", "left")
    joined = with_payload_values(joined, "shap_values", "__p")
    return once(joined, __v=parse_vitals("vitals")).select(
        "appointment_id", F.coalesce("found", F.lit(False)).alias("found"), "esi_level", "ktas_level", "supervised_confidence",
        "rl_action", "model_version", "shap_values", top_features("__p", 5).alias("top_features"),
        shock_index(hr, v["SBP"], 2).alias("shock_index"), "vitals", R.iso_text("created_at").alias("created_at"))


def patient_appointments(appointments: DataFrame, patients: DataFrame) -> DataFrame:
    """P18 set-based: the appointments of every known patient with that
    patient's appointment count.  Rows stay rows (no per-patient array), and
    the count is a partial aggregate, so a patient with very many visits is
    never gathered into one task."""
    a = appointments.join(patients.select("patient_id"), "patient_id", "left_semi")
    # Counted over its own column-pruned scan; the join's hot keys are split by AQE.
    n = appointments.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_appointments"))
    return a.join(n, "patient_id", "inner").select(
        "patient_id", "appointment_id", "status", "triage_level", "created_at", "n_appointments")


def orphan_visits(visits: DataFrame, patients: DataFrame, key: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) split of visits by patient existence."""
    p = patients.select(key)
    return visits.join(p, key, "left_semi"), visits.join(p, key, "left_anti")


def flag_patient_exists(visits: DataFrame, patients: DataFrame, key: str = "patient_id",
                        name: str = "patient_exists") -> DataFrame:
    """J8 in one pass: every visit with a flag telling whether its patient
    exists (a left join against the distinct patient keys, so no visit is
    duplicated)."""
    keys = patients.select(key).distinct().withColumn("__exists", F.lit(True))
    return visits.join(keys, key, "left").withColumn(name, F.coalesce(F.col("__exists"), F.lit(False))).drop("__exists")
