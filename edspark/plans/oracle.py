"""DuckDB oracle SQL, one entry per key of :data:`edspark.plans.catalog.QUERIES`
that is expressible in SQL.  Written independently of the Spark code from the
rule definitions, over the views of :mod:`edspark.plans.oracle_views`."""

from __future__ import annotations

from edspark.schemas import SERVICE_FEATURES as _SERVICE
from edspark.plans.oracle_views import COLOUR, K, with_views

ORACLE: dict[str, str] = {}
SERVICE_FIRST = _SERVICE[0]

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = "DATE '2024-01-30'"


def jnum(col: str, key: str) -> str:
    """Tolerant JSON number: null for invalid JSON, non-objects and non-numbers."""
    return f"(CASE WHEN json_valid({col}) THEN TRY_CAST(json_extract_string({col}, '$.{key}') AS DOUBLE) END)"


def log_sql(hours: int) -> str:
    """The triage log: recent results first, then what belongs to them."""
    return f"""
    WITH recent AS (FROM triage_results WHERE created_at >= {AS_OF} - INTERVAL {int(hours)} HOUR),
    vit AS (SELECT id, coalesce({jnum('vitals', 'Pulse')}, {jnum('vitals', 'HR')}) AS heart_rate, {jnum('vitals', 'SBP')} AS sbp,
                   {jnum('vitals', 'O2Sat')} AS o2sat, {jnum('vitals', 'Temp')} AS temp, {jnum('vitals', 'Age')} AS age FROM recent)
    SELECT recent.id, appointment_id, recent.esi_level AS triage_level, recent.supervised_confidence AS confidence,
           recent.rl_action, recent.shap_values, recent.vitals, recent.created_at AS timestamp,
           visit.scheduled_time AS arrival_time, visit.status, tok.token_number, tok.priority_score, tok.estimated_wait_minutes,
           vit.* EXCLUDE (id), CASE WHEN heart_rate <> 0 AND sbp > 0 THEN heart_rate / sbp END AS shock_index,
           CAST(hour(recent.created_at) AS INTEGER) AS hour, CAST(recent.created_at AS DATE) AS date
    FROM recent JOIN vit USING (id) JOIN appointments visit USING (appointment_id)
    LEFT JOIN priority_tokens tok USING (appointment_id)"""


LOG_VIEWS = ("triage_results", "appointments", "priority_tokens")


def _on_log(sql: str, hours: int = 720) -> str:
    base = with_views("SELECT 1", *LOG_VIEWS)
    head = base[: base.rindex("\nSELECT 1")]
    return f"{head},\nlog AS ({log_sql(hours)})\n{sql}"


# ---- dashboard ---------------------------------------------------------------

ORACLE["triage_log_window"] = _on_log("""
SELECT id, appointment_id, triage_level, confidence, rl_action, timestamp, arrival_time, status, token_number,
       priority_score, estimated_wait_minutes, heart_rate, sbp, o2sat, shock_index, hour, date
FROM log ORDER BY timestamp DESC, id""", 168)

ORACLE["arrivals_by_hour"] = _on_log("""
SELECT h.hour, coalesce(c.count, 0) AS count
FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
LEFT JOIN (SELECT hour, count(*) AS count FROM log GROUP BY hour) c ON h.hour = c.hour
ORDER BY h.hour""")

ORACLE["level_distribution"] = _on_log("""
SELECT triage_level, count(*) AS count FROM log WHERE triage_level IS NOT NULL
GROUP BY triage_level ORDER BY triage_level""")

ORACLE["action_distribution"] = _on_log("""
SELECT rl_action, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM log WHERE rl_action IS NOT NULL GROUP BY rl_action""")

ORACLE["wait_by_level"] = _on_log("""
SELECT triage_level, avg(estimated_wait_minutes) AS avg_wait_minutes FROM log
GROUP BY triage_level HAVING avg(estimated_wait_minutes) IS NOT NULL AND triage_level IS NOT NULL""")

ORACLE["daily_drift"] = _on_log("""
SELECT date, avg(confidence) AS avg_confidence, avg(triage_level) AS avg_triage_level,
       avg(shock_index) AS avg_shock_index
FROM log GROUP BY date ORDER BY date""")

QUEUE_STATS = f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'SCHEDULED') AS waiting,
       count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress,
       count(*) FILTER (WHERE status = 'COMPLETED') AS completed
FROM appointments WHERE CAST(created_at AS DATE) = {DAY}"""

ORACLE["queue_stats"] = with_views(QUEUE_STATS, "appointments")

ORACLE["kpi_cards"] = _on_log(f"""
SELECT t.patients_today, t.patients_today - s.completed AS pending, t.avg_wait_high_acuity,
       s.in_progress AS occupancy, s.waiting, t.avg_confidence
FROM (SELECT count(*) AS patients_today,
             avg(CASE WHEN triage_level IN (1, 2) THEN estimated_wait_minutes END) AS avg_wait_high_acuity,
             avg(confidence) AS avg_confidence
      FROM log WHERE date = {DAY}) t,
     ({QUEUE_STATS}) s""")

ORACLE["confidence_histogram"] = _on_log("""
SELECT bin, bin / 20.0 AS bin_start, (bin + 1) / 20.0 AS bin_end, count, mean_confidence
FROM (SELECT CAST(least(greatest(floor(confidence * 20), 0), 19) AS INTEGER) AS bin, count(*) AS count
      FROM log WHERE confidence IS NOT NULL GROUP BY 1) b,
     (SELECT avg(confidence) AS mean_confidence FROM log WHERE confidence IS NOT NULL) m""")

ORACLE["queue_wait"] = with_views(f"""
SELECT count(*) AS queue_length,
       coalesce(avg((epoch_us({AS_OF}) - epoch_us(created_at)) / 60000000.0), 0.0) AS avg_wait_minutes
FROM appointments WHERE status = 'SCHEDULED'""", "appointments")

ORACLE["recent_results"] = _on_log("""
SELECT timestamp, token_number, triage_level, confidence, shock_index, rl_action, heart_rate, sbp, o2sat
FROM log ORDER BY timestamp DESC, id LIMIT 100""")

ORACLE["shock_bands"] = _on_log("""
SELECT triage_level, CASE WHEN shock_index IS NULL THEN NULL WHEN shock_index > 1.0 THEN '>1.0'
                          WHEN shock_index > 0.7 THEN '>0.7' ELSE 'normal' END AS band, count(*) AS count
FROM log WHERE heart_rate IS NOT NULL AND sbp IS NOT NULL GROUP BY 1, 2""")

ORACLE["scatter_range"] = _on_log("""
SELECT min(sbp) - 10 AS sbp_lo, max(sbp) + 10 AS sbp_hi
FROM log WHERE heart_rate IS NOT NULL AND sbp IS NOT NULL""")


# ---- vitals history ------------------------------------------------------------

POINTS = f"""
points AS (
  SELECT reading_id, patient_id, ts,
         coalesce(nullif({jnum('vitals', 'HR')}, 0), {jnum('vitals', 'Pulse')}) AS hr,
         {jnum('vitals', 'SBP')} AS sbp,
         coalesce(nullif({jnum('vitals', 'RR')}, 0), {jnum('vitals', 'Resp')}) AS rr,
         coalesce(nullif({jnum('vitals', 'O2Sat')}, 0), {jnum('vitals', 'O2_Sat')}) AS o2_sat
  FROM vitals_readings),
history AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, reading_id DESC) AS INTEGER) AS recency
                 FROM points) WHERE recency <= 20)"""


def _long(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT patient_id, reading_id, ts, '{v}' AS vital, {v} AS value FROM {src} WHERE {v} IS NOT NULL"
        for v in ("hr", "sbp", "o2_sat"))


def _with_points(sql: str) -> str:
    head = with_views("SELECT 1", "vitals_readings")
    head = head[: head.rindex("\nSELECT 1")]
    return f"{head},{POINTS}\n{sql}"


ORACLE["vitals_history"] = _with_points(
    "SELECT reading_id, patient_id, ts, hr, sbp, rr, o2_sat, recency FROM history ORDER BY patient_id, ts, reading_id")

SPARK_STATS = f"""
, long AS ({_long('history')}),
agg AS (
  SELECT patient_id, vital, count(*) AS n_points, min(value) AS min_value, max(value) AS max_value,
         max(CASE WHEN rn = 1 THEN value END) AS latest
  FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, vital ORDER BY ts DESC, reading_id DESC) AS rn FROM long)
  GROUP BY patient_id, vital),
stats AS (
  SELECT *, CASE WHEN vital = 'hr' THEN latest > 100 WHEN vital = 'sbp' THEN latest < 90
                 WHEN vital = 'o2_sat' THEN latest < 95 ELSE false END AS warning,
         CASE WHEN (max_value - min_value) * 0.1 = 0 THEN 5.0 ELSE (max_value - min_value) * 0.1 END AS pad
  FROM agg)"""

ORACLE["vital_latest_warning"] = _with_points("")[:-1] + SPARK_STATS + """
SELECT patient_id, vital, n_points, latest, warning FROM stats"""
ORACLE["vital_ranges"] = _with_points("")[:-1] + SPARK_STATS + """
SELECT patient_id, vital, min_value, max_value, min_value - pad AS domain_lo, max_value + pad AS domain_hi FROM stats"""

ORACLE["vital_trend"] = _with_points("")[:-1] + f"""
, long AS ({_long('points')}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY patient_id, vital ORDER BY ts, reading_id) AS r_first,
            row_number() OVER (PARTITION BY patient_id, vital ORDER BY ts DESC, reading_id DESC) AS r_last,
            value > lag(value) OVER (PARTITION BY patient_id, vital ORDER BY ts, reading_id) AS rise
  FROM long)
SELECT patient_id, vital, max(CASE WHEN r_first = 1 THEN value END) AS first_value,
       max(CASE WHEN r_last = 1 THEN value END) AS last_value, count(*) AS n_points, count(*) FILTER (WHERE rise) AS n_rises,
       max(CASE WHEN r_last = 1 THEN value END) - max(CASE WHEN r_first = 1 THEN value END) AS change,
       CASE WHEN max(CASE WHEN r_last = 1 THEN value END) > max(CASE WHEN r_first = 1 THEN value END) THEN 'rising'
            WHEN max(CASE WHEN r_last = 1 THEN value END) < max(CASE WHEN r_first = 1 THEN value END) THEN 'falling'
            ELSE 'flat' END AS trend
FROM ranked GROUP BY patient_id, vital"""

ORACLE["occupancy_running"] = with_views("""
SELECT move_id, ts, area, delta,
       CAST(sum(delta) OVER (PARTITION BY area ORDER BY ts, move_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS occupancy
FROM bed_moves""", "bed_moves")


# ---- queue and hand-off --------------------------------------------------------

ORACLE["active_queue"] = with_views("""
SELECT a.appointment_id, t.token_number AS token, a.triage_level, a.priority_score, a.status,
       r.rl_action AS action, coalesce(r.shap_values IS NOT NULL, false) AS shap_ready,
       p.first_name || ' ' || p.last_name AS patient_name,
       row_number() OVER (ORDER BY a.priority_score DESC NULLS LAST, a.appointment_id) AS queue_position
FROM appointments a
LEFT JOIN triage_results r ON a.appointment_id = r.appointment_id
LEFT JOIN priority_tokens t ON a.appointment_id = t.appointment_id
LEFT JOIN patients p ON a.patient_id = p.patient_id
WHERE a.status IN ('SCHEDULED', 'IN_PROGRESS')""", "appointments", "triage_results", "priority_tokens", "patients")


def _int(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


HP = f"""
hp0 AS (
  SELECT a.appointment_id, a.patient_id, p.first_name || ' ' || p.last_name AS patient_name, a.priority_score,
         a.created_at, coalesce(t.token_number, 'N/A') AS token,
         coalesce(nullif(a.triage_level, 0), 5) AS triage_level,
         coalesce(nullif(r.rl_action, ''), 'Assessment pending') AS chief_complaint, r.rl_action AS action,
         (r.vitals IS NOT NULL AND r.vitals <> '') AS has_v,
         CASE WHEN r.vitals IS NOT NULL AND r.vitals <> ''
              THEN coalesce(nullif({jnum('r.vitals', 'HR')}, 0), {jnum('r.vitals', 'Pulse')}) END AS hr,
         CASE WHEN r.vitals IS NOT NULL AND r.vitals <> '' THEN {jnum('r.vitals', 'SBP')} END AS sbp,
         CASE WHEN r.vitals IS NOT NULL AND r.vitals <> '' THEN {jnum('r.vitals', 'O2Sat')} END AS o2,
         CASE WHEN r.vitals IS NOT NULL AND r.vitals <> ''
              THEN coalesce(nullif({jnum('r.vitals', 'RR')}, 0), {jnum('r.vitals', 'Resp')}) END AS rr
  FROM appointments a
  JOIN patients p ON a.patient_id = p.patient_id
  LEFT JOIN triage_results r ON a.appointment_id = r.appointment_id
  LEFT JOIN priority_tokens t ON a.appointment_id = t.appointment_id
  WHERE a.status IN ('SCHEDULED', 'IN_PROGRESS')),
hp1 AS (
  SELECT *, CASE WHEN hr <> 0 AND sbp > 0 THEN CAST(printf('%.2f', hr / sbp) AS DOUBLE) END AS shock_index,
         concat_ws(' | ', CASE WHEN hr <> 0 THEN 'HR ' || {_int('hr')} END,
                          CASE WHEN sbp <> 0 THEN 'BP ' || {_int('sbp')} END,
                          CASE WHEN o2 <> 0 THEN 'O2 ' || {_int('o2')} || '%' END,
                          CASE WHEN rr <> 0 THEN 'RR ' || {_int('rr')} END) AS parts
  FROM hp0),
hp AS (
  SELECT appointment_id, patient_id, patient_name, token, triage_level, chief_complaint,
         CASE WHEN NOT has_v THEN 'No vitals recorded' WHEN parts = '' THEN 'No vitals' ELSE parts END AS vitals_summary,
         shock_index,
         CAST(trunc((epoch_us({AS_OF}) - epoch_us(created_at)) / 60000000.0) AS INTEGER) AS time_in_ed,
         action, priority_score,
         CASE WHEN shock_index > 0.7 THEN 'deteriorating' ELSE 'stable' END AS trend_status,
         list_filter([
           CASE WHEN shock_index > 1.0 THEN '⚠️ ' || patient_name || ': Critical Shock Index ('
                || CAST(shock_index AS VARCHAR) || ')' END,
           CASE WHEN hr <> 0 AND hr > 120 THEN '\U0001f534 ' || patient_name || ': Tachycardia (HR ' || {_int('hr')} || ')' END,
           CASE WHEN sbp <> 0 AND sbp < 90 THEN '\U0001f534 ' || patient_name || ': Hypotension (SBP ' || {_int('sbp')} || ')' END,
           CASE WHEN o2 <> 0 AND o2 < 92 THEN '\U0001f534 ' || patient_name || ': Hypoxia (O2 ' || {_int('o2')} || '%)' END
         ], lambda x: x IS NOT NULL) AS alerts
  FROM hp1)"""


def _on_hp(sql: str) -> str:
    head = with_views("SELECT 1", "appointments", "patients", "triage_results", "priority_tokens")
    head = head[: head.rindex("\nSELECT 1")]
    return f"{head},{HP}\n{sql}"


ORACLE["handoff_patients"] = _on_hp("""
SELECT appointment_id, patient_id, patient_name, token, triage_level, chief_complaint, vitals_summary, shock_index,
       time_in_ed, action, trend_status, alerts, priority_score FROM hp ORDER BY priority_score DESC NULLS LAST, appointment_id""")

ORACLE["handoff_alerts"] = _on_hp("""
SELECT appointment_id, rule_pos, alert FROM (
  SELECT appointment_id, priority_score, CAST(unnest(range(len(alerts))) AS INTEGER) AS rule_pos, unnest(alerts) AS alert
  FROM hp)
ORDER BY priority_score DESC NULLS LAST, appointment_id, rule_pos LIMIT 10""")

ORACLE["handoff_summary"] = _on_hp("""
, c AS (
  SELECT count(*) AS total_patients, count(*) FILTER (WHERE triage_level <= 2) AS critical_count,
         count(*) FILTER (WHERE triage_level = 3) AS urgent_count,
         count(*) FILTER (WHERE triage_level > 3) AS stable_count, CAST(printf('%.1f', avg(time_in_ed)) AS DOUBLE) AS avg_wait_minutes
  FROM hp),
w AS (
  SELECT string_agg(patient_name, ', ' ORDER BY priority_score DESC NULLS LAST, appointment_id) AS names,
         count(*) AS n
  FROM (SELECT * FROM hp WHERE trend_status = 'deteriorating'
        ORDER BY priority_score DESC NULLS LAST, appointment_id LIMIT 3)),
s AS (
  SELECT c.*, w.names, w.n,
         concat_ws('. ', CASE WHEN critical_count > 0 THEN critical_count || ' critical patient(s) requiring immediate attention' END,
                         CASE WHEN urgent_count > 0 THEN urgent_count || ' urgent case(s) in queue' END,
                         CASE WHEN stable_count > 0 THEN stable_count || ' stable patient(s) for routine care' END) AS parts
  FROM c, w)
SELECT total_patients, critical_count, urgent_count, stable_count, avg_wait_minutes,
       CASE WHEN parts = '' THEN 'ED is currently clear. No active patients.' ELSE parts || '.' END
       || CASE WHEN n > 0 THEN ' Watch closely: ' || names || '.' ELSE '' END AS summary
FROM s""")

ORACLE["watch_list"] = _on_hp("""
SELECT appointment_id, patient_name, triage_level, trend_status, priority_score FROM hp
WHERE triage_level <= 2 OR trend_status = 'deteriorating' ORDER BY priority_score DESC NULLS LAST, appointment_id""")

ORACLE["result_detail"] = with_views(f"""
, asked AS (SELECT DISTINCT appointment_id FROM appointments WHERE status = 'IN_PROGRESS'),
r AS (SELECT *, coalesce(nullif({jnum('vitals', 'Pulse')}, 0), {jnum('vitals', 'HR')}) AS hr, {jnum('vitals', 'SBP')} AS sbp
      FROM triage_results)
SELECT appointment_id, r.id IS NOT NULL AS found, esi_level, ktas_level, supervised_confidence, rl_action, model_version,
       shap_values, CASE WHEN hr <> 0 AND sbp > 0 THEN CAST(printf('%.2f', hr / sbp) AS DOUBLE) END AS shock_index, vitals,
       CAST(CASE WHEN shap_values IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_top,
       CASE WHEN shap_values IS NOT NULL THEN '{SERVICE_FIRST}' END AS top_feature,
       CAST(json_extract(shap_values, '$[0]') AS DOUBLE) AS top_impact,
       CASE WHEN epoch_us(created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END AS created_at
FROM asked LEFT JOIN r USING (appointment_id)""", "triage_results", "appointments")

ORACLE["patient_appointments"] = with_views("""
SELECT patient_id, appointment_id, status, triage_level, created_at,
       count(*) OVER (PARTITION BY patient_id) AS n_appointments
FROM appointments WHERE patient_id IN (SELECT patient_id FROM patients)""", "appointments", "patients")

ORACLE["orphan_visits"] = with_views("""
SELECT reading_id, patient_id, patient_id IN (SELECT patient_id FROM patients) AS patient_exists
FROM vitals_readings""", "vitals_readings", "patients")


# ---- decisions and audit -------------------------------------------------------

DEC = """
dec0 AS (
  SELECT row_id, acuity AS ESI, policy_action, list_max(p) AS conf, list_position(p, list_max(p)) AS pred
  FROM (SELECT *, coalesce(probs, [0.1, 0.15, 0.5, 0.15, 0.1]) AS p FROM decisions_input)),
dec AS (
  SELECT row_id, ESI, pred AS Sup_Pred, conf AS Sup_Conf,
         CASE WHEN conf < 0.6 OR pred = 3 THEN 'RL_Agent' ELSE 'Supervised' END AS Source,
         CASE WHEN conf < 0.6 OR pred = 3 THEN policy_action
              ELSE CASE pred WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 1 END END
           AS Final_Action
  FROM dec0),
decf AS (SELECT *, ESI <= 2 AND Final_Action IN (0, 1) AS Is_Critical_Miss FROM dec),
named AS (
  SELECT *, CASE Final_Action WHEN 0 THEN 'Wait/Home' WHEN 1 THEN 'Fast Track' WHEN 2 THEN 'Acute Care'
                 WHEN 3 THEN 'Critical Care' WHEN 4 THEN 'Diagnostics' ELSE 'Unknown' END AS Action_Name
  FROM decf)"""


def _on_dec(sql: str, *extra: str) -> str:
    head = with_views("SELECT 1", "decisions_input", *extra)
    head = head[: head.rindex("\nSELECT 1")]
    return f"{head},{DEC}\n{sql}"


ORACLE["hybrid_decision"] = _on_dec(
    "SELECT row_id, ESI, Sup_Pred, Sup_Conf, Source, Final_Action, Is_Critical_Miss FROM decf")

ORACLE["decision_flags"] = _on_dec("""
SELECT row_id, ESI, Final_Action, ESI <= 2 AND Final_Action IN (0, 1) AS critical_miss,
       ESI >= 4 AND Final_Action IN (2, 3) AS over_triage,
       (ESI <= 2 AND Final_Action IN (2, 3)) OR (ESI = 3 AND Final_Action = 2) OR (ESI >= 4 AND Final_Action = 1)
         AS correct
FROM decf""")

ORACLE["hybrid_metrics"] = _on_dec("""
SELECT *, coalesce(rl_interventions * 100.0 / nullif(total_patients, 0), 0.0) AS rl_intervention_pct,
       coalesce(critical_misses * 100.0 / nullif(total_critical, 0), 0.0) AS critical_miss_rate,
       coalesce(over_triage * 100.0 / nullif(total_low_acuity, 0), 0.0) AS over_triage_rate,
       coalesce(correct * 100.0 / nullif(total_patients, 0), 0.0) AS accuracy
FROM (SELECT count(*) AS total_patients, count(*) FILTER (WHERE Source = 'RL_Agent') AS rl_interventions,
             count(*) FILTER (WHERE ESI <= 2) AS total_critical,
             count(*) FILTER (WHERE ESI <= 2 AND Final_Action IN (0, 1)) AS critical_misses,
             count(*) FILTER (WHERE ESI >= 4) AS total_low_acuity,
             count(*) FILTER (WHERE ESI >= 4 AND Final_Action IN (2, 3)) AS over_triage,
             count(*) FILTER (WHERE (ESI <= 2 AND Final_Action IN (2, 3)) OR (ESI = 3 AND Final_Action = 2)
                                    OR (ESI >= 4 AND Final_Action = 1)) AS correct
      FROM decf)""")

ORACLE["confusion_matrix"] = _on_dec("""
SELECT ESI,
       count(*) FILTER (WHERE Action_Name = 'Critical Care') / count(*) AS "Critical Care",
       count(*) FILTER (WHERE Action_Name = 'Acute Care') / count(*) AS "Acute Care",
       count(*) FILTER (WHERE Action_Name = 'Diagnostics') / count(*) AS "Diagnostics",
       count(*) FILTER (WHERE Action_Name = 'Fast Track') / count(*) AS "Fast Track",
       count(*) FILTER (WHERE Action_Name = 'Wait/Home') / count(*) AS "Wait/Home"
FROM named GROUP BY ESI""")

ORACLE["action_by_source"] = _on_dec("SELECT Action_Name, Source, count(*) AS count FROM named GROUP BY 1, 2")

ORACLE["safety_split"] = _on_dec("""
SELECT NOT (Final_Action IN (0, 1)) AS Is_Safe, count(*) AS count FROM decf WHERE ESI IN (1, 2) GROUP BY 1""")

ORACLE["action_labels"] = _on_dec("""
SELECT row_id, Final_Action, Action_Name,
       CASE Final_Action WHEN 0 THEN 'Wait' WHEN 1 THEN 'Fast Track' WHEN 2 THEN 'Acute' WHEN 3 THEN 'Critical'
                         WHEN 4 THEN 'Diagnostics' ELSE 'Unknown' END AS env_name,
       CASE Final_Action WHEN 0 THEN 'Assign to Bed' WHEN 1 THEN 'Move to Waiting Room'
                         WHEN 2 THEN 'Direct to Fast Track' ELSE 'Move to Waiting Room' END AS service_label
FROM named""")

FAIR = """
, fair AS (
  SELECT v.row_id, v.Age, v.ESI, d.Final_Action, d.Is_Critical_Miss,
         CASE WHEN v.Age < 18 THEN 'Pediatric (<18)' WHEN v.Age > 65 THEN 'Geriatric (>65)' ELSE 'Adult (18-65)' END
           AS Age_Group,
         CASE v.Sex WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' ELSE 'Unknown' END AS Gender_Label,
         CASE v.Race WHEN 1 THEN 'White' WHEN 2 THEN 'Black' WHEN 3 THEN 'Hispanic' WHEN 4 THEN 'Asian/Other'
                     ELSE 'Other' END AS Race_Label
  FROM audit_visits v JOIN decf d ON v.row_id = d.row_id
  WHERE v.ESI IS NOT NULL)"""

ORACLE["fairness_input"] = _on_dec(FAIR + """
SELECT row_id, Age, ESI, Age_Group, Gender_Label, Race_Label, Final_Action, Is_Critical_Miss FROM fair""",
                                   "audit_visits")

ORACLE["fairness_rates"] = _on_dec(FAIR + """,
long AS (
  SELECT 'Age_Group' AS dimension, Age_Group AS "group", * FROM fair
  UNION ALL SELECT 'Gender_Label', Gender_Label, * FROM fair
  UNION ALL SELECT 'Race_Label', Race_Label, * FROM fair),
per AS (
  SELECT dimension, "group", count(*) FILTER (WHERE ESI IN (1, 2)) AS n_critical,
         avg(CASE WHEN ESI IN (1, 2) THEN CAST(Is_Critical_Miss AS DOUBLE) END) * 100 AS critical_miss_rate,
         count(*) FILTER (WHERE ESI IN (4, 5)) AS n_low_acuity,
         avg(CASE WHEN ESI IN (4, 5) THEN CAST(ESI IN (4, 5) AND Final_Action = 3 AS DOUBLE) END) * 100
           AS over_triage_rate
  FROM long GROUP BY 1, 2)
SELECT * FROM per WHERE dimension IN (SELECT dimension FROM per GROUP BY 1 HAVING count(*) > 1)""",
                                   "audit_visits")

COST = """
, costed AS (
  SELECT d.*, coalesce(o.area_full, false) AS area_full FROM decf d
  LEFT JOIN (
    SELECT row_id, row_number() OVER (PARTITION BY area ORDER BY row_id) - 1
                   >= CASE area WHEN 'critical' THEN 10 WHEN 'acute' THEN 30 ELSE 20 END AS area_full
    FROM (SELECT row_id, CASE Final_Action WHEN 3 THEN 'critical' WHEN 2 THEN 'acute' WHEN 1 THEN 'fast' END AS area
          FROM decf) WHERE area IS NOT NULL) o ON d.row_id = o.row_id),
rewarded AS (
  SELECT *, CASE
    WHEN Final_Action = 0 THEN CASE WHEN ESI <= 2 THEN -500 ELSE -1 END
    WHEN Final_Action = 3 THEN CASE WHEN ESI >= 4 THEN -20 ELSE 20 END - CASE WHEN area_full THEN 50 ELSE 0 END
    WHEN Final_Action = 1 THEN CASE WHEN ESI >= 4 THEN 15 ELSE -500 END - CASE WHEN area_full THEN 30 ELSE 0 END
    WHEN Final_Action = 2 THEN CASE WHEN ESI IN (2, 3) THEN 15 WHEN ESI = 1 THEN -500 ELSE -10 END
                               - CASE WHEN area_full THEN 40 ELSE 0 END
    WHEN Final_Action = 4 THEN -5 ELSE 0 END AS reward
  FROM costed)"""

ORACLE["decision_cost"] = _on_dec(COST + """
SELECT Source, count(*) AS decisions, CAST(sum(reward) AS BIGINT) AS total_reward, avg(reward) AS mean_reward
FROM rewarded GROUP BY Source""")

ORACLE["policy_table"] = _on_dec(COST + """,
per AS (SELECT Sup_Pred, area_full, Final_Action, avg(reward) AS mean_reward, count(*) AS n
        FROM rewarded GROUP BY 1, 2, 3)
SELECT Sup_Pred, area_full, Final_Action AS best_action, mean_reward, n AS support
FROM (SELECT *, row_number() OVER (PARTITION BY Sup_Pred, area_full ORDER BY mean_reward DESC, Final_Action) AS rn
      FROM per) WHERE rn = 1""")


# ---- ingest --------------------------------------------------------------------

from edspark.schemas import CODE_PATTERN, CODES_FROM, LAYOUT_A, LAYOUT_B  # noqa: E402


def parse_sql(layout, src: str = "raw_lines", extra: str = "") -> str:
    cols = []
    for name, s, e, scale in layout:
        f = f"trim(substr(value, {s + 1}, {e - s}), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31))"
        v = f"CASE WHEN regexp_full_match({f}, '[0-9]+') THEN CAST({f} AS DOUBLE) END"
        cols.append(f"{v} / {scale} AS {name}" if scale != 1.0 else f"{v} AS {name}")
    codes = f"regexp_extract_all(substr(value, {CODES_FROM + 1}), '{CODE_PATTERN}')"
    cols.append(f"coalesce(nullif(array_to_string({codes}, ' '), ''), 'Unknown') AS Chief_complain")
    return f"SELECT {extra}{', '.join(cols)} FROM {src}"


ORACLE["fixed_width_parse"] = with_views(parse_sql(LAYOUT_A), "raw_lines")
ORACLE["fixed_width_parse_b"] = with_views(parse_sql(LAYOUT_B), "raw_lines")
ORACLE["valid_esi"] = with_views(
    f"SELECT * FROM ({parse_sql(LAYOUT_A)}) WHERE ESI IS NOT NULL AND ESI BETWEEN 1 AND 5", "raw_lines")
YEAR_EXPR = "CASE l_linestatus WHEN 'F' THEN 2021 ELSE 2022 END AS Year, "
UNION_YEARS = (f"SELECT * FROM ({parse_sql(LAYOUT_A, extra=YEAR_EXPR)}) "
               "WHERE ESI IS NOT NULL AND ESI BETWEEN 1 AND 5")
ORACLE["union_years"] = with_views(UNION_YEARS, "raw_lines")
ORACLE["year_counts"] = with_views(f"SELECT Year, count(*) AS count FROM ({UNION_YEARS}) GROUP BY Year", "raw_lines")
ORACLE["diagnosis_codes"] = with_views(f"""
SELECT regexp_extract_all(substr(value, {CODES_FROM + 1}), '{CODE_PATTERN}') AS codes,
       coalesce(nullif(array_to_string(regexp_extract_all(substr(value, {CODES_FROM + 1}), '{CODE_PATTERN}'), ' '), ''),
                'Unknown') AS Chief_complain
FROM raw_lines""", "raw_lines")
ORACLE["code_descriptions"] = with_views(f"""
, visits AS (SELECT row_number() OVER () AS rid, Chief_complain FROM ({parse_sql(LAYOUT_A)})),
words AS (SELECT rid, unnest(w) AS code, unnest(range(len(w))) AS pos
          FROM (SELECT rid, list_filter(string_split_regex(trim(Chief_complain), '\\s+'), lambda x: x <> '') AS w
                FROM visits)),
looked AS (
  SELECT w.rid, w.pos, coalesce(d1.description, d2.description, w.code) AS d
  FROM words w
  LEFT JOIN code_dictionary d1 ON w.code = d1.code
  LEFT JOIN code_dictionary d2
    ON CASE WHEN length(w.code) > 3 THEN substr(w.code, 1, 3) || '.' || substr(w.code, 4) END = d2.code)
SELECT v.Chief_complain,
       CASE WHEN v.Chief_complain IS NULL THEN 'Unknown' ELSE coalesce(t.txt, '') END AS Chief_complain_text
FROM visits v LEFT JOIN (SELECT rid, string_agg(d, ' ' ORDER BY pos) AS txt FROM looked GROUP BY rid) t
  ON v.rid = t.rid""", "raw_lines", "code_dictionary")


# ---- attribution ---------------------------------------------------------------

def fname(pos: str, names) -> str:
    arr = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    k = len(names)
    return (f"CASE WHEN {pos} < {k} THEN {arr}[{pos} + 1] WHEN {pos} < {k + 768} THEN 'BERT_' || CAST({pos} - {k} AS VARCHAR) "
            f"ELSE 'Feature_' || CAST({pos} AS VARCHAR) END")


from edspark.schemas import DASHBOARD_FEATURES, SERVICE_FEATURES  # noqa: E402

MEAN_ABS = f"""
, recent AS (SELECT * FROM attributions WHERE payload IS NOT NULL ORDER BY created_at DESC, row_id DESC LIMIT 100),
flat AS (SELECT CAST(unnest(range(len(payload))) AS INTEGER) AS pos, unnest(payload) AS v FROM recent),
imp AS (SELECT pos, {fname('pos', DASHBOARD_FEATURES)} AS feature, avg(abs(v)) AS importance FROM flat GROUP BY pos)"""

ORACLE["attribution_mean_abs"] = with_views(MEAN_ABS + "\nSELECT pos, feature, importance FROM imp", "attributions")

ORACLE["attribution_top"] = with_views(MEAN_ABS + """,
top AS (SELECT * FROM imp ORDER BY importance DESC, pos LIMIT 15),
kept AS (SELECT * FROM top WHERE NOT starts_with(feature, 'BERT_')
                             OR NOT EXISTS (SELECT 1 FROM top WHERE NOT starts_with(feature, 'BERT_')))
SELECT pos, feature, importance FROM kept ORDER BY importance DESC, pos LIMIT 10""", "attributions")

ORACLE["attribution_mean_abs_nested"] = with_views(f"""
, recent AS (SELECT * FROM nested_attributions WHERE payload IS NOT NULL ORDER BY created_at DESC, row_id DESC LIMIT 100),
cls AS (SELECT row_id, unnest(range(len(payload))) AS c, unnest(payload) AS p FROM recent),
flat AS (SELECT row_id, c, CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS v FROM cls),
per AS (SELECT row_id, pos, avg(v) AS mv FROM flat GROUP BY row_id, pos)
SELECT pos, {fname('pos', DASHBOARD_FEATURES)} AS feature, avg(abs(mv)) AS importance FROM per GROUP BY pos""",
                                                   "nested_attributions")

ORACLE["attribution_mean_abs_json"] = with_views(f"""
, recent AS (SELECT * FROM attributions ORDER BY created_at DESC, row_id DESC LIMIT 100),
vals AS (SELECT row_id, payload AS p FROM recent WHERE row_id % 6 IN (4, 5)
  UNION ALL SELECT row_id, list_transform(range(16), lambda i: (0.0 + payload[i + 1] + payload[i + 17] + payload[i + 33] + payload[i + 49]) / 4)
  FROM recent WHERE row_id % 6 = 3),
flat AS (SELECT CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS v FROM vals)
SELECT pos, {fname('pos', DASHBOARD_FEATURES)} AS feature, avg(abs(v)) AS importance FROM flat GROUP BY pos""", "attributions")

ORACLE["attribution_by_class"] = with_views(f"""
, one AS (SELECT payload[3] AS p FROM nested_attributions),
flat AS (SELECT CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS v FROM one)
SELECT pos, {fname('pos', DASHBOARD_FEATURES)} AS feature, avg(abs(v)) AS importance FROM flat GROUP BY pos""",
                                            "nested_attributions")

ORACLE["record_top_features"] = with_views(f"""
, flat AS (SELECT row_id, unnest(range(len(payload))) AS pos, unnest(payload) AS v FROM attributions),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(v) DESC, pos DESC) AS INTEGER) AS rank
            FROM flat)
SELECT row_id, rank, {fname('pos', SERVICE_FEATURES)} AS feature, v AS impact FROM ranked WHERE rank <= 3""",
                                           "attributions")

ORACLE["attribution_merge"] = with_views("""
SELECT t.appointment_id, (a.row_id IS NOT NULL OR t.shap_values IS NOT NULL) AS shap_ready,
       CAST(CASE WHEN a.row_id IS NOT NULL THEN len(a.payload) ELSE json_array_length(t.shap_values) END AS INTEGER)
         AS n_values
FROM triage_results t LEFT JOIN attributions a ON t.appointment_id = a.row_id""", "triage_results", "attributions")


# ---- features ------------------------------------------------------------------

NUMERIC = ["Age", "Temp", "Pulse", "Resp", "SBP", "DBP", "O2Sat", "PainScale"]
VISITS = f"visits AS (SELECT * FROM ({parse_sql(LAYOUT_A)}) WHERE ESI IS NOT NULL AND ESI BETWEEN 1 AND 5)"
LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM visits WHERE {c} IS NOT NULL" for c in NUMERIC)
STATS = f"""
, {VISITS},
long AS ({LONG}),
med AS (SELECT "column", median(value) AS median FROM long GROUP BY "column"),
md AS (SELECT "column", value AS mode FROM (
         SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS rn
         FROM long GROUP BY "column", value) WHERE rn = 1),
filled AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce({c}, (SELECT median FROM med WHERE \"column\" = '{c}')) AS value FROM visits"
    for c in NUMERIC)}),
mom AS (SELECT "column", avg(value) AS mean, stddev_pop(value) AS std FROM filled GROUP BY "column"),
stats AS (SELECT med."column", median, mode, mean, std FROM med LEFT JOIN md USING ("column") LEFT JOIN mom USING ("column"))"""

ORACLE["impute_scale_stats"] = with_views(STATS + "\nSELECT * FROM stats", "raw_lines")


def _scaled(c: str) -> str:
    w = f"WHERE \"column\" = '{c}'"
    return (f"(coalesce({c}, (SELECT median FROM stats {w})) - (SELECT mean FROM stats {w}))"
            f" / (SELECT CASE WHEN std = 0 OR std IS NULL THEN 1.0 ELSE std END FROM stats {w}) AS {c}")


ORACLE["impute_scale"] = with_views(STATS + f"\nSELECT ESI, {', '.join(_scaled(c) for c in NUMERIC)} FROM visits",
                                    "raw_lines")

ORACLE["one_hot_arrival"] = with_views(f"""
, {VISITS},
m AS (SELECT ArrivalMode AS mode FROM visits WHERE ArrivalMode IS NOT NULL
      GROUP BY ArrivalMode ORDER BY count(*) DESC, ArrivalMode LIMIT 1),
f AS (SELECT ESI, coalesce(ArrivalMode, (SELECT mode FROM m)) AS ArrivalMode FROM visits),
cats AS (SELECT list(DISTINCT ArrivalMode ORDER BY ArrivalMode) AS c FROM f)
SELECT ESI, ArrivalMode, list_transform((SELECT c FROM cats), lambda x: CAST(CASE WHEN x = ArrivalMode THEN 1.0 ELSE 0.0 END AS DOUBLE))
       AS ArrivalMode_onehot
FROM f""", "raw_lines")

ORACLE["feature_matrix"] = with_views(STATS + f"""
, m AS (SELECT ArrivalMode AS mode FROM visits WHERE ArrivalMode IS NOT NULL
      GROUP BY ArrivalMode ORDER BY count(*) DESC, ArrivalMode LIMIT 1),
f AS (SELECT * REPLACE (coalesce(ArrivalMode, (SELECT mode FROM m)) AS ArrivalMode),
             len(string_split(Chief_complain, ' ')) AS n_codes FROM visits),
cats AS (SELECT list(DISTINCT ArrivalMode ORDER BY ArrivalMode) AS c FROM f)
SELECT CAST(dense_rank() OVER (ORDER BY ESI) - 1 AS DOUBLE) AS label, {', '.join(_scaled(c) for c in NUMERIC)},
       list_transform((SELECT c FROM cats), lambda x: CAST(CASE WHEN x = ArrivalMode THEN 1.0 ELSE 0.0 END AS DOUBLE)) AS arrival,
       CAST(n_codes AS INTEGER) AS n_codes, CAST((SELECT sum(n_codes) FROM f) AS DOUBLE) AS corpus_codes
FROM f""", "raw_lines")

ORACLE["acuity_classifier"] = with_views(f"""
, {VISITS}
SELECT ESI, CAST((SELECT count(DISTINCT ESI) FROM visits) AS INTEGER) AS n_classes, true AS sums_to_one,
       true AS level_has_largest, false AS earlier_as_large FROM visits""", "raw_lines")

ORACLE["linear_attribution"] = with_views(f"""
, {VISITS}
SELECT ESI, CAST({len(NUMERIC)} AS INTEGER) AS n_contributions, true AS adds_up FROM visits""", "raw_lines")

ORACLE["complaint_features"] = with_views("""
, t AS (SELECT doc_id, len(list_filter(string_split_regex(lower(complaint), '[^a-zA-Z0-9_]+'), lambda x: x <> '')) AS n FROM complaints)
SELECT doc_id, CAST(n AS INTEGER) AS n_tokens, CAST((SELECT sum(n) FROM t) AS DOUBLE) AS corpus_terms FROM t""", "complaints")

ORACLE["text_vectors"] = with_views("""
SELECT doc_id, CAST(768 AS INTEGER) AS n_numbers, true AS no_longer, regexp_matches(complaint, '[a-zA-Z0-9_]') AS has_terms,
       true AS energy_kept FROM complaints""", "complaints")

ORACLE["label_encode"] = with_views(f"""
, {VISITS}
SELECT ESI, CAST(dense_rank() OVER (ORDER BY ESI) - 1 AS INTEGER) AS label FROM visits""", "raw_lines")

ORACLE["stratified_folds"] = with_views("""
SELECT row_id, acuity,
       CAST((row_number() OVER (PARTITION BY acuity ORDER BY (row_id % 2147483648 * 2654435761) % 4294967296, row_id) - 1) % 3
            AS INTEGER) AS fold
FROM decisions_input""", "decisions_input")


# ---- rules over whole tables ---------------------------------------------------

ORACLE["priority_tokens"] = with_views(f"""
SELECT appointment_id, triage_level, seq AS sequence, printf('%s-%04d', {COLOUR}, seq) AS token
FROM (SELECT *, row_number() OVER (PARTITION BY {COLOUR} ORDER BY issued_at, appointment_id) AS seq
      FROM (SELECT * REPLACE (CAST(CASE WHEN appointment_id % 10 <> 0 THEN triage_level ELSE triage_level + 4 END AS INTEGER) AS triage_level)
            FROM priority_tokens))""", "priority_tokens")

ORACLE["priority_score"] = with_views("""
SELECT appointment_id, CAST(floor(epoch(created_at) / 60) AS BIGINT) AS epoch_minutes,
       (6 - CAST(triage_level AS BIGINT)) * 100000 + CAST(floor(epoch(created_at) / 60) AS BIGINT) AS priority_score
FROM appointments""", "appointments")

ORACLE["vitals_json"] = with_views(f"""
SELECT reading_id, coalesce({jnum('vitals', 'Pulse')}, {jnum('vitals', 'HR')}) AS heart_rate,
       coalesce(nullif({jnum('vitals', 'HR')}, 0), {jnum('vitals', 'Pulse')}) AS hr_service,
       {jnum('vitals', 'SBP')} AS sbp, coalesce({jnum('vitals', 'O2Sat')}, {jnum('vitals', 'O2_Sat')}) AS o2sat
FROM vitals_readings""", "vitals_readings")

ORACLE["shock_index"] = with_views(f"""
SELECT reading_id, CASE WHEN hr <> 0 AND sbp > 0 THEN hr / sbp END AS shock_index,
       CASE WHEN hr <> 0 AND sbp > 0 THEN CAST(printf('%.2f', hr / sbp) AS DOUBLE) END AS shock_index_rounded
FROM (SELECT reading_id, coalesce({jnum('vitals', 'Pulse')}, {jnum('vitals', 'HR')}) AS hr, {jnum('vitals', 'SBP')} AS sbp
      FROM vitals_readings)""", "vitals_readings")

from edspark.schemas import MEDIAN_VITALS, VALID_RANGES, ZERO_IS_MISSING  # noqa: E402


def _san(k: str) -> str:
    v = jnum("vitals", k)
    bad = f"{v} IS NULL OR {v} < 0" + (f" OR {v} = 0" if k in ZERO_IS_MISSING else "")
    lo, hi = VALID_RANGES[k]
    return f"CASE WHEN {bad} THEN {MEDIAN_VITALS[k]} ELSE greatest({lo}, least({hi}, {v})) END"


ORACLE["sanitize_vitals"] = with_views(
    f"SELECT reading_id, {', '.join(f'{_san(k)} AS {k}' for k in MEDIAN_VITALS)} FROM vitals_readings",
    "vitals_readings")

ORACLE["structured_features"] = with_views(f"""
SELECT reading_id, {_san('Age')} AS Age, {_san('Temp')} AS Temp,
       coalesce(nullif({_san('Pulse')}, 0), coalesce({_san('HR')}, 82.0)) AS Pulse,
       coalesce(nullif({_san('Resp')}, 0), coalesce({_san('RR')}, 18.0)) AS Resp,
       {_san('SBP')} AS SBP, {_san('DBP')} AS DBP, {_san('O2Sat')} AS O2Sat, {_san('PainScale')} AS PainScale,
       CASE WHEN arrival_mode IS NOT NULL AND arrival_mode <> ''
            THEN CASE arrival_mode WHEN 'Ambulance' THEN 1.0 WHEN 'Public Transport' THEN 2.0 WHEN 'Walk-in' THEN 3.0
                                   WHEN 'Other' THEN 4.0 ELSE 3.0 END
            ELSE coalesce({jnum('vitals', 'ArrivalMode')}, 3.0) END AS ArrivalMode
FROM vitals_readings""", "vitals_readings")

ORACLE["dedupe_arrivals"] = with_views("""
SELECT appointment_id, patient_id, ts FROM (
  SELECT *, reading_id AS appointment_id, row_number() OVER (PARTITION BY reading_id ORDER BY ts, patient_id) AS rn
  FROM vitals_readings)
WHERE rn = 1""", "vitals_readings")

ORACLE["clean_complaint"] = with_views("""
SELECT doc_id,
       CASE WHEN complaint IS NULL OR length(regexp_replace(complaint, '^\\s+|\\s+$', '', 'g')) < 3
            THEN 'General complaint' ELSE complaint END AS complaint_clean,
       substr(complaint_clean, 1, 5000) AS complaint_cut,
       substr(complaint, 1, 100) AS event_text
FROM complaints""", "complaints")

ORACLE["walkin_dob"] = with_views(f"""
SELECT row_id, make_date(CAST(year({AS_OF}) - CAST(trunc(Age) AS INTEGER) AS BIGINT), 1, 1) AS date_of_birth
FROM audit_visits""", "audit_visits")

ORACLE["ed_state_vector"] = with_views(f"""
, q AS (SELECT count(*) AS queue_length FROM appointments WHERE status = 'SCHEDULED'),
x AS (
  SELECT r.reading_id, coalesce(d.probs, [0.1, 0.15, 0.5, 0.15, 0.1]) AS probs, r.ts, q.queue_length,
         CASE WHEN coalesce({jnum('r.vitals', 'O2Sat')}, 100.0) < 90 OR coalesce({jnum('r.vitals', 'SBP')}, 120.0) < 90
              THEN 0.9 ELSE 0.1 END::DOUBLE AS risk
  FROM vitals_readings r CROSS JOIN q LEFT JOIN decisions_input d ON r.reading_id = d.row_id)
SELECT reading_id, risk,
       CAST(probs || [risk] || [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
            || [least(queue_length, 5) / 5.0, least(greatest(queue_length - 5, 0), 5) / 5.0, 0.2, 0.2]
            || [hour(ts) / 24.0, minute(ts) / 60.0] AS FLOAT[]) AS state
FROM x""", "vitals_readings", "decisions_input", "appointments")

ORACLE["occupancy_ratio"] = with_views("""
, now AS (SELECT area, sum(delta) AS n FROM bed_moves GROUP BY area),
o AS (SELECT coalesce(max(n) FILTER (area = 'waiting'), 0) AS waiting, coalesce(max(n) FILTER (area = 'critical'), 0) AS critical,
             coalesce(max(n) FILTER (area = 'bed'), 0) AS bed, coalesce(max(n) FILTER (area = 'fast_track'), 0) AS fast_track FROM now)
SELECT CAST(waiting AS BIGINT) AS waiting, CAST(critical AS BIGINT) AS critical, CAST(bed AS BIGINT) AS bed,
       CAST(fast_track AS BIGINT) AS fast_track, waiting / 50.0::DOUBLE AS waiting_ratio, critical / 10.0::DOUBLE AS critical_ratio,
       bed / 30.0::DOUBLE AS bed_ratio, fast_track / 20.0::DOUBLE AS fast_track_ratio FROM o""", "bed_moves")

ORACLE["visit_status"] = with_views("""
SELECT appointment_id, rl_action,
       CASE WHEN rl_action IN ('Assign to Bed', 'Direct to Fast Track') THEN 'IN_PROGRESS' ELSE 'SCHEDULED' END AS status
FROM triage_results""", "triage_results")

ORACLE["bed_load"] = with_views("""
SELECT day, n_patients, load,
       CASE WHEN load > 0.9 THEN 'red' WHEN load > 0.7 THEN 'yellow' ELSE 'green' END AS band
FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS n_patients, least(count(*) + 8, 20) / 20.0 AS load
      FROM appointments WHERE status IN ('SCHEDULED', 'IN_PROGRESS') GROUP BY 1)""", "appointments")

ORACLE["arrival_severity"] = with_views("""
SELECT appointment_id, esi_level,
       CASE WHEN esi_level <= 2 THEN 'critical' WHEN esi_level = 3 THEN 'warning' END AS severity
FROM triage_results""", "triage_results")

ORACLE["wait_band"] = with_views("""
SELECT appointment_id,
       CASE WHEN estimated_wait_minutes IS NOT NULL AND estimated_wait_minutes <> 0
            THEN 'Estimated wait: ' || estimated_wait_minutes || ' minutes'
            ELSE coalesce(CASE triage_level WHEN 1 THEN 'You will be seen immediately'
                                            WHEN 2 THEN 'Estimated wait: 10-15 minutes'
                                            WHEN 3 THEN 'Estimated wait: 30-60 minutes'
                                            WHEN 4 THEN 'Estimated wait: 1-2 hours'
                                            WHEN 5 THEN 'Estimated wait: 2-4 hours' END,
                          'Please wait for your turn') END AS wait_text
FROM priority_tokens""", "priority_tokens")

ORACLE["input_range_check"] = with_views(f"""
SELECT Age, Pulse, Temp, PainScale, reason IS NULL AS valid, reason FROM (
  SELECT *, coalesce(CASE WHEN Age IS NOT NULL AND NOT (Age BETWEEN 0 AND 120) THEN 'age' END,
                     CASE WHEN Pulse IS NOT NULL AND NOT (Pulse BETWEEN 30 AND 250) THEN 'heart_rate' END,
                     CASE WHEN Temp IS NOT NULL AND NOT (Temp BETWEEN 90 AND 110) THEN 'temperature' END,
                     CASE WHEN PainScale IS NOT NULL AND NOT (PainScale BETWEEN 0 AND 10) THEN 'pain' END) AS reason
  FROM ({parse_sql(LAYOUT_A)}))""", "raw_lines")

ORACLE["kiosk_defaults"] = with_views(f"""
SELECT coalesce(nullif(Age, 0), 30.0) AS Age, coalesce(nullif(Pulse, 0), 80.0) AS Pulse,
       coalesce(nullif(Pulse, 0), 80.0) AS HR, coalesce(nullif(Temp, 0), 98.6) AS Temp,
       16.0::DOUBLE AS Resp, 120.0::DOUBLE AS SBP, 80.0::DOUBLE AS DBP, 98.0::DOUBLE AS O2Sat, PainScale
FROM ({parse_sql(LAYOUT_A)})""", "raw_lines")

ORACLE["latency_report"] = with_views("""
SELECT endpoint, count(*) AS n, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
       min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, avg(latency_ms) AS mean_ms, median(latency_ms) AS median_ms,
       coalesce(stddev_samp(latency_ms), 0.0) AS std_ms,
       count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0) AS requests_per_s
FROM request_log GROUP BY endpoint""", "request_log")

ORACLE["seeded_sample"] = with_views("""
SELECT appointment_id, triage_level FROM (
  SELECT * FROM appointments ORDER BY (appointment_id % 2147483648 * 2654435761 + 42) % 4294967296, appointment_id LIMIT 1000)
WHERE triage_level IS NOT NULL""", "appointments")

EVENT_KEYS = ("event_type,appointment_id,patient_id,token,triage_level,priority_score,action,vitals,"
              "chief_complaint,shap_ready")

ORACLE["arrival_events"] = with_views(f"""
SELECT t.appointment_id, a.patient_id, t.esi_level AS triage_level,
       (6 - CAST(t.esi_level AS BIGINT)) * 100000 + CAST(floor(epoch(t.created_at) / 60) AS BIGINT) AS priority_score,
       t.rl_action AS action, {jnum('t.vitals', 'SBP')} AS SBP,
       coalesce(nullif({jnum('t.vitals', 'Pulse')}, 0), {jnum('t.vitals', 'HR')}) AS HR,
       coalesce(nullif({jnum('t.vitals', 'Resp')}, 0), {jnum('t.vitals', 'RR')}) AS RR,
       {jnum('t.vitals', 'O2Sat')} AS O2Sat, substr(c.complaint, 1, 100) AS chief_complaint, false AS shap_ready,
       k.token_number AS token, '{EVENT_KEYS}' AS payload_keys, 'SBP,HR,RR,O2Sat' AS vitals_keys,
       k.token_number AS payload_token,
       coalesce(nullif({jnum('t.vitals', 'Pulse')}, 0), {jnum('t.vitals', 'HR')}) AS payload_hr
FROM triage_results t JOIN appointments a ON t.appointment_id = a.appointment_id
LEFT JOIN complaints c ON c.doc_id = t.appointment_id
LEFT JOIN priority_tokens k ON k.appointment_id = t.appointment_id""", "triage_results", "appointments", "complaints", "priority_tokens")


# ---- streaming (batch-equal results) -------------------------------------------

STREAM_TRIAGE = f"""
st AS (SELECT event_id AS appointment_id, user_id AS patient_id, CAST(ts AS TIMESTAMP) AS ts, event_id, event_type,
              CAST(1 + (user_id + {K}) % 5 AS INTEGER) AS triage_level
       FROM events)"""


def _stream(sql: str) -> str:
    return "WITH " + STREAM_TRIAGE.lstrip("\n") + "\n" + sql


ORACLE["stream_arrivals"] = _stream(f"""
SELECT appointment_id, triage_level,
       (6 - CAST(triage_level AS BIGINT)) * 100000 + CAST(floor(epoch(ts) / 60) AS BIGINT) AS priority_score,
       'new_patient' AS event_type, printf('%s-%04d', {COLOUR}, appointment_id) AS token, '{EVENT_KEYS}' AS payload_keys
FROM st""")

ORACLE["stream_dedupe"] = _stream("""
SELECT appointment_id, patient_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY appointment_id ORDER BY ts, patient_id) AS rn FROM st) WHERE rn = 1""")

ORACLE["stream_queue"] = _stream("""
, q AS (SELECT appointment_id, patient_id, ts, triage_level,
          (6 - CAST(triage_level AS BIGINT)) * 100000 + CAST(floor(epoch(ts) / 60) AS BIGINT) AS priority_score
        FROM (SELECT *, row_number() OVER (PARTITION BY appointment_id ORDER BY ts, patient_id) AS rn FROM st) WHERE rn = 1)
SELECT *, row_number() OVER (ORDER BY priority_score DESC, appointment_id) AS queue_position FROM q""")

ORACLE["stream_alerts"] = _stream("""
SELECT appointment_id, ts, triage_level, CASE WHEN triage_level <= 2 THEN 'critical' ELSE 'warning' END AS severity
FROM st WHERE triage_level <= 3""")

ORACLE["stream_hourly"] = _stream("""
SELECT date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, count(*) AS count
FROM st GROUP BY 1""")

ORACLE["stream_attribution_join"] = _stream("""
SELECT a.appointment_id, a.ts, a.triage_level, r.ts + INTERVAL 5 MINUTE AS ready_ts, true AS shap_ready
FROM st a JOIN st r ON a.appointment_id = r.event_id AND r.event_type = 'view'
 AND r.ts + INTERVAL 5 MINUTE >= a.ts AND r.ts + INTERVAL 5 MINUTE <= a.ts + INTERVAL 1 HOUR""")

ORACLE["stream_attribution_left"] = _stream(f"""
, vals AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
best AS (SELECT vec_id, {fname('pos', SERVICE_FEATURES)} AS top_feature, v AS top_impact FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, pos DESC) AS rn FROM vals) WHERE rn = 1)
SELECT a.appointment_id, a.ts, a.triage_level, r.ts + INTERVAL 5 MINUTE AS ready_ts, r.event_id IS NOT NULL AS shap_ready,
       b.top_feature, b.top_impact
FROM st a LEFT JOIN st r ON a.appointment_id = r.event_id AND r.event_type = 'view'
LEFT JOIN best b ON b.vec_id = r.event_id""")

ORACLE["csv_roundtrip"] = ORACLE["hybrid_decision"]  # the decisions, written and read back
ORACLE["vector_roundtrip"] = "SELECT vec_id, embedding, 4 * len(embedding) AS n_bytes FROM embeddings"

ORACLE["triage_log_sql"] = _on_log("""
SELECT id, appointment_id, triage_level, confidence, rl_action, timestamp, arrival_time, status, token_number,
       priority_score, estimated_wait_minutes
FROM log ORDER BY timestamp DESC, id""", 168)

ORACLE["parse_report"] = with_views(f"""
SELECT count(*) AS n_lines, count(*) FILTER (WHERE ESI IS NULL) AS n_missing_target,
       count(*) FILTER (WHERE ESI IS NOT NULL AND NOT (ESI BETWEEN 1 AND 5)) AS n_out_of_range,
       count(*) FILTER (WHERE ESI BETWEEN 1 AND 5) AS n_kept
FROM ({parse_sql(LAYOUT_A)})""", "raw_lines")

ORACLE["hourly_series"] = _on_log("""
SELECT date_trunc('hour', timestamp) AS hour_start, count(*) AS count FROM log GROUP BY 1 ORDER BY 1""")

ORACLE["hybrid_report"] = _on_dec("""
, m AS (
  SELECT coalesce(count(*) FILTER (WHERE Source = 'RL_Agent') * 100.0 / nullif(count(*), 0), 0.0) AS rl,
         coalesce(count(*) FILTER (WHERE ESI <= 2 AND Final_Action IN (0, 1)) * 100.0
                  / nullif(count(*) FILTER (WHERE ESI <= 2), 0), 0.0) AS cm,
         coalesce(count(*) FILTER (WHERE ESI >= 4 AND Final_Action IN (2, 3)) * 100.0
                  / nullif(count(*) FILTER (WHERE ESI >= 4), 0), 0.0) AS ot,
         coalesce(count(*) FILTER (WHERE (ESI <= 2 AND Final_Action IN (2, 3)) OR (ESI = 3 AND Final_Action = 2)
                                         OR (ESI >= 4 AND Final_Action = 1)) * 100.0 / nullif(count(*), 0), 0.0) AS acc
  FROM decf)
SELECT CAST(line_no AS INTEGER) AS line_no, value FROM (
  SELECT 0 AS line_no, 'Hybrid System Evaluation Report' AS value
  UNION ALL SELECT 1, repeat('=', 31)
  UNION ALL SELECT 2, printf('RL Interventions: %.1f%%', rl) FROM m
  UNION ALL SELECT 3, printf('Critical Miss Rate: %.2f%%', cm) FROM m
  UNION ALL SELECT 4, printf('Over-Triage Rate: %.2f%%', ot) FROM m
  UNION ALL SELECT 5, printf('Overall Accuracy: %.2f%%', acc) FROM m)""")

# ---- the feed: repeats, disorder, several micro-batches ---------------------------

FEED = f"""
WITH ev AS (SELECT event_id, event_id // 3 AS appointment_id, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'view' THEN 'ready' WHEN 'error' THEN 'discharge' ELSE 'arrival' END AS kind, user_id AS patient_id,
       CAST(1 + (user_id + {K}) % 5 AS INTEGER) AS triage_level,
       CAST(floor(date_diff('minute', TIMESTAMP '2024-01-01', CAST(ts AS TIMESTAMP)) * 4 / 43200.0) AS INTEGER)
         + CASE WHEN event_id % 11 = 5 THEN 3 WHEN event_id % 7 = 3 THEN 1 ELSE 0 END AS due FROM events),
feed AS (SELECT * EXCLUDE (due), greatest(0, least(3, due)) AS batch FROM ev
         UNION ALL SELECT * EXCLUDE (due), greatest(0, least(3, due + 1)) FROM ev WHERE event_id % 5 = 2),
latest AS (SELECT batch, date_trunc('millisecond', max(ts)) AS top FROM feed GROUP BY batch),
taken AS (SELECT f.* FROM feed f WHERE NOT coalesce(f.ts <= (SELECT max(top) FROM latest l WHERE l.batch <= f.batch - 2) - INTERVAL 2 HOUR, false))"""

ORACLE["feed_first_events"] = FEED + """
SELECT appointment_id, event_id, ts, kind, patient_id, triage_level FROM (
  SELECT *, row_number() OVER (PARTITION BY appointment_id ORDER BY ts, event_id) AS rn FROM feed) WHERE rn = 1"""

ORACLE["feed_dedupe"] = FEED + """
SELECT DISTINCT event_id, appointment_id, ts, kind FROM taken"""

ORACLE["feed_hourly"] = FEED + """
, hours AS (SELECT *, date_trunc('hour', ts) AS hour_start FROM feed)
SELECT hour_start, hour_start + INTERVAL 1 HOUR AS hour_end, count(*) AS count FROM hours h
WHERE NOT coalesce(hour_start + INTERVAL 1 HOUR <= (SELECT max(top) FROM latest l WHERE l.batch <= h.batch - 2) - INTERVAL 2 HOUR, false)
GROUP BY 1"""

ORACLE["feed_late_rows"] = FEED + """
SELECT f.batch, f.kind, count(*) AS n_rows, count(*) - any_value(coalesce(t.n, 0)) AS n_refused, any_value(t.first_taken) AS first_taken
FROM feed f LEFT JOIN (SELECT batch, kind, count(*) AS n, min(ts) AS first_taken FROM taken GROUP BY 1, 2) t
  ON t.batch = f.batch AND t.kind = f.kind GROUP BY 1, 2"""

ORACLE["feed_live_queue"] = FEED + """
, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY appointment_id ORDER BY ts, event_id) AS rn
                       FROM taken WHERE kind = 'arrival') WHERE rn = 1),
r AS (SELECT appointment_id, max(ts) AS ready_at FROM taken WHERE kind = 'ready' GROUP BY 1),
q AS (SELECT a.appointment_id, a.patient_id, a.ts AS arrived_at, a.triage_level,
             (6 - CAST(a.triage_level AS BIGINT)) * 100000 + CAST(floor(epoch(a.ts) / 60) AS BIGINT) AS priority_score,
             r.ready_at IS NOT NULL AS shap_ready, r.ready_at
      FROM a LEFT JOIN r USING (appointment_id)
      WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.appointment_id = a.appointment_id AND t.kind = 'discharge')
        AND a.ts + INTERVAL 20 DAY > (SELECT max(top) FROM latest) - INTERVAL 2 HOUR)
SELECT *, row_number() OVER (ORDER BY priority_score DESC, appointment_id) AS queue_position FROM q"""

# ---- occupancy under capacity, one move after the other ----------------------------

ORACLE["occupancy_capped"] = "WITH RECURSIVE " + with_views("", "bed_moves").removeprefix("WITH ").rstrip() + """,
m AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY ts, move_id) AS rn,
             CASE area WHEN 'bed' THEN 30 WHEN 'waiting' THEN 50 ELSE 20 END AS cap FROM bed_moves),
walk(area, rn, x) AS (
  SELECT DISTINCT area, 0::BIGINT, 0::BIGINT FROM m
  UNION ALL SELECT m.area, m.rn, least(m.cap, greatest(0, x + m.delta))::BIGINT FROM walk JOIN m ON m.area = walk.area AND m.rn = walk.rn + 1)
SELECT m.move_id, m.area, CAST(m.delta AS INTEGER) AS delta, w.x AS occupancy,
       CASE WHEN m.delta > 0 THEN p.x + 1 = w.x END AS admitted
FROM m JOIN walk w ON w.area = m.area AND w.rn = m.rn JOIN walk p ON p.area = m.area AND p.rn = m.rn - 1"""

FLOW = """
, moves AS (
  SELECT row_id, CASE Final_Action WHEN 3 THEN 'critical' WHEN 2 THEN 'acute' WHEN 1 THEN 'fast' END AS area, 1 AS delta FROM decf
  UNION ALL SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'fast' ELSE 'acute' END, -1 FROM decf WHERE row_id % 3 <> 0),
m AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY row_id, delta DESC) AS rn,
             CASE area WHEN 'critical' THEN 10 WHEN 'acute' THEN 30 ELSE 20 END AS cap FROM moves WHERE area IS NOT NULL),
walk(area, rn, x) AS (
  SELECT DISTINCT area, 0::BIGINT, 0::BIGINT FROM m
  UNION ALL SELECT m.area, m.rn, least(m.cap, greatest(0, x + m.delta))::BIGINT FROM walk JOIN m ON m.area = walk.area AND m.rn = walk.rn + 1),
costed AS (
  SELECT d.*, coalesce(o.area_full, false) AS area_full FROM decf d LEFT JOIN (
    SELECT m.row_id, p.x = m.cap AS area_full FROM m JOIN walk p ON p.area = m.area AND p.rn = m.rn - 1 WHERE m.delta = 1) o
  ON d.row_id = o.row_id)""" + COST[COST.index(",\nrewarded AS"):]

ORACLE["decision_cost_flow"] = "WITH RECURSIVE " + _on_dec(FLOW + """
SELECT Source, Final_Action, count(*) AS decisions, count(*) FILTER (WHERE area_full) AS refused,
       CAST(sum(reward) AS BIGINT) AS total_reward FROM rewarded GROUP BY 1, 2""").lstrip().removeprefix("WITH ")

ORACLE["policy_table_flow"] = "WITH RECURSIVE " + _on_dec(FLOW + """,
per AS (SELECT Sup_Pred, area_full, Final_Action, avg(reward) AS mean_reward, count(*) AS n
        FROM rewarded GROUP BY 1, 2, 3)
SELECT Sup_Pred, area_full, Final_Action AS best_action, mean_reward, n AS support
FROM (SELECT *, row_number() OVER (PARTITION BY Sup_Pred, area_full ORDER BY mean_reward DESC, Final_Action) AS rn
      FROM per) WHERE rn = 1""").lstrip().removeprefix("WITH ")

ORACLE["policy_fitted_q"] = "WITH RECURSIVE " + _on_dec(FLOW + """,
steps AS (SELECT Sup_Pred, area_full, Final_Action, reward, lead(Sup_Pred) OVER e AS next_pred, lead(area_full) OVER e AS next_full
  FROM (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 100 AS episode FROM rewarded) WINDOW e AS (PARTITION BY episode ORDER BY row_id)),
sweep AS (
  SELECT 1 AS k, Sup_Pred, area_full, Final_Action, count(*) AS support, avg(reward) AS q FROM steps GROUP BY ALL
  UNION ALL
  SELECT c.k + 1, s.Sup_Pred, s.area_full, s.Final_Action, count(*), avg(s.reward + 0.99 * coalesce(v.q, 0))
  FROM (SELECT max(k) AS k FROM sweep) c JOIN steps s ON c.k < 100 LEFT JOIN (SELECT Sup_Pred, area_full, max(q) AS q FROM sweep GROUP BY ALL) v
    ON v.Sup_Pred = s.next_pred AND v.area_full = s.next_full GROUP BY ALL)
SELECT Sup_Pred, area_full, Final_Action, support, round(q, 5) AS value,
       Final_Action = first_value(Final_Action) OVER (PARTITION BY Sup_Pred, area_full ORDER BY q DESC, Final_Action) AS best
FROM sweep WHERE k = 100""").lstrip().removeprefix("WITH ")

# ---- file order --------------------------------------------------------------------

NUMBERED = parse_sql(LAYOUT_A, src="(SELECT value, row_number() OVER (ORDER BY value) - 1 AS row_id FROM raw_lines)", extra="row_id, ")

ORACLE["numbered_lines"] = with_views(f"SELECT row_id, Age, Pulse, ESI, Chief_complain FROM ({NUMBERED})", "raw_lines")

ORACLE["fairness_by_line"] = _on_dec(f"""
, lines AS (SELECT row_id, Age, ESI FROM ({NUMBERED}) WHERE ESI IS NOT NULL),
res AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, Final_Action, Is_Critical_Miss FROM decf),
fair AS (SELECT lines.*, res.* EXCLUDE (row_id), CASE WHEN Age < 18 THEN 'Pediatric (<18)' WHEN Age > 65 THEN 'Geriatric (>65)' ELSE 'Adult (18-65)' END AS "group" FROM lines JOIN res USING (row_id)),
per AS (SELECT 'Age_Group' AS dimension, "group", count(*) FILTER (WHERE ESI IN (1, 2)) AS n_critical,
               avg(CASE WHEN ESI IN (1, 2) THEN CAST(Is_Critical_Miss AS DOUBLE) END) * 100 AS critical_miss_rate,
               count(*) FILTER (WHERE ESI IN (4, 5)) AS n_low_acuity,
               avg(CASE WHEN ESI IN (4, 5) THEN CAST(Final_Action = 3 AS DOUBLE) END) * 100 AS over_triage_rate FROM fair GROUP BY 2)
SELECT * FROM per""", "raw_lines")

ORACLE["tree_attribution"] = with_views(f"""
SELECT ESI, 9 AS n_contributions, true AS adds_up, true AS constant_has_none, true AS all_named
FROM ({parse_sql(LAYOUT_A)}) WHERE ESI IS NOT NULL AND ESI BETWEEN 1 AND 5""", "raw_lines")

ORACLE["canonical_vitals"] = with_views(f"""
SELECT reading_id, CAST(12 AS INTEGER) AS n_keys, CAST(patient_id AS DOUBLE) AS patient_id, 1.0::DOUBLE AS note,
       {_san('SBP')} AS SBP, {_san('HR')} AS HR, {_san('PainScale')} AS PainScale FROM vitals_readings""", "vitals_readings")

ORACLE["level_labels"] = with_views("""
SELECT level, CASE level WHEN 1 THEN 'RED (Resuscitation)' WHEN 2 THEN 'ORANGE (Emergent)' WHEN 3 THEN 'YELLOW (Urgent)'
       WHEN 4 THEN 'GREEN (Less Urgent)' WHEN 5 THEN 'BLUE (Non-Urgent)' ELSE 'Level ' || level END AS label, count(*) AS count
FROM (SELECT esi_level + id % 3 AS level FROM triage_results) GROUP BY 1, 2""", "triage_results")

ORACLE["keyed_update"] = with_views("""
SELECT appointment_id, CAST(CASE WHEN appointment_id % 2500 = 17 THEN 1 ELSE esi_level END AS INTEGER) AS esi_level, rl_action,
       created_at + CASE WHEN appointment_id % 2500 = 17 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS created_at
FROM triage_results
UNION ALL SELECT -1, esi_level, rl_action, created_at FROM triage_results WHERE appointment_id = 3""", "triage_results")
