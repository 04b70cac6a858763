"""DuckDB text of the bindings in :mod:`edspark.sources.fixtures`.

The oracle queries run on DuckDB with the raw test tables registered as views;
``with_views`` prefixes a query with the logical views it names.
"""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

VITALS = (
    "CASE WHEN event_type = 'error' THEN 'not json' ELSE printf('{\"%s\": %d, \"SBP\": %d, \"O2Sat\": %d}', "
    "CASE WHEN event_type = 'signup' THEN 'HR' ELSE 'Pulse' END, 40 + " + K + ", "
    "CASE WHEN event_id % 50 = 0 THEN 0 ELSE 70 + event_id % 90 END, 85 + " + K + " % 16) END"
)

PRIORITY = "((6 - CAST(triage_level AS BIGINT)) * 100000 + CAST(floor(epoch(created_at) / 60) AS BIGINT))"

COLOUR = ("CASE triage_level WHEN 1 THEN 'RED' WHEN 2 THEN 'ORG' WHEN 3 THEN 'YEL' "
          "WHEN 4 THEN 'GRN' WHEN 5 THEN 'BLU' ELSE 'UNK' END")


def _code(key: str) -> str:
    return f"(chr(CAST(65 + ({key}) % 26 AS INTEGER)) || lpad(CAST(({key}) // 26 AS VARCHAR), 3, '0'))"


VIEWS: dict[str, str] = {
    "appointments0": """
        SELECT o_orderkey AS appointment_id, o_custkey AS patient_id,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS triage_level,
               CASE o_orderstatus WHEN 'O' THEN 'SCHEDULED' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((o_orderkey * 3) % 43200 AS BIGINT)) AS created_at,
               CASE WHEN o_orderkey % 9 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00'
                    + to_minutes(CAST((o_orderkey * 3) % 43200 + o_orderkey % 6 * 15 AS BIGINT)) END AS scheduled_time
        FROM orders""",
    "appointments": f"""
        SELECT *, CASE WHEN appointment_id % 4 <> 0 THEN {PRIORITY} END AS priority_score
        FROM appointments0""",
    "patients": """
        SELECT c_custkey AS patient_id, split_part(c_name, '#', 1) AS first_name,
               split_part(c_name, '#', 2) AS last_name, c_mktsegment AS group_label
        FROM customer""",
    "triage_results": f"""
        SELECT event_id AS id, event_id AS appointment_id,
               CAST(1 + (user_id + {K}) % 5 AS INTEGER) AS esi_level,
               ({K} % 65 + 35) / 100.0 AS supervised_confidence,
               CASE event_type WHEN 'click' THEN 'Assign to Bed' WHEN 'view' THEN 'Move to Waiting Room'
                               WHEN 'purchase' THEN 'Direct to Fast Track' END AS rl_action,
               CASE WHEN event_id % 3 <> 0 THEN printf('[%d]', {K}) END AS shap_values,
               {VITALS} AS vitals, CAST(1 + (user_id + {K}) % 5 AS INTEGER) AS ktas_level,
               'v' || (event_id % 3 + 1) AS model_version, CAST(ts AS TIMESTAMP) AS created_at
        FROM events""",
    "priority_tokens": f"""
        SELECT appointment_id, printf('%s-%04d', {COLOUR}, appointment_id) AS token_number,
               triage_level, priority_score,
               CAST(CASE WHEN appointment_id % 7 <> 0 THEN appointment_id % 120 END AS INTEGER) AS estimated_wait_minutes,
               created_at AS issued_at, 'ACTIVE' AS status
        FROM appointments WHERE appointment_id % 4 <> 0""",
    "attributions": """
        SELECT e.vec_id AS row_id, CAST(v.ts AS TIMESTAMP) AS created_at, CAST(e.embedding AS DOUBLE[]) AS payload
        FROM embeddings e JOIN events v ON e.vec_id = v.event_id""",
    "decisions_input": """
        SELECT vec_id AS row_id,
               [abs(CAST(embedding[1] AS DOUBLE)) / t, abs(CAST(embedding[2] AS DOUBLE)) / t,
                abs(CAST(embedding[3] AS DOUBLE)) / t, abs(CAST(embedding[4] AS DOUBLE)) / t,
                abs(CAST(embedding[5] AS DOUBLE)) / t] AS probs,
               CAST(label % 5 + 1 AS INTEGER) AS acuity, CAST(label % 5 AS INTEGER) AS policy_action
        FROM (SELECT *, abs(CAST(embedding[1] AS DOUBLE)) + abs(CAST(embedding[2] AS DOUBLE))
                        + abs(CAST(embedding[3] AS DOUBLE)) + abs(CAST(embedding[4] AS DOUBLE))
                        + abs(CAST(embedding[5] AS DOUBLE)) AS t FROM embeddings)""",
    "vitals_readings": f"""
        SELECT event_id AS reading_id, user_id AS patient_id, CAST(ts AS TIMESTAMP) AS ts, {VITALS} AS vitals,
               CASE event_type WHEN 'click' THEN 'Ambulance' WHEN 'view' THEN 'Public Transport'
                               WHEN 'purchase' THEN 'Walk-in' WHEN 'signup' THEN 'Other' END AS arrival_mode
        FROM events""",
    "nested_attributions": """
        SELECT row_id, created_at,
               [payload[1:16], payload[17:32], payload[33:48], payload[49:64]] AS payload
        FROM attributions""",
    "raw_lines": f"""
        SELECT l_linestatus,
          lpad(CAST(l_orderkey AS VARCHAR), 10, '0')
          || CASE WHEN l_suppkey % 11 = 0 THEN '    ' WHEN l_suppkey % 13 = 0 THEN '  -9'
                  ELSE lpad(CAST(l_partkey % 100 AS VARCHAR), 4, ' ') END
          || lpad(CAST(l_suppkey AS VARCHAR), 16, '0')
          || CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE lpad(CAST(l_linenumber % 4 + 1 AS VARCHAR), 1, ' ') END
          || lpad(CAST(l_partkey AS VARCHAR), 16, '0')
          || lpad(CAST(l_partkey % 40 + 970 AS VARCHAR), 4, ' ')
          || CASE WHEN l_orderkey % 17 = 0 THEN ' -9' ELSE lpad(CAST(l_orderkey % 100 + 50 AS VARCHAR), 3, ' ') END
          || lpad(CAST(l_suppkey % 20 + 10 AS VARCHAR), 3, ' ')
          || CASE WHEN l_partkey % 19 = 0 THEN '   ' ELSE lpad(CAST(l_partkey % 100 + 80 AS VARCHAR), 3, ' ') END
          || lpad(CAST(l_orderkey % 50 + 50 AS VARCHAR), 3, ' ')
          || lpad(CAST(l_linenumber % 13 + 88 AS VARCHAR), 3, ' ')
          || lpad(CAST(l_linenumber % 7 + 1 AS VARCHAR), 2, ' ')
          || rpad(' ' || {_code('l_partkey')} || ' ' || {_code('l_partkey + 7')}
                  || ' x' || CAST(l_orderkey % 1000 AS VARCHAR) || ' Q1', 106, ' ')
          || CASE WHEN CAST(trunc(l_quantity) AS INTEGER) % 9 = 0 THEN '  '
                  ELSE lpad(CAST(CAST(trunc(l_quantity) AS INTEGER) % 11 AS VARCHAR), 2, ' ') END
          AS value
        FROM lineitem""",
    "code_dictionary": f"""
        SELECT CASE WHEN p_partkey % 2 = 1
                    THEN substr({_code('p_partkey')}, 1, 3) || '.' || substr({_code('p_partkey')}, 4)
                    ELSE {_code('p_partkey')} END AS code,
               p_name AS description
        FROM part""",
    "complaints": "SELECT doc_id, text AS complaint FROM documents",
    "request_log": """
        SELECT event_id AS request_id, event_type AS endpoint, CAST(ts AS TIMESTAMP) AS ts,
               value AS latency_ms, event_type <> 'error' AS passed
        FROM events""",
    "audit_visits": """
        SELECT c_custkey AS row_id,
               CASE WHEN c_custkey % 37 <> 0 THEN CAST(CAST(trunc(c_acctbal) AS BIGINT) % 100 AS DOUBLE) END AS Age,
               c_nationkey % 3 AS Sex, c_nationkey % 6 AS Race,
               CASE WHEN c_custkey % 41 <> 0 THEN CAST(c_custkey % 5 + 1 AS DOUBLE) END AS ESI
        FROM customer""",
    "bed_moves": """
        SELECT event_id AS move_id, CAST(ts AS TIMESTAMP) AS ts,
               CASE WHEN event_type IN ('click', 'signup') THEN 'bed'
                    WHEN event_type IN ('view', 'error') THEN 'waiting' ELSE 'fast_track' END AS area,
               CASE WHEN event_id % 4 = 3 THEN -1 ELSE 1 END AS delta
        FROM events""",
}

DEPENDS = {"nested_attributions": ["attributions"], "appointments": ["appointments0"], "priority_tokens": ["appointments0", "appointments"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views (and their dependencies)."""
    order: list[str] = []
    for n in names:
        for d in DEPENDS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return f"WITH {ctes}\n{sql}"
