"""Plan checks: filters and column pruning reach the scan, no row-at-a-time
Python, no Cartesian product except one-row broadcasts."""

from conftest import SF_SMALL
from edspark.plans.catalog import QUERIES


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_triage_log_pushes_filter_and_prunes(spark):
    plan = _plan(QUERIES["triage_log_window"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in plan
    assert "o_totalprice" not in plan


def test_no_python_udfs_outside_blob_codec(spark):
    for name in ("triage_log_window", "handoff_patients", "hybrid_decision", "code_descriptions", "vitals_history",
                 "attribution_mean_abs", "fairness_rates", "latency_report", "sanitize_vitals"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_no_cartesian_product(spark):
    for name in ("kpi_cards", "handoff_summary", "confidence_histogram", "ed_state_vector", "action_distribution"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name


def test_tables_are_read_as_stored(spark):
    from edspark.plans.catalog import QUERIES

    for name in ("shock_index", "daily_drift", "active_queue", "fairness_input", "wait_band"):
        assert "RoundRobin" not in _plan(QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_history_limits_before_its_one_shuffle(spark):
    from edspark.operators.history import sparkline_stats, vitals_history, vitals_points
    from edspark.sources import fixtures as fx

    plan = _plan(vitals_history(vitals_points(fx.vitals_readings(spark, "/root/testdata/sf0.001")), 20))
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan and "rangepartitioning" not in plan
    stats = sparkline_stats(vitals_history(vitals_points(fx.vitals_readings(spark, "/root/testdata/sf0.001")), 20))
    assert "rangepartitioning" not in _plan(stats)


def test_shares_do_not_rerun_the_log(spark):
    from edspark.plans.catalog import QUERIES

    for name in ("action_distribution", "confidence_histogram"):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Subquery" not in plan and plan.split("== Initial Plan ==")[0].count("Scan parquet") <= 3, name


def test_label_codes_are_not_numbered_in_one_task(spark):
    from pyspark.sql import functions as F

    from edspark.operators.features import label_encode

    df = spark.range(100).select((F.col("id") % 7).alias("ESI"))
    assert "Window" not in _plan(label_encode(df, "ESI"))


def test_json_is_parsed_once_a_row(spark):
    """from_json stands once per parsed text in the optimised plan, and the
    texts of events are written once."""
    def optimised(name):
        return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()

    for name in ("watch_list", "handoff_patients", "handoff_alerts", "canonical_vitals"):
        assert optimised(name).count("from_json(") <= (2 if name == "canonical_vitals" else 1), name
    plan = optimised("result_detail")
    assert plan.count("from_json(") == 4  # vitals, and the payload as each of its forms
    plan = optimised("arrival_events")
    assert plan.count("StructsToJsonEvaluator(") == 1 and plan.count("from_json(") == 1
