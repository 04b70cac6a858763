"""Every registered query against its DuckDB oracle (rows-only for the
fitted models), plus the driver contract."""

import pytest

from conftest import SF_MID, SF_SMALL
from edspark.plans.catalog import QUERIES
from edspark.plans.compare import compare_close as compare, duckdb_connection
from edspark.plans.oracle import ORACLE

SLOW = {"acuity_classifier"}


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SLOW))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    if name in ORACLE:
        ok, det = compare(df, con, ORACLE[name])
        assert ok, det
    else:
        assert df.count() > 0


def test_flagship_at_sf001(spark):
    con = duckdb_connection(SF_MID)
    for name in ("daily_drift", "handoff_summary", "active_queue", "code_descriptions"):
        ok, det = compare(QUERIES[name](spark, SF_MID), con, ORACLE[name])
        assert ok, (name, det)


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 80
