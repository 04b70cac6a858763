"""Occupancy between bounds against a plain loop."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edspark.operators import sequence as sq
from edspark.operators.decisions import decision_cost
from edspark.operators.history import occupancy_capped


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-5, 5), st.integers(0, 8)), min_size=1, max_size=40), st.integers(-20, 20))
def test_prefixes_equal_a_loop(rows, start):
    step, low, high = (np.array(x, np.int64) for x in zip(*[(d, a, a + w) for d, a, w in rows], strict=True))
    d, lo, hi = sq._prefixes(step, low, high)
    x = start
    for i in range(len(rows)):
        x = min(high[i], max(low[i], x + step[i]))
        assert x == min(hi[i], max(lo[i], start + d[i]))


@pytest.mark.parametrize("partitions", [1, 7])
def test_clamped_sum_equals_a_loop(spark, partitions):
    r = np.random.default_rng(1)
    rows = [(["a", "b", None][i % 3] if i % 10 else "hot", int(x), i, "text") for i, x in enumerate(r.integers(-3, 5, 4000))]
    df = spark.createDataFrame(rows, "area string, delta int, at int, other string").repartition(5)
    out = sq.clamped_sum(df, "delta", 0, F.when(F.col("area") == "hot", 40).otherwise(9), ["at"], ["area"], start=4, num_partitions=partitions)
    got = {x["at"]: (x["running_before"], x["running"], x["running_held"], x["other"]) for x in out.collect()}
    now = {}
    for area, delta, at, _ in rows:
        before = now.get(area, 4)
        after = min(40 if area == "hot" else 9, max(0, before + delta))
        now[area] = after
        assert got[at] == (before, after, after != before + delta, "text")
    assert len(got) == len(rows) and out.columns == [*df.columns, "running_before", "running", "running_held"]


def test_admissions_are_refused_and_freed(spark):
    moves = [(i, i, "bed", d) for i, d in enumerate([1, 1, 1, -1, 1, -1, -1, -1, 1])] + [(20, 3, "x", 1)]
    df = spark.createDataFrame(moves, "move_id int, ts int, area string, delta int")
    got = [(r.occupancy, r.admitted) for r in occupancy_capped(df, F.lit(2)).filter("area = 'bed'").orderBy("move_id").collect()]
    assert got == [(1, True), (2, True), (2, False), (1, None), (2, True), (1, None), (0, None), (0, None), (1, True)]


def test_decisions_meet_full_areas(spark):
    """Ten critical places: the eleventh decision finds none, until two leave."""
    dec = spark.createDataFrame([(i, 1, 3) for i in range(14)], "row_id int, ESI int, Final_Action int")
    leave = spark.createDataFrame([(11, "critical"), (12, "critical"), (2, "fast")], "row_id int, area string")
    full = {r.row_id: (r.area_full, r.reward) for r in decision_cost(dec, discharges=leave).collect()}
    assert [full[i][0] for i in range(14)] == [False] * 10 + [True, True, False, False]
    assert full[0][1] - full[10][1] == 50
    assert [r.area_full for r in decision_cost(dec).orderBy("row_id").collect()] == [False] * 10 + [True] * 4


def test_empty(spark):
    df = spark.createDataFrame([], "area string, delta int, at int")
    assert sq.clamped_sum(df, "delta", 0, 5, ["at"], ["area"]).count() == 0
