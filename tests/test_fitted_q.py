"""Fitted Q iteration (L7) against value iteration by plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from edspark.operators import decisions as dec

SCHEMA = "state string, action int, reward double, next_state string"


def by_hand(rows, gamma, sweeps):
    q = dict.fromkeys({(s, a) for s, a, _, _ in rows}, 0.0)
    for _ in range(sweeps):
        ahead = defaultdict(lambda: float("-inf"))
        for (s, _), v in q.items():
            ahead[s] = max(ahead[s], v)
        seen = defaultdict(list)
        for s, a, r, n in rows:
            seen[s, a].append(r + gamma * (ahead[n] if n in ahead else 0.0))
        q = {k: sum(v) / len(v) for k, v in seen.items()}
    return q


def log(n, seed):
    r = random.Random(seed)
    return [(r.choice("abc"), r.randrange(3), float(r.randrange(-20, 20)), r.choice(["a", "b", "c", "unseen", None])) for _ in range(n)]


@pytest.mark.parametrize("sweeps", [1, 2, 11, 25])
def test_equals_value_iteration(spark, sweeps):
    rows = log(200, sweeps)
    got = dec.fitted_q(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.9, sweeps, together=4).collect()
    want = by_hand(rows, 0.9, sweeps)
    assert {(r["state"], r["action"]): r["value"] for r in got} == pytest.approx(want)
    assert sum(r["n"] for r in got) == len(rows)
    best = {r["state"]: r["action"] for r in got if r["best"]}
    assert best == {s: min((-v, a) for (t, a), v in want.items() if t == s)[1] for s in "abc"}


def test_ends_once_values_stand_and_ties_take_the_lowest_action(spark):
    rows = [("a", 1, 2.0, "a"), ("a", 0, 2.0, "a"), ("b", 1, 0.0, "a")]
    got = {(r["state"], r["action"]): r for r in dec.fitted_q(spark.createDataFrame(rows, SCHEMA), 0.5, 1000).collect()}
    assert got["a", 0]["value"] == pytest.approx(4) and got["b", 1]["value"] == pytest.approx(2)
    assert got["a", 0]["best"] and not got["a", 1]["best"] and got["b", 1]["best"]


def test_looking_ahead_changes_the_choice(spark):
    """Action 1 costs now and leads to where reward is."""
    rows = [("low", 0, 1.0, "low"), ("low", 1, -1.0, "high"), ("high", 0, 10.0, "high")]
    df = spark.createDataFrame(rows, SCHEMA)
    best = lambda sweeps: {r["state"]: r["action"] for r in dec.fitted_q(df, 0.9, sweeps).collect() if r["best"]}
    assert best(1)["low"] == 0 and best(5)["low"] == 1


def test_transitions_end_with_the_episode(spark):
    df = spark.range(7).select((F.col("id") * 2).alias("row_id"), (F.col("id") % 3).cast("int").alias("level"),
                               F.lit(1).alias("Final_Action"), F.col("id").cast("double").alias("reward")).repartition(4)
    got = sorted(dec.logged_transitions(df, ["level"], episode=3).collect(), key=lambda r: r["reward"])
    assert [r["state"]["level"] for r in got] == [0, 1, 2, 0, 1, 2, 0]
    assert [r["next_state"] and r["next_state"]["level"] for r in got] == [1, 2, None, 1, 2, None, None]


def test_no_transition(spark):
    assert dec.fitted_q(spark.createDataFrame([], SCHEMA)).count() == 0
