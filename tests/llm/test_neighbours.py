import math
from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from edspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank string"


def plain(rows, k, every):
    good = {}
    for i, x, *_ in rows:
        if i is None or not x or any(c is None or not math.isfinite(c) for c in x) or not any(x):
            continue
        x = [float(np.float32(c)) for c in x]
        good[i] = min(good.get(i, x), x)
    out = []
    for q, x in good.items():
        if q % every == 0:
            near = sorted((-reduce(add, (a * b for a, b in zip(x, y))), i) for i, y in good.items() if i != q and len(y) == len(x))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def data(n, seed=0, dims=16):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dims).astype(np.float32).tolist(), "x") for i in range(n)]
    hot = rows[3][1]
    rows += [(1000 + i, hot, "x") for i in range(120)]  # one very common vector
    rows += [(2000 + i, (np.array(hot) + 1e-4 * r.normal(size=dims)).astype(np.float32).tolist(), "x") for i in range(40)]
    return rows


@pytest.mark.parametrize("blocks", [(1024, 4096), (7, 13)])
@pytest.mark.parametrize("k", [1, 20])
def test_against_brute_force(spark, blocks, k):
    rows = data(150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = neighbours.nearest(df, F.col("id") % 5 == 0, k, query_rows=blocks[0], candidate_rows=blocks[1])
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == plain(rows, k, 5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (5, [1e30, -1e30], "x"), (10, [1e-38, 0.0], "x"), (15, None, "x"), (20, [0.0, 0.0], "x"),
            (25, [nan, 1.0], "x"), (30, [inf, 1.0], "x"), (35, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (40, [], "x"),
            (45, [1.0, 2.0, 3.0], "x"), (50, [3.0, 2.0, 1.0], "x"), (55, [1.0, 2.0], "x"), (55, [1.0, 2.0], "x"), (60, [2.0, 1.0], "x"),
            (60, [0.5, 9.0], "x"), (65, [-1.0, -2.0], "x")]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0, 4).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain(rows, 4, 5)
    assert {r["query_id"] for r in got} == {0, 5, 10, 45, 50, 55, 60, 65}


def test_empty_and_alone(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0], "x")], SCHEMA), F.lit(True)).count() == 0


@pytest.mark.parametrize("dims", [3, 64, 2500])
def test_bounds_hold(dims):
    r = np.random.default_rng(dims)
    x, y = r.normal(size=(40, dims)) * r.exponential(size=(40, 1)) ** 6, r.normal(size=(50, dims))
    low, high = neighbours.tile_bounds(neighbours.quantise(x), neighbours.quantise(y))
    true = x @ y.T
    assert (low <= true).all() and (true <= high).all()
    assert ((high - low) < 0.1 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)).all()
