"""Contributions of tree models against all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from edspark.operators import tree_attribution as ta


def frame(spark, n=300):
    r = np.random.default_rng(3)
    rows = [(float(a), float(b), float(c), "xyz"[int(d)], float(a * 2 + (b > 0) * c + (d == 1) * 3), int(a + c > 0) + int(b > 1))
            for a, b, c, d in zip(r.normal(size=n), r.normal(size=n), r.normal(size=n), r.integers(3, size=n), strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d string, y double, k int")
    df = StringIndexer(inputCol="d", outputCol="di").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "c", "di"], outputCol="features").transform(df).cache()


def expected(nodes, at, x, known):
    """Mean prediction when only the features in ``known`` are followed."""
    node = nodes[at]
    if node["left"] < 0:
        return node["value"]
    if node["feature"] in known:
        met = bool(ta._met(np.array([x[node["feature"]]]), [node["near"]])[0])
        return expected(nodes, node["left"] if met else node["right"], x, known)
    return sum(nodes[c]["count"] / node["count"] * expected(nodes, c, x, known) for c in (node["left"], node["right"]))


def by_subsets(nodes, x, n):
    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                w = math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n)
                out[i] += w * (expected(nodes, 0, x, {*s, i}) - expected(nodes, 0, x, set(s)))
    return out


def test_one_tree_equals_the_sum_over_all_subsets(spark, monkeypatch):
    df = frame(spark)
    model = DecisionTreeRegressor(labelCol="y", maxDepth=5).fit(df)
    held = {}
    leaves = ta._leaves
    monkeypatch.setattr(ta, "_leaves", lambda nodes, w: held.update(nodes=nodes) or leaves(nodes, w))
    tree = ta.tree_model(spark, model)
    x = np.array([r["features"].toArray() for r in df.limit(25).collect()])
    got = ta.contributions(tree, x)
    for row, c in zip(x, got, strict=True):
        assert c == pytest.approx(by_subsets(held["nodes"], row, 4), abs=1e-9)
    assert tree.base == pytest.approx(expected(held["nodes"], 0, x[0], set()))


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "tree_class", "forest_class", "boosted_class"])
def test_contributions_add_up(spark, kind):
    df = frame(spark)
    learner, target, index = {
        "tree": (DecisionTreeRegressor(labelCol="y"), "prediction", None),
        "forest": (RandomForestRegressor(labelCol="y", numTrees=6, seed=1), "prediction", None),
        "boosted": (GBTRegressor(labelCol="y", maxIter=4, seed=1), "prediction", None),
        "tree_class": (DecisionTreeClassifier(labelCol="k"), "probability", 1),
        "forest_class": (RandomForestClassifier(labelCol="k", numTrees=6, seed=1), "probability", 2),
        "boosted_class": (GBTClassifier(labelCol="two", maxIter=4, seed=1), "rawPrediction", None),
    }[kind]
    df = df.withColumn("two", (F.col("k") > 0).cast("int"))
    model = learner.fit(df)
    rows = ta.tree_attribution(model.transform(df), model, class_index=index).collect()
    assert len(rows) == 300
    for r in rows:
        want = r[target][index] if index is not None else r[target]
        if kind == "boosted_class":  # Spark's raw prediction of class 1 is the margin
            want = r[target][1]
        assert sum(r["contributions"]) + r["contributions_base"] == pytest.approx(want, abs=1e-9)


def test_names_and_bounds(spark, monkeypatch):
    df = frame(spark)
    assert ta.slot_names(df)[:3] == ["a", "b", "c"] and len(ta.slot_names(df)) == 4
    model = DecisionTreeRegressor(labelCol="y", maxDepth=3).fit(df)
    monkeypatch.setattr(ta, "MAX_NODES", 2)
    with pytest.raises(ValueError):
        ta.tree_model(spark, model)
    monkeypatch.undo()
    assert ta.tree_attribution(model.transform(df.limit(0)), model).count() == 0


def test_game_of_one_leaf():
    """Efficiency and the null player."""
    table = ta.shapley_table(np.array([0.5, 0.25, 1.0]), 8.0)
    for pattern in range(8):
        met = [pattern >> i & 1 for i in range(3)]
        assert table[pattern].sum() == pytest.approx(8.0 * math.prod(met) - 8.0 * 0.125)
    assert table[7][2] == 0 and ta.shapley_table(np.zeros(0), 3.0).shape == (1, 0)
