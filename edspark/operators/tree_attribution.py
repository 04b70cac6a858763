"""Contributions of the features to a fitted tree model's prediction.

Path-dependent Shapley values: a feature that is left out of a coalition
sends a row down both sides of its splits, weighted by the training rows that
went there.  For one leaf, only the features on its path matter, and of a row
only whether it meets all the path's conditions on each of them.  So a leaf
with m path features has at most 2 ** m different contributions; they are
worked out once per leaf from the node table, and a row looks its own up.

The node table is the one that Spark writes with a model: it is read back as
a table, its size is checked, and only then is it sent to the tasks.  Rows are
scored in Arrow batches, leaf by leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edspark.session import scratch_dir

#: Bounds of what is sent to the tasks.
MAX_NODES, MAX_TABLE = 200_000, 4_000_000
#: Conditions whose rows of a batch are kept at a time.
MAX_MASKS = 4096


@dataclass
class Leaf:
    """``features``: those on the path; ``tests``: for each of them its
    conditions (kind, bound): "le" and "gt" against a threshold, "in" and
    "out" of a set; ``table``: contributions by pattern of met features, bit i
    for feature i."""

    features: list[int]
    tests: list[list[tuple]]
    table: np.ndarray


@dataclass
class TreeModel:
    leaves: list[Leaf]
    base: float  # the mean prediction over the training rows, as the trees hold it
    n_features: int


def shapley_table(fractions: np.ndarray, value: float) -> np.ndarray:
    """Contributions of a leaf's m path features for every pattern of met
    ones.  ``fractions``: the share of training rows that a left-out feature
    lets through.  The leaf's game is value * product over the features of
    (met, if in the coalition, else its share)."""
    m = len(fractions)
    met = (np.arange(1 << m)[:, None] >> np.arange(m)[None, :] & 1).astype(float)
    table = np.zeros((1 << m, m))
    # Weights of coalition sizes: k! (m - 1 - k)! / m!
    weight = np.ones(max(1, m))
    if m:
        weight[0] = 1.0 / m
        for k in range(1, m):
            weight[k] = weight[k - 1] * k / (m - k)
    for i in range(m):
        size = np.zeros((1 << m, m))  # by size, the sum over coalitions of the others
        size[:, 0] = 1.0
        for j in range(m):
            if j == i:
                continue
            grown = size * fractions[j]
            grown[:, 1:] += size[:, :-1] * met[:, j:j + 1]
            size = grown
        table[:, i] = value * (met[:, i] - fractions[i]) * (size @ weight[:m])
    return table


def _leaves(nodes: dict[int, dict], weight: float) -> Iterator[tuple[Leaf, float]]:
    """The leaves of one tree with their share of the training rows."""
    stack = [(0, {}, {}, 1.0)]
    while stack:
        at, tests, shares, reach = stack.pop()
        node = nodes[at]
        if node["left"] < 0:
            features = sorted(tests)
            table = shapley_table(np.array([shares[f] for f in features]), weight * node["value"])
            yield Leaf(features, [tests[f] for f in features], table), reach * weight * node["value"]
            continue
        f = node["feature"]
        for child, side in ((node["left"], node["near"]), (node["right"], node["far"])):
            part = nodes[child]["count"] / node["count"] if node["count"] else 0.5
            stack.append((child, {**tests, f: [*tests.get(f, []), side]}, {**shares, f: shares.get(f, 1.0) * part}, reach * part))


def _node_table(spark: SparkSession, model) -> DataFrame:
    """(tree, id, left, right, count, prediction, stats, feature, bounds,
    categories) of a tree, forest or boosted model."""
    path = scratch_dir(spark, "tree-model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    nested = "nodeData" in data.columns
    n = "nodeData." if nested else ""
    tree = F.col("treeID") if nested else F.lit(0)
    return data.select(
        tree.cast("int").alias("tree"), F.col(f"{n}id").alias("id"), F.col(f"{n}leftChild").alias("left"), F.col(f"{n}rightChild").alias("right"),
        F.col(f"{n}rawCount").cast("double").alias("count"), F.col(f"{n}prediction").alias("prediction"), F.col(f"{n}impurityStats").alias("stats"),
        F.col(f"{n}split.featureIndex").alias("feature"), F.col(f"{n}split.leftCategoriesOrThreshold").alias("bounds"),
        F.col(f"{n}split.numCategories").alias("categories"))


def tree_model(spark: SparkSession, model, class_index: int | None = None) -> TreeModel:
    """The leaves of a fitted Spark tree model.  ``class_index``: the class
    whose probability is explained (trees and forests of classifiers); without
    it the prediction of a regressor, or the margin of a boosted model."""
    table = _node_table(spark, model)
    count = table.count()
    if count > MAX_NODES:
        raise ValueError(f"{count} nodes; at most {MAX_NODES} are sent to the tasks")
    trees: dict[int, dict[int, dict]] = {}
    for r in table.collect():
        if class_index is None:
            value = r["prediction"]
        else:
            total = sum(r["stats"])
            value = r["stats"][class_index] / total if total else 0.0
        node = {"left": r["left"], "right": r["right"], "count": r["count"], "value": value, "feature": r["feature"]}
        if r["left"] >= 0:
            if r["categories"] == -1:
                node["near"], node["far"] = ("le", float(r["bounds"][0])), ("gt", float(r["bounds"][0]))
            else:
                node["near"], node["far"] = ("in", tuple(r["bounds"])), ("out", tuple(r["bounds"]))
        trees.setdefault(r["tree"], {})[r["id"]] = node
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    boosted = type(model).__name__.startswith("GBT")
    scale = 1.0 if boosted else 1.0 / len(weights)
    leaves, base, cells = [], 0.0, 0
    for t, nodes in sorted(trees.items()):
        for leaf, share in _leaves(nodes, weights[t] * scale):
            cells += leaf.table.size
            if cells > MAX_TABLE:
                raise ValueError(f"more than {MAX_TABLE} contributions; use shallower trees")
            leaves.append(leaf)
            base += share
    return TreeModel(leaves, base, model.numFeatures)


def _met(x: np.ndarray, tests: list[tuple]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for kind, bound in tests:
        if kind == "le":
            out &= x <= bound
        elif kind == "gt":
            out &= ~(x <= bound)
        else:
            out &= np.isin(x, bound) == (kind == "in")
    return out


def contributions(model: TreeModel, x: np.ndarray) -> np.ndarray:
    """Contributions of every feature for every row of ``x``.  Leaves of a
    tree share the upper parts of their paths: a feature's conditions are
    tested once for all leaves that have them.  A slot's values lie together,
    as the leaves add to one slot after the other."""
    out = np.zeros((model.n_features, len(x)))
    columns = np.ascontiguousarray(x.T)
    met: dict[tuple, np.ndarray] = {}
    for leaf in model.leaves:
        pattern = np.zeros(len(x), np.min_scalar_type(len(leaf.table) - 1))
        for bit, (f, tests) in enumerate(zip(leaf.features, leaf.tests, strict=True)):
            key = (f, *tests)
            if key not in met:
                if len(met) >= MAX_MASKS:
                    met.clear()
                met[key] = _met(columns[f], tests)
            pattern |= met[key].astype(pattern.dtype) << pattern.dtype.type(bit)
        at = pattern.astype(np.intp)
        for i, f in enumerate(leaf.features):
            out[f] += np.ascontiguousarray(leaf.table[:, i])[at]
    return out.T


def tree_attribution(df: DataFrame, model, features: str | Column = "features", class_index: int | None = None,
                     name: str = "contributions") -> DataFrame:
    """Adds ``name``: one contribution per slot of the vector column
    ``features``.  They add up to the prediction less ``name_base``, the
    model's mean prediction over its training rows."""
    from pyspark.ml.functions import vector_to_array

    spark = df.sparkSession
    held = spark.sparkContext.broadcast(tree_model(spark, model, class_index))

    @F.arrow_udf("array<double>")
    def explain(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1 if len(rows) else held.value.n_features)
        at = np.arange(len(rows) + 1, dtype=np.int32) * held.value.n_features
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(contributions(held.value, x)).ravel()))

    column = F.col(features) if isinstance(features, str) else features
    return df.withColumn(name, explain(vector_to_array(column))).withColumn(f"{name}_base", F.lit(held.value.base))


def slot_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of the slots of an assembled vector, from the column's metadata
    (``feature_<i>`` where it has none)."""
    meta = df.schema[features].metadata.get("ml_attr", {})
    names = {a["idx"]: a.get("name") for group in meta.get("attrs", {}).values() for a in group}
    size = meta.get("num_attrs", len(names))
    return [names.get(i) or f"feature_{i}" for i in range(size)]
