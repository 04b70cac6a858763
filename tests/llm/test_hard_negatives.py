"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from edspark.llm import hard_negatives
from edspark.llm.common import ship

SCHEMA = "vec_id bigint, label int, embedding array<double>"


def brute(rows, every, n_pos=5, n_neg=5, share=80):
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        codes = [max(-(1 << 63), min((1 << 63) - 1, math.floor(x * 256.0))) for x in v]
        if i not in held or (label, v) < (held[i][0], held[i][2]):
            held[i] = (label, codes, v)
    out = set()
    for i, (label, a, _) in held.items():
        if i % every:
            continue
        scored = [(max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, c, strict=True)))), j, own)
                  for j, (own, c, _) in held.items() if j != i and len(c) == len(a)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == label][:n_pos]:
            hard = [s for s in scored if s[2] != label and share * p <= 100 * s[0] <= 100 * p][:n_neg]
            out |= {(i, j, r + 1, k, p, s) for r, (s, k, _) in enumerate(hard)}
    return out


def mined(spark, rows, every, **more):
    ship(spark)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("point", F.lit("clash")).repartition(4)
    got = hard_negatives.mine(df, F.col("id") % every == 0, **more).collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got}


def vectors(n, dim, seed, copies=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, dim)) / 4 + r.normal(size=(5, dim))[r.integers(5, size=n)], 2)
    x[:copies] = x[0]
    return [(i, int(r.integers(4)), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("tile_rows, chunk_rows, run_tiles", [(2048, 4096, 4), (128, 5, 2)])
def test_matches_brute_force(spark, tile_rows, chunk_rows, run_tiles):
    rows = vectors(700, 6, 1, copies=200)
    rows += [(None, 1, [1.0] * 6), (9000, None, [1.0] * 6), (9100, 1, None), (9200, 1, [1.0, None]), (9300, 1, [float("nan")] * 6),
             (9400, 1, [float("inf")] * 6), (7000, 1, [0.5, 0.5]), (7001, 2, [0.5, 0.45]), (7002, 1, [0.5, 0.6]), (7003, 2, []),
             (7010, 2, []), (7020, 1, []), (40, 0, [0.1] * 6), (41, 3, rows[41][2]), rows[60]]
    got = mined(spark, rows, 10, tile_rows=tile_rows, chunk_rows=chunk_rows, run_tiles=run_tiles)
    want = brute(rows, 10)
    assert len(want) > 300 and got == want


def test_large_codes_are_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, int(i % 2), [float(x) for x in r.integers(-5, 6, 3) * 10.0 ** 7 + r.integers(0, 3, 3)]) for i in range(60)]
    rows += [(100, 0, [1e300, 1.0, 0.0]), (101, 0, [1e300, 2.0, 0.0]), (102, 1, [1e300, 3.0, 0.0])]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_boxes_bound_all_products():
    r = np.random.default_rng(2)
    codes = r.integers(-50, 50, (5000, 8)).astype(float)
    tree = hard_negatives.RTree(codes, np.zeros(5000, np.int64), np.arange(5000))
    assert sorted(np.concatenate(tree.children[:tree.leaves]).tolist()) == list(range(5000))
    query = hard_negatives._query(r.integers(-50, 50, 8).astype(float))
    low, high = tree.bounds(query, np.arange(tree.root + 1))
    for node in range(tree.leaves):
        s = tree.scores(query, tree.children[node])
        assert low[node] <= s.min() and s.max() <= high[node]
    for node in range(tree.leaves, tree.root + 1):
        assert high[node] >= high[tree.children[node]].max() and low[node] <= low[tree.children[node]].min()


def test_queue_prunes_boxes(monkeypatch):
    """On clustered points only a part of the leaves is opened."""
    r = np.random.default_rng(4)
    codes = (r.normal(size=(32, 4))[np.arange(16384) % 32] * 300 + r.normal(size=(16384, 4)) * 5).round()
    tree = hard_negatives.RTree(codes, np.zeros(16384, np.int64), np.arange(16384))
    opened = []
    scores = hard_negatives.RTree.scores
    monkeypatch.setattr(hard_negatives.RTree, "scores", lambda self, q, rows: opened.append(1) or scores(self, q, rows))
    best = hard_negatives.positives([tree], codes[7], 0, 6)
    s = codes @ codes[7]
    assert best == sorted(((x, i) for i, x in enumerate(s.tolist())), key=lambda x: (-x[0], x[1]))[:6]
    assert len(opened) < tree.leaves / 2


def test_empty(spark):
    assert mined(spark, [], 10) == set()
    assert mined(spark, [(10, 1, [1.0])], 10) == set()
