import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from edspark.operators import sparse_trees as st

WIDTH = 40


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    out = []
    for i in range(400):
        codes = sorted(set(r.integers(2, WIDTH, 3).tolist()))
        a, b = float(r.integers(-9, 10)), float(r.integers(0, 5))
        label = int((a > 2) + (b > 1 and 5 in codes or 7 in codes or a < -4 and r.random() < 0.7))
        out.append((i, float(label), i % 2, Vectors.sparse(WIDTH, [0, 1, *codes], [a, b, *[1.0] * len(codes)])))
    return spark.createDataFrame(out, ["row_id", "label", "fold", "features"]).cache()


def meta(df, models):
    return np.array([r["s"] for r in st.scored(df, models, "features", "s").orderBy("row_id").collect()])


def test_trees_are_those_of_the_dense_learners(spark, rows, tmp_path):
    fits = st.fit_stack(rows, "label", "features", "fold", 2, 42)
    everything = fits[-1]
    for i, m in enumerate(everything):
        m.save(spark, f"{tmp_path}/{i}")
    got = meta(rows, [st.Model.load(spark, f"{tmp_path}/{i}") for i in range(3)])
    assert np.array_equal(got, meta(rows, everything))
    assert np.allclose(got[:, :3].sum(axis=1), 1) and np.allclose(got[:, 3:6].sum(axis=1), 1)
    tree = DecisionTreeClassifier(maxDepth=5, seed=1).fit(rows).transform(rows).orderBy("row_id").collect()
    assert np.allclose(got[:, 3:6], [r["probability"].toArray() for r in tree])
    for c in range(3):
        one = rows.withColumn("own", (F.col("label") == c).cast("double"))
        boosted = GBTClassifier(labelCol="own", maxIter=5, maxDepth=3, seed=1).fit(one).transform(one).orderBy("row_id").collect()
        assert np.allclose(got[:, 6 + c], [r["rawPrediction"][1] for r in boosted])
    # A fold's trees are those of the other rows alone.
    part = rows.filter("fold != 0")
    tree = DecisionTreeClassifier(maxDepth=5, seed=1).fit(part).transform(rows).orderBy("row_id").collect()
    assert np.allclose(meta(rows, fits[0])[:, 3:6], [r["probability"].toArray() for r in tree])


def test_few_open_nodes_a_pass_give_the_same_trees(rows, monkeypatch):
    whole = st.fit_stack(rows, "label", "features", "fold", 2, 42, forest=2, rounds=1, depth=3, boosted_depth=2)
    monkeypatch.setattr(st, "CELLS", 2000)
    assert st.fit_stack(rows, "label", "features", "fold", 2, 42, forest=2, rounds=1, depth=3, boosted_depth=2) == whole


def test_wide_vectors_cost_no_time_by_row(spark):
    """A slot a row, as codes of a large table have: held densely, 20,000 rows
    of 20,000 slots take 1.6 GB."""
    n = 20_000
    df = spark.createDataFrame(spark.sparkContext.parallelize(range(n), 4).map(
        lambda i: (i, float(i % 3), i % 2, Vectors.sparse(n + 1, sorted({0, 1 + i % n, 1 + i * 7 % n}),
                                                          [i % 3 + 1.0] + [1.0] * (len({0, 1 + i % n, 1 + i * 7 % n}) - 1)))),
        ["row_id", "label", "fold", "features"])
    got = meta(df, st.fit_stack(df, "label", "features", "fold", 2, 42, rounds=1)[-1])
    assert (got[:, 3:6].argmax(axis=1) == np.arange(n) % 3).all() and (got[:, 6:].argmax(axis=1) == np.arange(n) % 3).all()


def test_table_of_many_values(spark):
    df = spark.createDataFrame([(Vectors.dense([float(i), float(i % 3)]),) for i in range(-100, 900)], ["features"])
    t = st.fit_table(df, "features")
    assert t.start.tolist() == [0, 32, 35] and t.upper[32:34].tolist() == [0.5, 1.5] and t.zero[1] == 32
    value = np.arange(-100.0, 900.0)
    bins = t.bins(np.zeros(1000, np.int64), value)
    assert np.bincount(bins).min() >= 31 and np.bincount(bins).max() <= 32
    assert (bins == np.searchsorted(t.upper[:31], value)).all()


def blocks_of(packed):
    names = [c.split()[0] for c in st.Block.SCHEMA.split(", ")]
    return [st.Block(packed.table, *(r[n] for n in names)) for r in packed.blocks.collect()]


def test_rows_are_packed_once_into_blocks_of_a_fold(rows, monkeypatch):
    monkeypatch.setattr(st, "BLOCK", 64)
    packed = st.packed(rows, "label", "features", "fold", 42)
    blocks = blocks_of(packed)
    assert len(blocks) < 400 / 16 and max(b.rows for b in blocks) <= 64
    held = rows.orderBy("row_id").collect()
    for fold in (0, 1):
        own, mine = [r for r in held if r["fold"] == fold], [b for b in blocks if b.fold == fold]
        assert sorted(np.concatenate([b.label for b in mine])) == sorted(int(r["label"]) for r in own)
        feature = np.concatenate([r["features"].indices for r in own]).astype(np.int64)
        bins = packed.table.bins(feature, np.concatenate([r["features"].values for r in own]))
        want = np.bincount(bins[bins != packed.table.zero[feature]], minlength=len(packed.table.upper))
        got = np.zeros(len(want))
        for b in mine:
            got[b.bin] += b.count
            assert b.weight.shape == (5, b.rows) and len(b.row) == b.count.sum()
            assert all(len(set(b.row[i:j])) == j - i for i, j in zip(b.begin[:-1], b.begin[1:], strict=True))
        assert np.array_equal(got, want)


def test_blocks_of_any_size_give_the_same_scores(rows, monkeypatch):
    whole = meta(rows, st.fit_stack(rows, "label", "features", "fold", 2, 42, forest=3, rounds=2)[0])
    monkeypatch.setattr(st, "BLOCK", 50)
    assert np.allclose(meta(rows, st.fit_stack(rows, "label", "features", "fold", 2, 42, forest=3, rounds=2)[0]), whole)


def test_out_of_fold_scores_are_those_of_each_row(rows):
    packed = st.packed(rows, "label", "features", "fold", 42, forest=3)
    *held_out, _ = st.stack_of(packed, 2, 42, forest=3, rounds=2)
    got = [(r["label"], *r["scores"]) for r in st.held_out_scores(packed, held_out).collect() for _ in range(r["rows"])]
    want = [(r["label"], *r["s"]) for f in (0, 1) for r in st.scored(rows.filter(F.col("fold") == f), held_out[f], "features", "s").collect()]
    assert np.allclose(sorted(got), sorted(want))
