import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from edspark.operators import features, text_vectors


def corpus(n=120):
    r = random.Random(4)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("chest", "head", "limb", "skin")]
    out = [(i, " ".join(r.choices(topics[i % 4], k=20)) + f" note{i % 7}") for i in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 2, " ... "), (n + 3, out[0][1])]


def matrix(df, model):
    rows = model.terms.transform(text_vectors._terms(df, "t")).orderBy("id").select(vector_to_array("__unit").alias("x"))
    return np.array([r["x"] for r in rows.collect()])


def vectors(df, model):
    out = text_vectors.transform(df, "t", model).orderBy("id").select(vector_to_array("text_vector").alias("z"))
    return np.array([r["z"] for r in out.collect()])


def test_against_a_full_decomposition(spark):
    """Same singular values, and no rank-k matrix is nearer."""
    df = spark.createDataFrame(corpus(), "id long, t string").repartition(5)
    model = text_vectors.fit(df, "t", size=6, slots=64)
    x, z = matrix(df, model), vectors(df, model)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose(model.energy, s[:6] ** 2)
    error = np.linalg.norm(x - z @ model.directions.T)
    assert error == pytest.approx(np.sqrt((s[6:] ** 2).sum()), rel=1e-6)
    assert model.total_energy == pytest.approx((s**2).sum())
    assert (z**2).sum() == pytest.approx(model.energy.sum())
    assert np.allclose(model.directions.T @ model.directions, np.eye(6))


def test_texts_of_one_topic_are_alike(spark):
    df = spark.createDataFrame(corpus(), "id long, t string")
    z = vectors(df, text_vectors.fit(df, "t", size=8, slots=256))[:120]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    alike = z @ z.T
    same = np.arange(120)[:, None] % 4 == np.arange(120)[None] % 4
    assert alike[same].mean() > alike[~same].mean() + 0.5


def test_empty_texts_repeats_and_missing_directions(spark):
    df = spark.createDataFrame(corpus(), "id long, t string")
    z = vectors(df, text_vectors.fit(df, "t", size=300, slots=512))
    assert z.shape == (124, 300)
    assert not z[120:123].any() and np.allclose(z[123], z[0])
    spanned = np.linalg.matrix_rank(z)
    assert spanned < 300 and not z[:, 124:].any()


def test_split_of_the_input_does_not_matter(spark):
    df = spark.createDataFrame(corpus(), "id long, t string")
    a, b = (text_vectors.fit(df.repartition(n), "t", size=4, slots=64) for n in (1, 9))
    assert np.allclose(a.energy, b.energy)


def test_a_fitted_model_takes_new_texts_and_feeds_the_feature_matrix(spark):
    df = spark.createDataFrame(corpus(), "id long, t string")
    model = text_vectors.fit(df, "t", size=5, slots=64)
    new = spark.createDataFrame([(1, "chest1 chest2", 0.5, "x"), (2, None, 1.5, "y")], "id long, t string, Age double, __sparse string")
    out = features.feature_matrix(text_vectors.transform(new.drop("__sparse"), "t", model), ["Age"], ["text_vector"])
    got = {r["id"]: r["f"] for r in out.select("id", vector_to_array("features").alias("f")).collect()}
    assert len(got[1]) == 6 and got[1][0] == 0.5 and any(got[1][1:]) and got[2] == [1.5, 0, 0, 0, 0, 0]


def test_bounds(spark):
    df = spark.createDataFrame([], "t string")
    with pytest.raises(ValueError):
        text_vectors.fit(df, "t")
    with pytest.raises(ValueError):
        text_vectors.fit(df, "t", slots=1 << 18)


def test_query(spark):
    from edspark.plans.catalog import QUERIES
    out = QUERIES["text_vectors"](spark, "/root/testdata/sf0.001")
    assert out.filter(F.col("n_numbers") != 768).isEmpty() and out.filter(~F.col("no_longer")).isEmpty()
