"""Dense text vectors (L5): truncated singular value decomposition of the
weighted term matrix, by default 768 numbers a text.

Texts become unit vectors of weighted term counts over ``slots`` hashed terms.
The Gram matrix of all texts (slots x slots, 32 MB for 2,048) is added up by
Spark's tree aggregation over sparse rows: a task holds one such matrix, and
the driver adds up the last level's, about the square root of the number of
partitions, half the size each.  Its leading
eigenvectors are the right singular vectors; a text's dense vector is its
product with them, worked out batch by batch.

Defined cases: a null text counts as empty; a text without a term has the zero
vector; where the terms span fewer than ``size`` directions, the further
numbers are zero; an empty table has no model (``ValueError``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most slots: a Gram matrix of 4,096 is 128 MB.
MOST_SLOTS = 4096
_BLOCK = 1024


@dataclass
class TextVectors:
    """A fitted model: the term pipeline, the directions (slots x size) and
    the squared singular value of each direction."""

    terms: PipelineModel
    directions: np.ndarray
    energy: np.ndarray
    total_energy: float


def _terms(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))


def fit(df: DataFrame, text_col: str, size: int = 768, slots: int = 2048) -> TextVectors:
    """The ``size`` leading directions of all texts of ``df``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    if not 0 < size <= slots <= MOST_SLOTS:
        raise ValueError(f"size {size} and slots {slots}: at most {MOST_SLOTS} slots, and no more numbers than slots")
    texts = _terms(df.select(text_col), text_col).select("__text")
    if texts.isEmpty():
        raise ValueError("no text to fit on")
    stages = [RegexTokenizer(inputCol="__text", outputCol="__tok", pattern="\\W+", toLowercase=True),
              HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=slots),
              IDF(inputCol="__tf", outputCol="__weighted"),
              Normalizer(inputCol="__weighted", outputCol="__unit", p=2.0)]
    terms = Pipeline(stages=stages).fit(texts)
    rows = MLUtils.convertVectorColumnsFromML(terms.transform(texts).select("__unit"), "__unit")
    gram = RowMatrix(rows, numCols=slots).computeGramianMatrix().toArray()
    energy, vectors = np.linalg.eigh(gram)
    energy, vectors = np.maximum(energy[::-1][:size], 0.0), vectors[:, ::-1][:, :size]
    # A direction without energy is no direction; each one's largest entry is positive.
    found = energy > 1e-9 * max(energy[0], 1e-300)
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)])
    return TextVectors(terms, vectors * sign * found, energy * found, float(np.trace(gram)))


def transform(df: DataFrame, text_col: str, model: TextVectors, out: str = "text_vector") -> DataFrame:
    """``df`` plus the dense vector of each text, as a vector column that
    ``features.feature_matrix`` takes."""
    from pyspark.ml.functions import array_to_vector

    sent = df.sparkSession.sparkContext.broadcast(model.directions)

    @F.pandas_udf("array<double>")
    def project(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        directions = sent.value
        for slots, values in rows:
            done = []
            for at in range(0, len(slots), _BLOCK):
                s, v = slots.iloc[at : at + _BLOCK], values.iloc[at : at + _BLOCK]
                dense = np.zeros((len(s), len(directions)))
                line = np.repeat(np.arange(len(s)), [len(x) for x in s])
                dense[line, np.concatenate([*s, []]).astype(np.int64)] = np.concatenate([*v, []])
                done += list(dense @ directions)
            yield pd.Series(done)

    sparse = model.terms.transform(_terms(df, text_col)).withColumn("__sparse", F.unwrap_udt("__unit"))
    made = sparse.withColumn(out, array_to_vector(project(F.col("__sparse.indices"), F.col("__sparse.values"))))
    return made.select(*[F.col(f"`{c}`") for c in df.columns], out)
