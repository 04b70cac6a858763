"""Model data pipeline.

Fitted statistics are computed set-based: the exact median is a distributed
order-statistic (range-partitioned positions, no single-task percentile
buffer), the mode a partial count, mean and population std a partial
aggregate.  Fitted values are a handful of numbers per column and are applied
as a one-row broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edspark.operators.sequence import ordered_sequence, running_sum
from edspark.session import ensure_checkpoint_dir

NUMERIC = ["Age", "Temp", "Pulse", "Resp", "SBP", "DBP", "O2Sat", "PainScale"]
CATEGORICAL = "ArrivalMode"


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([], list(cols), "column", "value"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n), nulls included: the one pass over the data from
    which all fitted statistics follow.  Counts combine before the shuffle;
    the table is written once, as the statistics read it several times."""
    ensure_checkpoint_dir(df.sparkSession)
    return _long(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).checkpoint()


def medians_of(counts: DataFrame) -> DataFrame:
    """Exact median per column of a table of counts (mean of the two middle
    values for even totals), by a distributed running count."""
    known = counts.filter(F.col("value").isNotNull())
    cum = running_sum(known, "n", [F.col("value")], ["column"], name="__cum")
    total = known.groupBy("column").agg(F.sum("n").alias("__n"))
    reached = cum.join(total, "column")
    first = lambda k: F.min(F.when(F.col("__cum") >= k, F.col("value")))
    return reached.groupBy("column").agg(
        ((first(F.floor((F.col("__n") + 1) / 2)) + first(F.ceil((F.col("__n") + 1) / 2))) / 2).alias("median"))


def modes_of(counts: DataFrame) -> DataFrame:
    """Most frequent value per column; ties -> smallest value."""
    return counts.filter(F.col("value").isNotNull()).groupBy("column").agg(
        F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("mode"))


def exact_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per column as rows ``(column, median)``."""
    return medians_of(value_counts(df, cols))


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return modes_of(value_counts(df, cols))


def impute_scale_stats(df: DataFrame, cols: Sequence[str] = NUMERIC) -> DataFrame:
    """A21/L1 fit: per column the exact median, the mode, and the mean and
    population std of the median-imputed column, all from one pass over the
    data (:func:`value_counts`)."""
    counts = value_counts(df, cols)
    median = medians_of(counts)
    filled = counts.join(median, "column", "left").select(
        "column", F.coalesce("value", "median").alias("v"), "n").filter(F.col("v").isNotNull())
    mean = filled.groupBy("column").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    off = F.col("v") - F.col("mean")
    std = filled.join(mean, "column").groupBy("column").agg(F.sqrt(F.sum(off * off * F.col("n")) / F.sum("n")).alias("std"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(median, "column", "left").join(modes_of(counts), "column", "left").join(mean, "column", "left").join(
        std, "column", "left")


def impute_scale(df: DataFrame, stats: DataFrame, cols: Sequence[str] = NUMERIC, keep: Sequence[str] = ()) -> DataFrame:
    """L1 transform: ``(coalesce(x, median) - mean) / std`` (std 0 -> 1, as
    the reference scaler does).  ``stats`` has one row per column; it is
    fetched once and the fitted numbers become literals in the projection."""
    fitted = {r["column"]: r for r in stats.select("column", "median", "mean", "std").collect()}
    out = []
    for c in cols:
        f = fitted[c]
        std = 1.0 if not f["std"] else f["std"]
        out.append(((F.coalesce(F.col(c).cast("double"), F.lit(f["median"])) - F.lit(f["mean"])) / F.lit(std)).alias(c))
    return df.select(*keep, *out)


def one_hot(df: DataFrame, col: str = CATEGORICAL, keep: Sequence[str] = (), categories: DataFrame | None = None) -> DataFrame:
    """L2: mode imputation, then one-hot over the sorted categories seen at
    fit time, as a sparse vector ``<col>_onehot`` of any length; values not
    seen then give all zeros.  ``categories`` is the table of
    :func:`fit_categories` (fitted on ``df`` by default)."""
    from pyspark.ml.feature import OneHotEncoder

    cats = categories if categories is not None else fit_categories(df, col)
    fill = cats.agg(F.max_by("value", F.struct(F.col("n"), -F.col("value")))).scalar()
    size = cats.count()
    x = df.withColumn("__x", F.coalesce(F.col(col).cast("double"), fill))
    codes = _checked_broadcast(cats.select(F.col("value").alias("__value"), "index"))
    x = x.join(codes, F.col("__x") == F.col("__value"), "left").withColumn(
        "__index", F.coalesce("index", F.lit(size)).cast("double"))
    # One slot beyond the known ones takes what was not seen, and is dropped.
    encoder = OneHotEncoder(inputCol="__index", outputCol="__vector", handleInvalid="keep", dropLast=True).fit(
        cats.select(F.col("index").cast("double").alias("__index")))
    return encoder.transform(x).select(*keep, F.col("__x").alias(col), F.col("__vector").alias(f"{col}_onehot"))


def fit_categories(df: DataFrame, col: str) -> DataFrame:
    """(value, n, index): the categories of a column in sorted order, numbered
    from 0 by the distributed sequence."""
    counts = value_counts(df, [col]).filter(F.col("value").isNotNull()).select("value", "n")
    return ordered_sequence(counts, [F.col("value")], name="__seq").select("value", "n", (F.col("__seq") - 1).alias("index"))


def _checked_broadcast(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast a code table if its counted size allows."""
    return F.broadcast(table) if table.count() <= rows else table


def label_encode(df: DataFrame, col: str = "ESI", name: str = "label") -> DataFrame:
    """L3: sorted distinct labels -> 0..k-1 (a code table joined back)."""
    labels = df.select(col).filter(F.col(col).isNotNull()).distinct()
    codes = ordered_sequence(labels, [F.col(col)], name="__seq").select(col, (F.col("__seq") - 1).cast("int").alias(name))
    return df.join(_checked_broadcast(codes), col, "left")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) in the order of a seeded hash
    of an integer key (taken modulo 2^31, which keeps the product in range)."""
    h = F.pmod(F.pmod(F.col(key), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))
    return df.orderBy(h, F.col(key)).limit(n)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3) -> DataFrame:
    """fold = position inside the label (in a fixed hash order) mod k, so
    each fold holds the same share of every label.  Positions come from the
    distributed sequence, so a dominant label is not one task."""
    # The key modulo 2^31 keeps the product inside 64 bits.
    h = F.pmod(F.pmod(F.col(key), F.lit(1 << 31)) * F.lit(2654435761), F.lit(4294967296))
    seq = ordered_sequence(df.withColumn("__h", h), [F.col("__h"), F.col(key)], [label], name="__pos")
    return seq.withColumn("fold", ((F.col("__pos") - 1) % k).cast("int")).drop("__h", "__pos")


def complaint_features(df: DataFrame, text_col: str, key: str, num_features: int = 1 << 18) -> DataFrame:
    """L5 (re-aimed): built-in text encoder ``RegexTokenizer -> HashingTF ->
    IDF`` fitted and applied on the whole corpus; returns the number of
    tokens and the sparse vectors of term counts and of weighted terms.  A pre-trained
    encoder would plug in here as an Arrow ``pandas_udf``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    tok = RegexTokenizer(inputCol=text_col, outputCol="__tok", pattern="\\W+", toLowercase=True)
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features)
    idf = IDF(inputCol="__tf", outputCol="features")
    model = Pipeline(stages=[tok, tf, idf]).fit(df.select(key, text_col))
    out = model.transform(df.select(key, text_col))
    return out.select(key, F.size("__tok").alias("n_tokens"), F.col("__tf").alias("term_counts"), "features")


def vector_total(df: DataFrame, vector: str) -> F.Column:
    """Total of all values of a sparse vector column over all rows, as a
    scalar subquery.  Only the one summed vector is ever expanded."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    one = df.select(Summarizer.sum(F.col(vector)).alias("s")).select(vector_to_array("s").alias("s"))
    return one.select(F.aggregate("s", F.lit(0.0), lambda a, v: a + v)).scalar()


def feature_matrix(df: DataFrame, numeric: Sequence[str], vector_cols: Sequence[str], out: str = "features") -> DataFrame:
    """Horizontal concatenation of scaled numeric columns and vector
    columns with ``VectorAssembler``."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[*numeric, *vector_cols], outputCol=out).transform(df)


def _balanced_weights(df: DataFrame, label: str, rows: str) -> DataFrame:
    """``weight``: that of a label's row, times the ``rows`` of a line."""
    counts = df.groupBy(label).agg(F.sum(rows).alias("__nc"))
    n = counts.agg(F.sum("__nc")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    w = counts.select(label, (n / (k * F.col("__nc"))).alias("weight"))
    return df.join(w, label, "left").withColumn("weight", F.col("weight") * F.col(rows))


def fit_stacked_classifier(train: DataFrame, label: str = "label", features: str = "features",
                           folds: int = 2, seed: int = 42):
    """L4: three tree learners (a five-tree random forest, a decision tree,
    and one-vs-rest gradient-boosted trees with five iterations per class),
    stacked on 2-fold out-of-fold class scores (probabilities for the forest
    and the tree, raw scores for one-vs-rest), with a class-balanced logistic
    regression on top.  The trees of all folds grow together over the entries
    other than zero (``sparse_trees``), so the width of the vectors, one slot
    for each code, costs neither memory nor time a row.  The rows are packed
    once; the passes and the out-of-fold scores read the packed rows.
    Returns ``(base_models, meta_model)``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from edspark.operators.sparse_trees import held_out_scores, packed, stack_of

    data = train.withColumn("__fold", F.pmod(F.xxhash64(F.col("row_id")), F.lit(folds)))
    rows = packed(data, label, features, "__fold", seed)
    *held_out, base = stack_of(rows, folds, seed)
    oof = held_out_scores(rows, held_out).select(F.col("label").alias(label), array_to_vector("scores").alias("__meta"), "rows")
    meta = LogisticRegression(labelCol=label, featuresCol="__meta", weightCol="weight", maxIter=50).fit(
        _balanced_weights(oof.checkpoint(), label, "rows"))
    return base, meta


def base_scores(df: DataFrame, models, features: str = "features") -> DataFrame:
    """``df`` plus ``__meta``, the models' scores side by side (probabilities,
    raw scores for one-vs-rest), in one pass over the rows: no join, no shuffle."""
    from pyspark.ml.functions import array_to_vector

    from edspark.operators.sparse_trees import scored

    return scored(df, models, features, "__meta").withColumn("__meta", array_to_vector("__meta"))


def predict_stacked(df: DataFrame, base, meta) -> DataFrame:
    """``df`` plus class probabilities, confidence and 1-based level (M5)."""
    from pyspark.ml.functions import vector_to_array

    from edspark.functions.rules import argmax_level

    pred = meta.transform(base_scores(df, base))
    return pred.select(*df.columns, vector_to_array("probability").alias("probs")).select(
        *df.columns, "probs", F.array_max("probs").alias("confidence"), argmax_level("probs").alias("level"))


def exact_medians_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median of ``value`` per ``group`` (column ``median_<suffix>``)."""
    long = df.select(F.col(group), F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    return median_by(long, group, "value").withColumnRenamed("median_value", "median_" + value.split("_")[-1])


def sorted_median_by(long: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median per group from distributed positions of every value
    (range-partitioned sort).  It moves the whole column; the tests compare
    :func:`median_by` with it."""
    ranked = ordered_sequence(long.select(group, value), [F.col(value)], [group], name="__pos")
    n = long.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    k1 = F.floor((F.col("__n") + 1) / 2)
    k2 = F.ceil((F.col("__n") + 1) / 2)
    mid = ranked.join(n, group).filter((F.col("__pos") == k1) | (F.col("__pos") == k2))
    return mid.groupBy(group).agg(F.avg(value).alias(f"median_{value}"))


def median_by(long: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median of non-null ``value`` per ``group`` without moving the
    column: (1) a grouped ``percentile_approx`` sketch gives bounds whose
    ranks straddle the middle ranks (its rank error is at most n/accuracy);
    (2) one partially aggregated pass counts the rows below the bounds and
    the distinct values between them; (3) a distributed running count over
    those in-bracket values finds the middle ranks.  Only the bracket (about
    4n/accuracy rows, fewer with ties) is shuffled by value.  A bracket that
    missed would violate the sketch's error bound; the job then fails with
    an error instead of returning a wrong value (``sorted_median_by`` is the
    heavy exact alternative)."""
    eps = 1.0 / accuracy
    qs = [max(0.0, 0.5 - 2 * eps), min(1.0, 0.5 + 2 * eps)]
    data = long.select(group, F.col(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    bounds = data.groupBy(group).agg(F.percentile_approx("__v", qs, accuracy).alias("__q"),
                                     F.count(F.lit(1)).alias("__n"))
    ensure_checkpoint_dir(long.sparkSession)
    bounds = bounds.select(group, F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi"), "__n").checkpoint()
    side = (F.when(F.col("__v") < F.col("__lo"), F.lit(-1)).when(F.col("__v") > F.col("__hi"), F.lit(1))
            .otherwise(F.lit(0)))
    tally = (data.join(_checked_broadcast(bounds.select(group, "__lo", "__hi")), group)
             .groupBy(group, side.alias("__side"), F.when(side == 0, F.col("__v")).alias("__bv"))
             .agg(F.count(F.lit(1)).alias("__c")))
    below = tally.filter(F.col("__side") == -1).select(group, F.col("__c").alias("__below"))
    band = tally.filter(F.col("__side") == 0).select(group, "__bv", "__c")
    cum = running_sum(band, "__c", [F.col("__bv")], [group], name="__cum")
    targets = bounds.join(below, group, "left").select(
        group, (F.floor((F.col("__n") + 1) / 2) - F.coalesce(F.col("__below"), F.lit(0))).alias("__k1"),
        (F.ceil((F.col("__n") + 1) / 2) - F.coalesce(F.col("__below"), F.lit(0))).alias("__k2"))
    picked = targets.join(cum, group, "left").groupBy(group).agg(
        F.min(F.when(F.col("__cum") >= F.col("__k2"), F.col("__bv"))).alias("__m2"),
        F.min(F.when(F.col("__cum") >= F.col("__k1"), F.col("__bv"))).alias("__m1"),
        F.min("__k1").alias("__k1"))
    ok = (F.col("__k1") >= 1) & F.col("__m1").isNotNull() & F.col("__m2").isNotNull()
    median = F.when(ok, (F.col("__m1") + F.col("__m2")) / 2).otherwise(
        F.raise_error(F.lit("median bracket missed the middle ranks")))
    return picked.select(group, median.alias(f"median_{value}"))


def encode_texts(df: DataFrame, text_col: str, encoder_factory, out: str = "embedding") -> DataFrame:
    """Plug a caller-supplied text encoder in as an Arrow iterator
    ``pandas_udf``: the encoder is built once per task and called on Arrow
    batches of cleaned complaints (X4/X5); it must map a list of strings to a
    list of float vectors."""
    from pyspark.sql import types as T

    from edspark.functions.text import clean_complaint

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder_factory()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in model(batch.tolist())])

    return df.withColumn(out, _encode(clean_complaint(text_col)))
