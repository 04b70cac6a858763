"""Feature-attribution aggregates.

Payloads are ``array<double>`` (``[F]``), ``array<array<double>>``
(``[class][F]``) or three levels (``[class][row][F]``).  Per-record work is
array expressions (no shuffle); cross-record work is ``posexplode`` plus a
position-keyed partial aggregate, so no single group holds a payload.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edspark.functions.once import once
from edspark.schemas import DASHBOARD_FEATURES, DASHBOARD_TEXT_DIMS, DASHBOARD_TEXT_PREFIX, SERVICE_FEATURES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_payload(text, nesting: int = 1) -> Column:
    """Tolerant JSON parse of an attribution payload of the given nesting."""
    t: T.DataType = T.DoubleType()
    for _ in range(nesting):
        t = T.ArrayType(t)
    return F.from_json(_c(text), t)


def class_mean(nested) -> Column:
    """``[class][F]`` -> position-wise mean over classes (``[F]``); null
    for an empty payload or classes of different lengths."""
    a = _c(nested)
    n = F.size(a)
    first = F.get(a, F.lit(0))
    even = (n > 0) & F.forall(a, lambda c: F.size(c) == F.size(first))
    mean = F.transform(first, lambda _, i: F.aggregate(a, F.lit(0.0), lambda acc, c: acc + F.get(c, i)) / n)
    return F.when(even, mean)


def flatten_payload(payload, nesting: int) -> Column:
    """Mean over classes when nested, then flatten rows (3 levels)."""
    p = _c(payload)
    if nesting == 1:
        return p
    if nesting == 2:
        return class_mean(p)
    # [class][row][F] -> mean over class -> [row][F] -> flatten
    return F.flatten(F.transform(F.get(p, F.lit(0)), lambda _, r: class_mean(F.transform(p, lambda c: F.get(c, r)))))


def _parsed_forms(text) -> dict[str, Column]:
    """The payload parsed as each of the three forms; only the one that its
    opening brackets tell is not null."""
    t = F.trim(_c(text))
    opens = {n: t.rlike("^" + r"\[\s*" * n + r"[^\[\s]") for n in (1, 2, 3)}
    return {f"__form{n}": F.when(o, parse_payload(t, n)) for n, o in opens.items()}


def _values_of(forms: Mapping[str, Column]) -> Column:
    return F.coalesce(*[flatten_payload(c, i + 1) for i, c in enumerate(forms.values())])


def _all_known(values) -> Column:
    v = _c(values)
    return F.when((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()), v)


def payload_values(text) -> Column:
    """The values of a JSON payload of any of the three forms, told
    by its opening brackets; null for empty, bad or uneven payloads."""
    return _all_known(_values_of(_parsed_forms(text)))


def with_payload_values(df: DataFrame, text: str, name: str) -> DataFrame:
    """:func:`payload_values` as a further column, parsed once a row."""
    forms = once(df, **_parsed_forms(text))
    values = once(forms, __values=_values_of({f"__form{n}": F.col(f"__form{n}") for n in (1, 2, 3)}))
    return values.withColumn(name, _all_known("__values")).drop("__form1", "__form2", "__form3", *(["__values"] if name != "__values" else []))


def feature_name(pos, names: Sequence[str] = DASHBOARD_FEATURES, text_prefix: str = DASHBOARD_TEXT_PREFIX,
                 text_dims: int = DASHBOARD_TEXT_DIMS) -> Column:
    """Name by 0-based position: the structured names, then
    ``BERT_i`` for the text dimensions, then ``Feature_i``."""
    p = _c(pos)
    k = len(names)
    return (F.when(p < k, F.element_at(F.array(*[F.lit(n) for n in names]), (p + 1).cast("int")))
            .when(p < k + text_dims, F.concat(F.lit(text_prefix), (p - k).cast("string")))
            .otherwise(F.concat(F.lit("Feature_"), p.cast("string"))))


def latest(attr: DataFrame, n: int, ts: str = "created_at", key: str = "row_id", payload: str = "payload") -> DataFrame:
    """T4: the newest ``n`` rows with a payload (a top-k, not a scan cap)."""
    return attr.filter(F.col(payload).isNotNull()).orderBy(F.desc(ts), F.desc(key)).limit(n)


def mean_abs_by_position(attr: DataFrame, payload: str = "payload", nesting: int = 1, parse=None) -> DataFrame:
    """Mean absolute value per position over the given rows; ``parse``
    (:func:`payload_values`) reads a JSON column, row by row in its own form."""
    flat = attr.select((parse(payload) if parse else flatten_payload(payload, nesting)).alias("p"))
    flat = flat.select(F.posexplode("p").alias("pos", "v"))
    return flat.groupBy("pos").agg(F.avg(F.abs("v")).alias("importance"), F.count(F.lit(1)).alias("n_rows"))


def attribution_mean_abs(attr: DataFrame, n: int = 100, nesting: int = 1, parse=None) -> DataFrame:
    """Importance per named feature over the newest ``n`` payloads."""
    agg = mean_abs_by_position(latest(attr, n), nesting=nesting, parse=parse)
    return agg.select("pos", feature_name("pos").alias("feature"), "importance")


def attribution_by_class(attr: DataFrame, class_idx: int = 2, payload: str = "payload") -> DataFrame:
    """Mean |value| per position for one class of ``[class][F]``
    payloads, over every row."""
    one = attr.select(F.element_at(F.col(payload), class_idx + 1).alias("p"))
    agg = one.select(F.posexplode("p").alias("pos", "v")).groupBy("pos").agg(F.avg(F.abs("v")).alias("importance"))
    return agg.select("pos", feature_name("pos").alias("feature"), "importance")


def attribution_top(importance: DataFrame, first: int = 15, show: int = 10) -> DataFrame:
    """The ``first`` most important features; drop text dimensions
    (``BERT_`` prefix) unless that leaves nothing; then the top ``show``."""
    top = importance.orderBy(F.desc("importance"), F.asc("pos")).limit(first)
    keep = ~F.col("feature").startswith(DASHBOARD_TEXT_PREFIX)
    w = Window.partitionBy()
    marked = top.withColumn("__keep", keep).withColumn("__any", F.max(F.col("__keep").cast("int")).over(w))
    kept = marked.filter(F.col("__keep") | (F.col("__any") == 0))
    return kept.orderBy(F.desc("importance"), F.asc("pos")).limit(show).select("pos", "feature", "importance")


def top_features(values: Column, n: int = 3) -> Column:
    """The ``n`` largest |values| (ties: later position first) as structs
    of the service's feature name and the signed impact; empty if null."""
    keyed = F.transform(values, lambda v, i: F.struct((-F.abs(v)).alias("k1"), (-i).alias("k2"), i.alias("pos"), v.alias("impact")))
    top = F.transform(F.slice(F.sort_array(keyed), 1, n), lambda s: F.struct(
        feature_name(s["pos"], SERVICE_FEATURES).alias("feature"), s["impact"].alias("impact")))
    return F.coalesce(top, F.array().cast("array<struct<feature:string,impact:double>>"))


def record_top_features(attr: DataFrame, n: int = 3, payload: str = "payload", key: str = "row_id",
                        nesting: int = 1) -> DataFrame:
    """T6 per record; class 0 when nested.  Pure array expressions per row,
    then one explode."""
    p = _c(payload)
    for _ in range(nesting - 1):
        p = F.get(p, F.lit(0))
    ex = attr.select(key, F.posexplode(top_features(p, n)).alias("rank0", "s"))
    return ex.select(key, (F.col("rank0") + 1).alias("rank"), "s.feature", "s.impact")


def linear_attribution(df: DataFrame, features: Sequence[str], coefficients: Sequence[float],
                       means: dict) -> DataFrame:
    """L8 (re-aimed): contribution ``coef_i * (x_i - mean_i)`` per feature as
    an array column; coefficients and means are fitted numbers (one per
    feature) applied as literals."""
    contrib = F.array(*[F.lit(float(c)) * (F.col(f) - F.lit(float(means[f]))) for f, c in zip(features, coefficients)])
    return df.withColumn("contributions", contrib)
