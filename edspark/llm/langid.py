"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the character
n-grams (n = 1 to ``max_n``) that occur in both, over the root of the product
of how many each has.  Texts are folded first: lower case, and any run of
characters that are no letters becomes one space.

Labels come from kernel ridge regression, one language against the rest, in
the Nyström form: kernels to ``landmarks_per_lang`` labelled texts of each
language stand for the whole kernel matrix, so the fit is one small linear
system whose sums Spark adds up over a sample of at most ``sample_per_lang``
labelled texts of each language.  Prediction is two matrix products a batch:
presence vectors by landmarks, kernels by coefficients.

n-grams are told apart by a hash of ``HASH_BITS`` bits; whole texts are read,
in pieces that overlap by ``max_n - 1`` characters.

Defined cases: a null text or one without a letter is ``und`` with score 0;
if no row has a label, every text is ``und``; a null id counts as the empty
text in the hold-out rule; repeated rows get equal predictions; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edspark.llm.common import fresh, text_of

HASH_BITS = 14
PIECE = 1 << 20
BLOCK = 64  # texts in one matrix product
UNKNOWN = "und"


@cache
def _fold_table() -> np.ndarray:
    """Code point to folded code point; 32 (space) for all but letters."""
    table = np.full(0x110000, 32, np.uint32)
    for code in range(0x110000):
        ch = chr(code)
        if ch.isalpha():
            low = ch.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (x ^ (x >> np.uint32(13))) >> np.uint32(32 - HASH_BITS)


def presence(text: str, row: np.ndarray, max_n: int = 3) -> bool:
    """Set ``row`` (zeros) to 1 where a hashed n-gram occurs; tells whether
    the text has a letter."""
    table, letters, last = _fold_table(), False, np.array([32], np.uint32)
    for at in range(0, len(text), PIECE):
        codes = table[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate((last, codes))
        gap = codes == 32
        codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]  # a run of gaps is one
        if len(codes) == 0 or (len(codes) == 1 and codes[0] == 32):
            continue
        letters = True
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, max_n + 1):
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
            row[_mix(gram)] = 1
        last = codes[-(max_n - 1) :]
    return letters


@dataclass
class Model:
    """Landmarks as packed presence rows, and per language the coefficient of
    each landmark's kernel."""

    languages: list[str]
    landmarks: np.ndarray  # (m, D / 8) packed
    coefficients: np.ndarray  # (m, languages)
    max_n: int = 3
    sharpness: float = 4.0
    _matrix: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_matrix": None}

    def matrix(self) -> np.ndarray:
        """(D, m) landmark columns, each over the root of its count."""
        if self._matrix is None:
            rows = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
            self._matrix = np.ascontiguousarray((rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))).T)
        return self._matrix

    def kernels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(kernel to each landmark, has a letter) for each text."""
        out, letters = np.zeros((len(texts), len(self.landmarks)), np.float32), np.zeros(len(texts), bool)
        for at in range(0, len(texts), BLOCK):
            block = texts[at : at + BLOCK]
            rows = np.zeros((len(block), 1 << HASH_BITS), np.uint8)
            for i, t in enumerate(block):
                letters[at + i] = presence(t, rows[i], self.max_n)
            count = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.int64), 1))[:, None]
            out[at : at + len(block)] = (rows.astype(np.float32) @ self.matrix()) / count
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        kernels, letters = self.kernels(texts)
        margin = self.sharpness * (kernels.astype(np.float64) @ self.coefficients)
        share = np.exp(margin - margin.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)  # ties go to the first language by name
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, share[np.arange(len(best)), best], 0.0)


def _sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """At most ``per_lang`` texts of each language, the first by the id's
    hash: (lang, text, place).  The choice is made on ids alone; the chosen
    ids (a bounded number) are then joined to the texts.  Only ids whose hash
    is in a language's lowest part, about 1.5 times ``per_lang`` of its
    distinct ones, leave the scan to be ranked."""
    pick = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    pick = pick.filter(F.col("lang").isNotNull()).withColumn("h", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    counts = pick.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    bars = labelled.sparkSession.createDataFrame([(r["lang"], 1.5 * per_lang / r["n"]) for r in counts], "of string, bar double")
    part = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    pick = pick.join(F.broadcast(bars), (F.col("lang") == F.col("of")) & (part < F.col("bar"))).select("id", "lang", "h")
    w = Window.partitionBy("lang").orderBy("h", "id")
    pick = pick.dropDuplicates(["id", "lang"]).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_lang)
    texts = labelled.select(F.col(f"`{id_col}`").alias("tid"), F.col(f"`{lang_col}`").cast("string").alias("tlang"),
                            text_of(f"`{text_col}`").alias("text"))
    found = texts.join(F.broadcast(pick), (F.col("tlang") == F.col("lang")) & F.col("tid").eqNullSafe(F.col("id")))
    # An id that repeats brings several rows: the bound holds again here.
    w = Window.partitionBy("lang").orderBy("place", F.xxhash64("text"))
    return found.select("lang", "text", F.row_number().over(w).alias("place")).filter(F.col("place") <= per_lang)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_n: int = 3,
        landmarks_per_lang: int = 24, sample_per_lang: int = 1500, ridge: float = 1e-3) -> Model:
    """Fit on a bounded sample of the rows that have a label."""
    sample = _sample(labelled, id_col, text_col, lang_col, sample_per_lang)
    sample = sample.repartition(16, "lang", "place")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        rows = np.zeros((len(texts), 1 << HASH_BITS), np.uint8)
        for row, t in zip(rows, texts, strict=True):
            presence(t, row, max_n)
        return pd.Series([r.tobytes() for r in np.packbits(rows, axis=1)])

    sample = sample.select("lang", "place", packed("text").alias("bits")).checkpoint()
    landmarks = sample.filter(F.col("place") <= landmarks_per_lang).orderBy("lang", "place").collect()
    if not landmarks:
        return Model([], np.zeros((0, 1 << HASH_BITS >> 3), np.uint8), np.zeros((0, 0)), max_n)
    languages = sorted({r["lang"] for r in landmarks})
    model = Model(languages, np.stack([np.frombuffer(r["bits"], np.uint8) for r in landmarks]),
                  np.zeros((len(landmarks), len(languages))), max_n)
    m, place = len(landmarks), {lang: i for i, lang in enumerate(languages)}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kk, ky = np.zeros((m, m)), np.zeros((m, len(languages)))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in part["bits"]]), axis=1).astype(np.float32)
                k = (rows @ model.matrix()) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
                k = k.astype(np.float64)
                y = -np.ones((len(part), len(languages)))
                y[np.arange(len(part)), [place[lang] for lang in part["lang"]]] = 1
                kk += k.T @ k
                ky += k.T @ y
        yield pd.DataFrame({"kk": [kk.tobytes()], "ky": [ky.tobytes()]})

    parts = sample.select("lang", "bits").mapInPandas(sums, "kk binary, ky binary").collect()
    kk = sum(np.frombuffer(p["kk"]).reshape(m, m) for p in parts)
    ky = sum(np.frombuffer(p["ky"]).reshape(m, len(languages)) for p in parts)
    rows = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
    kmm = ((rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))) @ model.matrix()).astype(np.float64)
    # Nyström ridge regression: minimise |K a - y|^2 + ridge n a' Kmm a.
    n = max(1, sample.count())
    model.coefficients = np.linalg.lstsq(kk + ridge * n * kmm + 1e-9 * n * np.eye(m), ky, rcond=None)[0]
    return model


def prediction(docs: DataFrame, model: Model, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, score = sent.value.predict([t or "" for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return predict(text)


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` plus a struct column ``name`` (lang_pred, score)."""
    return docs.withColumn(name, prediction(docs, model, text_of(f"`{text_col}`")))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.35) -> DataFrame:
    """The documents whose language is told with ``min_score`` or more."""
    (name,) = fresh(docs.columns, "language")
    found = identify(docs, model, text_col, name)
    return found.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= min_score)).drop(name)
