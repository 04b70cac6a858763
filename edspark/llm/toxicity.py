"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are its words, its words' stems (their first letters, as
``STEMS`` says), its pairs of neighbouring words and its skip-grams (pairs
with one word between), each once, hashed to ``HASH_BITS`` bits.  FTRL-proximal (H. B. McMahan et al., "Ad Click Prediction: a View from
the Trenches", 2013) gives every coordinate its own rate and, by its L1 term,
leaves most weights exactly zero, so the model that is sent to the executors
is small: at most 2 ** ``HASH_BITS`` weights, in practice a few thousand.

The fit is sequential and sees a bounded sample, at most ``per_class``
labelled texts of each class, chosen by the id's hash; features are extracted
in parallel, and features in fewer than ``min_texts`` sampled texts are left
out.  Scoring reads whole texts, in the scan, without a shuffle.

Defined cases: a null text has no feature and gets the score of the bias; a
null label is no label; a document labelled twice is toxic if one label says
so; labels without a document are ignored; without any label every score is 0;
repeated rows get equal scores; a null id counts as the empty text in the
hold-out rule; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edspark.llm.common import text_of

HASH_BITS = 20
EDGES = ".,;:!?\"'()[]{}<>#*$%&|-_/…«»“”„¿¡"
MAX_KNOWN = 300_000
STEMS = (4, 5)
_known: dict[str, int] = {}  # word as written -> slots of the bare word and its stems, one table a worker


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of the method, and the bounds of the sample."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 3
    per_class: int = 8000
    min_texts: int = 5


def _word_code(word: str) -> int:
    """Slots of a word and of its stems, side by side."""
    bare = (word.strip(EDGES) or word).encode("utf-8", "replace")
    code = zlib.crc32(b"w" + bare) >> (32 - HASH_BITS)
    for i, n in enumerate(STEMS, 1):
        code |= zlib.crc32(b"%d" % n + bare.decode()[:n].encode()) >> (32 - HASH_BITS) << (i * HASH_BITS)
    return code


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each word, text it is from) over all texts."""
    split = [t.lower().split() for t in texts]
    missing = set(chain.from_iterable(split)).difference(_known)
    new = {w: _word_code(w) for w in missing}
    extra = len(_known) + len(new) > MAX_KNOWN
    _known.update(new)
    counts = np.fromiter(map(len, split), np.int64, len(split))
    out = np.fromiter(map(_known.__getitem__, chain.from_iterable(split)), np.uint64, int(counts.sum()))
    if extra:
        for w in new:
            del _known[w]
    return out, np.repeat(np.arange(len(texts)), counts)


def _slot(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def occurrences(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, slot) of all words, stems, pairs and skip-grams."""
    w, doc = _words(texts)
    for i in range(len(STEMS) + 1):
        yield doc, (w >> np.uint64(i * HASH_BITS) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            same = doc[gap:] == doc[:-gap]
            pair = w[:-gap] * np.uint64(0x9E3779B97F4A7C15) + w[gap:] * np.uint64(0xD1B54A32D192ED03) + np.uint64(gap + 1)
            yield doc[gap:][same], _slot(pair[same])


def features(text: str) -> np.ndarray:
    """Distinct slots of one text."""
    return np.unique(np.concatenate([slot for _, slot in occurrences([text])]))


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, rates: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) after ``epochs`` passes in the given order."""
    size = 1 << HASH_BITS
    seen = np.zeros(size, np.int64)
    for r in rows:
        seen[r] += 1
    rows = [r[seen[r] >= rates.min_texts] for r in rows]
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    for _ in range(rates.epochs):
        for r, y in zip(rows, labels.tolist(), strict=True):
            zr, nr = z[r], n[r]
            w = np.where(np.abs(zr) <= rates.l1, 0.0,
                         -(zr - np.sign(zr) * rates.l1) / ((rates.beta + np.sqrt(nr)) / rates.alpha + rates.l2))
            bias = -bias_z / ((rates.beta + bias_n ** 0.5) / rates.alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y  # every feature is 0 or 1
            z[r] = zr + g - (np.sqrt(nr + g * g) - np.sqrt(nr)) / rates.alpha * w
            n[r] = nr + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n ** 0.5) / rates.alpha * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= rates.l1, 0.0,
                 -(z - np.sign(z) * rates.l1) / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2))
    held = np.flatnonzero(w)
    return held, w[held], -bias_z / ((rates.beta + bias_n ** 0.5) / rates.alpha)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float
    fitted: bool = True

    def scores(self, texts: list[str], step: int = 500) -> np.ndarray:
        out = np.zeros(len(texts))
        if not self.fitted:
            return out
        table = np.zeros(1 << HASH_BITS)
        table[self.slots] = self.weights
        for at in range(0, len(texts), step):
            block = texts[at : at + step]
            hit = [np.unique((doc[on := table[slot] != 0] << HASH_BITS) | slot[on]) for doc, slot in occurrences(block)]
            hit = np.unique(np.concatenate(hit))
            total = np.bincount(hit >> HASH_BITS, weights=table[hit & ((1 << HASH_BITS) - 1)], minlength=len(block))
            out[at : at + step] = 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rates: Ftrl = Ftrl()) -> Model:
    """Fit on a bounded sample of the labelled documents."""
    told = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).filter(
        "id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    counts = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, fitted=False)
    # The ids whose hash is in the lowest per_class / n part, then at most per_class of them.
    chosen = None
    for y, n in sorted(counts.items()):
        bar = min(1 << 31, int((1 << 31) * 1.1 * rates.per_class / n) + 1)
        part = told.filter((F.col("y") == y) & (order < bar)).orderBy(order, "id").limit(rates.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)

    @F.pandas_udf("binary")
    def slots(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype("<u4").tobytes() for t in texts])

    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    # Bounded by per_class ids a class.
    sample = own.join(F.broadcast(chosen), "id").select("id", "y", slots("text").alias("slots"))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(place=[zlib.crc32(str(i).encode()) for i in rows["id"]]).sort_values(["place", "id", "slots"])
        held, weights, bias = fit_ftrl([np.frombuffer(b, "<u4") for b in rows["slots"]],
                                       (rows["y"].to_numpy() > 0).astype(float), rates)
        return pd.DataFrame({"slots": [held.astype("<i8").tobytes()], "weights": [weights.tobytes()], "bias": [float(bias)]})

    made = sample.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda rows: train(rows), "slots binary, weights binary, bias double").collect()
    if not made:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, fitted=False)
    return Model(np.frombuffer(made[0]["slots"], "<i8"), np.frombuffer(made[0]["weights"]), made[0]["bias"])


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """Probability of label 1 for a text column."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(sent.value.scores(list(texts)))

    return of(text)
