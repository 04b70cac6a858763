"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.

1. quality rules: documents that the current policy rejects go;
2. language ID: documents without a letter, or in none of the known
   languages, go;
3. SimHash near-dedup: of each group of linked documents the one with the
   smallest id stays;
4. mixing: each source's documents as often as its weight's quota takes them;
5. packing: the pieces of the documents and their places in sequences.

Nulls, empty and very long texts, repeated rows, empty tables and further
columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edspark.llm import langid, mixing, packing, quality, simhash
from edspark.llm.common import fresh, remainder, shared_dir, ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (ledger,) = fresh(docs.columns, "ledger")
    judged = quality.with_ledger(docs, name=ledger)
    return judged.filter(quality.passes(F.col(f"{ledger}.failed_bits"), quality.CURRENT)).drop(ledger)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    if not model.languages:  # nothing to learn from: no document can be told to be foreign
        return docs
    return langid.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.Mixture())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID, fingerprints and tokens can't be expressed in SQL; the tests
#: compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
