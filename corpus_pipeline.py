"""Corpus pipeline: language ID, exact dedup, near-dedup, decontamination, BPE encoding.

Each stage keeps or drops whole rows, by doc_id and the text's digest, so rows that share a doc_id, or have none, stay or
go each by its own text. Null and empty texts have no language and go in the first stage; of rows that repeat both
doc_id and text one stays; an empty table gives an empty result; other columns are carried along under their own names,
whatever these are, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clausegrid.llm import bpe, decontaminate, exact_dedup, langid, simhash
from clausegrid.llm.common import materialize, prepare, table

#: Encoded pieces that a worker keeps here, where it holds the memory of the earlier stages as well.
KEPT_PIECES = 40_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on the labelled ones, doesn't reject."""
    prepare(spark)
    return langid.drop_unknown(docs, langid.fit(docs))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id."""
    prepare(spark)
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' count and digest, and the decoded text's digest, of each document that is left."""
    prepare(spark)
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, kept=KEPT_PIECES)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal),
    ("near_dedup", one_of_near),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: Language ID is trained, and fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
