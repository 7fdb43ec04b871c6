"""From raw documents to packed training sequences.

Each stage takes what the one before has kept, written as Parquet and read
again. All but the last return the columns of ``documents``, and any further
ones, whatever their names. All work on whole texts and whole tables; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import exact_dedup, language_id, minhash, packing
from timberline.llm.common import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told: a letter at least, and one language that stands out.

    Null, empty and letterless texts go, as do ties between the two best
    languages. Repeated rows and rows with a null id are judged by their texts.
    """
    model = language_id.LanguageModel.train(language_id.training_sample(docs))
    return language_id.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the one with the largest id.

    A null text counts as empty. A row with a null id stays only beside no
    others; of rows that repeat id and text one stays.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (shingles of five words, similarity 0.8), keep the smallest id.

    Texts that are null or without words have no copies and stay, as do rows with
    a null id. Rows that repeat an id are one document.
    """
    return minhash.deduplicate(docs, words=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all tokens that are left into sequences of several lengths.

    One row per piece of a document with its place; a text without tokens (null
    or empty) is one row without a bin. Repeated rows are packed each.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: The first and last stages have no SQL; tests compare all with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
