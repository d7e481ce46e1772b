"""Preparation of a corpus: stages that each drop or rearrange documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of ``documents`` and leave others out; the last gives the packed pieces.
Texts of any length are read whole. An empty table gives an empty table. Rows are dropped by
``doc_id``, so rows that repeat an id stay or go together, and rows with a null id stay after the
first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import language_id, packing
from kgspark.llm.common import small_or_plain, staged, table
from kgspark.llm.decontaminate import decontaminate
from kgspark.llm.exact_dedup import exact_duplicates
from kgspark.llm.ngram_join import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are in none of the learned languages go; ``lang`` of the others is left as it is.

    Null and empty texts and those without a letter go. Equal texts get equal answers; of languages
    that code a text alike the first by name counts. Null labels teach nothing.
    """
    model = language_id.fit(docs)
    return language_id.in_known_language(docs, model, most=language_id.limits(docs, model)).select(COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; null and empty texts are equal."""
    return _without(docs, exact_duplicates(docs).filter("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five words, the smallest id stays.

    Null and empty texts are linked with nothing and stay.
    """
    return _without(docs, near_duplicates(docs).filter("doc_id <> component_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item go; null and empty texts and items hold nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token of what is left lies in sequences of 1024; a null or empty text has its end token alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the ids of ``gone``; rows with a null id stay."""
    ids = staged(gone.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), "dropped")
    return docs.join(small_or_plain(ids), "doc_id", "left_anti").select(COLUMNS)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
# Language models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
