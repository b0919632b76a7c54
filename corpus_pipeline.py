"""The training-data pipeline: every stage is one operator, written and read again before the next.

Stages: quality classifier, SimHash near-dedup, benchmark decontamination, mixing to target
weights, packed token ids. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swelter.llm import decontam, mixing, packing, quality_fm, simhash
from swelter.llm.common import DOCUMENT_COLUMNS, store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_fm.good_documents(docs, table(spark, sf_dir, "labels"), list(DOCUMENT_COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.one_of_each(docs, list(DOCUMENT_COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"), list(DOCUMENT_COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document, repeats as rows of their own."""
    return mixing.mixed_documents(docs, list(DOCUMENT_COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("packed token ids", pack),
]

#: The classifier and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if number == 0 else store(docs), sf_dir)
    return docs
