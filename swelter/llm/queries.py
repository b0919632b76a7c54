"""Registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.llm import (
    collocations, decontam, host_rules, html_crf, kmeans_tree, language_spans, line_runs, mixing, packing, quality_fm, revisits, simhash, token_align,
)
from swelter.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


@_query()
def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query(mixing.SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@_query()
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@_query()
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.mark_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids")


@_query()
def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@_query(revisits.SQL)
def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.captures_of(table(spark, sf_dir, "pages")))
    return found.select(
        "record_id", "canonical", F.col("at").alias("captured_at"), "outcome", "refers_to", revisits.header_lines(F.col("headers")).alias("headers")
    )


@_query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query(host_rules.SQL)
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_host_rules(table(spark, sf_dir, "documents"))


@_query()
def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans.identify_languages(table(spark, sf_dir, "documents"))


@_query(line_runs.SQL)
def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("n_kept_chars"), F.md5("kept").alias("kept_md5")
    )


@_query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment_digest(table(spark, sf_dir, "documents"))


@_query()
def op12_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@_query()
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
