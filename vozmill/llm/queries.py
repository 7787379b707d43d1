"""Registered queries of the operators: name -> function of (spark, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vozmill.llm import (
    collocations, consistent_parsing, decontamination, language_id, lexical_search, license_scan, line_dedup,
    quality_classifier, quality_rules, simhash_dedup, source_mixing, toxicity, url_reputation,
)
from vozmill.llm.common import read
from vozmill.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read(spark, d, "documents"), shingle=4, max_bits=4)


def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.find_contaminated(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.identify(read(spark, d, "documents"), folds=5, fold=0)


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_rows(read(spark, d, "documents"), read(spark, d, "labels"), folds=5, fold=0)


RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Per document: its text without lines that repeat, and how many went."""
    cleaned = line_dedup.dedup_lines(read(spark, d, "documents"), similarity=0.8)
    return cleaned.select("doc_id", "n_removed", "text")


def op6_url_reputation(spark: SparkSession, d: str) -> DataFrame:
    """A page's outcome is that of the document whose number ends its path: of low quality, or toxic."""
    pages = read(spark, d, "pages")
    number = F.regexp_extract("url", r"^.*?://[^/?#]*(?:/[^/?#]*)*?/(\d+)(?:\.html)?/?(?:[?#].*)?$", 1)
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long")
    labels = read(spark, d, "labels").groupBy("doc_id").agg(F.max(bad).alias("outcome"))
    numbered = pages.select("page_id", number.try_cast("bigint").alias("doc_id"))
    outcomes = numbered.join(labels, "doc_id").select("page_id", "outcome")
    return url_reputation.judge(pages, outcomes, RULES)


def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan(read(spark, d, "documents"))


def op8_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality_classifier.score_rows(read(spark, d, "documents"), read(spark, d, "labels"), folds=4, fold=2)


def op9_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return source_mixing.mix(read(spark, d, "documents"), weights=(3, 1, 2), share=1.5, cap=2)


def op10_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.judge(read(spark, d, "documents"), read(spark, d, "labels"))


def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations.collocations(read(spark, d, "documents"), max_words=3, min_count=10, held_percent=50, top=2000)


def op12_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return consistent_parsing.with_neighbours(read(spark, d, "documents"))


def op13_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical_search.search(read(spark, d, "documents"), read(spark, d, "benchmark"), top=50)


def _prepared(function: Query) -> Query:
    return lambda spark, d: function(prepare(spark), d)


QUERIES: dict[str, Query] = {
    f.__name__: _prepared(f)
    for f in (
        op1_simhash_dedup, op2_decontamination, op3_language_id, op4_toxicity, op5_line_dedup, op6_url_reputation, op7_license_scan,
        op8_quality_classifier, op9_source_mixing, op10_quality_rules, op11_collocations,
        op12_document_fingerprints, op13_lexical_search,
    )
}
