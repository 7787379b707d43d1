"""The corpus pipeline: documents in, a mixed training corpus out.

Every stage works on all rows that the one before it kept and hands on the columns of
``documents``; the last adds what the mix takes of each document. Decisions go by row: rows
without an id and rows that share one are judged by their own texts. The line stage alone works by
id: rows without an id keep their lines. Columns beyond those of ``documents`` are handed on as they are,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vozmill.llm import decontamination, line_dedup, quality_rules, simhash_dedup, source_mixing
from vozmill.llm.common import read, stored
from vozmill.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, read(prepare(spark), sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere; a text of such lines only becomes empty."""
    prepare(spark)
    cleaned = line_dedup.dedup_lines(docs, count_col=None)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast("long"))
    return cleaned


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return simhash_dedup.keep_one(docs, shingle=4, max_bits=4)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.keep_clean(docs, read(prepare(spark), sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, and how many."""
    prepare(spark)
    return source_mixing.mix_rows(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("source_mixing", mixed),
]

#: Fuzzy lines, Hamming balls and latent search are beyond SQL; a test holds brute force against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each one's rows are written as Parquet and read again."""
    docs = read(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
