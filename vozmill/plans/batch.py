"""Collect, merge, normalize, enrich and report in one run.

Every stage is written to the output folder and read back, so later stages and
the many report aggregates start from a table instead of repeating the work, and
a lost executor costs no more than the running stage.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vozmill.operators.aggregates import source_breakdown
from vozmill.operators.classify import classify_rules, enrich
from vozmill.operators.report import report_lines
from vozmill.operators.sets import empty_feedback, fallback_source, union_sources
from vozmill.plans.normalize import normalize_feedback
from vozmill.sources.writers import save_report, save_table, save_upsert

log = logging.getLogger(__name__)

BOTH, AUTO, AUTO_OR_MANUAL, MANUAL = "both", "auto", "auto_or_manual", "manual"


def try_source(spark: SparkSession, name: str, load: Callable[[], DataFrame]) -> DataFrame:
    """A source that cannot be opened (path, schema, columns) is skipped with a warning."""
    try:
        return load()
    except (AnalysisException, ValueError) as problem:
        log.warning("source %s skipped: %s", name, problem)
        return empty_feedback(spark).withColumn("row_ord", F.lit(0).cast("bigint"))


def collect(mode: str, auto: DataFrame, manual: DataFrame) -> DataFrame:
    """The sources of a mode as one table with batch order."""
    if mode == MANUAL:
        return union_sources([manual])
    if mode == AUTO:
        return union_sources([auto])
    if mode == AUTO_OR_MANUAL:
        sides = [union_sources([frame]) for frame in (auto, manual)]
        return fallback_source(*sides)
    if mode == BOTH:
        return union_sources([auto, manual])
    raise ValueError(f"Unknown collection mode: {mode}")


def classify(normalized: DataFrame, replies: DataFrame | None, brand: str) -> DataFrame:
    if replies is None:
        return classify_rules(normalized, brand=brand)
    return enrich(normalized, replies, brand=brand)


@dataclass
class RunResult:
    merged_path: str
    normalized_path: str
    analyzed_path: str
    report_path: str
    added: int
    source_breakdown: DataFrame


def run_batch(
    spark: SparkSession, auto: Callable[[], DataFrame], manual: Callable[[], DataFrame],
    out_dir: str, as_of, stored_path: str | None = None, replies: DataFrame | None = None,
    mode: str = BOTH, brand: str = "Empresa", sort_output: bool = False,
) -> RunResult:
    """P2 (mode "both") and P3 (the other modes): one full run into ``out_dir``.

    ``sort_output`` writes the normalized table in its global order (L1), which
    costs one more shuffle of the whole table; reports do not need it.
    """
    fresh = collect(mode, try_source(spark, "auto", auto), try_source(spark, "manual", manual))
    merged_path = f"{out_dir}/merged"
    merged, added = save_upsert(spark, stored_path, fresh, merged_path)

    normalized_path = save_table(
        normalize_feedback(merged, as_of, sort=sort_output), f"{out_dir}/normalized"
    )
    normalized = spark.read.parquet(normalized_path)
    analyzed_path = save_table(classify(normalized, replies, brand), f"{out_dir}/analyzed")
    analyzed = spark.read.parquet(analyzed_path)
    report_path = save_report(report_lines(analyzed), f"{out_dir}/report")
    return RunResult(
        merged_path, normalized_path, analyzed_path, report_path, added, source_breakdown(normalized)
    )


