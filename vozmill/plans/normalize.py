"""From collected to normalized feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vozmill.functions import dates
from vozmill.functions.ids import stable_id
from vozmill.functions.text import strip
from vozmill.operators.dedupe import dedupe_content
from vozmill.operators.ordering import normalized_order
from vozmill.operators.sets import align_schema, union_sources
from vozmill.schemas import FEEDBACK_COLUMNS, ORDER_COLUMNS

_C = F.col


def normalize_rows(df: DataFrame, as_of, min_chars: int = 10) -> DataFrame:
    """Row-wise part of P1: trim, length, date, id, ingestion time. No shuffle."""
    aligned = align_schema(df, FEEDBACK_COLUMNS, keep=ORDER_COLUMNS)
    trimmed = aligned.withColumn("raw_text", strip(_C("raw_text")))
    dated = trimmed.where(F.length("raw_text") >= min_chars).withColumn(
        "feedback_date", dates.parse_date(_C("feedback_date"))
    )
    named = dated.withColumn(
        "feedback_id",
        stable_id(_C("feedback_id"), _C("source"), _C("feedback_date"), _C("raw_text")),
    )
    return named.withColumn("ingested_at", dates.as_timestamp(as_of)).select(
        *FEEDBACK_COLUMNS, "ingested_at", *ORDER_COLUMNS
    )


def normalize_feedback(frames: DataFrame | list[DataFrame], as_of, sort: bool = False) -> DataFrame:
    """Normalized, deduplicated feedback; sorted only when it is the output.

    ``frames`` is one table with batch_seq and row_ord, or a list of tables with row_ord.
    """
    df = union_sources(frames) if isinstance(frames, list) else frames
    unique = dedupe_content(normalize_rows(df, as_of))
    return normalized_order(unique) if sort else unique
