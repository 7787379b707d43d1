"""Schema alignment, unions and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vozmill.functions.dates import parse_date
from vozmill.functions.ids import stable_id
from vozmill.functions.text import strip
from vozmill.schemas import FEEDBACK_COLUMNS, FEEDBACK_SCHEMA, ORDER_COLUMNS


def align_schema(df: DataFrame, columns=FEEDBACK_COLUMNS, keep=()) -> DataFrame:
    """Add missing columns as blank text, drop others, fix the order; nulls become blank."""
    aligned = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c)
        for c in columns
    ]
    return df.select(*aligned, *[c for c in keep if c in df.columns])


def fill_ids(df: DataFrame) -> DataFrame:
    """T6 ahead of a merge: blank ids get the id that normalization would give them."""
    day, text = parse_date(F.col("feedback_date")), strip(F.col("raw_text"))
    return df.withColumn("feedback_id", stable_id(F.col("feedback_id"), F.col("source"), day, text))


def empty_feedback(spark: SparkSession, schema=FEEDBACK_SCHEMA) -> DataFrame:
    """Typed table without rows."""
    return spark.createDataFrame([], schema)


def require_columns(df: DataFrame, required, what: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns in {what}: {missing}")


def union_sources(frames: list[DataFrame], columns=FEEDBACK_COLUMNS) -> DataFrame:
    """Concatenation that remembers the order of the frames in ``batch_seq``.

    Every frame brings ``row_ord``, its own row order.
    """
    tagged = [
        align_schema(df, columns, keep=["row_ord"]).withColumn("batch_seq", F.lit(i))
        for i, df in enumerate(frames)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).select(
        *columns, *ORDER_COLUMNS
    )


def fallback_source(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The secondary rows only when the primary has none.

    The existence test is a scalar subquery that stops at the first row.
    """
    return primary.unionByName(secondary.where(~primary.select(F.lit(1)).exists()))
