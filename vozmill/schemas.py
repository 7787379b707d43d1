"""Typed schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Column names that inputs and outputs must have
# --------------------------------------------------------------------------
FEEDBACK_COLUMNS = [
    "feedback_id", "source", "source_url", "author", "feedback_date",
    "raw_text", "initial_category", "channel", "status",
]
REVIEW_COLUMNS = FEEDBACK_COLUMNS[:-1]
MANUAL_COLUMNS = ["source_url", "title", "description", "date", "status", "initial_category"]
SEED_COLUMNS = ["author", "feedback_date", "raw_text", "initial_category"]
ANALYSIS_COLUMNS = [
    "sentiment_label", "sentiment_score", "primary_theme", "urgency", "priority",
    "internal_recommendation", "response_guide", "escalation_required", "provider",
    "model_used", "confidence", "analysis_notes",
]
# Explicit row order: position of the batch, position of the row in its batch.
ORDER_COLUMNS = ["batch_seq", "row_ord"]


def strings(names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


FEEDBACK_SCHEMA = strings(FEEDBACK_COLUMNS)
ORDER_FIELDS = [T.StructField("batch_seq", T.IntegerType()), T.StructField("row_ord", T.LongType())]
NORMALIZED_SCHEMA = T.StructType(
    [
        T.StructField(n, T.DateType() if n == "feedback_date" else T.StringType())
        for n in FEEDBACK_COLUMNS
    ]
    + [T.StructField("ingested_at", T.TimestampType())]
)
ANALYSIS_FIELDS = [
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("primary_theme", T.StringType()),
    T.StructField("urgency", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("internal_recommendation", T.StringType()),
    T.StructField("response_guide", T.StringType()),
    T.StructField("escalation_required", T.BooleanType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("analysis_notes", T.StringType()),
]
ANALYZED_SCHEMA = T.StructType(NORMALIZED_SCHEMA.fields + ANALYSIS_FIELDS)
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
