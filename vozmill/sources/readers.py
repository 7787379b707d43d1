"""CSV, Parquet and page readers."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozmill import lexicon as lx
from vozmill.functions.dates import parse_date
from vozmill.functions.ids import review_id, url_id
from vozmill.functions.text import clean_review, infer_category, strip
from vozmill.functions.values import to_bool
from vozmill.operators import filters
from vozmill.operators.classify import refresh_guides
from vozmill.operators.dedupe import dedupe_columns
from vozmill.operators.sets import align_schema, empty_feedback, require_columns
from vozmill.schemas import (
    ANALYSIS_COLUMNS, ANALYZED_SCHEMA, FEEDBACK_COLUMNS, MANUAL_COLUMNS, ORDER_FIELDS,
    PAGE_SCHEMA, REVIEW_COLUMNS, SEED_COLUMNS,
)

# Texts that the CSV format treats as missing.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_C = F.col
# A file's rows are numbered in this many bits below the rank of the file.
_PLACE_BITS = 33
# Listings and rows write the beginning of local paths in two ways.
_LOCAL = "^file:/+"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _known(c: Column) -> Column:
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.isin(MISSING_WORDS), F.lit("")).otherwise(text)


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"')


def with_file_order(rows: DataFrame) -> DataFrame:
    """Adds ``row_ord`` to files read whole by one task each: by file path, then by place in the file.

    Spark packs files into tasks by size, so a number that grows along the tasks would not follow
    the names. The rank of a file leads the number, its lower bits grow along the rows of the
    task. Only the list of files is sorted; rows get the rank by a join on their file.
    """
    files = sorted(rows.inputFiles(), key=unquote)
    names = [(rank, re.sub(_LOCAL, "file:/", name)) for rank, name in enumerate(files)]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    placed = rows.select("*", F.regexp_replace("_metadata.file_path", _LOCAL, "file:/").alias("__file"), place.alias("__place"))
    if len(names) < 2:
        return placed.withColumn("row_ord", _C("__place")).drop("__file", "__place")
    ranks = rows.sparkSession.createDataFrame(names, "__rank bigint, __file string")
    known = F.coalesce(_C("__rank"), F.raise_error(F.concat(F.lit("file outside the listing: "), _C("__file"))).cast("bigint"))
    ordered = placed.join(ranks, "__file", "left").withColumn(
        "row_ord", F.shiftleft(known, _PLACE_BITS).bitwiseOR(_C("__place"))
    )
    return ordered.drop("__file", "__place", "__rank")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted line breaks are kept; adds ``row_ord``, over several files too.

    With quoted line breaks Spark reads each file in one task; land large CSV files as
    Parquet once.
    """
    return with_file_order(_csv(spark).csv(path))


def read_lenient_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows longer than the header are skipped, shorter ones end in nulls.

    One column after the header's catches what is too much; empty fields are
    null, so a comma at the end of a full row is no further field.
    ``columns`` names the columns of files that have no header.
    """
    names = columns or _csv(spark).csv(path).columns
    names = ["__own_row_ord" if n == "row_ord" else n for n in names]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__over"]])
    rows = _csv(spark).option("header", not columns).schema(schema).csv(path)
    fitting = with_file_order(rows).where(_C("__over").isNull())
    return fitting.select(
        *[F.nullif(_C(f"`{n}`"), F.lit("")).alias(n) for n in names if n != "__own_row_ord"], "row_ord"
    )


def format_manual(
    raw: DataFrame, status_option: str = filters.ALL, limit: int | None = None,
    source: str = "site_manual", author: str = "Consumidor RA", channel: str = "complaint_site",
) -> DataFrame:
    """S1 on a table with the manual columns and ``row_ord``: filter, limit, join texts, constants."""
    require_columns(raw, MANUAL_COLUMNS, "manual input")
    known = raw.select(*[_known(_C(c)).alias(c) for c in MANUAL_COLUMNS], "row_ord")
    chosen = filters.status_filter(known, status_option)
    if limit is not None:
        chosen = chosen.orderBy("row_ord").limit(max(0, int(limit)))
    parts = [F.nullif(strip(_C(c)), F.lit("")) for c in ("title", "description")]
    rows = chosen.select(
        url_id(_C("source_url"), _C("title"), _C("date")).alias("feedback_id"),
        F.lit(source).alias("source"),
        strip(_C("source_url")).alias("source_url"),
        F.lit(author).alias("author"),
        strip(_C("date")).alias("feedback_date"),
        F.concat_ws(" ", *parts).alias("raw_text"),
        F.coalesce(
            F.nullif(strip(_C("initial_category")), F.lit("")), F.lit(lx.CATEGORY_COMPLAINT)
        ).alias("initial_category"),
        F.lit(channel).alias("channel"),
        strip(_C("status")).alias("status"),
        "row_ord",
    )
    return rows.where(F.length("raw_text") >= 10)


def read_manual(spark: SparkSession, path: str, **options) -> DataFrame:
    """Manual complaints from CSV; a missing file gives the typed empty table."""
    if not path_exists(spark, path):
        return empty_feedback(spark).withColumn("row_ord", F.lit(0).cast("bigint"))
    raw = read_csv(spark, path)
    require_columns(raw, MANUAL_COLUMNS, path)
    return format_manual(raw, **options)


def format_reviews(
    raw: DataFrame, default_url: str, source: str = "reviews_seed", channel: str = "review_site_seed",
) -> DataFrame:
    """S2 on a table with the seed columns and ``row_ord``."""
    require_columns(raw, SEED_COLUMNS, "review seed")
    url = _known(_C("source_url")) if "source_url" in raw.columns else F.lit("")
    rows = raw.select(
        F.coalesce(F.nullif(strip(_known(_C("author"))), F.lit("")), F.lit(lx.ANONYMOUS)).alias("author"),
        strip(_known(_C("feedback_date"))).alias("feedback_date"),
        clean_review(_known(_C("raw_text"))).alias("raw_text"),
        F.coalesce(F.nullif(strip(url), F.lit("")), F.lit(default_url)).alias("source_url"),
        strip(_known(_C("initial_category"))).alias("_given"),
        "row_ord",
    ).where(F.length("raw_text") >= 15)
    done = rows.select(
        review_id(_C("author"), _C("feedback_date"), _C("raw_text"), _C("source_url")).alias("feedback_id"),
        F.lit(source).alias("source"),
        "source_url", "author", "feedback_date", "raw_text",
        F.coalesce(F.nullif(_C("_given"), F.lit("")), infer_category(_C("raw_text"))).alias("initial_category"),
        F.lit(channel).alias("channel"),
        "row_ord",
    )
    hashed = [_C(c) for c in ("author", "feedback_date", "raw_text", "source_url")]
    return dedupe_columns(done, hashed, "first", ["row_ord"])


def read_review_seed(spark: SparkSession, path: str, default_url: str = "https://reviews.example.com/") -> DataFrame:
    """Seed reviews from CSV; a missing file gives the typed empty table."""
    if not path_exists(spark, path):
        return align_schema(empty_feedback(spark), REVIEW_COLUMNS).withColumn("row_ord", F.lit(0).cast("bigint"))
    raw = read_csv(spark, path)
    require_columns(raw, SEED_COLUMNS, path)
    return format_reviews(raw, default_url)


def scan_pages(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """S3: stored pages (page_id, url, html) from Parquet, or raw files as (url, content)."""
    if file_format == "binaryFile":
        files = spark.read.format("binaryFile").load(path)
        return files.select(
            F.xxhash64("path").alias("page_id"), _C("path").alias("url"), "content"
        )
    return spark.read.format(file_format).schema(PAGE_SCHEMA).load(path)


def type_analyzed(raw: DataFrame, prefix: str = "site_") -> DataFrame:
    """S11 on a table of texts: typed columns, source prefix, null guides as blank, fresh guides."""
    present = filters.source_prefix(raw, prefix)
    typed = present.select(
        *[
            (
                parse_date(_C(c)) if c == "feedback_date" else _C(c).cast("string")
            ).alias(c) if c in raw.columns else F.lit("").alias(c)
            for c in FEEDBACK_COLUMNS
        ],
        *[_typed_label(raw, c).alias(c) for c in ANALYSIS_COLUMNS],
        *[c for c in ("batch_seq", "row_ord") if c in raw.columns],
    )
    return refresh_guides(typed)


def _typed_label(raw: DataFrame, name: str) -> Column:
    kind = ANALYZED_SCHEMA[name].dataType
    if name not in raw.columns:
        return F.lit(None).cast(kind)
    if name == "escalation_required":
        return to_bool(_C(name), lx.TRUE_WORDS_STORED)
    if name == "response_guide":
        return strip(_C(name))
    if isinstance(kind, T.IntegerType):
        return _C(name).try_cast("double").try_cast(kind)  # a CSV may hold "4.0"
    return _C(name).try_cast(kind)


def read_analyzed(spark: SparkSession, path: str, file_format: str = "parquet", prefix: str = "site_") -> DataFrame:
    """The analyzed table, from Parquet or (leniently) from CSV."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType(ANALYZED_SCHEMA.fields + ORDER_FIELDS))
    if file_format == "csv":
        return type_analyzed(read_lenient_csv(spark, path), prefix)
    return type_analyzed(spark.read.format(file_format).load(path), prefix)
