"""Table and report writers. A path is never overwritten while it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vozmill.operators.dedupe import upsert_feedback, upsert_into_clean
from vozmill.operators.sets import fill_ids, union_sources
from vozmill.sources.readers import path_exists, read_manual


def save_table(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "error") -> str:
    """Write a table as Parquet or as CSV with a header."""
    writer = df.write.mode(mode).format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)
    return path


def save_upsert(
    spark: SparkSession, stored_path: str | None, incoming: DataFrame, out_path: str,
    auto_source: str = "site_auto",
) -> tuple[DataFrame, int]:
    """S8 at rest: merge into a new snapshot directory and count the added rows.

    The stored snapshot is the output of an earlier call (or absent), so its keys
    are unique and the cheaper merge applies.
    """
    if stored_path and stored_path.rstrip("/") == out_path.rstrip("/"):
        raise ValueError("The new snapshot needs a path of its own")
    incoming = fill_ids(incoming)
    known = bool(stored_path) and path_exists(spark, stored_path)
    if known:
        stored = spark.read.parquet(stored_path)
        # Batches continue after the stored ones.
        last = F.coalesce(stored.select(F.max("batch_seq")).scalar(), F.lit(-1))
        shifted = incoming.withColumn("batch_seq", (F.col("batch_seq") + last + 1).cast("int"))
        merged = upsert_into_clean(stored, shifted, auto_source)
    else:
        merged = upsert_feedback(incoming.limit(0), incoming, auto_source)
    save_table(merged, out_path)
    written = spark.read.parquet(out_path)
    before = stored.count() if known else 0
    return written, max(0, written.count() - before)


def load_and_upsert(
    spark: SparkSession, path: str, stored_path: str | None, out_path: str, auto_source: str = "site_auto", **options
) -> tuple[DataFrame, int]:
    """Manual complaints from CSV files merged into a new snapshot; the rows and how many are new.

    ``options`` are those of :func:`read_manual`. Without input files the snapshot stays as it was.
    """
    return save_upsert(spark, stored_path, union_sources([read_manual(spark, path, **options)]), out_path, auto_source)


def save_report(lines: DataFrame, path: str) -> str:
    """S10 as text: a few dozen lines, so one file."""
    lines.orderBy("line_no").coalesce(1).select("text").write.mode("error").text(path)
    return path
