"""Deduplication and merge.

Single-row-per-key selection is ``row_number() = 1``: Spark prunes each map task
to one row per key before the exchange, so a hot key ships one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozmill.functions.ids import merge_key
from vozmill.functions.text import has_loader_hint, strip
from vozmill.schemas import ORDER_COLUMNS


def keep_one(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def _ordering(order_columns, keep: str) -> list[Column]:
    return [F.col(c).desc() if keep == "last" else F.col(c).asc() for c in order_columns]


def with_merge_key(df: DataFrame, order_columns=ORDER_COLUMNS, name: str = "merge_key") -> DataFrame:
    """Merge key; a row without URL and id gets a key of its own."""
    own = F.concat_ws(":", F.lit("row:"), *[F.col(c).cast("string") for c in order_columns])
    return df.withColumn(name, F.coalesce(merge_key(F.col("source_url"), F.col("feedback_id")), own))


def _with_key(df: DataFrame, order_columns) -> DataFrame:
    return with_merge_key(df, order_columns, "_key")


def dedupe_url(df: DataFrame, order_columns=ORDER_COLUMNS) -> DataFrame:
    """One row per bare URL, else per id; the last wins."""
    keyed = _with_key(df, order_columns)
    return keep_one(keyed, [F.col("_key")], _ordering(order_columns, "last")).drop("_key")


def dedupe_id(df: DataFrame, keep: str = "last", order_columns=ORDER_COLUMNS) -> DataFrame:
    """One row per feedback_id, the first or the last."""
    return keep_one(df, [F.col("feedback_id")], _ordering(order_columns, keep))


def dedupe_columns(df: DataFrame, keys: list[Column], keep: str, order_columns) -> DataFrame:
    """One row per whole value of the keys, the first or the last.

    For rows whose short id is a hash of the keys: equal ids of different rows lose nothing.
    """
    keyed = df.withColumn("_digest", F.xxhash64(*keys))
    return keep_one(keyed, [F.col("_digest"), *keys], _ordering(order_columns, keep)).drop("_digest")


def dedupe_content(df: DataFrame, order_columns=ORDER_COLUMNS) -> DataFrame:
    """D3: one row per (source, date, text), the first.

    A 64-bit hash of the text leads the key: sorts compare eight bytes first
    and reach the long text only for equal hashes.
    """
    keyed = df.withColumn("_digest", F.xxhash64("raw_text"))
    keys = [F.col(c) for c in ("_digest", "source", "feedback_date", "raw_text")]
    return keep_one(keyed, keys, _ordering(order_columns, "first")).drop("_digest")


def is_low_quality(source: Column, text: Column, auto_source: str = "site_auto") -> Column:
    """F4 predicate: boilerplate text from the automatic source."""
    return (strip(source) == auto_source) & has_loader_hint(text)


def drop_low_quality(df: DataFrame, auto_source: str = "site_auto") -> DataFrame:
    """F4"""
    return df.where(~is_low_quality(F.col("source"), F.col("raw_text"), auto_source))


def _merge_sides(stored: DataFrame, incoming: DataFrame, auto_source: str) -> DataFrame:
    """One row per key with the surviving stored and incoming row as structs.

    Each side keeps its last row per key and loses it when it is of low quality;
    across the sides the incoming row wins. Both steps need the same grouping,
    so one aggregation with map-side combine does the work of three dedupes, and
    the quality of a text is tested only for the rows that are left.
    """
    sides = _with_key(
        stored.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True))),
        ["_new", *ORDER_COLUMNS],
    )
    row = F.struct(*stored.columns)
    order = F.struct(*ORDER_COLUMNS)
    best = sides.groupBy("_key").agg(
        F.max_by(row, F.when(~F.col("_new"), order)).alias("_old_row"),
        F.max_by(row, F.when(F.col("_new"), order)).alias("_new_row"),
    )

    def clean(side: str) -> Column:
        row = F.col(side)
        bad = is_low_quality(row["source"], row["raw_text"], auto_source)
        return F.when(row.isNotNull() & ~bad, row).alias(side)

    return best.select(clean("_old_row"), clean("_new_row"))


def upsert_feedback(stored: DataFrame, incoming: DataFrame, auto_source: str = "site_auto") -> DataFrame:
    """Merged table. Both frames carry batch_seq and row_ord."""
    merged = _merge_sides(stored, incoming, auto_source).select(
        F.coalesce("_new_row", "_old_row").alias("_row")
    )
    return merged.where(F.col("_row").isNotNull()).select(
        *[F.col(f"_row.{c}").alias(c) for c in stored.columns]
    )


def upsert_added(stored: DataFrame, incoming: DataFrame, auto_source: str = "site_auto") -> DataFrame:
    """One row with stored_rows, merged_rows and added = max(0, merged - stored)."""
    sides = _merge_sides(stored, incoming, auto_source)
    counts = sides.agg(
        F.count("_old_row").alias("stored_rows"),
        F.count(F.coalesce("_new_row", "_old_row")).alias("merged_rows"),
    )
    return counts.withColumn(
        "added", F.greatest(F.lit(0).cast("bigint"), F.col("merged_rows") - F.col("stored_rows"))
    )


def upsert_into_clean(stored: DataFrame, incoming: DataFrame, auto_source: str = "site_auto") -> DataFrame:
    """S8 for a stored table that an earlier upsert wrote (unique keys, no bad rows).

    Equal to :func:`upsert_feedback` there, but the stored rows are only filtered
    by an anti join on the incoming keys. Spark broadcasts those keys when their
    measured size allows, and then a large stored table is not shuffled at all.
    """
    last = drop_low_quality(dedupe_url(incoming), auto_source)
    keys = _with_key(last, ["batch_seq", "row_ord"]).select("_key")
    kept = _with_key(stored, ["batch_seq", "row_ord"]).join(keys, "_key", "left_anti").drop("_key")
    return kept.unionByName(last)


