"""Orders, samples and numbered lists. The table order is an explicit list of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions.text import cut_text, sample_text
from vozmill.functions.values import title_label_of
from vozmill.schemas import ORDER_COLUMNS

_C = F.col


def table_order() -> list[Column]:
    """L1: newest date first, undated last, then source, then order of arrival."""
    return [_C("feedback_date").desc_nulls_last(), _C("source").asc(), *[_C(c).asc() for c in ORDER_COLUMNS]]


def normalized_order(df: DataFrame) -> DataFrame:
    """L1: global sort, for output only."""
    return df.orderBy(*table_order())


def text_samples(df: DataFrame, n: int = 5, limit: int = 150, dots: bool = True) -> DataFrame:
    """L2: first n texts per positive and negative label; one pass, pruned before the exchange."""
    shown = sample_text if dots else cut_text
    sides = df.where(_C("sentiment_label").isin(lx.POSITIVE, lx.NEGATIVE))
    order = Window.partitionBy("sentiment_label").orderBy(*table_order())
    first = sides.withColumn("position", F.row_number().over(order)).where(_C("position") <= n)
    return first.select("sentiment_label", "position", shown(_C("raw_text"), limit).alias("text"))


def _numbered(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows with their position; only those n rows meet in one task."""
    first = df.orderBy(*order).limit(n)
    return first.withColumn(
        "position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    )


def priority_actions(df: DataFrame, n: int = 10) -> DataFrame:
    """L3: first n cases of high priority with their recommendation."""
    first = _numbered(df.where(_C("priority") >= 4), n, table_order())
    return first.select("position", "priority", "primary_theme", "internal_recommendation")


def priority_guides(df: DataFrame, n: int = 10, limit: int = 240) -> DataFrame:
    """L3: first n cases of high priority that have a guide."""
    rated = df.where((_C("priority") >= 4) & _C("response_guide").isNotNull())
    first = _numbered(rated, n, table_order())
    return first.select(
        "position", "primary_theme", sample_text(_C("response_guide"), limit).alias("guide")
    )


#: The lists of the report: positive and negative texts, actions, guides.
POSITIVE_TEXTS, NEGATIVE_TEXTS, ACTIONS, GUIDES = 1, 2, 4, 5


def report_lists(df: DataFrame, n_texts: int = 5, n_cases: int = 10) -> DataFrame:
    """L2 and L3 in one pass: (list, position, priority, primary_theme, text), texts whole.

    A row is spread into the lists it belongs to, each with the one text that the list shows. Every
    task keeps the first rows of each list before the only exchange.
    """
    high = _C("priority") >= 4
    lists = F.array(
        F.when(_C("sentiment_label") == lx.POSITIVE, F.struct(F.lit(POSITIVE_TEXTS).alias("list"), _C("raw_text").alias("text"))),
        F.when(_C("sentiment_label") == lx.NEGATIVE, F.struct(F.lit(NEGATIVE_TEXTS).alias("list"), _C("raw_text").alias("text"))),
        F.when(high, F.struct(F.lit(ACTIONS).alias("list"), _C("internal_recommendation").alias("text"))),
        F.when(
            high & _C("response_guide").isNotNull(),
            F.struct(F.lit(GUIDES).alias("list"), _C("response_guide").alias("text")),
        ),
    )
    place = ["feedback_date", "source", *ORDER_COLUMNS]
    spread = df.select(*place, "priority", "primary_theme", F.inline(F.array_compact(lists)))
    order = Window.partitionBy("list").orderBy(*table_order())
    first = spread.withColumn("position", F.row_number().over(order)).where(_C("position") <= max(n_texts, n_cases))
    texts = _C("list").isin(POSITIVE_TEXTS, NEGATIVE_TEXTS)
    kept = first.where(_C("position") <= F.when(texts, n_texts).otherwise(n_cases))
    return kept.select("list", "position", "priority", "primary_theme", "text")


def critical_cases(df: DataFrame, numbered: bool = True) -> DataFrame:
    """L4: cases of priority 5 and 4 in report order, with theme label and case number."""
    critical = df.where(_C("priority").isin(4, 5)).withColumn(
        "theme_label", title_label_of(_C("primary_theme"), lx.REPORT_THEME_LABELS)
    )
    columns = ["priority", "theme_label", "raw_text", "internal_recommendation", "response_guide"]
    if not numbered:
        return critical.orderBy(_C("priority").desc(), *table_order()).select(*columns)
    return number_by_priority(critical, "case_no").select("case_no", *columns)


# Rows of one batch are numbered in runs of this many row positions.
RUN_LENGTH = 1 << 20


def number_by_priority(df: DataFrame, name: str) -> DataFrame:
    """1-based position by (priority descending, table order), without a global window.

    A row's number is its place in its run plus the sizes of all runs before it.
    Runs are pieces of (priority, date, source, batch) of bounded length, so a hot
    source or a mass of undated rows is spread over many tasks. Only run sizes
    are summed up: per cell in parallel, and over the cells on one row per
    (priority, date, source).
    """
    undated = F.lit(-(2**31)).cast("bigint")
    cell, run = ["_p", "_d", "_s"], ["_p", "_d", "_s", "_b", "_r"]
    placed = df.withColumns(
        {
            "_p": -_C("priority"),
            "_d": -F.coalesce(F.unix_date("feedback_date").cast("bigint"), undated),
            "_s": F.coalesce("source", F.lit("")),
            "_b": _C("batch_seq"),
            "_r": F.floor(_C("row_ord") / RUN_LENGTH),
        }
    )
    sizes = placed.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.unboundedPreceding, -1)
    in_cell = Window.partitionBy(*cell).orderBy("_b", "_r").rowsBetween(*earlier)
    over_cells = Window.partitionBy(F.lit(1)).orderBy(*cell).rowsBetween(*earlier)
    cells = sizes.groupBy(*cell).agg(F.sum("_n").alias("_cell_n"))
    cell_start = cells.select(*cell, F.sum("_cell_n").over(over_cells).alias("_cell_start"))
    starts = sizes.withColumn("_run_start", F.sum("_n").over(in_cell)).join(cell_start, cell)
    starts = starts.select(
        *run,
        (F.coalesce("_run_start", F.lit(0)) + F.coalesce("_cell_start", F.lit(0))).alias("_start"),
    )
    inner = placed.withColumn(
        "_inner", F.row_number().over(Window.partitionBy(*run).orderBy("row_ord"))
    )
    # Rows without batch or row number form runs of their own, ahead of the others.
    same = [inner[c].eqNullSafe(starts[c]) for c in run]
    numbered = inner.join(starts, same).withColumn(name, _C("_start") + _C("_inner"))
    return numbered.select(*df.columns, name)


def case_table(df: DataFrame) -> DataFrame:
    """High-priority rows by priority, then by the real date, both descending."""
    return df.where(_C("priority") >= 4).orderBy(
        _C("priority").desc(), _C("feedback_date").desc_nulls_last(),
        *[_C(c).asc() for c in ORDER_COLUMNS],
    )


def preview_rows(df: DataFrame, n: int = 30, limit: int = 140) -> DataFrame:
    """First n rows of a fresh batch: date, status and the cut text."""
    first = df.orderBy(*[_C(c).asc() for c in ORDER_COLUMNS]).limit(n)
    return first.select(
        "feedback_date", "status", cut_text(_C("raw_text"), limit).alias("text")
    )
