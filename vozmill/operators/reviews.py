"""Review pages: dated lines open reviews.

The text of a page is one value, so lines, segments and authors are array
expressions within its row: no shuffle, and no page can become a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions.ids import review_id
from vozmill.functions.text import bind, clean_review, collapse_spaces, infer_category, text_or_blank
from vozmill.operators.dedupe import dedupe_columns

_C = F.col
# Line ends in the sense of Unicode text.
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_DATE_LINE = "^[0-9]{2}/[0-9]{2}/[0-9]{4}$"


def lines_of(text: Column) -> Column:
    """Cleaned, non-blank lines of a text as an array."""
    cleaned = F.transform(F.split(text_or_blank(text), _LINE_END), collapse_spaces)
    return F.filter(cleaned, lambda line: line != "")


def is_date_line(line: Column) -> Column:
    return line.rlike(_DATE_LINE)


def is_stop_line(line: Column) -> Column:
    return F.upper(line).isin(lx.REVIEW_STOP_LINES)


def page_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """Numbered lines of every page (page_id, line_no, line), from 0."""
    # The outer form keeps Spark from testing the array for emptiness, which would split twice.
    lines = pages.select("page_id", F.posexplode_outer(lines_of(_C(text))).alias("line_no", "line"))
    return lines.where(_C("line").isNotNull())


def _dated(lines: Column) -> Column:
    """Positions (from 1) of the date lines, closed by one past the end."""
    numbered = F.transform(lines, lambda line, i: F.when(is_date_line(line), i + 1))
    marks = F.filter(numbered, lambda i: i.isNotNull())
    return F.concat(marks, F.array(F.size(lines) + 1))


def _reviews(pages: DataFrame, text: str, keep) -> DataFrame:
    """One row per date line with its author, segment and cleaned segment."""
    split = pages.select("page_id", *keep, lines_of(_C(text)).alias("_lines"))
    marked = split.withColumn("_marks", _dated(_C("_lines")))
    opened = F.transform(
        F.slice("_marks", F.lit(1), F.size("_marks") - 1), lambda at, i: _review(at, i)
    )
    # The outer form keeps Spark from testing the array for emptiness, which would build it twice.
    reviews = marked.withColumn("_reviews", opened).select("page_id", *keep, F.inline_outer("_reviews"))
    return reviews.where(_C("line_no").isNotNull())


def review_segments(pages: DataFrame, text: str = "text", keep=()) -> DataFrame:
    """One row per date line: page_id, line_no, feedback_date, author, segment.

    The segment holds the lines up to the next date without stop lines. The author
    is the nearest of the seven lines before that is neither date nor stop line
    and has at most 80 characters.
    """
    return _reviews(pages, text, keep).drop("raw_text")


def _review(at: Column, i: Column) -> Column:
    """Struct of the review opened by the date line at position ``at`` (from 1), mark ``i``."""
    body = F.slice("_lines", at + 1, F.element_at("_marks", i + 2) - at - 1)
    first = F.greatest(F.lit(1), at - 7)
    before = F.reverse(F.slice("_lines", first, at - first))
    names = F.filter(
        before, lambda line: ~is_date_line(line) & ~is_stop_line(line) & (F.length(line) <= 80)
    )
    segment = F.array_join(F.filter(body, lambda line: ~is_stop_line(line)), " ")
    return bind(
        segment,
        lambda t: F.struct(
            (at - 1).alias("line_no"),
            F.element_at("_lines", at).alias("feedback_date"),
            F.coalesce(F.get(names, F.lit(0)), F.lit(lx.ANONYMOUS)).alias("author"),
            t.alias("segment"),
            clean_review(t).alias("raw_text"),
        ),
    )


def review_records(
    pages: DataFrame, text: str = "text", url: str = "url",
    source: str = "reviews", channel: str = "review_site",
) -> DataFrame:
    """Feedback rows (without status) of review pages; the first of equal reviews is kept."""
    # The cleaned text comes out of the generator, so the length filter does not repeat its work.
    records = _reviews(pages, text, [url]).where(F.length("raw_text") >= 15).select(
        review_id(_C("author"), _C("feedback_date"), _C("raw_text"), _C(url)).alias("feedback_id"),
        F.lit(source).alias("source"),
        _C(url).alias("source_url"),
        "author",
        "feedback_date",
        "raw_text",
        infer_category(_C("raw_text")).alias("initial_category"),
        F.lit(channel).alias("channel"),
        "page_id",
        "line_no",
    )
    hashed = [_C(c) for c in ("author", "feedback_date", "raw_text", "source_url")]
    return dedupe_columns(records, hashed, "first", ["page_id", "line_no"])
