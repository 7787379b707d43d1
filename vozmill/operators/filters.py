"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions import dates
from vozmill.functions.text import is_boilerplate, status_class, strip

ALL, RESOLVED, UNRESOLVED = "Todas", "Resolvidas", "Nao Resolvidas"
_UNRESOLVED_NAMES = {UNRESOLVED, "Não Resolvidas"}


def min_length(df: DataFrame, column: str = "raw_text", n: int = 10) -> DataFrame:
    """trimmed text of at least n characters."""
    return df.where(F.length(strip(F.col(column))) >= n)


def status_matches(c: Column, option: str) -> Column:
    resolved = status_class(c) == lx.STATUS_RESOLVED
    if option == RESOLVED:
        return resolved
    if option in _UNRESOLVED_NAMES:
        return ~resolved
    return F.lit(True)


def status_filter(df: DataFrame, option: str = ALL, column: str = "status") -> DataFrame:
    """resolved, not resolved, or all; an unknown option means all."""
    return df.where(status_matches(F.col(column), option))


def time_window(df: DataFrame, as_of, hours: int | None, column: str = "feedback_date") -> DataFrame:
    """last N hours; rows without date drop out, no hours means no filter."""
    if not hours:
        return df
    return df.where(dates.within_hours(F.col(column), as_of, hours))


def drop_boilerplate(df: DataFrame, column: str = "raw_text", hints=lx.BOILERPLATE_HINTS) -> DataFrame:
    """boilerplate rows of any source."""
    return df.where(~is_boilerplate(F.col(column), hints))


def source_prefix(df: DataFrame, prefix: str = "site_") -> DataFrame:
    """F6"""
    return df.where(F.col("source").startswith(prefix))


def codes_of(labels: dict[str, str], selected: list[str]) -> list[str]:
    """Codes behind the selected labels; a name that is no label stands for itself."""
    known = [code for code, label in labels.items() if label in selected]
    return known + [name for name in selected if name not in labels.values()]


def selection(sources=None, sentiments=None, themes=None) -> Column | None:
    """F7 as a condition: selections by display label; None leaves a column free, nulls never match."""
    chosen = [
        ("source", lx.SOURCE_LABELS, sources),
        ("sentiment_label", lx.SENTIMENT_LABELS, sentiments),
        ("primary_theme", lx.THEME_LABELS, themes),
    ]
    conditions = [
        F.col(column).isin(codes_of(labels, selected))
        for column, labels, selected in chosen
        if selected is not None
    ]
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def multi_filter(df: DataFrame, sources=None, sentiments=None, themes=None) -> DataFrame:
    """F7"""
    condition = selection(sources, sentiments, themes)
    return df if condition is None else df.where(condition)


def high_priority(df: DataFrame, low: int = 4) -> DataFrame:
    """F8"""
    return df.where(F.col("priority") >= low)


def url_path(url: Column) -> Column:
    """Path of a URL, without the parameters of its last segment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_matches(url: Column, path_regex: str) -> Column:
    """the path of the URL matches from its start."""
    return url_path(url).rlike(path_regex)
