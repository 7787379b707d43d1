"""Dates and relative time phrases. The clock is always an ``as_of`` argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vozmill.functions.text import bind, fold_text, strip, text_or_blank

_DAY = (
    r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2})"
    r"(?:[T ]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?\s*(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
_DATE = r"\b([0-9]{2}/[0-9]{2}/[0-9]{4})\b"
# Fixed value: the singular form matches first, so the unit is always singular.
_AGO = r"ha\s*([0-9]+)\s*(hora|horas|dia|dias|minuto|minutos)"


def as_timestamp(as_of) -> Column:
    """Column for an ``as_of`` given as a Column, a datetime or ISO text."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def parse_date(c: Column) -> Column:
    """Day-first text, else ISO text, else null; decided per row.

    Days and months may have one digit. A time of day may follow a date; it is left out, and
    its zone does not move the day.
    """
    return bind(
        F.regexp_extract(strip(c), _DAY, 1),
        lambda day: F.coalesce(F.try_to_date(day, "d/M/yyyy"), F.try_to_date(day, "yyyy-M-d")),
    )


def extract_date(c: Column) -> Column:
    """First dd/mm/yyyy in a text, blank when none."""
    return F.regexp_extract(text_or_blank(c), _DATE, 1)


def extract_relative(c: Column) -> Column:
    """T11: "ha N unit", else ontem, hoje, agora, in that order; else blank."""
    return bind(fold_text(c), relative_of_folded)


def relative_of_folded(folded: Column) -> Column:
    """T11 for a folded text."""

    def found(ago: Column) -> Column:
        return (
            F.when(ago != "", F.regexp_replace(ago, _AGO, "ha $1 $2"))
            .when(folded.contains("ontem"), F.lit("ontem"))
            .when(folded.contains("hoje"), F.lit("hoje"))
            .when(folded.contains("agora"), F.lit("agora"))
            .otherwise(F.lit(""))
        )

    return bind(F.regexp_extract(folded, _AGO, 0), found)


def parse_relative(c: Column, as_of) -> Column:
    """Relative phrase to timestamp; agora/hoje, then ontem, then "ha N unit"."""
    now = as_timestamp(as_of)

    def moment(folded: Column) -> Column:
        amount = F.regexp_extract(folded, _AGO, 1).try_cast("int")
        unit = F.regexp_extract(folded, _AGO, 2)
        return (
            F.when(folded.contains("agora") | folded.contains("hoje"), now)
            .when(folded.contains("ontem"), now - F.make_interval(days=F.lit(1)))
            .when(unit.startswith("hora"), now - F.make_interval(hours=amount))
            .when(unit.startswith("dia"), now - F.make_interval(days=amount))
            .when(unit.startswith("minuto"), now - F.make_interval(mins=amount))
        )

    return bind(fold_text(c), moment)


def effective_date(explicit: Column, relative: Column, as_of) -> Column:
    """The explicit date, else the day of the relative phrase."""
    return F.coalesce(parse_date(explicit), parse_relative(relative, as_of).cast("date"))


def within_hours(date: Column, as_of, hours: int) -> Column:
    """midnight of the date is not before ``as_of`` minus ``hours``."""
    return date.cast("timestamp") >= as_timestamp(as_of) - F.make_interval(hours=F.lit(int(hours)))
