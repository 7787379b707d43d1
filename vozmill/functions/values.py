"""Typed values, labels and column aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions.text import strip


def to_bool(c: Column, true_words=lx.TRUE_WORDS) -> Column:
    """Text is true when it is one of the words; numbers when not zero."""
    text = F.lower(strip(c))
    return text.isin(true_words)


def number_to_bool(c: Column) -> Column:
    return F.coalesce(c != 0, F.lit(False))


# Texts that a cast can read as a number begin and end like this, blanks and control signs aside.
_NUMBER_LIKE = (
    r"^[\x00-\x20\x7f]*(?:[+-]?(?:[0-9.][0-9A-Za-z.+-]*|(?i:inf(?:inity)?|nan))|true|false)[\x00-\x20\x7f]*$"
)


def to_number(c: Column, default=0, low=None, high=None, kind: str = "double") -> Column:
    """Typed number or the default, then clamped. Whole numbers keep all digits; fractions are cut off.

    A failed cast raises and catches an error, which costs far more than a look at the letters first.
    """
    given = F.when(c.cast("string").rlike(_NUMBER_LIKE), c)
    typed = given.try_cast(kind)
    if kind in ("int", "bigint"):
        typed = F.coalesce(typed, given.try_cast("double").try_cast(kind))
    value = F.coalesce(typed, F.lit(default).cast(kind))
    if low is not None:
        value = F.greatest(value, F.lit(low).cast(kind))
    if high is not None:
        value = F.least(value, F.lit(high).cast(kind))
    return value


def percent(part: Column, total: Column) -> Column:
    """Share in percent with one digit, half up in integers; 0.0 for an empty total."""
    part, total = part.cast("bigint"), total.cast("bigint")
    tenths = F.floor((part * 2000 + total) / F.nullif(total * 2, F.lit(0)))
    return F.coalesce(tenths.cast("double") / 10, F.lit(0.0))


def label_of(c: Column, labels: dict[str, str], missing: str | None = "-") -> Column:
    """Code to label; unknown codes pass through, null gives ``missing``."""
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    shown = F.coalesce(F.try_element_at(lookup, c), c)
    return shown if missing is None else F.coalesce(shown, F.lit(missing))


def title_label_of(c: Column, labels: dict[str, str]) -> Column:
    """T16, report form: unknown codes are shown as words with capitals."""
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(
        F.try_element_at(lookup, c), F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    )


def resolve_column(df: DataFrame, options: list[str], fallback: str = "") -> str:
    """First of the names that the table has."""
    return next((name for name in options if name in df.columns), fallback)


# Synonyms under which the labels are also published (fixed values: column names).
ALIASES = {
    "actionable_recommendation": "internal_recommendation",
    "resposta_sugerida_cliente": "response_guide",
    "suggested_customer_response": "response_guide",
    "guia_resposta_atendente": "response_guide",
    "sentimento": "sentiment_label",
    "tema_principal": "primary_theme",
    "prioridade": "priority",
}


def with_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Repeat columns under their synonyms."""
    return df.select(
        "*", *[F.col(old).alias(new) for new, old in aliases.items() if old in df.columns]
    )
