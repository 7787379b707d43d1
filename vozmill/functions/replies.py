"""Model replies: JSON text to typed, validated labels (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions.text import (
    bind, collapse_spaces, contains_all, count_hits, strip, text_or_blank,
)


def json_block(reply: Column) -> Column:
    """M1: text from the first "{" to the last "}"; a null or empty reply counts as "{}"."""
    text = F.when(reply.isNull() | (reply == ""), F.lit("{}")).otherwise(reply)
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def parse_reply(reply: Column) -> Column:
    """M1: variant of the JSON object, null when the reply is not valid."""
    return F.try_parse_json(json_block(reply))


def pick(payload: Column, keys: list[str]) -> Column:
    """M2: value of the first key that is present, as variant; a JSON null is present."""
    return F.coalesce(*[F.try_variant_get(payload, f"$.{k}", "variant") for k in keys])


def kind_of(value: Column) -> Column:
    """One of VOID, BOOLEAN, STRING, BIGINT, DECIMAL, DOUBLE, ARRAY, OBJECT; null when absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def as_text(value: Column) -> Column:
    """Text of a value as the labels see it: null is "none", absent is null."""
    kind = kind_of(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def is_number(value: Column) -> Column:
    return kind_of(value).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def pick_nonblank(payload: Column, keys: list[str], default: str) -> Column:
    """M3: first value that is not empty, zero, false or null; trimmed; else the default."""

    def filled(value: Column) -> Column:
        text = as_text(value)
        empty = (
            (F.coalesce(kind_of(value), F.lit("VOID")) == "VOID")
            | text.isin("", "[]", "{}")
            | ((kind_of(value) == "BOOLEAN") & (text == "False"))
            | (is_number(value) & (F.try_variant_get(value, "$", "double") == 0))
        )
        return F.when(~empty, text)

    options = [bind(F.try_variant_get(payload, f"$.{k}", "variant"), filled) for k in keys]
    return bind(
        strip(F.coalesce(*options, F.lit(default))),
        lambda text: F.when(text == "", F.lit(default)).otherwise(text),
    )


def pick_enum(payload: Column, keys: list[str], allowed: list[str], default: str) -> Column:
    """M4: lower-case trimmed label, the default when it is not allowed."""
    return bind(
        F.lower(strip(bind(pick(payload, keys), as_text))),
        lambda label: F.when(label.isin(allowed), label).otherwise(F.lit(default)),
    )


def whole_number(value: Column, default: int) -> Column:
    """M5: integer of a JSON value before clamping, as bigint.

    Numbers are cut to whole, true is 1, text must be a whole number; anything
    else gives the default. Numbers beyond bigint keep their sign at its limit.
    """
    return bind(value, lambda bound: _whole(bound, default))


def _whole(value: Column, default: int) -> Column:
    kind = kind_of(value)
    text = strip(F.try_variant_get(value, "$", "string"))
    big = F.try_variant_get(value, "$", "double")
    limit = F.lit(2**62)
    from_number = F.coalesce(
        F.try_variant_get(value, "$", "bigint"),
        F.when(big > 0, limit).when(big < 0, -limit),
    )
    from_text = F.when(
        text.rlike(r"^[+-]?[0-9]+$"),
        F.coalesce(
            text.try_cast("bigint"), F.when(text.startswith("-"), -limit).otherwise(limit)
        ),
    )
    number = F.when(kind == "STRING", from_text).when(
        kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), from_number
    )
    return F.coalesce(number, F.lit(default).cast("bigint"))


def real_number(value: Column, default: float) -> Column:
    """M5: double of a JSON number, boolean or numeric text, else the default."""
    return bind(value, lambda bound: _real(bound, default))


def _real(value: Column, default: float) -> Column:
    kind = kind_of(value)
    text = strip(F.try_variant_get(value, "$", "string"))
    from_text = F.when(~text.rlike("[0-9.][dDfF]$"), text.try_cast("double"))
    number = F.when(kind == "STRING", from_text).when(
        kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"),
        F.try_variant_get(value, "$", "double"),
    )
    return F.coalesce(number, F.lit(default))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def reply_urgency(value: Column, raw_priority: Column) -> Column:
    """M6: own urgency if given; blank or absent is derived from the unclamped priority."""
    given = F.coalesce(F.lower(strip(bind(value, as_text))), F.lit(""))
    derived = (
        F.when(raw_priority >= 5, F.lit("critica"))
        .when(raw_priority >= 4, F.lit("alta"))
        .when(raw_priority <= 2, F.lit("baixa"))
        .otherwise(F.lit("media"))
    )
    return F.when(given == "", derived).when(given.isin(lx.URGENCIES), given).otherwise(F.lit("media"))


def reply_flag(value: Column) -> Column:
    """Escalation flag: boolean, non-zero number or one of the true words; absent is false."""

    def flag(bound: Column) -> Column:
        return (
            F.when(kind_of(bound) == "BOOLEAN", F.try_variant_get(bound, "$", "boolean"))
            .when(is_number(bound), F.try_variant_get(bound, "$", "double") != 0)
            .otherwise(F.lower(strip(as_text(bound))).isin(lx.TRUE_WORDS))
        )

    return F.coalesce(bind(value, flag), F.lit(False))


def is_generic(c: Column) -> Column:
    """M7: short, or made of generic phrases without anything specific."""
    return bind(
        collapse_spaces(F.lower(text_or_blank(c))),
        lambda text: (F.length(text) < lx.GENERIC_MIN_LENGTH)
        | (
            (count_hits(text, lx.GENERIC_MARKERS) >= 2)
            & (count_hits(text, lx.SPECIFIC_MARKERS) == 0)
        ),
    )


def looks_customer_facing(c: Column) -> Column:
    """M8: opens like a letter to the customer and lacks the internal labels."""
    openers = "^(?:" + "|".join(lx.DIRECT_OPENERS) + ")"
    return bind(
        F.lower(strip(c)),
        lambda text: text.rlike(openers) & ~contains_all(text, lx.INTERNAL_LABELS),
    )


def has_guide_shape(c: Column) -> Column:
    return bind(F.lower(text_or_blank(c)), lambda text: contains_all(text, lx.GUIDE_LABELS))


def ensure_guide(response: Column, default_guide: Column, wrapped: Column) -> Column:
    """M9: keep a guide, replace blank, generic or customer-facing text, wrap the rest."""
    return bind(
        strip(response),
        lambda text: F.when(text == "", default_guide)
        .when(has_guide_shape(text), text)
        .when(looks_customer_facing(text) | is_generic(text), default_guide)
        .otherwise(wrapped),
    )
