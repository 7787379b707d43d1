"""Keyword rules as expressions.

``flags`` turns the text into a few small columns (counts and booleans); every
other rule reads only those, so the long text is searched once per keyword.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions.text import (
    case_match, clean_author, contains_any, count_hits, reference_from, strip,
)


def flags(text: Column, lowered: Column) -> dict[str, Column]:
    """Hit counts and trigger flags of one text; ``lowered`` is its lower-case form."""
    out = {f"_hits_{i}": count_hits(lowered, words) for i, words in enumerate(lx.THEME_KEYWORDS.values())}
    out["_negative"] = count_hits(lowered, lx.NEGATIVE_WORDS)
    out["_positive"] = count_hits(lowered, lx.POSITIVE_WORDS)
    out["_urgent"] = contains_any(lowered, lx.URGENT_WORDS)
    out.update(case_flags(text, lowered))
    return out


def case_flags(text: Column, lowered: Column) -> dict[str, Column]:
    """Flags for issue summary and next step, and the place that names the case."""
    exchange = lowered.contains("troca")
    return {
        "_coupon": lowered.contains("cupom"),
        "_not_received": contains_any(lowered, ["nao recebi", "não recebi"]),
        "_refund": contains_any(lowered, ["reembolso", "estorno"]),
        "_refused": exchange & lowered.contains("recus"),
        "_exchange": exchange | contains_any(lowered, ["devolu", "cancel", "arrependimento"]),
        "_case": case_match(text),
    }


def reference() -> Column:
    """T19 from the match kept by :func:`case_flags`."""
    return reference_from(F.col("_case"))


def theme(hits=None) -> Column:
    """Theme with most hits, ties by declared order, "outros" without hits."""
    themes = list(lx.THEME_KEYWORDS)
    hits = hits or [F.col(f"_hits_{i}") for i in range(len(themes))]
    # Ranks fall along the declared order; "outros" is best only when all counts are 0.
    options = [F.struct(F.lit(0).alias("n"), F.lit(1).alias("rank"), F.lit(lx.OTHER_THEME).alias("name"))]
    for i, (name, hit) in enumerate(zip(themes, hits)):
        options.append(F.struct(hit.alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("name")))
    return F.array_max(F.array(*options))["name"]


def sentiment(negative=None, positive=None) -> Column:
    """The side with more hits."""
    negative = F.col("_negative") if negative is None else negative
    positive = F.col("_positive") if positive is None else positive
    return (
        F.when(negative > positive, F.lit(lx.NEGATIVE))
        .when(positive > negative, F.lit(lx.POSITIVE))
        .otherwise(F.lit(lx.NEUTRAL))
    )


def sentiment_score(negative=None, positive=None) -> Column:
    """In integer hundredths, so that the double is exact."""
    negative = F.col("_negative") if negative is None else negative
    positive = F.col("_positive") if positive is None else positive
    hundredths = (
        F.when(negative > positive, F.greatest(F.lit(-100), F.lit(-35) - negative * 10))
        .when(positive > negative, F.least(F.lit(100), F.lit(35) + positive * 10))
        .otherwise(F.lit(0))
    )
    return hundredths.cast("double") / 100


def urgency(urgent: Column, label: Column) -> Column:
    """C3"""
    return (
        F.when(urgent, F.lit("alta")).when(label == lx.NEGATIVE, F.lit("media")).otherwise(F.lit("baixa"))
    )


def priority(label: Column, urgency_: Column, theme_: Column) -> Column:
    """C4: 1..5"""
    points = (
        F.lit(1)
        + F.when(label == lx.NEGATIVE, 2).otherwise(0)
        + F.when(urgency_ == "media", 1).when(urgency_ == "alta", 2).otherwise(0)
        + theme_.isin(lx.WEIGHTY_THEMES).cast("int")
    )
    return F.greatest(F.lit(1), F.least(F.lit(5), points))


def escalation(priority_: Column, urgency_: Column) -> Column:
    """C5"""
    return (priority_ >= 4) | (urgency_ == "alta")


def by_theme(theme_: Column, texts: dict[str, str]) -> Column:
    """Text of the theme; a theme without text takes the one of "outros"."""
    pairs = [F.when(theme_ == name, F.lit(text)) for name, text in texts.items() if name != lx.OTHER_THEME]
    return F.coalesce(*pairs, F.lit(texts[lx.OTHER_THEME]))


def recommendation(theme_: Column, label: Column) -> Column:
    """C6"""
    return F.when(label == lx.POSITIVE, F.lit(lx.PRAISE_RECOMMENDATION)).otherwise(
        by_theme(theme_, lx.RECOMMENDATIONS)
    )


def issue_summary(theme_: Column, wording: str = "rules") -> Column:
    """Ordered special cases, then the theme."""
    return (
        F.when(F.col("_coupon"), F.lit(lx.ISSUE_COUPON[wording]))
        .when(F.col("_not_received"), F.lit(lx.ISSUE_NOT_RECEIVED[wording]))
        .when(F.col("_refund"), F.lit(lx.ISSUE_REFUND[wording]))
        .when(F.col("_refused"), F.lit(lx.ISSUE_EXCHANGE_REFUSED[wording]))
        .otherwise(by_theme(theme_, lx.ISSUE_BY_THEME[wording]))
    )


def next_step(theme_: Column, wording: str = "rules") -> Column:
    """Ordered special cases, then the theme; only "rules" knows the exchange step."""
    chain = F.when(F.col("_coupon"), F.lit(lx.STEP_COUPON[wording])).when(
        F.col("_refund"), F.lit(lx.STEP_REFUND[wording])
    )
    if wording == "rules":
        chain = chain.when(F.col("_exchange"), F.lit(lx.STEP_EXCHANGE))
    return chain.otherwise(by_theme(theme_, lx.STEP_BY_THEME[wording]))


def fill(template: str, **values: Column) -> Column:
    """Concatenate a template with {named} slots from literals and columns."""
    pieces = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if piece.startswith("{") and piece.endswith("}"):
            pieces.append(values[piece[1:-1]])
        elif piece:
            pieces.append(F.lit(piece))
    return F.concat(*pieces)


def fast_track(urgency_: Column) -> Column:
    return urgency_.isin("alta", "critica")


def reply_text(
    label: Column, urgency_: Column, issue: Column, step: Column, reference: Column,
    wording: str = "rules", author: Column | None = None, brand: str = "Empresa",
) -> Column:
    """Thanks for praise, otherwise apology with case, step and pace."""
    greeting = F.lit("Ola")
    if author is not None:
        name = clean_author(author)
        greeting = F.when(name != "", F.concat(F.lit("Ola, "), name)).otherwise(greeting)
    pace = F.when(fast_track(urgency_), F.lit(lx.PRIORITY_FAST)).otherwise(F.lit(lx.PRIORITY_NORMAL))
    praise = fill(lx.PRAISE_TEXT[wording], greeting=greeting, brand=F.lit(brand))
    apology = fill(
        lx.APOLOGY_TEXT[wording],
        greeting=greeting, issue=issue, reference=reference, priority=pace, step=step,
    )
    return F.when(label == lx.POSITIVE, praise).otherwise(apology)


def response_guide(
    urgency_: Column, issue: Column, step: Column, reference: Column, text: Column,
    wording: str = "rules", recommendation_: Column | None = None,
) -> Column:
    """Guide for the agent around the editable text."""
    sla = F.when(fast_track(urgency_), F.lit(lx.SLA_FAST)).otherwise(F.lit(lx.SLA_NORMAL))
    values = dict(issue=issue, reference=reference, step=step, sla=sla, text=text)
    if wording == "model":
        given = F.lit("") if recommendation_ is None else recommendation_
        values["recommendation"] = F.when(given == "", F.lit(lx.VALIDATE_WITH_TEAM)).otherwise(
            strip(given)
        )
    return fill(lx.GUIDE_TEXT[wording], **values)
