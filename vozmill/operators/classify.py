"""Rule classification, reply validation and enrichment as layers of projections.

Layers matter: the text is lowered once, searched once per keyword, and every
later rule reads the small flag columns. Catalyst keeps the layers apart because
an expensive expression that is used several times is not inlined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions import replies, rules
from vozmill.functions.ids import content_key
from vozmill.functions.text import contains_all, fold_accents, strip, text_or_blank
from vozmill.operators.dedupe import keep_one
from vozmill.schemas import ANALYSIS_COLUMNS

_C = F.col


def with_flags(df: DataFrame, text: str = "raw_text", accents: bool = False) -> DataFrame:
    """Scratch columns of the rules; ``accents=True`` folds accents before matching."""
    lowered = fold_accents(_C(text)) if accents else F.lower(text_or_blank(_C(text)))
    return df.withColumn("_lower", lowered).withColumns(rules.flags(_C(text), _C("_lower")))


def classify_labels(df: DataFrame, text: str = "raw_text", accents: bool = False) -> DataFrame:
    """Labels only, with the scratch columns still in place."""
    flagged = with_flags(df, text, accents)
    labelled = flagged.withColumns(
        {
            "sentiment_label": rules.sentiment(),
            "sentiment_score": rules.sentiment_score(),
            "primary_theme": rules.theme(),
            "_reference": rules.reference(),
        }
    )
    urgent = labelled.withColumn("urgency", rules.urgency(_C("_urgent"), _C("sentiment_label")))
    ranked = urgent.withColumn(
        "priority", rules.priority(_C("sentiment_label"), _C("urgency"), _C("primary_theme"))
    )
    return ranked.withColumns(
        {
            "escalation_required": rules.escalation(_C("priority"), _C("urgency")),
            "internal_recommendation": rules.recommendation(_C("primary_theme"), _C("sentiment_label")),
        }
    )


def add_rule_texts(df: DataFrame, brand: str = "Empresa") -> DataFrame:
    """C7-C10 in the rules wording, as scratch columns and ``response_guide``."""
    return (
        df.withColumns(
            {
                "_issue": rules.issue_summary(_C("primary_theme"), "rules"),
                "_step": rules.next_step(_C("primary_theme"), "rules"),
            }
        )
        .withColumn(
            "_reply",
            rules.reply_text(
                _C("sentiment_label"), _C("urgency"), _C("_issue"), _C("_step"), _C("_reference"),
                brand=brand,
            ),
        )
        .withColumn(
            "response_guide",
            rules.response_guide(_C("urgency"), _C("_issue"), _C("_step"), _C("_reference"), _C("_reply")),
        )
    )


def classify_rules(
    df: DataFrame, text: str = "raw_text", accents: bool = False, brand: str = "Empresa"
) -> DataFrame:
    """C11: all rule labels, the guide, and the provenance columns."""
    done = add_rule_texts(classify_labels(df, text, accents), brand).withColumns(
        {
            "provider": F.lit(lx.PROVIDER_RULES),
            "model_used": F.lit(lx.RULES_MODEL),
            "confidence": F.lit(lx.RULES_CONFIDENCE),
            "analysis_notes": F.lit(lx.NOTE_MISSING),
        }
    )
    base = [c for c in df.columns if c not in ANALYSIS_COLUMNS]
    return done.select(*base, *ANALYSIS_COLUMNS)


def reply_labels(df: DataFrame, reply: str = "reply", keys=lx.REPLY_KEYS) -> DataFrame:
    """M1-M6: validated labels of a reply column, prefix ``m_``; ``_valid`` tells usable replies."""
    payload = _C("_payload")
    raw = df.withColumn("_payload", replies.parse_reply(_C(reply))).withColumns(
        {
            "_valid": payload.isNotNull(),
            "_priority_raw": replies.whole_number(
                replies.pick(payload, keys["priority"]), lx.DEFAULT_PRIORITY
            ),
        }
    )
    return raw.withColumns(
        {
            "m_sentiment": replies.pick_enum(payload, keys["sentiment"], lx.SENTIMENTS, lx.NEUTRAL),
            "m_theme": replies.pick_enum(payload, keys["theme"], lx.THEMES, lx.OTHER_THEME),
            "m_urgency": replies.reply_urgency(replies.pick(payload, keys["urgency"]), _C("_priority_raw")),
            "m_priority": replies.clamp(_C("_priority_raw"), 1, 5).cast("int"),
            "m_score": replies.clamp(
                replies.real_number(replies.pick(payload, keys["score"]), 0.0), -1.0, 1.0
            ),
            "m_confidence": replies.clamp(
                replies.real_number(replies.pick(payload, keys["confidence"]), lx.DEFAULT_CONFIDENCE),
                0.0, 1.0,
            ),
            "m_escalation": replies.reply_flag(replies.pick(payload, keys["escalation"])),
            "m_recommendation": replies.pick_nonblank(
                payload, keys["recommendation"], lx.REVIEW_MANUALLY
            ),
            "m_response": replies.pick_nonblank(payload, keys["response"], ""),
        }
    )


def _model_guide(df: DataFrame, response: Column, author: Column, brand: str) -> DataFrame:
    """M9 on top of the final labels; needs the case flags of the text."""
    staged = df.withColumns(
        {
            "_m_issue": rules.issue_summary(_C("primary_theme"), "model"),
            "_m_step": rules.next_step(_C("primary_theme"), "model"),
        }
    ).withColumn(
        "_m_text",
        rules.reply_text(
            _C("sentiment_label"), _C("urgency"), _C("_m_issue"), _C("_m_step"), _C("_reference"),
            wording="model", author=author, brand=brand,
        ),
    )
    default = rules.response_guide(
        _C("urgency"), _C("_m_issue"), _C("_m_step"), _C("_reference"), _C("_m_text"),
        wording="model", recommendation_=_C("internal_recommendation"),
    )
    wrapped = rules.fill(
        lx.GUIDE_TEXT["wrapped"],
        issue=_C("_m_issue"), reference=_C("_reference"), step=_C("_m_step"), text=strip(response),
    )
    return staged.withColumn("_m_guide", replies.ensure_guide(response, default, wrapped))


def validate_reply(
    df: DataFrame, reply: str = "reply", text: str = "raw_text", author: str = "author",
    model_name: str = "batch_model", brand: str = "Empresa", keys=lx.REPLY_KEYS,
) -> DataFrame:
    """Rows with a valid reply, typed labels and a guide. Invalid replies drop out."""
    labels = reply_labels(df, reply, keys).where(_C("_valid"))
    lowered = labels.withColumn("_lower", F.lower(text_or_blank(_C(text))))
    named = lowered.withColumns(rules.case_flags(_C(text), _C("_lower"))).withColumns(
        {
            "_reference": rules.reference(),
            "sentiment_label": _C("m_sentiment"),
            "sentiment_score": _C("m_score"),
            "primary_theme": _C("m_theme"),
            "urgency": _C("m_urgency"),
            "priority": _C("m_priority"),
            "internal_recommendation": _C("m_recommendation"),
            "escalation_required": _C("m_escalation"),
            "provider": F.lit(lx.PROVIDER_MODEL),
            "model_used": F.lit(model_name),
            "confidence": _C("m_confidence"),
            "analysis_notes": F.lit(lx.NOTE_MODEL),
        }
    )
    guided = _model_guide(named, _C("m_response"), _C(author), brand).withColumn(
        "response_guide", _C("_m_guide")
    )
    base = [c for c in df.columns if c not in ANALYSIS_COLUMNS and c != reply]
    return guided.select(*base, *ANALYSIS_COLUMNS)


#: What a model is asked about, and what makes the content key.
REQUEST_COLUMNS = ("source", "feedback_date", "raw_text")


def own_content_key() -> Column:
    return content_key(*[_C(c) for c in REQUEST_COLUMNS])


def reply_requests(feedback: DataFrame) -> DataFrame:
    """Rows to send to a model: id, full key, and the content it is asked about.

    Its replies come back as (feedback_id, content_key, reply), so that rows whose short ids
    are equal by chance get their own.
    """
    return feedback.select("feedback_id", own_content_key().alias("content_key"), *REQUEST_COLUMNS)


def enrich(
    feedback: DataFrame, model_replies: DataFrame, model_name: str = "batch_model",
    brand: str = "Empresa", keys=lx.REPLY_KEYS,
) -> DataFrame:
    """Labels of a valid reply, else of the rules.

    ``model_replies`` holds (feedback_id, reply); with a ``reply_seq`` column the
    last reply of an id counts, without it the largest text, so that rows never multiply.
    An id has 48 bits where it is a hash. With a ``content_key`` column, as :func:`reply_requests` hands
    out, a reply belongs to the rows of its id and content; where the replies also repeat source, date or
    text of their request, a reply with other values counts as none.

    An id may be shared by a large part of the feedback. Adaptive execution splits
    such a partition only when both sides of the join come straight from an
    exchange, so the replies are grouped by a wider key than the join needs.
    """
    keyed = "content_key" in model_replies.columns
    keys_of_reply = ["feedback_id", "content_key"] if keyed else ["feedback_id"]
    wide = [F.xxhash64("feedback_id"), *[_C(c) for c in keys_of_reply]]
    last = [_C(c).desc() for c in ("reply_seq", "reply") if c in model_replies.columns]
    model_replies = keep_one(model_replies, wide, last)
    asked_with = [c for c in REQUEST_COLUMNS if keyed and c in model_replies.columns]
    asking = feedback.withColumn("content_key", own_content_key()) if keyed else feedback
    joined = asking.join(
        model_replies.select(
            *keys_of_reply, _C("reply").alias("_raw_reply"), F.lit(True).alias("_answered"),
            *[_C(c).alias(f"_asked_{c}") for c in asked_with],
        ),
        keys_of_reply,
        "left",
    )
    if keyed:
        same = [_C(c).cast("string").eqNullSafe(_C(f"_asked_{c}").cast("string")) for c in asked_with]
        fits = reduce(lambda a, b: a & b, same, F.lit(True))
        joined = joined.withColumn("_answered", F.when(fits, _C("_answered"))).drop(
            "content_key", *[f"_asked_{c}" for c in asked_with]
        )
    # A row without reply row must not read as the empty reply: "-" holds no JSON.
    answered = joined.withColumn(
        "_reply_text", F.when(_C("_answered"), _C("_raw_reply")).otherwise(F.lit("-"))
    )
    labels = reply_labels(answered, "_reply_text", keys)
    lowered = labels.withColumn("_lower", F.lower(text_or_blank(_C("raw_text"))))
    # Keyword counts are needed only where the rules decide.
    searched = lowered.withColumn("_searched", F.when(_C("_valid"), F.lit("")).otherwise(_C("_lower")))
    flags = {
        **rules.flags(_C("raw_text"), _C("_searched")),
        **rules.case_flags(_C("raw_text"), _C("_lower")),
    }
    valid = _C("_valid")

    def either(model: Column, rule: Column) -> Column:
        return F.when(valid, model).otherwise(rule)

    staged = searched.withColumns(flags).withColumns(
        {
            "sentiment_label": either(_C("m_sentiment"), rules.sentiment()),
            "sentiment_score": either(_C("m_score"), rules.sentiment_score()),
            "primary_theme": either(_C("m_theme"), rules.theme()),
            "_reference": rules.reference(),
        }
    )
    staged = staged.withColumn(
        "urgency", either(_C("m_urgency"), rules.urgency(_C("_urgent"), _C("sentiment_label")))
    )
    staged = staged.withColumn(
        "priority",
        either(
            _C("m_priority"),
            rules.priority(_C("sentiment_label"), _C("urgency"), _C("primary_theme")),
        ),
    )
    staged = staged.withColumns(
        {
            "escalation_required": either(
                _C("m_escalation"), rules.escalation(_C("priority"), _C("urgency"))
            ),
            "internal_recommendation": either(
                _C("m_recommendation"),
                rules.recommendation(_C("primary_theme"), _C("sentiment_label")),
            ),
        }
    )
    texts = add_rule_texts(staged, brand)
    guided = _model_guide(texts, _C("m_response"), _C("author"), brand)
    note = F.when(_C("_answered").isNull(), F.lit(lx.NOTE_MISSING)).otherwise(F.lit(lx.NOTE_INVALID))
    done = guided.withColumns(
        {
            "response_guide": either(_C("_m_guide"), _C("response_guide")),
            "provider": either(F.lit(lx.PROVIDER_MODEL), F.lit(lx.PROVIDER_RULES)),
            "model_used": either(F.lit(model_name), F.lit(lx.RULES_MODEL)),
            "confidence": either(_C("m_confidence"), F.lit(lx.RULES_CONFIDENCE)),
            "analysis_notes": either(F.lit(lx.NOTE_MODEL), note),
        }
    )
    base = [c for c in feedback.columns if c not in ANALYSIS_COLUMNS]
    return done.select(*base, *ANALYSIS_COLUMNS)


def refresh_guides(analyzed: DataFrame, brand: str = "Empresa") -> DataFrame:
    """New guide by rules where it is blank, an old generic text, or no guide at all."""
    guide = strip(_C("response_guide"))
    lowered = F.lower(guide)
    stale = (
        (guide == "")
        | lowered.contains(lx.OLD_GENERIC_PHRASE)
        | ~contains_all(lowered, lx.REFRESH_LABELS)
    )
    marked = analyzed.withColumns({"_guide": guide, "_stale": stale})
    if "raw_text" not in analyzed.columns:
        fresh = F.when(_C("_guide") == "", F.lit(lx.STATIC_GUIDE)).otherwise(_C("_guide"))
        return marked.withColumn("response_guide", fresh).select(*analyzed.columns)
    # Rules read the text only of stale rows; the others search a blank text.
    scratch = marked.select(
        F.struct(*[_C(c) for c in analyzed.columns]).alias("_row"), "_guide", "_stale",
        F.when(_C("_stale"), text_or_blank(_C("raw_text"))).otherwise(F.lit("")).alias("raw_text"),
    )
    ruled = add_rule_texts(classify_labels(scratch), brand)
    fresh = F.when(_C("_stale"), _C("response_guide")).otherwise(_C("_guide"))
    return ruled.select(
        *[
            (fresh if c == "response_guide" else _C(f"_row.{c}")).alias(c)
            for c in analyzed.columns
        ]
    )
