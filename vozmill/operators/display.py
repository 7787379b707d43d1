"""Presentation columns of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions.values import label_of, to_number

_C = F.col


def display_rows(df: DataFrame, keep=()) -> DataFrame:
    """Shown date, labels, yes/no and integer priority."""
    shown = {
        "data": F.coalesce(F.date_format("feedback_date", "dd/MM/yyyy"), F.lit("-")),
        "fonte": label_of(_C("source"), lx.SOURCE_LABELS),
        "sentimento": label_of(_C("sentiment_label"), lx.SENTIMENT_LABELS),
        "tema_principal": label_of(_C("primary_theme"), lx.THEME_LABELS),
        "prioridade": to_number(_C("priority"), 0, kind="int"),
        "urgencia": label_of(_C("urgency"), lx.URGENCY_LABELS),
        "escalacao_recomendada": F.when(_C("escalation_required"), F.lit("Sim")).otherwise(F.lit("Nao")),
        "acao_recomendada": _C("internal_recommendation"),
        "guia_resposta": _C("response_guide"),
        "feedback_original": _C("raw_text"),
    }
    return df.select(*keep, *[v.alias(k) for k, v in shown.items()])
