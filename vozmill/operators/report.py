"""The executive report as ordered lines.

The table is read twice: all numbers and the top themes come from one aggregation row, all lists
from one pruned ranking. The report has at most a few dozen lines, so its final order is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions.text import sample_text
from vozmill.functions.values import percent
from vozmill.operators import aggregates, ordering

_C = F.col


def _text(c: Column) -> Column:
    return c.cast("string")


def _frame_lines(model_label: str, with_guides: bool) -> Column:
    """Array of (section, item, text) of all lines that need only the number row."""
    section = 0
    lines: list[Column] = []

    def add(item: int, text: Column, when: Column | None = None) -> None:
        entry = F.struct(
            F.lit(section).alias("section"), F.lit(item).alias("item"), text.alias("text")
        )
        lines.append(entry if when is None else F.when(when, entry))

    def share(label: str, name: str) -> Column:
        return F.concat(
            F.lit(f"- {label}: "), _text(_C(name)), F.lit(" ("),
            _text(percent(_C(name), _C("total"))), F.lit("%)"),
        )

    add(0, F.lit(lx.REPORT_TITLE))
    add(1, F.lit(""))
    add(2, F.lit(lx.REPORT_SECTIONS["summary"]))
    add(3, F.concat(F.lit("- Total de feedbacks analisados: "), _text(_C("total"))))
    add(4, share("Positivos", lx.POSITIVE))
    add(5, share("Neutros", lx.NEUTRAL))
    add(6, share("Negativos", lx.NEGATIVE))
    add(7, F.concat(F.lit("- Escalacoes recomendadas: "), _text(_C("escalations"))))
    add(8, F.lit(""))
    empties = {
        "positive": _C(lx.POSITIVE) == 0,
        "negative": _C(lx.NEGATIVE) == 0,
        "themes": _C("top_theme").isNull(),
        "actions": _C("high") == 0,
        "guides": _C("guides") == 0,
    }
    for name, empty in empties.items():
        section += 1
        add(0, F.lit(lx.REPORT_SECTIONS[name]))
        if name == "guides":
            absent = (_C("total") == 0) | F.lit(not with_guides)
            note = F.when(absent, F.lit(lx.REPORT_EMPTY["guides_absent"])).otherwise(
                F.lit(lx.REPORT_EMPTY["guides"])
            )
            add(1, note, absent | empty)
        else:
            add(1, F.lit(lx.REPORT_EMPTY[name]), empty)
        add(1000, F.lit(""))
    section += 1
    add(0, F.lit(lx.REPORT_SECTIONS["insights"]))
    add(1000, F.lit(""))
    section += 1
    add(0, F.lit(lx.REPORT_SECTIONS["next"]))
    for i, text in enumerate(lx.REPORT_NEXT_STEPS, start=1):
        add(i, F.lit(text))
    insight_lines = F.transform(
        aggregates.insight_texts(model_label),
        lambda text, i: F.struct(
            F.lit(6).alias("section"), (i + 1).alias("item"), F.concat(F.lit("- "), text).alias("text")
        ),
    )
    theme_lines = F.transform(
        _C("top_themes"),
        lambda x, i: F.struct(
            F.lit(3).alias("section"), (i + 1).alias("item"),
            F.concat(F.lit("- "), x["theme"], F.lit(": "), _text(-x["less"])).alias("text"),
        ),
    )
    return F.concat(F.array_compact(F.array(*lines)), theme_lines, insight_lines)


def report_lines(analyzed: DataFrame, model_label: str = "modelo") -> DataFrame:
    """(line_no, text) from line 1 on; the table has analysis and order columns."""
    with_guides = "response_guide" in analyzed.columns
    if not with_guides:
        analyzed = analyzed.withColumn("response_guide", F.lit(None).cast("string"))
    frame = aggregates.report_numbers(analyzed).select(
        F.inline(_frame_lines(model_label, with_guides))
    )
    of_list, theme = _C("list"), F.coalesce("primary_theme", F.lit("nan"))
    listed = ordering.report_lists(analyzed).select(
        of_list.alias("section"),
        _C("position").alias("item"),
        F.when(
            of_list == ordering.ACTIONS,
            F.concat(F.lit("- Prioridade "), _text(_C("priority")), F.lit(" | Tema: "), theme, F.lit(" | Acao: "), "text"),
        )
        .when(
            of_list == ordering.GUIDES,
            F.concat(F.lit("- Tema: "), theme, F.lit(" | Guia sugerido: "), sample_text(_C("text"), 240)),
        )
        .otherwise(F.concat(F.lit("- "), sample_text(_C("text"), 150)))
        .alias("text"),
    )
    lines = frame.unionByName(listed)
    place = Window.partitionBy(F.lit(1)).orderBy("section", "item")
    return lines.select(F.row_number().over(place).alias("line_no"), "text")
