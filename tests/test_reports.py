"""Aggregates, lists, report and dashboard on small tables."""

import random

from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.operators import aggregates, classify, ordering, report
from vozmill.plans.dashboard import dashboard_tables
from vozmill.plans.normalize import normalize_feedback
from vozmill.schemas import ANALYZED_SCHEMA, ORDER_FIELDS

from pyspark.sql import types as T

AS_OF = "2024-12-31 00:00:00"
TEXTS = [
    "Atraso na entrega, nao recebi", "Adorei, excelente compra", "Frete muito caro e juros",
    "Texto sem palavra conhecida", "Defeito e ferrugem no produto", "Chamado sem resposta",
]


def analyzed(spark, n=60):
    rng = random.Random(5)
    rows = [
        ("", rng.choice(["site_auto", "site_manual", "reviews"]), rng.choice(["01/02/2024", "02/02/2024", ""]),
         f"{rng.choice(TEXTS)} numero {i}", 0, i)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "feedback_id string, source string, feedback_date string, raw_text string, batch_seq int, row_ord bigint")
    return classify.classify_rules(normalize_feedback(df, AS_OF))


def empty(spark):
    return spark.createDataFrame([], T.StructType(ANALYZED_SCHEMA.fields + ORDER_FIELDS))


def test_empty_report(spark):
    lines = [r.text for r in report.report_lines(empty(spark)).orderBy("line_no").collect()]
    assert lines[0] == lx.REPORT_TITLE
    assert "- Total de feedbacks analisados: 0" in lines and "- Positivos: 0 (0.0%)" in lines
    for name in ("positive", "negative", "themes", "actions", "guides_absent"):
        assert lx.REPORT_EMPTY[name] in lines
    assert [x for x in lines if x[2:] in lx.INSIGHTS_EMPTY] == ["- " + x for x in lx.INSIGHTS_EMPTY]
    assert lines[-3:] == lx.REPORT_NEXT_STEPS


def test_report_without_guides(spark):
    lines = [r.text for r in report.report_lines(analyzed(spark).drop("response_guide")).collect()]
    assert lx.REPORT_EMPTY["guides_absent"] in lines


def test_numbers_agree_with_a_plain_count(spark):
    df = analyzed(spark).cache()
    rows = df.collect()
    totals = aggregates.sentiment_totals(df).first()
    assert totals.total == len(rows)
    assert totals.n_negativo == sum(r.sentiment_label == "negativo" for r in rows)
    shares = aggregates.theme_top_other(df, 2).collect()
    assert sum(r.n for r in shares) == len(rows) and abs(sum(r.pct for r in shares) - 100) < 0.3
    assert len(shares) <= 3
    numbers = aggregates.report_numbers(df).first()
    assert numbers.high == sum(r.priority >= 4 for r in rows)
    assert numbers.escalations == sum(r.escalation_required for r in rows)
    assert aggregates.kpis(df).first().n_critical == numbers.high
    pivot = {r.primary_theme: r for r in aggregates.theme_priority_cross(df, pivot=True).collect()}
    for r in aggregates.theme_priority_cross(df).collect():
        assert pivot[r.primary_theme][str(r.priority)] == r.n


def test_case_numbers_follow_the_global_order(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RUN_LENGTH", 4)
    df = analyzed(spark, 150).cache()

    def place(r):
        day = r.feedback_date.toordinal() if r.feedback_date else 0
        return (-r.priority, -day, r.source, r.batch_seq, r.row_ord)

    want = [r.raw_text for r in sorted(df.where("priority >= 4").collect(), key=place)]
    got = sorted((r.case_no, r.raw_text) for r in ordering.critical_cases(df).collect())
    assert [n for n, _ in got] == list(range(1, len(want) + 1))
    assert [t for _, t in got] == want
    assert [r.raw_text for r in ordering.critical_cases(df, numbered=False).collect()] == want


def test_lists_have_the_asked_length(spark):
    df = analyzed(spark, 100)
    samples = ordering.text_samples(df, 3).collect()
    assert sorted({(r.sentiment_label, r.position) for r in samples}) == [
        (s, i) for s in ("negativo", "positivo") for i in (1, 2, 3)
    ]
    assert [r.position for r in ordering.priority_actions(df, 4).orderBy("position").collect()] == [1, 2, 3, 4]
    assert ordering.preview_rows(df.withColumn("status", F.lit("x")), 7).count() == 7


def test_dashboard(spark):
    df = analyzed(spark).cache()
    tables = dashboard_tables(df, sources=["Site (coleta manual)"], sentiments=["Negativo"], themes=None)
    want = df.where("source = 'site_manual' and sentiment_label = 'negativo'")
    assert tables["kpis"].first().total == want.count() == tables["rows"].count()
    assert tables["cases"].count() == want.where("priority >= 4").count()
    shown = tables["rows"].first()
    assert shown.sentimento == "Negativo" and shown.fonte == "Site (coleta manual)"
    assert tables["filter_options"].where("filter = 'source'").count() == 3
    assert all(t.columns for t in tables.values())


def test_case_numbers_with_missing_order(spark):
    """Rows without batch or row number are numbered too, ahead of the others."""
    rows = [(5, "site_auto", None, None), (5, "site_auto", 0, 2), (4, "reviews", 1, None), (5, None, 0, 1), (4, "reviews", None, 7), (4, "reviews", 1, 3)]
    df = spark.createDataFrame(
        [(p, s, b, r, "entrega", "t", "a", "g") for p, s, b, r in rows],
        "priority int, source string, batch_seq int, row_ord bigint, primary_theme string, raw_text string, "
        "internal_recommendation string, response_guide string",
    ).withColumn("feedback_date", F.lit(None).cast("date"))
    numbered = ordering.number_by_priority(df, "case_no").collect()
    assert sorted(r.case_no for r in numbered) == [1, 2, 3, 4, 5, 6]
    got = {r.case_no: (r.priority, r.source, r.batch_seq, r.row_ord) for r in numbered}
    assert [got[i] for i in range(1, 7)] == [
        (5, None, 0, 1), (5, "site_auto", None, None), (5, "site_auto", 0, 2),
        (4, "reviews", None, 7), (4, "reviews", 1, None), (4, "reviews", 1, 3),
    ]
    assert ordering.critical_cases(df).count() == 6


def test_dashboard_from_numbers_equals_the_single_aggregates(spark):
    from vozmill.operators import filters

    df = analyzed(spark).withColumn("primary_theme", F.when(F.col("row_ord") % 7 != 0, F.col("primary_theme")))
    for chosen in ({}, {"sentiments": ["Negativo"]}, {"sources": ["nowhere"]}):
        numbers = aggregates.dashboard_numbers(df, filters.selection(**{"sources": None, **chosen}))
        some = filters.multi_filter(df, **chosen)

        def same(a, b):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))

        same(aggregates.kpis_of(numbers), aggregates.kpis(some))
        same(aggregates.theme_priority_of(numbers), aggregates.theme_priority_cross(some))
        same(aggregates.theme_distribution_of(numbers), aggregates.theme_distribution(some))
        same(aggregates.theme_order_of(aggregates.theme_priority_of(numbers)), aggregates.theme_order(some))
        same(aggregates.filter_options_of(numbers), aggregates.all_filter_options(df))


def test_report_lists_equal_the_single_lists(spark):
    df = analyzed(spark)
    got = {}
    for r in ordering.report_lists(df).collect():
        got.setdefault(r["list"], []).append((r.position, r.text))
    texts = {(r.sentiment_label, r.position) for r in ordering.text_samples(df).collect()}
    assert {p for p, _ in got[ordering.POSITIVE_TEXTS]} == {p for s, p in texts if s == lx.POSITIVE}
    assert {p for p, _ in got[ordering.NEGATIVE_TEXTS]} == {p for s, p in texts if s == lx.NEGATIVE}
    actions = [(r.position, r.internal_recommendation) for r in ordering.priority_actions(df).collect()]
    assert sorted(got[ordering.ACTIONS]) == sorted(actions)
    assert len(got[ordering.GUIDES]) == ordering.priority_guides(df).count()
    assert ordering.report_lists(df.limit(0)).count() == 0
