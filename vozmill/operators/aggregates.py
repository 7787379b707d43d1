"""Report and dashboard numbers.

Each is a hash aggregation with map-side combine; windows without partition run
only over rows that are already aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.functions.rules import fill
from vozmill.functions.values import label_of, percent

_C = F.col


def _count_of(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def sentiment_totals(df: DataFrame) -> DataFrame:
    """A1: one row with counts and shares of the sentiments."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[_count_of(_C("sentiment_label") == s).alias(f"n_{s}") for s in lx.SENTIMENTS],
    )
    return counts.select(
        "*", *[percent(_C(f"n_{s}"), _C("total")).alias(f"pct_{s}") for s in lx.SENTIMENTS]
    )


def theme_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("primary_theme").agg(F.count(F.lit(1)).alias("n"))


def theme_top(df: DataFrame, n: int = 5) -> DataFrame:
    """A2: most frequent themes; ties by name, nulls left out."""
    counts = theme_counts(df.where(_C("primary_theme").isNotNull()))
    return counts.orderBy(_C("n").desc(), _C("primary_theme").asc()).limit(n)


def theme_top_other(df: DataFrame, n: int = 5) -> DataFrame:
    """A3: the top n themes, the rest added to "outros", with shares. One pass; themes are ranked by their counts."""
    counts = theme_counts(
        df.withColumn("primary_theme", F.coalesce("primary_theme", F.lit(lx.OTHER_THEME)))
    )
    by_count = Window.partitionBy(F.lit(1)).orderBy(_C("n").desc(), _C("primary_theme").asc())
    ranked = counts.withColumn("_rank", F.row_number().over(by_count))
    shown = F.when(_C("_rank") <= n, _C("primary_theme")).otherwise(lx.OTHER_THEME)
    slices = ranked.groupBy(shown.alias("primary_theme")).agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(F.lit(1))
    return slices.select(
        "primary_theme", "n", percent(_C("n"), F.sum("n").over(whole)).alias("pct")
    )


def theme_top_critical(df: DataFrame, n: int = 5) -> DataFrame:
    """A4: A3 on priorities 4 and 5."""
    return theme_top_other(df.where(_C("priority").isin(4, 5)), n)


def priority_share(df: DataFrame) -> DataFrame:
    """A5"""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), _count_of(_C("priority") >= 4).alias("n_high")
    )
    return counts.withColumn("pct_high", percent(_C("n_high"), _C("total")))


def escalation_count(df: DataFrame) -> DataFrame:
    """A6"""
    return df.agg(_count_of(_C("escalation_required")).alias("n_escalations"))


def provider_coverage(df: DataFrame) -> DataFrame:
    """A7"""
    return df.groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def _most_frequent(name: str, count: str) -> Column:
    """Value with the largest count, the smallest value on ties, nulls left out."""
    ranked = F.when(_C(name).isNotNull(), F.struct(-_C(count), _C(name)))
    return F.min_by(_C(name), ranked)


def kpis(df: DataFrame) -> DataFrame:
    """Total, share of negatives, most frequent theme with label, critical cases."""
    per_theme = df.groupBy("primary_theme").agg(
        F.count(F.lit(1)).alias("n"),
        _count_of(_C("sentiment_label") == lx.NEGATIVE).alias("negative"),
        _count_of(_C("priority").isin(4, 5)).alias("critical"),
    )
    row = per_theme.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("n_critical"),
        _most_frequent("primary_theme", "n").alias("top_theme"),
    )
    return row.select(
        "total",
        percent(_C("negative"), _C("total")).alias("pct_negative"),
        "top_theme",
        label_of(_C("top_theme"), lx.THEME_LABELS).alias("top_theme_label"),
        "n_critical",
    )


def theme_priority_cross(df: DataFrame, pivot: bool = False, at_rest: bool = False) -> DataFrame:
    """Counts per theme and priority above 0; optionally one column per priority.

    The condition is tested on the counts: a filter on the rows would be moved
    below the rules and compute them a second time. Over a stored table (``at_rest``) it
    is tested on the rows, so that it reaches the scan.
    """
    rows = df.where(_C("priority") > 0) if at_rest else df
    counts = rows.groupBy("primary_theme", "priority").agg(_count_of(_C("priority") > 0).alias("n"))
    rated = counts.where(_C("n") > 0)
    if pivot:
        return rated.groupBy("primary_theme").pivot("priority", [1, 2, 3, 4, 5]).agg(F.sum("n"))
    return rated


def theme_order(df: DataFrame) -> DataFrame:
    """A10: theme labels by their total over A9, with their position."""
    return theme_order_of(theme_priority_cross(df))


def theme_order_of(cross: DataFrame) -> DataFrame:
    """A10 from the counts of A9."""
    totals = (
        cross
        .groupBy(label_of(_C("primary_theme"), lx.THEME_LABELS).alias("theme_label"))
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy(F.lit(1)).orderBy(_C("n").desc(), _C("theme_label").asc())
    return totals.withColumn("position", F.row_number().over(order))


def theme_distribution(df: DataFrame) -> DataFrame:
    """Counts per theme with null as "outros", and labels."""
    themed = df.withColumn("primary_theme", F.coalesce("primary_theme", F.lit(lx.OTHER_THEME)))
    return theme_counts(themed).withColumn(
        "theme_label", label_of(_C("primary_theme"), lx.THEME_LABELS)
    )


def filter_options(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """One row per label with the sorted list of its codes."""
    codes = df.where(_C(column).isNotNull()).select(_C(column).alias("code")).distinct()
    return codes.groupBy(label_of(_C("code"), labels).alias("label")).agg(
        F.array_sort(F.collect_set("code")).alias("codes")
    )


def all_filter_options(df: DataFrame) -> DataFrame:
    """A12 for the three selections of the dashboard."""
    options = None
    for column, labels in (
        ("source", lx.SOURCE_LABELS),
        ("sentiment_label", lx.SENTIMENT_LABELS),
        ("primary_theme", lx.THEME_LABELS),
    ):
        one = filter_options(df, column, labels).select(F.lit(column).alias("filter"), "label", "codes")
        options = one if options is None else options.unionByName(one)
    return options


def source_breakdown(df: DataFrame) -> DataFrame:
    """A13"""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def run_summary(
    fresh: DataFrame, upsert_counts: DataFrame,
    auto_source: str = "site_auto", manual_source: str = "site_manual",
) -> DataFrame:
    """One row: rows read per source and in all, new rows, rows of the merged table.

    ``upsert_counts`` is the one row of ``upsert_added``; it enters as scalar subqueries.
    """
    read = fresh.agg(
        _count_of(_C("source") == auto_source).alias("n_auto"),
        _count_of(_C("source") == manual_source).alias("n_manual"),
        F.count(F.lit(1)).alias("n_read"),
    )
    return read.select(
        "*",
        upsert_counts.select("added").scalar().alias("n_new"),
        upsert_counts.select("merged_rows").scalar().alias("n_total"),
    )


#: What the rows of :func:`dashboard_numbers` count, by their grouping columns.
DASHBOARD_PARTS = {
    "all": (), "source": ("source",), "sentiment": ("sentiment_label",), "theme": ("primary_theme",),
    "theme_priority": ("primary_theme", "priority"),
}


def dashboard_numbers(df: DataFrame, chosen: Column | None = None) -> DataFrame:
    """A8 to A12 in one pass: counts for every grouping of the dashboard, told apart by ``part``.

    ``n_rows`` counts all rows, ``n``, ``n_negative`` and ``n_critical`` those that fulfil ``chosen`` (all
    without it). The table has a row per value, so the dashboard's tables are small selections of it.
    """
    keys = ["source", "sentiment_label", "primary_theme", "priority"]
    narrow = df.select(*keys, F.coalesce(F.lit(True) if chosen is None else chosen, F.lit(False)).alias("_chosen"))
    counted = narrow.groupingSets([[_C(c) for c in part] for part in DASHBOARD_PARTS.values()], *keys).agg(
        F.grouping_id(*keys).alias("_part"),
        F.count(F.lit(1)).alias("n_rows"),
        _count_of(_C("_chosen")).alias("n"),
        _count_of(_C("_chosen") & (_C("sentiment_label") == lx.NEGATIVE)).alias("n_negative"),
        _count_of(_C("_chosen") & _C("priority").isin(4, 5)).alias("n_critical"),
    )
    # A bit of the grouping id is set where the column is left out.
    part = None
    for name, of in DASHBOARD_PARTS.items():
        left_out = sum(1 << i for i, c in enumerate(reversed(keys)) if c not in of)
        hit = _C("_part") == left_out
        part = F.when(hit, F.lit(name)) if part is None else part.when(hit, F.lit(name))
    return counted.select(part.alias("part"), *keys, "n_rows", "n", "n_negative", "n_critical")


def _part(numbers: DataFrame, name: str) -> DataFrame:
    return numbers.where(_C("part") == name)


def kpis_of(numbers: DataFrame) -> DataFrame:
    """A8 from :func:`dashboard_numbers`."""
    row = numbers.where(_C("part").isin("all", "theme")).agg(
        *[
            F.coalesce(F.sum(F.when(_C("part") == "all", _C(c))), F.lit(0)).alias(c)
            for c in ("n", "n_negative", "n_critical")
        ],
        F.min_by(
            _C("primary_theme"),
            F.when((_C("part") == "theme") & _C("primary_theme").isNotNull() & (_C("n") > 0), F.struct(-_C("n"), _C("primary_theme"))),
        ).alias("top_theme"),
    )
    return row.select(
        _C("n").alias("total"),
        percent(_C("n_negative"), _C("n")).alias("pct_negative"),
        "top_theme",
        label_of(_C("top_theme"), lx.THEME_LABELS).alias("top_theme_label"),
        "n_critical",
    )


def theme_distribution_of(numbers: DataFrame) -> DataFrame:
    """A11 from :func:`dashboard_numbers`."""
    themed = _part(numbers, "theme").where(_C("n") > 0)
    counts = themed.groupBy(F.coalesce("primary_theme", F.lit(lx.OTHER_THEME)).alias("primary_theme")).agg(F.sum("n").alias("n"))
    return counts.withColumn("theme_label", label_of(_C("primary_theme"), lx.THEME_LABELS))


def theme_priority_of(numbers: DataFrame) -> DataFrame:
    """A9 from :func:`dashboard_numbers`."""
    rated = _part(numbers, "theme_priority").where((_C("priority") > 0) & (_C("n") > 0))
    return rated.select("primary_theme", "priority", "n")


def filter_options_of(numbers: DataFrame) -> DataFrame:
    """A12 from :func:`dashboard_numbers`: the options of all rows, not of the chosen ones."""
    columns = {"source": "source", "sentiment": "sentiment_label", "theme": "primary_theme"}
    labels = {"source": lx.SOURCE_LABELS, "sentiment": lx.SENTIMENT_LABELS, "theme": lx.THEME_LABELS}
    code, label, name = None, None, None
    for part, column in columns.items():
        hit, shown = _C("part") == part, label_of(_C(column), labels[part])
        code = F.when(hit, _C(column)) if code is None else code.when(hit, _C(column))
        label = F.when(hit, shown) if label is None else label.when(hit, shown)
        name = F.when(hit, F.lit(column)) if name is None else name.when(hit, F.lit(column))
    options = numbers.where(_C("part").isin(list(columns))).select(name.alias("filter"), label.alias("label"), code.alias("code"))
    known = options.where(_C("code").isNotNull())
    return known.groupBy("filter", "label").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def report_numbers(df: DataFrame, top_themes: int = 5) -> DataFrame:
    """One row with every number of the report, from one pass over the table.

    The first aggregation has one group per (theme, sentiment, provider); the
    second folds these few rows.
    """
    cells = df.groupBy("primary_theme", "sentiment_label", "provider").agg(
        F.count(F.lit(1)).alias("n"),
        _count_of(_C("priority") >= 4).alias("high"),
        _count_of((_C("priority") >= 4) & _C("response_guide").isNotNull()).alias("guides"),
        _count_of(_C("escalation_required")).alias("escalations"),
    )
    # Per theme next, so that its total can be ranked.
    by_theme = cells.groupBy("primary_theme").agg(
        F.sum("n").alias("n"),
        F.sum("high").alias("high"),
        F.sum("guides").alias("guides"),
        F.sum("escalations").alias("escalations"),
        *[
            F.sum(F.when(_C("sentiment_label") == s, _C("n")).otherwise(0)).alias(s)
            for s in lx.SENTIMENTS
        ],
        *[
            F.sum(F.when(_C("provider") == p, _C("n")).otherwise(0)).alias(f"by_{p}")
            for p in (lx.PROVIDER_MODEL, lx.PROVIDER_RULES)
        ],
    )
    sums = ["n", "high", "guides", "escalations", *lx.SENTIMENTS, "by_model", "by_rules"]
    top = _most_frequent("primary_theme", "n")
    return by_theme.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias("total" if c == "n" else c) for c in sums],
        top.alias("top_theme"),
        F.coalesce(F.max(F.when(_C("primary_theme").isNotNull(), _C("n"))), F.lit(0)).alias("top_count"),
        # A2 in the same pass: by falling count, then name; there is one row per theme here.
        F.slice(
            F.array_sort(
                F.collect_list(
                    F.when(_C("primary_theme").isNotNull(), F.struct((-_C("n")).alias("less"), _C("primary_theme").alias("theme")))
                )
            ),
            1, top_themes,
        ).alias("top_themes"),
    )


def insight_texts(model_label: str = "modelo") -> Column:
    """Array of lines over the columns of :func:`report_numbers`."""
    label = label_of(_C("top_theme"), lx.REPORT_THEME_LABELS, missing=lx.REPORT_THEME_LABELS["outros"])

    def number(c: Column) -> Column:
        return c.cast("string")

    lines = F.array(
        fill(lx.INSIGHT_TEXT["negative"], negative_pct=number(percent(_C("negativo"), _C("total")))),
        fill(lx.INSIGHT_TEXT["theme"], label=label, count=number(_C("top_count"))),
        fill(lx.INSIGHT_TEXT["priority"], high_pct=number(percent(_C("high"), _C("total")))),
        fill(
            lx.INSIGHT_TEXT["coverage"],
            model_label=F.lit(model_label),
            model=number(_C("by_model")),
            rules=number(_C("by_rules")),
        ),
    )
    empty = F.array(*[F.lit(t) for t in lx.INSIGHTS_EMPTY])
    return F.when(_C("total") == 0, empty).otherwise(lines)


def insights(df: DataFrame, model_label: str = "modelo") -> DataFrame:
    """(line_no, text)"""
    return report_numbers(df).select(
        F.posexplode(insight_texts(model_label)).alias("line_no", "text")
    )


