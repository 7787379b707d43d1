"""The tables behind the dashboard, for one selection of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vozmill.operators import aggregates, display, filters, ordering


def selection_numbers(analyzed: DataFrame, sources=None, sentiments=None, themes=None) -> DataFrame:
    """All numbers of the dashboard from one scan: counts of the selection, options of the whole table."""
    return aggregates.dashboard_numbers(analyzed, filters.selection(sources, sentiments, themes))


def dashboard_tables(
    analyzed: DataFrame, sources=None, sentiments=None, themes=None, numbers: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Lazy tables by name; each reads only the columns it needs of ``analyzed``.

    The first five are selections of ``numbers``, the small table of :func:`selection_numbers`; hand
    it in written and read back, and the stored table is scanned once for all of them.
    """
    if numbers is None:
        numbers = selection_numbers(analyzed, sources, sentiments, themes)
    chosen = filters.multi_filter(analyzed, sources, sentiments, themes)
    cross = aggregates.theme_priority_of(numbers)
    return {
        "filter_options": aggregates.filter_options_of(numbers),
        "kpis": aggregates.kpis_of(numbers),
        "theme_distribution": aggregates.theme_distribution_of(numbers),
        "theme_priority": cross,
        "theme_order": aggregates.theme_order_of(cross),
        "samples": ordering.text_samples(chosen, limit=180, dots=False),
        "cases": display.display_rows(ordering.case_table(chosen)),
        "rows": display.display_rows(chosen),
    }
