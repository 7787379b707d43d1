"""Registered queries of whole runs, readers over files, and the tables of the dashboard."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vozmill.checks import inputs
from vozmill.checks.inputs import AS_OF, load
from vozmill.checks.oracles import (
    ANALYSIS_OUT, ANALYZED, BASE_OUT, ENRICHED, MANUAL, NORM, ORACLES, SIDES, UPSERT, WORDED,
    chain, fold, label, label_ctes, lit, model_ctes, normalized_ctes, pct, reply_ctes, report_sql, status_of, text_ctes, upsert_ctes,
)
from vozmill.checks.queries import analyzed, enriched, feedback, normalized, query, shared_folder
from vozmill import lexicon as lx
from vozmill.functions import text
from vozmill.operators import aggregates, classify, dedupe, filters, sets
from vozmill.plans import batch
from vozmill.plans.dashboard import selection_numbers
from vozmill.plans.incremental import IncrementalRun
from vozmill.schemas import FEEDBACK_COLUMNS
from vozmill.sources import readers, writers

_C = F.col
REVIEWS_URL = "https://reviews.example.com/"
CHOSEN = {"sentiments": [lx.SENTIMENT_LABELS["negativo"], lx.SENTIMENT_LABELS["neutro"]]}


def _batch(spark, d, number: int) -> DataFrame:
    return feedback(spark, d).where(_C("batch_seq") == number).withColumn("batch_seq", F.lit(0))


#: Bytes of the stored table that go into one CSV file, which one task reads.
FILE_BYTES = 32 << 20


def _stored_bytes(spark, df: DataFrame) -> int:
    """Bytes of the files that a table is read from."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(name) for name in df.inputFiles()]
    conf = spark._jsc.hadoopConfiguration()
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def _files(spark, df: DataFrame, order: str, file_bytes: int = FILE_BYTES) -> str:
    """The table as CSV files of bounded size, three at least, by name in the order of a column, which is not written."""
    path = shared_folder(spark)
    parts = df.repartitionByRange(max(3, -(-_stored_bytes(spark, df) // file_bytes)), order).sortWithinPartitions(order).drop(order)
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    parts.write.options(**options).csv(path)
    return path


# ----------------------------------------------------------------------------- runs
@query
def incremental_run(spark, d):
    """Two batches, one after the other, through the bucketed snapshots: the analyzed table."""
    answers = load(spark, d, inputs.replies).select("feedback_id", "reply", "reply_seq")
    run = IncrementalRun(spark, shared_folder(spark), buckets=16)
    for number in (0, 1):
        run.add(_batch(spark, d, number), AS_OF, answers)
    return run.analyzed()


def _run(spark, d, mode: str) -> batch.RunResult:
    def auto() -> DataFrame:
        return sets.align_schema(_batch(spark, d, 0), FEEDBACK_COLUMNS, keep=["row_ord"])

    def manual() -> DataFrame:
        return readers.format_manual(load(spark, d, inputs.manual))

    return batch.run_batch(spark, auto, manual, shared_folder(spark), AS_OF, mode=mode)


def _register_run(name: str, mode: str) -> None:
    def run(spark, d):
        return spark.read.parquet(_run(spark, d, mode).analyzed_path)

    run.__name__ = name
    query(run)


_register_run("run_both", batch.BOTH)
_register_run("run_auto", batch.AUTO)
_register_run("run_auto_or_manual", batch.AUTO_OR_MANUAL)
_register_run("run_manual", batch.MANUAL)


@query
def run_report(spark, d):
    """The report file of a whole run, line by line (one file, so lines keep their order)."""
    lines = spark.read.text(_run(spark, d, batch.BOTH).report_path)
    return lines.select((F.monotonically_increasing_id() + 1).cast("int").alias("line_no"), _C("value").alias("text"))


_LOADED = "SELECT *, CAST({} AS INT) AS batch_seq FROM manual_all WHERE length(raw_text) >= 10"
_NOTHING = ("nothing", "SELECT * FROM fresh WHERE false")


def _from_merged(*first: tuple[str, str]) -> list[tuple[str, str]]:
    """The analyzed table by rules alone, from ``merged``."""
    return [*first, *normalized_ctes("SELECT * FROM merged", "channel"), *label_ctes(), *text_ctes(), *ANALYZED[len(WORDED):]]


_BOTH = _from_merged(
    *SIDES, *MANUAL, ("loaded", _LOADED.format(1)),
    ("fresh", "SELECT * FROM stored UNION ALL BY NAME SELECT * FROM loaded"), _NOTHING, *upsert_ctes("nothing", "fresh"),
)
_AUTO = _from_merged(*SIDES, ("fresh", "SELECT * FROM stored"), _NOTHING, *upsert_ctes("nothing", "fresh"))
_MANUAL = _from_merged(*MANUAL, ("fresh", _LOADED.format(0)), _NOTHING, *upsert_ctes("nothing", "fresh"))
_ALL = f"SELECT {BASE_OUT}, {ANALYSIS_OUT} FROM"
ORACLES["incremental_run"] = chain(*_from_merged(*UPSERT), *ENRICHED[len(ANALYZED):], body=f"{_ALL} enriched")
ORACLES["run_both"] = chain(*_BOTH, body=f"{_ALL} analyzed")
ORACLES["run_auto"] = ORACLES["run_auto_or_manual"] = chain(*_AUTO, body=f"{_ALL} analyzed")
ORACLES["run_manual"] = chain(*_MANUAL, body=f"{_ALL} analyzed")
ORACLES["run_report"] = report_sql(_BOTH + [("enriched", f"{_ALL} analyzed")])


# ---------------------------------------------------------------------------- merges
@query
def upsert_into_clean(spark, d):
    """The merge into a snapshot that an earlier merge wrote."""
    filled = sets.fill_ids(feedback(spark, d))
    rows = sets.align_schema(filled, FEEDBACK_COLUMNS, keep=["batch_seq", "row_ord"])
    old, new = (rows.where(_C("batch_seq") == b) for b in (0, 1))
    return dedupe.upsert_into_clean(dedupe.upsert_feedback(old.limit(0), old), new)


ORACLES["upsert_into_clean"] = chain(*UPSERT, body="SELECT * FROM merged")


@query
def load_and_upsert(spark, d):
    """Manual complaints in several CSV files, merged into the snapshot of the collected ones."""
    folder = shared_folder(spark)
    collected = sets.align_schema(_batch(spark, d, 0), FEEDBACK_COLUMNS, keep=["batch_seq", "row_ord"])
    writers.save_upsert(spark, None, collected, f"{folder}/1")
    path = _files(spark, load(spark, d, inputs.manual), "row_ord")
    merged, _ = writers.load_and_upsert(spark, path, f"{folder}/1", f"{folder}/2")
    return merged.drop("row_ord")


ORACLES["load_and_upsert"] = chain(
    *SIDES, *MANUAL, ("loaded", _LOADED.format(1)), *upsert_ctes("stored", "loaded"), body="SELECT * EXCLUDE (row_ord) FROM merged"
)


# --------------------------------------------------------------------------- readers
@query
def read_manual(spark, d):
    """The manual reader over several files with its row limit: the first rows by file and place."""
    path = _files(spark, load(spark, d, inputs.manual), "row_ord")
    return readers.read_manual(spark, path, status_option=filters.UNRESOLVED, limit=50).drop("row_ord")


ORACLES["read_manual"] = chain(
    *MANUAL,
    ("first_rows", f"SELECT * FROM manual_all WHERE {status_of('status')} <> 'resolvida' ORDER BY row_ord LIMIT 50"),
    body="SELECT * EXCLUDE (row_ord) FROM first_rows WHERE length(raw_text) >= 10",
)


@query
def read_review_seed(spark, d):
    """The review reader over several files; the first of equal reviews stays."""
    path = _files(spark, load(spark, d, inputs.seed), "row_ord")
    return readers.read_review_seed(spark, path, REVIEWS_URL).drop("row_ord")


ORACLES["read_review_seed"] = f"SELECT * EXCLUDE (row_ord) FROM ({ORACLES['review_seed']})"


@query
def read_analyzed_csv(spark, d):
    """The analyzed table as CSV files, read back with types; a third of the guides is blank."""
    rows = analyzed(spark, d).drop("batch_seq")
    texts = rows.select(*[_C(c).cast("string").alias(c) for c in rows.columns if c != "row_ord"], "row_ord")
    holes = F.when(_C("row_ord") % 3 == 0, F.lit(None)).otherwise(_C("response_guide"))
    path = _files(spark, texts.withColumn("response_guide", holes), "row_ord")
    return readers.read_analyzed(spark, path, "csv").drop("channel", "row_ord")


_BLANK_IS_NULL = ", ".join(
    c if c == "feedback_date" else f"nullif({c}, '') AS {c}" for c in FEEDBACK_COLUMNS if c != "channel"
)
ORACLES["read_analyzed_csv"] = chain(
    *ANALYZED, body=f"SELECT {_BLANK_IS_NULL}, {ANALYSIS_OUT} FROM analyzed WHERE starts_with(source, 'site_')"
)


# ------------------------------------------------------------------------- dashboard
@query
def dashboard_numbers(spark, d):
    """All numbers of the dashboard for one selection, from one scan."""
    return selection_numbers(enriched(spark, d), **CHOSEN)


@query
def dashboard_kpis(spark, d):
    return aggregates.kpis_of(selection_numbers(enriched(spark, d), **CHOSEN))


@query
def dashboard_themes(spark, d):
    """Theme distribution, and the theme order over the cross with priorities."""
    numbers = selection_numbers(enriched(spark, d), **CHOSEN)
    spread = aggregates.theme_distribution_of(numbers).select("theme_label", "n", F.lit(0).alias("position"))
    order = aggregates.theme_order_of(aggregates.theme_priority_of(numbers))
    return spread.unionByName(order.select("theme_label", "n", "position"))


@query
def dashboard_options(spark, d):
    options = aggregates.filter_options_of(selection_numbers(enriched(spark, d), **CHOSEN))
    return options.withColumn("codes", F.array_join("codes", ","))


_PICKED = ("selection", "SELECT *, sentiment_label IN ('negativo', 'neutro') AS c FROM enriched")
_KEYS = ("source", "sentiment_label", "primary_theme", "priority")


def _grouped(part: str, *by: str) -> str:
    keys = ", ".join(c if c in by else f"NULL AS {c}" for c in _KEYS)
    return (
        f"SELECT '{part}' AS part, {keys}, count(*) AS n_rows, count(*) FILTER (c) AS n, "
        "count(*) FILTER (c AND sentiment_label = 'negativo') AS n_negative, count(*) FILTER (c AND priority IN (4, 5)) AS n_critical "
        "FROM selection" + (f" GROUP BY {', '.join(by)}" if by else "")
    )


ORACLES["dashboard_numbers"] = chain(
    *ENRICHED, _PICKED,
    body=" UNION ALL ".join(_grouped(part, *by) for part, by in aggregates.DASHBOARD_PARTS.items()),
)
ORACLES["dashboard_kpis"] = chain(
    *ENRICHED, _PICKED,
    ("c", "SELECT count(*) AS total, count(*) FILTER (sentiment_label = 'negativo') AS negative, "
          "count(*) FILTER (priority IN (4, 5)) AS n_critical FROM selection WHERE c"),
    ("top", "SELECT primary_theme AS top_theme FROM selection WHERE c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"),
    body=f"SELECT total, {pct('negative', 'total')} AS pct_negative, top_theme, {label('top_theme', lx.THEME_LABELS)} AS top_theme_label, n_critical FROM c, top",
)
ORACLES["dashboard_themes"] = chain(
    *ENRICHED, _PICKED,
    ("spread", f"SELECT {label('primary_theme', lx.THEME_LABELS)} AS theme_label, count(*) AS n FROM selection WHERE c GROUP BY 1"),
    ("rated", f"SELECT {label('primary_theme', lx.THEME_LABELS)} AS theme_label, count(*) AS n FROM selection WHERE c AND priority > 0 GROUP BY 1"),
    body="SELECT theme_label, n, CAST(0 AS INT) AS position FROM spread UNION ALL "
    "SELECT theme_label, n, CAST(row_number() OVER (ORDER BY n DESC, theme_label) AS INT) FROM rated",
)
ORACLES["dashboard_options"] = ORACLES["filter_options"]


# --------------------------------------------------------------- full keys and folding
@query
def enrich_by_content(spark, d):
    """Short ids that many rows share: every row gets the reply that was made for its own content."""
    rows = normalized(spark, d).withColumn("feedback_id", F.sha1((_C("row_ord") % 5).cast("string")))
    made = load(spark, d, inputs.replies).select(_C("doc_id").alias("row_ord"), "reply")
    asked = classify.reply_requests(rows.select("*")).select("feedback_id", "content_key", *classify.REQUEST_COLUMNS)
    by_row = rows.select("row_ord", "feedback_id", classify.own_content_key().alias("content_key")).join(made, "row_ord")
    answered = by_row.drop("row_ord").join(asked, ["feedback_id", "content_key"])
    return classify.enrich(rows, answered).select("row_ord", "feedback_id", *lx_columns())


def lx_columns() -> list[str]:
    return [c.strip() for c in ANALYSIS_OUT.split(",")]


_SHARED = [("shared", "SELECT * REPLACE (sha1(CAST(row_ord % 5 AS VARCHAR)) AS feedback_id) FROM norm")]
_OWN_LABELS = NORM + _SHARED + label_ctes("shared") + text_ctes() + ANALYZED[len(WORDED):]
ORACLES["enrich_by_content"] = chain(
    *_OWN_LABELS,
    ("answered", f"SELECT shared.*, r.reply FROM shared JOIN ({inputs.sql(inputs.replies)}) r ON r.doc_id = shared.row_ord"),
    *reply_ctes("answered"), *model_ctes("answers"),
    body=f"SELECT row_ord, feedback_id, {ANALYSIS_OUT} FROM by_model UNION ALL SELECT a.row_ord, a.feedback_id, "
    + ", ".join(
        f"CASE WHEN w.row_ord IS NULL THEN a.analysis_notes ELSE {lit(lx.NOTE_INVALID)} END AS analysis_notes"
        if c == "analysis_notes" else f"a.{c}" for c in lx_columns()
    )
    + " FROM analyzed a LEFT JOIN answered w ON w.row_ord = a.row_ord "
    "WHERE NOT EXISTS (SELECT 1 FROM by_model m WHERE m.row_ord = a.row_ord)",
)

#: Ligatures, fractions, units, letters beyond the first plane, syllables, a sign of eighteen letters.
SIGNS = "ﬁm ﬄ ½ ㎏ №Ⅳ ĳ 𝐀𝒷 한국어 각 ﷺ ａｂ ① ℡"


@query
def fold_signs(spark, d):
    """Whole texts followed by signs of several letters."""
    signed = feedback(spark, d).select("row_ord", F.concat("raw_text", F.lit(" " + SIGNS)).alias("t"))
    return signed.select("row_ord", text.fold_text(_C("t")).alias("folded"))


def _plain_fold(signs: str) -> str:
    whole = unicodedata.normalize("NFKD", signs.lower())
    return " ".join("".join(c for c in whole if not unicodedata.combining(c)).split())


ORACLES["fold_signs"] = chain(
    ("f", inputs.sql(inputs.feedback)),
    body=f"SELECT row_ord, trim({fold('raw_text')} || ' ' || {lit(_plain_fold(SIGNS))}) AS folded FROM f",
)
