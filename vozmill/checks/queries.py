"""Registered queries: name -> function of (spark, data folder)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vozmill import lexicon as lx
from vozmill.checks import inputs
from vozmill.checks.inputs import AS_OF, BASE_URL, PATH_REGEX, load
from vozmill.functions import dates, ids, replies, rules, text, values
from vozmill.operators import (
    aggregates, classify, dedupe, display, extract, filters, ordering, report, reviews, sets,
)
from vozmill.plans.batch import AUTO_OR_MANUAL, collect
from vozmill.plans.normalize import normalize_feedback
from vozmill.schemas import FEEDBACK_COLUMNS
from vozmill.session import prepare
from vozmill.sources import readers

_C = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a function under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see; a local one only where everything is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vozmill-")
    return f"{base.rstrip('/')}/vozmill-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ common inputs
def feedback(spark, d) -> DataFrame:
    return load(spark, d, inputs.feedback)


def normalized(spark, d) -> DataFrame:
    return normalize_feedback(feedback(spark, d), AS_OF)


def labelled(spark, d) -> DataFrame:
    """Normalized feedback with the rule labels and scratch columns."""
    return classify.classify_labels(normalized(spark, d))


def analyzed(spark, d) -> DataFrame:
    return classify.classify_rules(normalized(spark, d))


def enriched(spark, d) -> DataFrame:
    """Feedback labelled by replies and rules; both providers occur."""
    answers = load(spark, d, inputs.replies).select("feedback_id", "reply", "reply_seq")
    return classify.enrich(normalized(spark, d), answers)


def stored(spark, df: DataFrame) -> DataFrame:
    """The table written once and read back, as a run does before it reports on it."""
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.parquet(path)


def stored_enriched(spark, d) -> DataFrame:
    return stored(spark, enriched(spark, d))


def raw_text(spark, d) -> DataFrame:
    return feedback(spark, d).select("row_ord", "raw_text")


def _of_text(spark, d, name: str, expression) -> DataFrame:
    return raw_text(spark, d).select("row_ord", expression(_C("raw_text")).alias(name))


# -------------------------------------------------------------- scans and sources
@query
def manual_load(spark, d):
    raw = load(spark, d, inputs.manual)
    return readers.format_manual(raw, filters.UNRESOLVED)


@query
def manual_load_limit(spark, d):
    """The row limit of the load: first 50 rows that pass the status filter."""
    return readers.format_manual(load(spark, d, inputs.manual), filters.UNRESOLVED, limit=50)


@query
def review_seed(spark, d):
    return readers.format_reviews(load(spark, d, inputs.seed), "https://reviews.example.com/")


@query
def scan_pages(spark, d):
    pages = readers.scan_pages(spark, f"{d}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query
def lenient_csv(spark, d):
    """Whole documents as CSV, with too long and too short rows added to them, written and read back."""
    rows = load(spark, d, inputs.feedback).select("row_ord", "source", "raw_text")
    quoted = F.concat(F.lit('"'), F.replace(_C("raw_text"), F.lit('"'), F.lit('""')), F.lit('"'))

    def added(kind: int) -> Column:
        return (_C("row_ord") + kind * inputs.EXTRA_ROWS).cast("string")

    whole = F.concat_ws(",", added(0), "source", quoted)
    short = F.when(_C("row_ord") % 7 == 3, F.concat_ws(",", added(1), "source"))
    long = F.when(_C("row_ord") % 5 == 0, F.concat_ws(",", added(2), "source", quoted, F.lit("extra")))
    lines = rows.select(F.explode(F.array_compact(F.array(whole, short, long))).alias("value"))
    path = shared_folder(spark)
    lines.write.text(path)
    found = readers.read_lenient_csv(spark, path, ["seq", "source", "raw_text"])
    return found.select(_C("seq").cast("bigint").alias("row_ord"), "source", "raw_text")


@query
def align_schema(spark, d):
    raw = load(spark, d, inputs.manual)
    return sets.align_schema(raw, FEEDBACK_COLUMNS, keep=["row_ord"])


@query
def empty_input(spark, d):
    aligned = sets.align_schema(feedback(spark, d), FEEDBACK_COLUMNS)
    return sets.empty_feedback(spark).unionByName(aligned)


def _sides(spark, d):
    """Stored and incoming batch with filled ids."""
    filled = sets.fill_ids(feedback(spark, d))
    rows = sets.align_schema(filled, FEEDBACK_COLUMNS, keep=["batch_seq", "row_ord"])
    return rows.where(_C("batch_seq") == 0), rows.where(_C("batch_seq") == 1)


@query
def upsert_merge(spark, d):
    return dedupe.upsert_feedback(*_sides(spark, d))


@query
def upsert_added(spark, d):
    return dedupe.upsert_added(*_sides(spark, d))


@query
def manual_upsert(spark, d):
    loaded = readers.format_manual(load(spark, d, inputs.manual))
    incoming = sets.align_schema(loaded, FEEDBACK_COLUMNS, keep=["row_ord"]).withColumn("batch_seq", F.lit(1))
    return dedupe.upsert_feedback(_sides(spark, d)[0], incoming)


@query
def report_lines(spark, d):
    return report.report_lines(stored_enriched(spark, d))


@query
def read_analyzed(spark, d):
    """The analyzed table as texts, typed again; a third of the guides is blank."""
    rows = analyzed(spark, d)
    plain = [c for c in rows.columns if c not in ("batch_seq", "row_ord")]
    texts = rows.select(*[_C(c).cast("string").alias(c) for c in plain], "batch_seq", "row_ord")
    holes = texts.withColumn(
        "response_guide", F.when(_C("row_ord") % 3 == 0, F.lit(None)).otherwise(_C("response_guide"))
    )
    return readers.type_analyzed(holes).drop("channel")


# ------------------------------------------------------------------ set operations
@query
def union_sources(spark, d):
    raw = feedback(spark, d)
    manual = readers.format_manual(load(spark, d, inputs.manual))
    return sets.union_sources([raw.drop("batch_seq"), manual])


@query
def fallback_source(spark, d):
    raw = sets.align_schema(feedback(spark, d), FEEDBACK_COLUMNS)
    nothing = raw.where(_C("source") == "sem fonte")
    manual = raw.where(_C("source") == "site_manual")
    reviews_only = raw.where(_C("source") == "reviews")
    absent = sets.fallback_source(nothing, manual).withColumn("run", F.lit("primary empty"))
    present = sets.fallback_source(reviews_only, manual).withColumn("run", F.lit("primary present"))
    return absent.unionByName(present)


# ---------------------------------------------------------------- scalar functions
@query
def collapse_spaces(spark, d):
    return _of_text(spark, d, "flat", text.collapse_spaces)


@query
def fold_text(spark, d):
    return _of_text(spark, d, "folded", text.fold_text)


@query
def boilerplate_flag(spark, d):
    return raw_text(spark, d).select(
        "row_ord",
        text.is_boilerplate(_C("raw_text")).alias("site_hints"),
        text.has_loader_hint(_C("raw_text")).alias("loader_hints"),
    )


@query
def strip_boilerplate(spark, d):
    tailed = raw_text(spark, d).withColumn(
        "raw_text",
        F.when(_C("row_ord") % 4 == 1, F.concat("raw_text", F.lit(" - EMPRESA  - portal do Consumidor 2024")))
        .when(_C("row_ord") % 4 == 2, F.concat("raw_text", F.lit(" Pesquise  reputação de empresas antes de comprar aqui")))
        .when(_C("row_ord") % 8 == 3, F.concat("raw_text", F.lit(" Termos de Uso")))
        .otherwise(_C("raw_text")),
    )
    return tailed.select("row_ord", text.strip_boilerplate(_C("raw_text")).alias("clean"))


@query
def sample_text(spark, d):
    return raw_text(spark, d).select(
        "row_ord",
        text.sample_text(_C("raw_text"), 150).alias("sample_150"),
        text.sample_text(_C("raw_text"), 240).alias("sample_240"),
        text.cut_text(_C("raw_text"), 140).alias("cut_140"),
    )


@query
def stable_id(spark, d):
    return feedback(spark, d).select(
        "row_ord",
        ids.stable_id(
            _C("feedback_id"), _C("source"), dates.parse_date(_C("feedback_date")), _C("raw_text")
        ).alias("feedback_id"),
    )


@query
def url_id(spark, d):
    return load(spark, d, inputs.manual).select(
        "row_ord", ids.url_id(_C("source_url"), _C("title"), _C("date")).alias("feedback_id")
    )


@query
def review_id(spark, d):
    return load(spark, d, inputs.seed).select(
        "row_ord",
        ids.review_id(_C("author"), _C("feedback_date"), _C("raw_text"), _C("source_url")).alias("feedback_id"),
    )


@query
def parse_date(spark, d):
    """The given tables hold no dates: the values are made up per row number."""
    return feedback(spark, d).select(
        "row_ord", dates.parse_date(_C("feedback_date")).alias("feedback_date")
    )


@query
def extract_date(spark, d):
    return load(spark, d, inputs.relative).select(
        "doc_id", dates.extract_date(_C("context")).alias("date_str")
    )


@query
def extract_relative(spark, d):
    return load(spark, d, inputs.relative).select(
        "doc_id",
        dates.extract_relative(_C("phrase")).alias("of_phrase"),
        dates.extract_relative(_C("context")).alias("of_context"),
    )


@query
def parse_relative(spark, d):
    """The given tables hold no relative times: the values are made up per row number."""
    return load(spark, d, inputs.relative).select(
        "doc_id", dates.parse_relative(_C("phrase"), AS_OF).alias("moment")
    )


@query
def effective_date(spark, d):
    """The given tables hold no dates: the values are made up per row number."""
    return load(spark, d, inputs.relative).select(
        "doc_id", dates.effective_date(_C("date_str"), _C("phrase"), AS_OF).alias("day")
    )


@query
def to_bool(spark, d):
    answers = load(spark, d, inputs.replies)
    payload = replies.parse_reply(_C("reply"))
    flag = replies.pick(payload, lx.REPLY_KEYS["escalation"])
    labels = spark.read.parquet(f"{d}/labels.parquet")
    of_labels = labels.select(
        _C("doc_id"), F.lit("label").alias("kind"), values.number_to_bool(_C("toxic")).alias("flag")
    )
    of_status = feedback(spark, d).select(
        _C("row_ord").alias("doc_id"),
        F.lit("word").alias("kind"),
        values.to_bool(F.when(_C("row_ord") % 2 == 0, F.lit(" Sim ")).otherwise(_C("status"))).alias("flag"),
    )
    of_replies = answers.where(payload.isNotNull()).select(
        "doc_id", F.lit("reply").alias("kind"), replies.reply_flag(flag).alias("flag")
    )
    return of_labels.unionByName(of_status).unionByName(of_replies)


@query
def to_number(spark, d):
    """Numbers from every word of the documents, and from row numbers beyond the whole doubles."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    small = F.concat(F.lit(" "), (_C("doc_id") % 13 - 3).cast("string"), F.when(_C("doc_id") % 4 == 1, F.lit(".5")).otherwise(F.lit("")))
    large = (_C("doc_id") + 2**53).cast("string")
    words = F.concat(F.split("text", " "), F.array(small, large))
    each = docs.select("doc_id", F.posexplode(words).alias("pos", "word"))
    return each.select(
        "doc_id", "pos",
        values.to_number(_C("word"), 0).alias("plain"),
        values.to_number(_C("word"), 3, 1, 5).alias("clamped"),
        values.to_number(_C("word"), 0, kind="bigint").alias("whole"),
    )


@query
def theme_labels(spark, d):
    odd = labelled(spark, d).select(
        "row_ord",
        F.when(_C("row_ord") % 10 == 0, F.lit(None)).when(_C("row_ord") % 10 == 1, F.lit("tema_novo"))
        .otherwise(_C("primary_theme")).alias("theme"),
    )
    return odd.select(
        "row_ord",
        values.label_of(_C("theme"), lx.THEME_LABELS).alias("screen_label"),
        values.title_label_of(_C("theme"), lx.REPORT_THEME_LABELS).alias("report_label"),
    )


@query
def with_aliases(spark, d):
    rows = analyzed(spark, d).select("row_ord", "sentiment_label", "primary_theme", "priority", "internal_recommendation", "response_guide")
    return values.with_aliases(rows)


@query
def status_class(spark, d):
    """The given tables hold no statuses: the values are made up per row number."""
    return feedback(spark, d).select("row_ord", text.status_class(_C("status")).alias("status_class"))


@query
def case_reference(spark, d):
    return _of_text(spark, d, "reference", text.case_reference)


@query
def clean_author(spark, d):
    """The given tables hold no authors: the values are made up per row number."""
    return feedback(spark, d).select("row_ord", text.clean_author(_C("author")).alias("author"))


@query
def infer_category(spark, d):
    return _of_text(spark, d, "category", text.infer_category)


@query
def clean_review(spark, d):
    return load(spark, d, inputs.seed).select("row_ord", text.clean_review(_C("raw_text")).alias("review"))


@query
def mojibake_flag(spark, d):
    """Marker letters of the documents, and of a garbled copy with two letters per accent."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    garbled = F.concat("text", F.regexp_replace("text", "[^é]", ""), F.lit("Ã"))
    garbled = F.translate(garbled, "é", "Ã")
    return docs.select(
        "doc_id",
        text.mojibake_hits(_C("text")).alias("hits"),
        text.mojibake_hits(garbled).alias("garbled_hits"),
        text.looks_garbled(garbled).alias("garbled"),
    )


@query
def decode_pages(spark, d):
    raw = load(spark, d, inputs.raw_bytes, "pages")
    return extract.decode_pages(raw).select("page_id", "html")


@query
def display_rows(spark, d):
    return display.display_rows(analyzed(spark, d), keep=["row_ord"])


# --------------------------------------------------------------------- predicates
@query
def min_length(spark, d):
    return filters.min_length(raw_text(spark, d), "raw_text", 40)


@query
def status_filter(spark, d):
    rows = feedback(spark, d).select("row_ord", "status")
    options = [filters.ALL, filters.RESOLVED, filters.UNRESOLVED, "outra"]
    runs = [filters.status_filter(rows, o).withColumn("option", F.lit(o)) for o in options]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])


@query
def time_window(spark, d):
    rows = feedback(spark, d).select(
        "row_ord", dates.parse_date(_C("feedback_date")).alias("feedback_date")
    )
    return filters.time_window(rows, AS_OF, 24 * 90)


@query
def drop_low_quality(spark, d):
    return dedupe.drop_low_quality(feedback(spark, d).select("row_ord", "source", "raw_text"))


@query
def drop_boilerplate(spark, d):
    return filters.drop_boilerplate(raw_text(spark, d))


@query
def source_prefix(spark, d):
    return filters.source_prefix(feedback(spark, d)).select("row_ord", "source", "raw_text")


@query
def multi_filter(spark, d):
    chosen = filters.multi_filter(
        stored(spark, labelled(spark, d).select("row_ord", "source", "sentiment_label", "primary_theme")),
        sources=["Site (coleta automatica)", "reviews"],
        sentiments=["Negativo", "Neutro"],
        themes=["Entrega e prazo", "Atendimento", "Outros"],
    )
    return chosen.select("row_ord", "source", "sentiment_label", "primary_theme")


@query
def high_priority(spark, d):
    return filters.high_priority(stored(spark, labelled(spark, d).select("row_ord", "priority")))


@query
def complaint_text(spark, d):
    return raw_text(spark, d).where(text.looks_like_complaint(_C("raw_text")))


@query
def url_pattern(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    return pages.select(
        "page_id", filters.url_path(_C("url")).alias("path"),
        filters.url_matches(_C("url"), "^/(fr|de)/[0-9]+/?$").alias("fits"),
    )


# ----------------------------------------------------------------- classification
def _labels(spark, d, *columns):
    return labelled(spark, d).select("row_ord", *columns)


@query
def theme(spark, d):
    return _labels(spark, d, "primary_theme")


@query
def sentiment(spark, d):
    return _labels(spark, d, "sentiment_label", "sentiment_score")


@query
def urgency(spark, d):
    return _labels(spark, d, "urgency")


@query
def priority(spark, d):
    return _labels(spark, d, "priority")


@query
def escalation(spark, d):
    return _labels(spark, d, "escalation_required")


@query
def recommendation(spark, d):
    return _labels(spark, d, "internal_recommendation")


def _wordings(spark, d, make) -> DataFrame:
    rows = labelled(spark, d)
    return rows.select("row_ord", *[make(_C("primary_theme"), w).alias(f"{w}_wording") for w in ("rules", "model")])


@query
def issue_summary(spark, d):
    return _wordings(spark, d, rules.issue_summary)


@query
def next_step(spark, d):
    return _wordings(spark, d, rules.next_step)


def _worded(spark, d) -> DataFrame:
    """Reply texts in both wordings next to the labels."""
    rows = labelled(spark, d)
    for w in ("rules", "model"):
        rows = rows.withColumns(
            {
                f"_issue_{w}": rules.issue_summary(_C("primary_theme"), w),
                f"_step_{w}": rules.next_step(_C("primary_theme"), w),
            }
        )
        rows = rows.withColumn(
            f"_text_{w}",
            rules.reply_text(
                _C("sentiment_label"), _C("urgency"), _C(f"_issue_{w}"), _C(f"_step_{w}"),
                _C("_reference"), wording=w, author=_C("author") if w == "model" else None,
            ),
        )
    return rows


@query
def reply_text(spark, d):
    return _worded(spark, d).select(
        "row_ord", _C("_text_rules").alias("rules_wording"), _C("_text_model").alias("model_wording")
    )


@query
def response_guide(spark, d):
    def guide(w: str) -> Column:
        given = _C("internal_recommendation") if w == "model" else None
        return rules.response_guide(
            _C("urgency"), _C(f"_issue_{w}"), _C(f"_step_{w}"), _C("_reference"), _C(f"_text_{w}"),
            wording=w, recommendation_=given,
        )

    return _worded(spark, d).select(
        "row_ord", guide("rules").alias("rules_layout"), guide("model").alias("model_layout")
    )


@query
def rules_classify(spark, d):
    return analyzed(spark, d)


@query
def rules_folded(spark, d):
    """The same labels with accents folded before matching."""
    return classify.classify_labels(normalized(spark, d), accents=True).select(
        "row_ord", "primary_theme", "sentiment_label", "sentiment_score", "urgency", "priority"
    )


# ------------------------------------------------------------------- model replies
def _replies(spark, d) -> DataFrame:
    return load(spark, d, inputs.replies).select("doc_id", "reply")


@query
def json_block(spark, d):
    return _replies(spark, d).select(
        "doc_id",
        replies.json_block(_C("reply")).alias("block"),
        replies.parse_reply(_C("reply")).isNotNull().alias("valid"),
    )


def _reply_columns(spark, d, **columns) -> DataFrame:
    rows = classify.reply_labels(_replies(spark, d)).where(_C("_valid"))
    return rows.select("doc_id", *[_C(v).alias(k) for k, v in columns.items()])


@query
def reply_fields(spark, d):
    payload = replies.parse_reply(_C("reply"))
    rows = _replies(spark, d).withColumn("payload", payload).where(_C("payload").isNotNull())
    return rows.select(
        "doc_id",
        *[
            replies.as_text(replies.pick(_C("payload"), lx.REPLY_KEYS[k])).alias(k)
            for k in ("sentiment", "theme", "urgency", "escalation")
        ],
    )


@query
def reply_texts(spark, d):
    return _reply_columns(spark, d, recommendation="m_recommendation", response="m_response")


@query
def reply_enums(spark, d):
    return _reply_columns(spark, d, sentiment="m_sentiment", theme="m_theme", urgency="m_urgency")


@query
def reply_numbers(spark, d):
    return _reply_columns(spark, d, priority="m_priority", score="m_score", confidence="m_confidence")


@query
def reply_urgency(spark, d):
    return _reply_columns(spark, d, urgency="m_urgency", raw_priority="_priority_raw")


def _responses(spark, d) -> DataFrame:
    return classify.reply_labels(_replies(spark, d)).where(_C("_valid")).select("doc_id", "m_response")


@query
def generic_reply(spark, d):
    return _responses(spark, d).select("doc_id", replies.is_generic(_C("m_response")).alias("generic"))


@query
def customer_facing(spark, d):
    return _responses(spark, d).select(
        "doc_id", replies.looks_customer_facing(_C("m_response")).alias("customer_facing")
    )


@query
def ensure_guide(spark, d):
    """Which way each response goes, and the text that is kept."""
    guide = replies.ensure_guide(_C("m_response"), F.lit("<default>"), F.concat(F.lit("<wrapped>"), "m_response"))
    return _responses(spark, d).select("doc_id", guide.alias("guide"))


@query
def validate_reply(spark, d):
    texts = feedback(spark, d).select(_C("row_ord").alias("doc_id"), "raw_text", "author")
    return classify.validate_reply(_replies(spark, d).join(texts, "doc_id"))


@query
def enrich(spark, d):
    return enriched(spark, d)


@query
def refresh_guides(spark, d):
    """Guides of four kinds: good, blank, old generic phrase, plain text."""
    rows = analyzed(spark, d).select("row_ord", "raw_text", "response_guide")
    mixed = rows.withColumn(
        "response_guide",
        F.when(_C("row_ord") % 4 == 1, F.lit(" "))
        .when(_C("row_ord") % 4 == 2, F.concat("response_guide", F.lit("Ja acionamos o time responsavel para tratar seu caso com prioridade")))
        .when(_C("row_ord") % 4 == 3, _C("raw_text"))
        .otherwise(_C("response_guide")),
    )
    return classify.refresh_guides(mixed)


# ---------------------------------------------------------------------- extraction
def _listings(spark, d) -> DataFrame:
    return load(spark, d, inputs.listings)


@query
def link_entries(spark, d):
    return extract.link_entries(_listings(spark, d), PATH_REGEX, BASE_URL)


@query
def link_entries_pages(spark, d):
    """The same job on the given web pages: menu links with a long enough title."""
    pages = readers.scan_pages(spark, f"{d}/pages.parquet")
    entries = extract.link_entries(pages, "^/.+$", BASE_URL)
    return entries.select("page_id", "source_url", "title", "snippet", "status")


@query
def page_headings(spark, d):
    """First heading of the given web pages, as the page detail reads it."""
    pages = readers.scan_pages(spark, f"{d}/pages.parquet")
    return extract.parse_pages(pages, ["heading"], BASE_URL).select(
        "page_id", text.collapse_spaces(_C("heading")).alias("heading")
    )


def _entries(spark, d, limit=None) -> DataFrame:
    return extract.listing_entries(_listings(spark, d), PATH_REGEX, BASE_URL, limit)


@query
def merge_entries(spark, d):
    return _entries(spark, d)


@query
def merge_entries_first(spark, d):
    return _entries(spark, d, limit=50)


def _json_candidates(spark, d) -> DataFrame:
    return extract.with_json_candidates(load(spark, d, inputs.embedded))


@query
def json_candidates(spark, d):
    return extract.explode_candidates(_json_candidates(spark, d), "json_candidates")


@query
def best_candidate(spark, d):
    return _json_candidates(spark, d).select(
        "page_id", extract.best_candidate(_C("json_candidates")).alias("text")
    )


def _detail_parts(spark, d) -> DataFrame:
    return extract.parse_pages(load(spark, d, inputs.details), extract.DETAIL_PARTS, BASE_URL)


@query
def block_candidates(spark, d):
    return extract.explode_candidates(
        extract.with_block_candidates(_detail_parts(spark, d)), "block_candidates"
    )


@query
def ld_candidates(spark, d):
    found = _detail_parts(spark, d).withColumn("ld_candidates", extract.ld_candidates(_C("ld_strings")))
    return extract.explode_candidates(found, "ld_candidates")


@query
def text_cascade(spark, d):
    texts = extract.page_texts(_detail_parts(spark, d))
    return texts.select(
        "page_id", extract.text_cascade(F.lit("trecho da lista de casos")).alias("description")
    )


@query
def page_detail(spark, d):
    return extract.page_detail(_entries(spark, d), load(spark, d, inputs.details), BASE_URL)


@query
def complaint_records(spark, d):
    return extract.complaint_records(
        _entries(spark, d), load(spark, d, inputs.details), BASE_URL, AS_OF,
        status_option=filters.UNRESOLVED, hours=24 * 200,
    )


def _review_pages(spark, d) -> DataFrame:
    return load(spark, d, inputs.review_pages)


@query
def page_lines(spark, d):
    return reviews.page_lines(_review_pages(spark, d))


@query
def page_lines_html(spark, d):
    """Text lines of the given web pages."""
    pages = readers.scan_pages(spark, f"{d}/pages.parquet")
    return reviews.page_lines(extract.parse_pages(pages, ["lines"], BASE_URL), "lines")


@query
def review_segments(spark, d):
    return reviews.review_segments(_review_pages(spark, d)).drop("author")


@query
def review_author(spark, d):
    return reviews.review_segments(_review_pages(spark, d)).select("page_id", "line_no", "author")


@query
def review_records(spark, d):
    return reviews.review_records(_review_pages(spark, d))


# ------------------------------------------------------------------- deduplication
@query
def dedupe_url(spark, d):
    return dedupe.dedupe_url(feedback(spark, d))


@query
def dedupe_id(spark, d):
    rows = feedback(spark, d)
    last = dedupe.dedupe_id(rows, "last").withColumn("keep", F.lit("last"))
    return last.unionByName(dedupe.dedupe_id(rows, "first").withColumn("keep", F.lit("first")))


@query
def dedupe_content(spark, d):
    return dedupe.dedupe_content(feedback(spark, d))


# -------------------------------------------------------------------- aggregations
def _aggregate(name: str, make, source=enriched) -> None:
    def run(spark, d):
        return make(source(spark, d))

    run.__name__ = name
    query(run)


_aggregate("sentiment_totals", aggregates.sentiment_totals)
_aggregate("theme_top", aggregates.theme_top)
_aggregate("theme_top_other", lambda df: aggregates.theme_top_other(df, 3))
_aggregate("theme_top_critical", lambda df: aggregates.theme_top_critical(df, 3), stored_enriched)
_aggregate("priority_share", aggregates.priority_share)
_aggregate("escalation_count", aggregates.escalation_count)
_aggregate("provider_coverage", aggregates.provider_coverage)
_aggregate("kpis", aggregates.kpis)
_aggregate("theme_priority_cross", aggregates.theme_priority_cross, labelled)
_aggregate("theme_priority_pivot", lambda df: aggregates.theme_priority_cross(df, pivot=True), labelled)
_aggregate("theme_order", aggregates.theme_order)
_aggregate(
    "theme_distribution",
    lambda df: aggregates.theme_distribution(
        df.withColumn("primary_theme", F.nullif("primary_theme", F.lit("atendimento")))
    ),
)
_aggregate(
    "filter_options",
    lambda df: aggregates.all_filter_options(df).withColumn("codes", F.array_join("codes", ",")),
    stored_enriched,
)
_aggregate("source_breakdown", aggregates.source_breakdown, normalized)
_aggregate("insights", aggregates.insights)


@query
def run_summary(spark, d):
    stored, incoming = _sides(spark, d)
    return aggregates.run_summary(incoming, dedupe.upsert_added(stored, incoming))


# ----------------------------------------------------------------- orders and lists
@query
def normalized_order(spark, d):
    return ordering.normalized_order(normalized(spark, d)).select("row_ord", "feedback_date", "source", "raw_text")


_aggregate("text_samples", ordering.text_samples, stored_enriched)
_aggregate("priority_actions", ordering.priority_actions, stored_enriched)
_aggregate("priority_guides", ordering.priority_guides, stored_enriched)
_aggregate("critical_cases", ordering.critical_cases, stored_enriched)
_aggregate(
    "case_table",
    lambda df: display.display_rows(ordering.case_table(df), keep=["row_ord"]),
    stored_enriched,
)


@query
def preview_rows(spark, d):
    return ordering.preview_rows(feedback(spark, d))


# ----------------------------------------------------------------------- composites
@query
def normalize_feedback_rows(spark, d):
    return normalized(spark, d)


QUERIES["normalize_feedback"] = QUERIES.pop("normalize_feedback_rows")


@query
def flagship(spark, d):
    """Collected feedback to the theme by priority table: merge, normalize, classify, count."""
    merged = dedupe.upsert_feedback(*_sides(spark, d))
    done = classify.classify_labels(normalize_feedback(merged, AS_OF))
    return aggregates.theme_priority_cross(done)


@query
def refresh_fallback(spark, d):
    """Mode "auto, else manual" with an automatic source that collected nothing."""
    _, incoming = _sides(spark, d)
    nothing = incoming.where(_C("source") == "sem fonte").drop("batch_seq")
    manual = readers.format_manual(load(spark, d, inputs.manual))
    fresh = collect(AUTO_OR_MANUAL, nothing, manual)
    merged = dedupe.upsert_feedback(fresh.limit(0), fresh)
    return aggregates.source_breakdown(normalize_feedback(merged, AS_OF))

