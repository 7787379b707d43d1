"""Extraction from stored pages.

Python reads the HTML of a page once, inside the tasks, next to the scan; what it
emits are short typed parts. Cleaning, scoring and choice are Catalyst expressions,
and everything about one page is decided within its row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vozmill import lexicon as lx
from vozmill.functions import dates
from vozmill.functions.ids import bare_url, short_hash
from vozmill.functions.text import (
    bind, collapse_again, collapse_spaces, cut_footer, fold_flat, fold_text, is_boilerplate_flat, is_complaint_flat,
    looks_garbled, status_of_folded, strip_boilerplate, text_or_blank,
)
from vozmill.operators import filters
from vozmill.operators.dedupe import dedupe_columns, keep_one
from vozmill.operators import json_parts
from vozmill.operators.page_parts import PageParts

_C = F.col

PART_TYPES = {
    "links": "struct<anchors: array<struct<pos: int, url: string, title: string, start: int, stop: int>>, "
             "pieces: array<string>>",
    "heading": "string",
    "og_title": "string",
    "pieces": "array<string>",
    "lines": "string",
    "json_strings": "array<struct<hits: int, text: string>>",
    "ld_strings": "array<struct<type: string, text: string>>",
    "blocks": "array<struct<rank: int, start: int, stop: int, n_chars: int>>",
}


#: Pages whose parts are held at once.
PAGES_PER_BATCH = 256


def parse_pages(pages: DataFrame, parts: list[str], base_url: str) -> DataFrame:
    """Named parts of every page; one row per page, (page_id, url, *parts).

    Only page_id, url and html go to Python and only the named parts come back.
    """
    unknown = sorted(set(parts) - set(PART_TYPES))
    if unknown:
        raise ValueError(f"Unknown page parts: {unknown}")
    schema = "page_id bigint, url string, " + ", ".join(f"{p} {PART_TYPES[p]}" for p in parts)

    make = {
        "links": lambda page: page.links(base_url),
        "heading": lambda page: page.heading(),
        "og_title": lambda page: page.og_title,
        "pieces": lambda page: page.pieces,
        "lines": lambda page: "\n".join(page.raw),
        "json_strings": lambda page: [{"hits": n, "text": t} for n, t in page.json_strings()],
        "ld_strings": lambda page: [{"type": k, "text": t} for k, t in page.linked_texts()],
        "blocks": lambda page: page.blocks(),
    }
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_PER_BATCH):
                part = batch.slice(start, PAGES_PER_BATCH)
                read_pages = [PageParts(html) for html in part.column("html").to_pylist()]
                made = [pa.array([make[p](page) for page in read_pages], kinds.field(p).type) for p in parts]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *made], schema=kinds)

    return pages.select(
        _C("page_id").cast("bigint").alias("page_id"), _C("url").cast("string").alias("url"), "html"
    ).mapInArrow(read, schema)


def decode_pages(df: DataFrame, column: str = "content") -> DataFrame:
    """Adds ``html``: UTF-8, or a legacy code page where that fails or is garbled.

    The legacy page is Latin-1 with signs in place of 27 controls; bytes that it leaves
    undefined mean plain Latin-1.
    """
    undefined = "".join(chr(b) for b in range(0x80, 0xA0) if not bytes([b]).decode("cp1252", "ignore"))
    controls = "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in undefined)
    signs = controls.encode("latin-1").decode("cp1252")
    as_utf8 = _C(column).cast("string")
    latin = F.decode(_C(column), "ISO-8859-1")
    legacy = F.when(latin.rlike(f"[{undefined}]"), latin).otherwise(F.translate(latin, controls, signs))
    good = F.is_valid_utf8(as_utf8) & ~looks_garbled(as_utf8)
    return df.withColumn("html", F.when(good, as_utf8).otherwise(legacy))


# ------------------------------------------------------------------------- entries
def _entry_columns(brand: str, site: str) -> dict[str, Column]:
    """Snippet of an entry: its block without the title, or the title when too short."""
    block, title = _C("_block"), _C("title")
    # At position 0 (title not in the block) nothing is cut.
    rest = bind(
        F.position(title, block),
        lambda at: F.when(at > 0, F.overlay(block, F.lit(""), at, F.length(title))).otherwise(block),
    )
    return {"_rest": strip_boilerplate(rest, brand, site)}


def fitting_anchors(
    parsed: DataFrame, path_regex: str, brand: str = "Empresa", site: str = "Portal do Consumidor"
) -> DataFrame:
    """Anchors with a fitting path and a long enough title: page_id, pos, source_url, title, block.

    The first per URL of a page. All is decided inside the row of the page, and only the anchors
    that stay get the text of their block.
    """
    fitting = F.filter(_C("links.anchors"), lambda x: filters.url_matches(x["url"], path_regex))
    titled = F.filter(
        F.transform(
            fitting,
            lambda x: F.struct(
                x["url"].alias("source_url"), x["pos"].alias("pos"),
                strip_boilerplate(x["title"], brand, site).alias("title"), x["start"].alias("start"), x["stop"].alias("stop"),
            ),
        ),
        lambda x: F.length(x["title"]) >= 10,
    )
    # Sorted by URL, then position: the first of each URL follows another URL.
    placed = parsed.select("page_id", _C("links.pieces").alias("_pieces"), F.array_sort(titled).alias("_placed"))
    first = F.filter(
        "_placed", lambda x, i: (i == 0) | (F.get(_C("_placed"), i - 1)["source_url"] != x["source_url"])
    )
    blocked = F.transform(
        first,
        lambda x: F.struct(
            "page_id", x["pos"].alias("pos"), x["source_url"].alias("source_url"), x["title"].alias("title"),
            F.when(
                x["start"].isNotNull(), F.array_join(F.slice("_pieces", x["start"] + 1, x["stop"] - x["start"]), " ")
            ).alias("block"),
        ),
    )
    return placed.select(F.inline(blocked))


def read_entries(
    anchors: DataFrame, brand: str = "Empresa", site: str = "Portal do Consumidor"
) -> DataFrame:
    """Status, relative time and snippet from the block around each anchor."""
    blocks = anchors.withColumn("_block", collapse_again(F.coalesce(_C("block"), _C("title"))))
    # The block is folded once for both readings.
    entries = blocks.withColumn("_folded", fold_flat(_C("_block"))).withColumns(
        {
            "status": status_of_folded(_C("_folded")),
            "relative_text": dates.relative_of_folded(_C("_folded")),
            **_entry_columns(brand, site),
        }
    )
    return entries.select(
        "page_id", "pos", "source_url", "title", "status", "relative_text",
        F.when(F.length("_rest") < 20, _C("title")).otherwise(_C("_rest")).alias("snippet"),
    )


def link_entries(pages: DataFrame, path_regex: str, base_url: str, **names) -> DataFrame:
    """Entries of listing pages, the first per page and URL."""
    return read_entries(fitting_anchors(parse_pages(pages, ["links"], base_url), path_regex, **names), **names)


def merge_entries(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """First entry (or anchor) per URL over all pages in order, then the first N."""
    first = keep_one(entries, [_C("source_url")], [_C("page_id").asc(), _C("pos").asc()])
    return first if limit is None else first.orderBy("page_id", "pos").limit(int(limit))


def listing_entries(
    pages: DataFrame, path_regex: str, base_url: str, limit: int | None = None, **names
) -> DataFrame:
    """E1 and E2 together: anchors are merged and limited before their blocks are read."""
    anchors = fitting_anchors(parse_pages(pages, ["links"], base_url), path_regex, **names)
    return read_entries(merge_entries(anchors, limit), **names)


# ---------------------------------------------------------------------- candidates
_JSON_STRINGS = T.ArrayType(T.StructType([T.StructField("hits", T.IntegerType()), T.StructField("text", T.StringType())]))


@F.arrow_udf(_JSON_STRINGS)
def json_strings(payload: pa.Array) -> pa.Array:
    """The strings of JSON texts, each with the number of hint words in the keys above it."""
    kind = pa.list_(pa.struct([("hits", pa.int32()), ("text", pa.string())]))
    found = [json_parts.strings(text) for text in payload.to_pylist()]
    return pa.array([[{"hits": n, "text": t} for n, t in each] for each in found], kind)


def json_score(hits: Column, text: Column) -> Column:
    return F.length(text) + hits * lx.JSON_HINT_WEIGHT


def ld_score(kind: Column, text: Column) -> Column:
    return F.length(text) + F.when(fold_text(kind).isin(lx.LD_TYPES), lx.LD_TYPE_WEIGHT).otherwise(0)


def _candidates(items: Column, score) -> Column:
    """Array of (score, pos, text) of the items that look like complaints."""
    cleaned = F.transform(
        items, lambda x, i: F.struct(x.alias("item"), i.alias("pos"), collapse_spaces(x["text"]).alias("text"))
    )
    fitting = F.filter(cleaned, lambda x: is_complaint_flat(x["text"]))
    return F.transform(
        fitting,
        lambda x: F.struct(
            score(x["item"], x["text"]).alias("score"), x["pos"].alias("pos"), x["text"].alias("text")
        ),
    )


def best_candidate(candidates: Column) -> Column:
    """Text of the best score, the first on ties, blank without candidates.

    Works on the array of a row, so the choice needs no grouping.
    """
    ranked = F.transform(
        candidates, lambda x: F.struct(x["score"].alias("s"), (-x["pos"]).alias("p"), x["text"].alias("t"))
    )
    return F.coalesce(F.array_max(ranked)["t"], F.lit(""))


def json_candidates(strings: Column) -> Column:
    """Candidates among the strings of embedded JSON."""
    return _candidates(strings, lambda item, text: json_score(item["hits"], text))


def ld_candidates(strings: Column) -> Column:
    """E5: candidates among the text fields of linked data."""
    return _candidates(strings, lambda item, text: ld_score(item["type"], text))


def with_json_candidates(df: DataFrame, column: str = "embedded_json") -> DataFrame:
    """Adds ``json_candidates`` from the JSON text of a column."""
    return df.withColumn("_strings", json_strings(_C(column))).withColumn(
        "json_candidates", json_candidates(_C("_strings"))
    ).drop("_strings")


def _block_text(block: Column, pieces: Column) -> Column:
    return F.array_join(F.slice(pieces, block["start"] + 1, block["stop"] - block["start"]), " ")


def with_block_candidates(df: DataFrame) -> DataFrame:
    """Adds ``block_candidates``, all with their texts, from the marked blocks of a parsed page."""
    texts = F.transform("blocks", lambda x: F.struct(x["rank"].alias("rank"), _block_text(x, _C("pieces")).alias("text")))
    return df.withColumn(
        "block_candidates", _candidates(texts, lambda item, text: F.length(text) + lx.BLOCK_WEIGHT)
    )


def best_block() -> Column:
    """E4 and E6 at once: the text of the best block, blank without candidates.

    The score grows with the length, which is known without the text: blocks are tried from the
    longest on, and only those that are tried get their text.
    """
    tried = F.array_sort(
        F.transform(
            F.filter("blocks", lambda x: x["n_chars"] >= 40),
            lambda x, i: F.struct((-x["n_chars"]).alias("less"), i.alias("pos"), x["start"].alias("start"), x["stop"].alias("stop")),
        )
    )

    def first(found: Column, block: Column) -> Column:
        fitting = bind(
            _block_text(block, _C("pieces")), lambda text: F.when(is_complaint_flat(text), text).otherwise(F.lit(""))
        )
        return F.when(found != "", found).otherwise(fitting)

    return F.coalesce(F.aggregate(tried, F.lit(""), first), F.lit(""))


def explode_candidates(df: DataFrame, column: str) -> DataFrame:
    """One row per candidate: page_id, pos, score, text."""
    each = df.select("page_id", F.explode_outer(column).alias("_c")).where(_C("_c").isNotNull())
    return each.select(
        "page_id", _C("_c.pos").alias("pos"), _C("_c.score").alias("score"), _C("_c.text").alias("text")
    )


# --------------------------------------------------------------------------- detail
DETAIL_PARTS = ["heading", "og_title", "pieces", "json_strings", "ld_strings", "blocks"]


def page_texts(parsed: DataFrame) -> DataFrame:
    """Best text of each kind per page: ``json_text``, ``block_text``, ``ld_text``."""
    return parsed.withColumns(
        {
            "json_text": best_candidate(json_candidates(_C("json_strings"))),
            "block_text": best_block(),
            "ld_text": best_candidate(ld_candidates(_C("ld_strings"))),
        }
    ).drop("json_strings", "blocks", "ld_strings")


def own_text(default: Column | None = None) -> Column:
    """Embedded JSON, then block, then linked data; blank or the default when all are blank."""
    kinds = [F.nullif(_C(c), F.lit("")) for c in ("json_text", "block_text", "ld_text")]
    return F.coalesce(*kinds, F.lit("") if default is None else text_or_blank(default))


def text_cascade(snippet: Column, brand: str = "Empresa", site: str = "Portal do Consumidor") -> Column:
    """The own text of the page, else the snippet of its entry; footers cut."""
    return strip_boilerplate(own_text(snippet), brand, site)


def page_detail(
    entries: DataFrame, pages: DataFrame, base_url: str,
    brand: str = "Empresa", site: str = "Portal do Consumidor",
) -> DataFrame:
    """Title, description, date text and status of every entry.

    Pages are read where they lie; the join moves their short results. An entry
    without page keeps its own title, snippet and status.
    """
    parsed = parse_pages(pages, DETAIL_PARTS, base_url)
    texts = page_texts(parsed).select(
        _C("url").alias("source_url"),
        _C("page_id").alias("_page"),
        F.array_join("pieces", " ").alias("body"),
        strip_boilerplate(_C("heading"), brand, site).alias("_h1"),
        strip_boilerplate(_C("og_title"), brand, site).alias("_og"),
        (own_text() != "").alias("_has_text"),
        # The page's own text is collapsed and free of hints, so the footer alone is left to cut.
        cut_footer(own_text(), brand, site).alias("_page_text"),
    )
    per_url = keep_one(texts, [_C("source_url")], [_C("_page").asc()]).withColumn("_found", F.lit(True))
    joined = entries.join(per_url, "source_url", "left")
    found = _C("_found").isNotNull()
    # The snippet of an entry is as long as a page's text; it is cleaned only where it stands in for that.
    lacking = found & (~_C("_has_text") | (F.length("_page_text") < 20))
    told = joined.withColumns(
        {
            "_title": F.coalesce(
                *[F.nullif(_C(c), F.lit("")) for c in ("_h1", "_og")],
                F.nullif(strip_boilerplate(_C("title"), brand, site), F.lit("")), collapse_spaces(_C("title")),
            ),
            "_snippet": F.when(lacking, strip_boilerplate(_C("snippet"), brand, site)),
        }
    ).withColumn("_description", F.when(_C("_has_text"), _C("_page_text")).otherwise(_C("_snippet")))
    # Each part is collapsed already.
    parts = F.filter(F.array("_title", "_description", "body"), lambda part: part != "")
    context = told.withColumn("_context", F.when(found, F.array_join(parts, " ")).otherwise(""))
    seen = bind(fold_flat(_C("_context")), status_of_folded)
    shown = {
        "title": F.when(found & (_C("_title") != ""), _C("_title")).otherwise(_C("title")),
        "description": F.when(~found, _C("snippet"))
        .when(F.length("_description") < 20, _C("_snippet"))
        .otherwise(_C("_description")),
        "date_str": dates.extract_date(_C("_context")),
        "status": bind(
            seen, lambda s: F.when(s == lx.STATUS_UNKNOWN, _C("status")).otherwise(s)
        ),
    }
    return context.select(
        "page_id", "pos", "source_url", "relative_text", *[v.alias(k) for k, v in shown.items()]
    )


def complaint_records(
    entries: DataFrame, pages: DataFrame, base_url: str, as_of,
    status_option: str = filters.ALL, hours: int | None = None,
    source: str = "site_auto", author: str = "Consumidor RA", channel: str = "complaint_site_auto",
    brand: str = "Empresa", site: str = "Portal do Consumidor",
) -> DataFrame:
    """Feedback rows from listing entries and complaint pages."""
    detail = page_detail(entries, pages, base_url, brand, site)
    # As output of a generator these are computed once: filters on them stay above it.
    fields = F.struct(
        "status",
        dates.effective_date(_C("date_str"), _C("relative_text"), as_of).alias("feedback_date"),
        collapse_again(F.concat_ws(" ", "title", "description")).alias("raw_text"),
    )
    staged = detail.select("page_id", "pos", "source_url", F.inline_outer(F.array(fields)))
    chosen = filters.time_window(filters.status_filter(staged, status_option), as_of, hours)
    kept = chosen.where((F.length("raw_text") >= 20) & ~is_boilerplate_flat(_C("raw_text")))
    records = kept.select(
        short_hash(bare_url(_C("source_url"))).alias("feedback_id"),
        F.lit(source).alias("source"),
        "source_url",
        F.lit(author).alias("author"),
        F.coalesce(_C("feedback_date").cast("string"), F.lit("")).alias("feedback_date"),
        "raw_text",
        F.lit(lx.CATEGORY_COMPLAINT).alias("initial_category"),
        F.lit(channel).alias("channel"),
        "status",
        "page_id",
        "pos",
    )
    return dedupe_columns(records, [bare_url(_C("source_url"))], "last", ["page_id", "pos"])
