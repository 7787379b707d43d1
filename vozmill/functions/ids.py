"""Stable identifiers and merge keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vozmill.functions.text import strip, text_or_blank


def short_hash(*parts: Column) -> Column:
    """First 12 hex digits of SHA-1 over the parts joined by a vertical bar."""
    return F.substring(F.sha1(F.concat_ws("|", *[text_or_blank(p) for p in parts])), 1, 12)


def bare_url(url: Column) -> Column:
    """URL without blanks around it and without closing slashes."""
    return F.rtrim(strip(url), F.lit("/"))


def stable_id(feedback_id: Column, source: Column, date: Column, text: Column) -> Column:
    """Keep a given id, else hash source, ISO date and text."""
    return F.when(strip(feedback_id) != "", feedback_id).otherwise(short_hash(source, date, text))


def url_id(url: Column, title: Column, date: Column) -> Column:
    """Hash of the bare URL, else of title, date and URL."""
    bare = bare_url(url)
    return F.when(bare != "", short_hash(bare)).otherwise(short_hash(title, date, url))


def review_id(author: Column, date: Column, text: Column, url: Column) -> Column:
    """Hash of author, date, text and URL."""
    return short_hash(author, date, text, url)


def content_key(source: Column, date: Column, text: Column) -> Column:
    """128 bits over source, ISO date and text, each with its length: the full key of a normalized row."""
    parts = [text_or_blank(p) for p in (source, date, text)]
    return F.md5(F.concat_ws("|", *[F.concat_ws(":", F.length(p).cast("string"), p) for p in parts]))


def merge_key(url: Column, feedback_id: Column) -> Column:
    """D1 key: the bare URL, else the id, else null (a row without key is never a duplicate)."""
    bare, own = bare_url(url), strip(feedback_id)
    return F.when(bare != "", F.concat(F.lit("url::"), bare)).when(
        own != "", F.concat(F.lit("id::"), own)
    )
