"""License scan by diagonal voting.

All rolling word pairs of a text are joined by hash with those of the templates; a match votes
for its diagonal, the place in the text less that in the template. Long templates count runs
of three words (the pair finds them, the join condition compares the words). Votes are summed per
diagonal, neighbouring diagonals (words added or left out) merge, and of the merged votes the
window of about the template's length that covers most of its words is verified. A base phrase counts
where all its pairs vote on one exact diagonal, that is, where its words stand consecutively.

The templates are the only small side of the join: their size is fixed by the caller and checked.
Text words stay in their row: pairs whose hash no template has are left out there, and the others
leave it with the few words from their place on, so the work grows with the length of a text.

Null and empty texts have no words and no labels. Rows that repeat an id and text count once
for the matches and are returned as often as they came. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vozmill.llm.common import stored

_C = F.col
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (phrase, label).
BASE = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: (label, text), texts of public licenses and of the notices that point to them.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
)
MOST_WORDS = 100_000


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _LOWER + " " * len(_SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _template_grams(spark, base, templates, gap: int, covered: float) -> DataFrame:
    """(template, label, kind, at, gram, width, words, span, most): each run of two or three words of each template.

    A copy of the template lies within ``span`` words; so many hold ``most`` runs of it at most.
    """
    rows = []
    for n, (label, text, width) in enumerate(
        [(label, phrase, 2) for phrase, label in base] + [(label, text, 3) for label, text in templates]
    ):
        split = text.lower().split()
        width = min(width, len(split))
        runs = [split[at : at + width] for at in range(len(split) - width + 1)]
        span = len(split) + math.ceil(len(split) * (1 - covered)) + gap + 1
        most = span * max(map(runs.count, runs), default=1)
        for at, run in enumerate(runs):
            rows.append((n, label, width == 2 and n < len(base), at, run, width, len(split), span, most))
    if sum(r[5] for r in rows) > MOST_WORDS:
        raise ValueError(f"templates hold more than {MOST_WORDS} words")
    schema = (
        "template int, label string, base boolean, at int, gram array<string>, width int, words int, span int, most int"
    )
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64(F.get("gram", F.lit(0)), F.get("gram", F.lit(1))))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    base: tuple = BASE, templates: tuple = TEMPLATES, gap: int = 3, covered: float = 0.75,
) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row."""
    spark = docs.sparkSession
    # Fixed number of rows, checked above.
    grams = _template_grams(spark, base, templates, gap, covered)
    known = [r["hash"] for r in grams.select("hash").distinct().collect()]
    grams = F.broadcast(grams)
    rows = docs.select(
        _C(id_col).alias("id"), F.xxhash64(_C(text_col)).alias("text_hash"), tokens(_C(text_col)).alias("tokens")
    )
    n = F.size("tokens")
    def pair(i: Column) -> Column:
        return F.xxhash64(F.get(_C("tokens"), i), F.get(_C("tokens"), i + 1))

    matches = F.transform(
        F.filter(F.sequence(F.lit(0), n - 2), lambda i: pair(i).isin(known)),
        lambda i: F.struct(i.alias("place"), pair(i).alias("pair"), F.slice("tokens", i + 1, 3).alias("run")),
    )
    # A null pair first: it matches nothing and keeps one row for each text.
    kind = "struct<place:int,pair:bigint,run:array<string>>"
    none = F.struct(F.lit(-1).alias("place"), F.lit(None).alias("pair"), F.lit(None).alias("run")).cast(kind)
    found_pairs = F.concat(F.array(none), F.when(n >= 2, matches).otherwise(F.array()).cast(f"array<{kind}>"))
    # Counted before the pairs are dealt out: else every pair's row would carry all words of its text.
    counted = rows.withColumn("n_words", n.cast("long"))
    placed = counted.select("id", "text_hash", "n_words", F.inline(found_pairs))
    same = (_C("pair") == _C("hash")) & (F.slice("run", 1, _C("width")) == _C("gram"))
    kept = _C("template").isNotNull() | (_C("place") < 0)
    hits = stored(placed.join(grams, same, "left").where(kept).select(
        "id", "text_hash", "n_words", "place", "template", "label", "base", "at", "width", "words", "span", "most",
        (_C("place") - _C("at")).alias("diagonal"),
    ))
    key = ["id", "text_hash"]
    votes = hits.where(_C("base")).groupBy(
        *key, "template", "label", "words", "width", _C("diagonal").cast("long").alias("diagonal")
    ).agg(F.count_distinct("at").alias("n_ats"))
    exact = votes.where(_C("n_ats") == _C("words") - _C("width") + 1)
    based = exact.groupBy(*key).agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"),
        F.collect_set("label").alias("base_names"),
    )
    line = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.coalesce(_C("diagonal") - F.lag("diagonal").over(line) > gap, F.lit(True))
    merged = hits.where(~_C("base")).distinct().withColumn("new", apart.cast("int")).withColumn("cluster", F.sum("new").over(line))
    clusters = merged.groupBy(*key, "template", "label", "words", "width", "span", "most", "cluster").agg(
        F.array_sort(F.collect_list(F.struct("place", "at"))).alias("votes")
    )

    def covers(vote: Column, i: Column) -> Column:
        """Share of the template's words in the window that begins with a vote, and the window."""
        inside = F.filter(
            F.slice("votes", i + 1, _C("most")), lambda x: x["place"] + _C("width") <= vote["place"] + _C("span")
        )
        under = F.flatten(F.transform(inside, lambda x: F.sequence(x["at"], x["at"] + _C("width") - 1)))
        return F.struct(
            (F.size(F.array_distinct(under)) / _C("words")).alias("share"),
            (-vote["place"]).alias("before"),
            (F.array_max(F.transform(inside, lambda x: x["place"])) + _C("width")).alias("stop"),
        )

    best = clusters.withColumn("best", F.array_max(F.transform("votes", covers)))
    verified = best.select(
        *key, "label", _C("best.share").alias("share"), (-_C("best.before")).alias("start"), _C("best.stop").alias("stop")
    )
    sure = _C("share") >= covered
    found = verified.groupBy(*key).agg(
        F.max("share").alias("share"), F.collect_set(F.when(sure, _C("label"))).alias("names"),
        F.array_sort(F.collect_list(F.when(sure, F.struct("start", "stop", "label")))).alias("spans"),
    )
    documents = hits.where(_C("place") < 0).select(*key, "n_words")
    for side in (based, found):
        side = side.withColumnsRenamed({"id": "side_id", "text_hash": "side_hash"})
        documents = documents.join(
            side, documents["id"].eqNullSafe(side["side_id"]) & (documents["text_hash"] == side["side_hash"]), "left"
        ).drop("side_id", "side_hash")
    no_names = F.array().cast("array<string>")
    of_base = F.coalesce("base_names", no_names)
    return documents.select(
        _C("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word", "last_word",
        F.array_join(F.array_sort(of_base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(of_base, F.coalesce("names", no_names))), ",").alias("labels"),
        F.when(_C("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), "spans",
    )
