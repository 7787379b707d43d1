"""Bounded samples of labelled rows, to fit classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vozmill.llm.common import seeded

_C = F.col


def sampled_texts(texts: DataFrame, sample: DataFrame, class_col: str) -> DataFrame:
    """(id, text, class) of the sampled ids, one text per id (the one whose hash is smallest).

    ``texts``: id, text. ``sample`` has an id once and is bounded by the caller's ``rows``, so it goes to
    every task and the texts of all other rows stay where they are; repeats of an id are
    reduced in each task before they meet.
    """
    found = texts.join(F.broadcast(sample.select("id", class_col)), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), _C("text").alias("text"))).alias("one")
    return found.groupBy("id", class_col).agg(one).select("id", _C("one.text").alias("text"), class_col)


def sampled(labelled: DataFrame, id_col: str, class_col: str, rows: int, seed: int) -> tuple[DataFrame, dict]:
    """About ``rows / classes`` rows of each class (all, if there are fewer), and each class's rate.

    Rows are chosen by a seeded hash of their id, so reruns agree. The counts per class, one
    row each, are all that reaches the driver.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(class_col).count().orderBy(class_col).collect()}
    share = max(rows // max(len(counts), 1), 1)
    rates = {k: min(1.0, share / n) for k, n in counts.items()}
    if not counts:
        return labelled, {}
    rate = F.create_map(*[F.lit(x) for k, r in rates.items() for x in (k, r)])[_C(class_col)]
    drawn = F.pmod(seeded(seed, _C(id_col)), F.lit(1_000_003)) / F.lit(1_000_003.0) < rate
    return labelled.where(drawn).limit(2 * rows), rates
