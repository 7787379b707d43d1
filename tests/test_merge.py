"""Deduplication, merge and normalization: semantics, order independence, hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from vozmill.operators import dedupe, sets
from vozmill.plans.normalize import normalize_feedback
from vozmill.schemas import FEEDBACK_COLUMNS

AS_OF = "2024-12-31 00:00:00"
SCHEMA = "feedback_id string, source string, source_url string, raw_text string, batch_seq int, row_ord bigint"
BAD = "Toda empresa tem problema"


def table(spark, rows):
    return sets.align_schema(spark.createDataFrame(rows, SCHEMA), FEEDBACK_COLUMNS, keep=["batch_seq", "row_ord"])


def random_rows(rng, batch, n):
    rows = []
    for i in range(n):
        url = rng.choice(["", "", "https://x/1", "https://x/1/", " https://x/2", "https://x/3//"])
        rows.append((rng.choice(["a", "b", " "]), rng.choice(["site_auto", "site_manual"]), url, rng.choice([BAD, "bom texto"]), batch, i))
    return rows


def key(r):
    url = r[2].strip().rstrip("/")
    return ("url", url) if url else ("id", r[0].strip()) if r[0].strip() else ("row", r[4], r[5])


def last_clean(rows):
    """Reference semantics on tuples: last per key, then drop low quality rows."""
    last = {}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        last[key(r)] = r
    return [r for r in last.values() if not (r[1] == "site_auto" and r[3] == BAD)]


def plain(df):
    return sorted((r.feedback_id, r.source, r.source_url, r.raw_text, r.batch_seq, r.row_ord) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_upsert_equals_stepwise_merge(spark, seed):
    rng = random.Random(seed)
    old, new = random_rows(rng, 0, 30), random_rows(rng, 1, 30)
    want = sorted(last_clean(last_clean(old) + last_clean(new)))
    stored, incoming = table(spark, old), table(spark, new)
    assert plain(dedupe.upsert_feedback(stored, incoming)) == want
    counts = dedupe.upsert_added(stored, incoming).first()
    assert (counts.stored_rows, counts.merged_rows) == (len(last_clean(old)), len(want))
    assert counts.added == max(0, len(want) - len(last_clean(old)))
    clean = table(spark, last_clean(old)) if last_clean(old) else stored.limit(0)
    assert plain(dedupe.upsert_into_clean(clean, incoming)) == want
    shuffled = dedupe.upsert_feedback(stored.repartition(7), incoming.orderBy(F.rand(1)))
    assert plain(shuffled) == want


def test_upsert_is_idempotent_and_keys_are_unique(spark):
    rng = random.Random(9)
    rows = [r for r in random_rows(rng, 0, 50) if r[0].strip()]
    once = dedupe.upsert_feedback(table(spark, []).limit(0), table(spark, rows))
    twice = dedupe.upsert_feedback(once, table(spark, rows).withColumn("batch_seq", F.lit(0)))
    assert plain(once) == plain(twice)
    assert len({key(r) for r in plain(once)}) == once.count()


def test_rows_without_key_are_all_kept(spark):
    rows = [("", "site_manual", " ", f"texto {i}", 0, i) for i in range(5)]
    assert dedupe.dedupe_url(table(spark, rows)).count() == 5


def test_first_and_last(spark):
    rows = [("a", "s", "", f"t{i}", 0, i) for i in range(4)]
    assert [r.raw_text for r in dedupe.dedupe_id(table(spark, rows), "first").collect()] == ["t0"]
    assert [r.raw_text for r in dedupe.dedupe_id(table(spark, rows), "last").collect()] == ["t3"]


def hot_rows(spark, n):
    """A third of all rows share one URL, one source and one text."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.lit("").alias("feedback_id"),
        F.when(hot, "site_manual").otherwise("reviews").alias("source"),
        F.when(hot, "https://x/hot").otherwise(F.concat(F.lit("https://x/"), F.col("id"))).alias("source_url"),
        F.lit("").alias("author"), F.lit("01/02/2024").alias("feedback_date"),
        F.when(hot, "o mesmo texto quente").otherwise(F.concat(F.lit("texto numero "), F.col("id"))).alias("raw_text"),
        F.lit("").alias("initial_category"), F.lit("").alias("channel"), F.lit("").alias("status"),
        F.lit(0).alias("batch_seq"), F.col("id").alias("row_ord"),
    )


def test_hot_key_ships_one_row_per_task(spark):
    rows = hot_rows(spark, 60_000)
    merged = dedupe.dedupe_url(rows)
    assert merged.count() == 40_001
    assert merged.where("source_url = 'https://x/hot'").first().row_ord == 59_997
    assert normalize_feedback(rows, AS_OF).count() == 40_001
    upserted = dedupe.upsert_feedback(rows, rows.withColumn("batch_seq", F.lit(1)))
    assert upserted.count() == 40_001 and upserted.where("batch_seq = 0").count() == 0


def test_normalize_a_list_of_frames(spark):
    one = table(spark, [("", "b", "", "  texto repetido ", 0, 1), ("", "b", "", "curto", 0, 2)]).drop("batch_seq")
    two = table(spark, [("id9", "b", "", "texto repetido", 0, 0), ("id8", "a", "", "outro texto", 0, 1)]).drop("batch_seq")
    rows = normalize_feedback([one, two], AS_OF, sort=True).collect()
    assert [(r.source, r.raw_text, r.batch_seq) for r in rows] == [("a", "outro texto", 1), ("b", "texto repetido", 0)]
    assert all(len(r.feedback_id) in (3, 12) and r.feedback_date is None for r in rows)
    assert str(rows[0].ingested_at) == AS_OF


def test_fallback_and_alignment(spark):
    frame = table(spark, [("a", "s", "", "um texto", 0, 0)]).drop("batch_seq", "row_ord")
    none = sets.empty_feedback(spark)
    assert sets.fallback_source(none, frame).count() == 1
    assert sets.fallback_source(frame, frame.unionByName(frame)).count() == 1
    assert sets.align_schema(none.drop("author"), FEEDBACK_COLUMNS).columns == FEEDBACK_COLUMNS
    with pytest.raises(ValueError, match="title"):
        sets.require_columns(none, ["title", "source"], "input")


def test_equal_ids_of_different_rows_lose_nothing(spark):
    rows = [("x", "Ana", "um texto", 1), ("x", "Ana", "outro texto", 2), ("x", "Ana", "um texto", 3)]
    df = spark.createDataFrame(rows, "feedback_id string, author string, raw_text string, row_ord bigint")
    keys = [F.col("author"), F.col("raw_text")]
    first = dedupe.dedupe_columns(df, keys, "first", ["row_ord"])
    assert sorted(r.row_ord for r in first.collect()) == [1, 2]
    last = dedupe.dedupe_columns(df, keys, "last", ["row_ord"])
    assert sorted(r.row_ord for r in last.collect()) == [2, 3]
