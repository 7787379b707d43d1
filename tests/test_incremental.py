"""Runs step by step: equal to full runs, untouched buckets stay as they are, failed runs are carried on."""

import os
import random

from pyspark.sql import functions as F

from vozmill.operators import dedupe, sets
from vozmill.plans.batch import classify
from vozmill.plans.incremental import IncrementalRun
from vozmill.plans.normalize import normalize_feedback
from vozmill.schemas import ANALYSIS_COLUMNS, FEEDBACK_COLUMNS
from vozmill.sources.snapshots import Snapshot, bucket_of

AS_OF = "2024-12-31 00:00:00"
SCHEMA = (
    "feedback_id string, source string, source_url string, author string, feedback_date string, raw_text string, "
    "status string, batch_seq int, row_ord bigint"
)
TEXTS = [
    "Atraso na entrega e nao recebi", "Adorei, excelente qualidade", "Toda empresa tem problema", "  curto ",
    "Produto com defeito e ferrugem", "Quero reembolso urgente agora",
]


def batch(spark, rng, n, keys):
    rows = []
    for i in range(n):
        k = rng.randrange(keys)
        rows.append((
            rng.choice(["", f"id{k}"]), rng.choice(["site_auto", "site_manual"]),
            rng.choice(["", f"https://x/{k}", f"https://x/{k}/"]), "Ana", rng.choice(["01/02/2024", "2024-02-01", ""]),
            rng.choice(TEXTS) + rng.choice(["", f" {k}"]), "", 0, i,
        ))
    return spark.createDataFrame(rows, SCHEMA)


def full_run(spark, batches, replies=None):
    """All batches merged one after the other, then everything normalized and classified."""
    merged = None
    for number, frame in enumerate(f for f in batches if not f.isEmpty()):
        rows = sets.align_schema(sets.fill_ids(frame), FEEDBACK_COLUMNS, keep=["batch_seq", "row_ord"])
        rows = rows.withColumn("batch_seq", F.lit(number))
        merged = dedupe.upsert_feedback(rows.limit(0) if merged is None else merged, rows)
        merged = spark.createDataFrame(merged.collect(), merged.schema)
    return classify(normalize_feedback(merged, AS_OF), replies, "Empresa")


def plain(df):
    columns = [*FEEDBACK_COLUMNS, "ingested_at", "batch_seq", "row_ord", *ANALYSIS_COLUMNS]
    return sorted((tuple(map(str, r)) for r in df.select(*columns).collect()))


def answers(spark, ids, theme):
    rows = [(i, '{"sentiment": "negative", "primary_theme": "%s"}' % theme) for i in ids]
    return spark.createDataFrame(rows, "feedback_id string, reply string")


def test_batches_equal_the_full_run(spark, tmp_path):
    rng = random.Random(1)
    batches = [batch(spark, rng, n, 12) for n in (30, 0, 12)]
    run = IncrementalRun(spark, str(tmp_path / "run"), buckets=7)
    for i, frame in enumerate(batches):
        before = run.merged.read().count()
        done = run.add(frame, AS_OF)
        assert done.version == i + 1 and done.added == max(0, run.merged.read().count() - before)
    assert plain(run.analyzed()) == plain(full_run(spark, batches))
    assert run.normalized().count() == run.analyzed().count()


def files(root):
    """Every data file with the time of its last change."""
    found = {}
    for folder, _, names in os.walk(root):
        found |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def test_only_touched_buckets_are_written(spark, tmp_path):
    run = IncrementalRun(spark, str(tmp_path / "run"), buckets=16)
    rows = [("", "site_manual", f"https://x/{k}", "Ana", "01/02/2024", f"Texto comprido numero {k}", "", 0, k) for k in range(200)]
    run.add(spark.createDataFrame(rows, SCHEMA), AS_OF)
    before = files(tmp_path / "run")
    index = {r["bucket"]: r["written"] for r in run.merged.index().collect()}
    assert len(index) == 16
    change = [("", "site_manual", "https://x/3/", "Ana", "01/02/2024", "Outro texto do caso 3", "", 0, 0)]
    done = run.add(spark.createDataFrame(change, SCHEMA), AS_OF)
    after = files(tmp_path / "run")
    assert {k: v for k, v in after.items() if k in before} == before
    assert len(done.merged_buckets) == 1 and len(done.analyzed_buckets) <= 2 and done.added == 0
    later = {r["bucket"]: r["written"] for r in run.merged.index().collect()}
    assert {b for b in later if later[b] != index[b]} == set(done.merged_buckets)
    new = [f for f in after if f not in before and "/data/" in f]
    assert {f.split("bucket=")[1].split("/")[0] for f in new if "/merged/" in f} == set(map(str, done.merged_buckets))
    texts = {r["raw_text"] for r in run.analyzed().collect()}
    assert len(texts) == 200 and "Outro texto do caso 3" in texts and "Texto comprido numero 3" not in texts
    assert run.merged.read(version=1).count() == 200  # older versions stay readable


def test_rows_analyzed_before_are_not_classified_again(spark, tmp_path, monkeypatch):
    from vozmill.plans import incremental

    rng = random.Random(5)
    seen = []

    def counted(frame, replies, brand):
        seen.append(frame.count())
        return classify(frame, replies, brand)

    monkeypatch.setattr(incremental, "classify", counted)
    run = IncrementalRun(spark, str(tmp_path / "run"), buckets=4)
    run.add(batch(spark, rng, 40, 400), AS_OF)
    run.add(batch(spark, rng, 2, 400), AS_OF)
    assert seen[0] > 5 and seen[1] <= 4


def test_new_replies_reach_old_rows(spark, tmp_path):
    rng = random.Random(6)
    first = batch(spark, rng, 25, 8)
    run = IncrementalRun(spark, str(tmp_path / "run"), buckets=5)
    run.add(first, AS_OF)
    ids = sorted({r["feedback_id"] for r in run.analyzed().collect()})[:2]
    new = answers(spark, ids, "preco_frete")
    done = run.add(first.limit(0), AS_OF, replies=new, new_replies=new)
    assert done.merged_buckets == [] and done.analyzed_buckets
    assert plain(run.analyzed()) == plain(full_run(spark, [first], new))
    assert run.analyzed().where("primary_theme = 'preco_frete' AND provider = 'model'").count() >= 2


def test_keys_and_digests_are_moved_in_place_of_texts(spark, tmp_path, monkeypatch):
    from vozmill.plans import incremental

    rng = random.Random(8)
    batches = [batch(spark, rng, n, 12) for n in (30, 20)]
    batches[0] = batches[0].withColumn("row_ord", F.when(F.col("row_ord") != 3, F.col("row_ord")))
    widths, dedupe_content = [], incremental.dedupe_content

    def seen(rows):
        widths.append(rows.agg(F.max(F.length("raw_text"))).first()[0])
        return dedupe_content(rows)

    monkeypatch.setattr(incremental, "dedupe_content", seen)
    run = IncrementalRun(spark, str(tmp_path / "run"), buckets=3)
    for frame in batches:
        run.add(frame, AS_OF)
    assert plain(run.analyzed()) == plain(full_run(spark, batches))
    assert widths == [64, 64]  # digests
    for version in (1, 2):
        folder = tmp_path / "run" / "changes" / str(version)
        texts = [f.name for f in folder.iterdir() if "raw_text" in spark.read.parquet(str(f)).columns]
        assert texts == ["came"]


def test_a_failed_run_is_carried_on(spark, tmp_path):
    rng = random.Random(7)
    batches = [batch(spark, rng, n, 10) for n in (20, 9, 6)]
    run = IncrementalRun(spark, str(tmp_path / "run"), buckets=6)
    run.add(batches[0], AS_OF)
    run.upsert(batches[1])  # ends here
    run = IncrementalRun(spark, str(tmp_path / "run"), buckets=6)
    assert run.resume(AS_OF) and not run.resume(AS_OF)
    run.upsert(batches[2])
    run.renormalize(AS_OF)  # ends here
    run.add(batches[0].limit(0), AS_OF)
    assert plain(run.analyzed()) == plain(full_run(spark, batches))


def test_an_uncommitted_version_does_not_count(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path / "t"), spark.range(0).schema, buckets=3)
    rows = spark.range(30).withColumn("bucket", bucket_of(F.col("id"), buckets=3))
    assert table.version() == 0 and table.read().count() == 0
    assert table.write(rows, [0, 1, 2], F.col("id")) == 1
    rows.limit(3).write.partitionBy("bucket").parquet(str(tmp_path / "t" / "data" / "written=2"))
    assert table.version() == 1 and table.read().count() == 30
    one = rows.where("bucket = 1 AND id < 10")
    assert table.write(one, [1]) == 2
    assert table.read().where("bucket = 1").count() == one.count() and table.read([1]).count() == one.count()
    assert table.write(one.limit(0), [1]) == 3
    assert sorted(r["bucket"] for r in table.index().collect()) == [0, 2]
    total = table.index().agg(F.sum("n_rows"), F.max("mark")).first()
    assert total[0] == table.read().count() and total[1] <= 29


def test_a_run_that_an_earlier_release_left_is_carried_on(spark, tmp_path, monkeypatch):
    from vozmill.plans import incremental

    rng = random.Random(9)
    batches = [batch(spark, rng, n, 8) for n in (20, 12)]
    run = IncrementalRun(spark, str(tmp_path / "run"), buckets=2)
    run.add(batches[0], AS_OF)
    run.upsert(batches[1])  # ends here
    came = spark.read.parquet(str(tmp_path / "run" / "changes" / "2" / "came"))
    went = run.merged.read(version=1).join(came.select("merge_key"), "merge_key", "left_semi")
    went.write.parquet(str(tmp_path / "run" / "changes" / "2" / "went"))
    monkeypatch.setattr(incremental, "path_exists", lambda spark, path: False)  # no list of keys
    assert run.resume(AS_OF)
    assert plain(run.analyzed()) == plain(full_run(spark, batches))
