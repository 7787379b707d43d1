"""P2 step by step: a batch changes only the buckets that hold its keys and contents.

Three snapshots follow each other. ``merged`` has one row per merge key, in buckets by key.
``candidates`` has all its rows in normalized form, in buckets by content, since rows of equal
content are deduplicated there. ``analyzed`` has the first row of every content with its labels, in
the same buckets. A batch gives a set of changes: the rows that come new and those they
replace. Only buckets of changed keys are merged again, only buckets of changed contents are
deduplicated again, and only rows that were not analyzed before, or have a new reply, are
classified. The result equals a full run over all batches; ``ingested_at`` alone stays the time of
the run in which a row came.

Which rows go, stay or are new is found on keys and digests alone, written once as lists of keys; whole rows
are read where they are kept or classified. Of the rows that stay and those that go, the shorter list is joined to the
whole rows.

Every run writes one version of each snapshot. Where a run ended between two of them, the
next one first carries the stored changes on.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vozmill.operators.dedupe import dedupe_content, dedupe_url, drop_low_quality, with_merge_key
from vozmill.operators.sets import align_schema, fill_ids
from vozmill.plans.batch import classify
from vozmill.plans.normalize import normalize_rows
from vozmill.schemas import (
    ANALYZED_SCHEMA, FEEDBACK_COLUMNS, FEEDBACK_SCHEMA, NORMALIZED_SCHEMA, ORDER_COLUMNS, ORDER_FIELDS,
)
from vozmill.sources.readers import path_exists
from vozmill.sources.snapshots import BUCKETS, Snapshot, bucket_of

_C = F.col
KEY = T.StructField("merge_key", T.StringType())
MERGED = T.StructType([*FEEDBACK_SCHEMA.fields, *ORDER_FIELDS, KEY])
CANDIDATES = T.StructType([*NORMALIZED_SCHEMA.fields, *ORDER_FIELDS, KEY])
ANALYZED = T.StructType([*ANALYZED_SCHEMA.fields, *ORDER_FIELDS, KEY])


@dataclass
class Increment:
    """What a batch did: versions, buckets written again, rows added to the merged table."""

    version: int
    merged_buckets: list[int]
    analyzed_buckets: list[int]
    added: int


class IncrementalRun:
    """The snapshots below ``root`` and their changes; ``analyzed()`` is the current result."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, auto_source: str = "site_auto"):
        self.spark, self.root, self.buckets, self.auto_source = spark, root.rstrip("/"), buckets, auto_source
        self.merged = Snapshot(spark, f"{self.root}/merged", MERGED, buckets)
        self.candidates = Snapshot(spark, f"{self.root}/candidates", CANDIDATES, buckets)
        self.labelled = Snapshot(spark, f"{self.root}/analyzed", ANALYZED, buckets)

    def analyzed(self) -> DataFrame:
        return self.labelled.read().drop("bucket", KEY.name)

    def normalized(self) -> DataFrame:
        return self.labelled.read().select(*[f.name for f in NORMALIZED_SCHEMA.fields], *ORDER_COLUMNS)

    def upsert(self, incoming: DataFrame) -> tuple[list[int], int]:
        """The batch into ``merged``. Returns the touched buckets and the number of rows added.

        The rows that came and those that went are stored as the changes of the new version.
        Batch numbers continue after the stored ones.
        """
        index = self.merged.index()
        last, before = index.agg(F.coalesce(F.max("mark"), F.lit(-1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
        rows = align_schema(fill_ids(incoming), FEEDBACK_COLUMNS, keep=ORDER_COLUMNS)
        rows = rows.withColumn("batch_seq", (_C("batch_seq") + F.lit(last) + 1).cast("int"))
        fresh = with_merge_key(drop_low_quality(dedupe_url(rows), self.auto_source), ORDER_COLUMNS, KEY.name)
        fresh = fresh.withColumn("bucket", bucket_of(_C(KEY.name), buckets=self.buckets))
        folder = self._changes(self.merged.version() + 1)
        fresh = _written(fresh, f"{folder}/came")
        touched = _buckets(fresh)
        stored = self.merged.read(touched)
        keys = fresh.select(KEY.name)
        # The time of the run plays no part in the place of a row.
        gone = self._placed(stored, "1970-01-01 00:00:00").select(KEY.name, "bucket").join(keys, KEY.name, "left_semi")
        _written(gone, f"{folder}/gone")
        kept = _without(stored, keys, [KEY.name], f"{folder}/merged")
        self.merged.write(kept.unionByName(fresh.select(kept.columns)), touched, _C("batch_seq").cast("bigint"))
        after = self.merged.index().agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        return touched, max(0, after - before)

    def _changes(self, version: int) -> str:
        return f"{self.root}/changes/{version}"

    def _changed(self, version: int, as_of) -> tuple[DataFrame, DataFrame, list[int]]:
        """P1 for the rows that came and went with a version, and the buckets of their contents."""
        bucket, folder = T.StructField("bucket", T.IntegerType()), self._changes(version)
        full = self.spark.read.schema(T.StructType([*MERGED.fields, bucket]))
        came = self._placed(full.parquet(f"{folder}/came"), as_of)
        if path_exists(self.spark, f"{folder}/gone"):
            gone = self.spark.read.schema(T.StructType([KEY, bucket])).parquet(f"{folder}/gone")
        else:  # an earlier release wrote the whole rows
            gone = self._placed(full.parquet(f"{folder}/went"), as_of).select(KEY.name, "bucket")
        return came, gone, _buckets(came.select("bucket").union(gone.select("bucket")))

    def _placed(self, rows: DataFrame, as_of) -> DataFrame:
        """P1 row by row, with the merge key and the bucket of the content."""
        keyed = with_merge_key(normalize_rows(rows, as_of), ORDER_COLUMNS, KEY.name)
        return keyed.withColumn("bucket", bucket_of(*_content(), buckets=self.buckets))

    def renormalize(self, as_of) -> None:
        """``candidates`` with the changes of the newest merged version."""
        version = self.merged.version()
        came, gone, touched = self._changed(version, as_of)
        kept = _without(self.candidates.read(touched), gone.select(KEY.name), [KEY.name], f"{self._changes(version)}/candidates")
        self.candidates.write(kept.unionByName(came.select(kept.columns)), touched)

    def reanalyze(
        self, as_of, replies: DataFrame | None, new_replies: DataFrame | None = None, brand: str = "Empresa"
    ) -> list[int]:
        """Labels of the first row of every touched content; rows analyzed before are kept as they are.

        ``replies`` holds the replies of all rows that may need labels, ``new_replies`` those that
        came since the last run: rows with such an id are classified again. Returns the touched buckets.
        """
        version = self.merged.version()
        touched = self._changed(version, as_of)[2]
        if new_replies is not None:
            narrow = self.candidates.read().select("feedback_id", "bucket")
            answered = narrow.join(new_replies.select("feedback_id"), "feedback_id", "left_semi")
            touched = sorted(set(touched) | set(_buckets(answered)))
        rows, known = self.candidates.read(touched), self.labelled.read(touched)
        if new_replies is not None:
            known = known.join(new_replies.select("feedback_id"), "feedback_id", "left_anti")
        place, folder = [KEY.name, *ORDER_COLUMNS], self._changes(version)
        # Contents are compared by a digest of 256 bits, so no text is moved to find the first rows.
        digests = rows.select(*place, "source", "feedback_date", F.sha2("raw_text", 256).alias("raw_text"))
        chosen = _written(dedupe_content(digests).select(*place), f"{folder}/chosen")
        before = _written(known.select(*place), f"{folder}/known")
        dropped = _written(before.join(chosen, place, "left_anti"), f"{folder}/dropped")
        kept = _without(known, dropped, place, f"{folder}/labelled")
        fresh = _written(chosen.join(before, place, "left_anti"), f"{folder}/fresh")
        fresh = _matched(rows, fresh, place, "left_semi")
        done = classify(fresh, replies, brand)
        self.labelled.write(kept.unionByName(done.select(kept.columns)), touched)
        return touched

    def resume(self, as_of, replies: DataFrame | None = None, brand: str = "Empresa") -> bool:
        """Carry on a run that ended after its merge; true if there was one."""
        version = self.merged.version()
        behind = [t for t in (self.candidates, self.labelled) if t.version() < version]
        if self.candidates in behind:
            self.renormalize(as_of)
        if self.labelled in behind:
            self.reanalyze(as_of, replies, brand=brand)
        return bool(behind)

    def add(
        self, incoming: DataFrame, as_of, replies: DataFrame | None = None, new_replies: DataFrame | None = None,
        brand: str = "Empresa",
    ) -> Increment:
        """One run: the batch (feedback columns, batch_seq, row_ord) through all three snapshots."""
        self.resume(as_of, replies, brand)
        merged_buckets, added = self.upsert(incoming)
        self.renormalize(as_of)
        touched = self.reanalyze(as_of, replies, new_replies, brand)
        return Increment(self.merged.version(), merged_buckets, touched, added)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # a failed run may have left one
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _without(rows: DataFrame, gone: DataFrame, key: list[str], path: str) -> DataFrame:
    """The rows without those of some keys; the shorter list, of what stays or of what goes, is joined to the whole rows."""
    stay = _written(_matched(rows.select(*key), gone, key, "left_anti"), path)
    if stay.count() < gone.count():
        return _matched(rows, stay, key, "left_semi")
    return _matched(rows, gone, key, "left_anti")


def _matched(rows: DataFrame, keys: DataFrame, key: list[str], how: str) -> DataFrame:
    """A semi or anti join that takes nulls as equal."""
    listed = keys.select(*[_C(c).alias(f"_of_{c}") for c in key])
    return rows.join(listed, reduce(lambda a, b: a & b, [_C(c).eqNullSafe(_C(f"_of_{c}")) for c in key]), how)


def _content() -> list[Column]:
    return [_C(c) for c in ("source", "feedback_date", "raw_text")]


def _buckets(rows: DataFrame) -> list[int]:
    """The buckets in use; there are no more than the table has."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
