"""Shared pieces: tables in the shared folder, words, helpers for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as single characters.
SPACES = " \t\n\x0b\x0c\r"

_LOCAL: dict[str, str] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a temporary folder serves, but only if everything runs in
    one process; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="vozmill-work-")
        base = _LOCAL[application]
    return f"{base.rstrip('/')}/vozmill-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: int) -> DataFrame:
    """The table written once to the shared folder and read back: short lineage, no recomputation.

    ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_digest(text: Column) -> Column:
    """128 bits of a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def words(text: Column) -> Column:
    """Words between spaces and the characters 9 to 13; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def seeded(seed: int, *columns: Column) -> Column:
    """A hash of 60 bits that any engine with md5 computes alike; null counts as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True if crc32 of the id as text leaves the remainder ``fold``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(text).cast(pa.large_binary())
        ends = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(lengths).to_pylist()])
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop
