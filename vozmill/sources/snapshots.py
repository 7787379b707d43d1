"""Tables in buckets whose new versions rewrite only the buckets that change.

A version is a row per bucket in ``index/version=V``: which version wrote the bucket, how many
rows it has and its largest mark. The rows lie in ``data/written=W/bucket=B``. A version counts
once its index is committed, so a run that fails leaves the table as it was, and the next one
writes over what it left. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vozmill.sources.readers import path_exists

_C = F.col
BUCKETS = 64
_INDEX = "bucket int, written int, n_rows long, mark long"


def bucket_of(*key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """V of all ``name=V`` below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    found = [status.getPath().getName() for status in system.listStatus(path)]
    return sorted(int(n.split("=", 1)[1]) for n in found if n.startswith(f"{name}="))


class Snapshot:
    """The table below ``root``; ``buckets`` is fixed when the first version is written."""

    def __init__(self, spark: SparkSession, root: str, schema, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        folder = f"{self.root}/index"
        committed = [
            v for v in _numbers(self.spark, folder, "version")
            if path_exists(self.spark, f"{folder}/version={v}/_SUCCESS")
        ]
        return max(committed, default=0)

    def index(self, version: int | None = None) -> DataFrame:
        """(bucket, written, n_rows, mark) of a version: a row per bucket that holds rows."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _INDEX)
        return self.spark.read.schema(_INDEX).parquet(f"{self.root}/index/version={version}")

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version with their ``bucket``, all or those of some buckets."""
        entries = self.index(version).collect()  # bounded by the number of buckets
        known = {r["bucket"]: r["written"] for r in entries}
        chosen = sorted(known if buckets is None else set(known) & set(buckets))
        paths = [f"{self.root}/data/written={known[b]}/bucket={b}" for b in chosen]
        columns = [f.name for f in self.schema.fields]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
        full = self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0)).schema
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*paths)
        return rows.select(*columns, "bucket")

    def write(self, rows: DataFrame, touched: list[int], mark: Column | None = None) -> int:
        """A new version: ``rows`` (with ``bucket``) replace the touched buckets, the others stay.

        ``mark`` is a bigint of a row; the index keeps its largest value of every bucket.
        """
        before = self.version()
        new = before + 1
        data = f"{self.root}/data/written={new}"
        columns = [f.name for f in self.schema.fields]
        # Adaptive execution splits a large bucket over several files and packs small ones.
        # A failed run may have left files under this number; no index names them.
        packed = rows.select(*columns, "bucket").hint("rebalance", "bucket")
        packed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(data)
        full = self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0)).schema
        counts = self.spark.read.schema(full).parquet(data).groupBy("bucket").agg(
            F.lit(new).alias("written"), F.count("*").alias("n_rows"),
            F.max(F.lit(None).cast("bigint") if mark is None else mark).alias("mark"),
        )
        kept = self.index(before).where(~_C("bucket").isin(list(touched)) if touched else F.lit(True))
        index = kept.unionByName(counts).coalesce(1)
        index.write.mode("overwrite").parquet(f"{self.root}/index/version={new}")
        return new
