"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """UTC for dates and timestamps, the last of repeated JSON keys, this package on the workers.

    On a cluster the package usually comes with ``--py-files``; shipping it again is
    harmless. Done once per application.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="vozmill-zip-")
        archive = shutil.make_archive(
            os.path.join(folder, "vozmill"), "zip", os.path.dirname(package), os.path.basename(package)
        )
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
    return spark
