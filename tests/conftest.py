import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from vozmill.session import prepare

    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """values(expression, texts): the expression over a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(expression, texts):
        rows = [(i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "i int, x string")
        got = df.select("i", expression(F.col("x")).alias("y")).collect()
        return [r["y"] for r in sorted(got, key=lambda r: r["i"])]

    return run
