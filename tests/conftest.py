import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lanternfold.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", master="local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate an expression over a list of strings, results in input order."""
    from pyspark.sql import functions as F

    def run(build, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = df.select("i", build(F.col("t")).alias("v")).collect()
        return [r.v for r in sorted(rows, key=lambda r: r.i)]

    return run
