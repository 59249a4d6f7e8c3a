import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    with tempfile.TemporaryDirectory(prefix="lodestone-tests-") as shared:
        conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{shared}", "spark.default.parallelism": "4"}
        session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()
