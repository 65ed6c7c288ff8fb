import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cityweave.sources.readers import ready
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "6g").config("spark.log.level", "ERROR")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cityweave-test-")).getOrCreate())
    yield ready(s)
    s.stop()
