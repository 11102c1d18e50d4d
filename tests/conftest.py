import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from filelake.session import local_session
    s = local_session("*", shuffle_partitions=8, app="filelake-tests")
    yield s
    s.stop()


@pytest.fixture
def mk(spark):
    """Manifest from literal rows: (path, content[, extra columns...])."""
    from pyspark.sql import functions as F

    def build(rows, extra_schema: str = ""):
        schema = "path string, content string" + (", " + extra_schema if extra_schema else "")
        df = spark.createDataFrame(rows, schema)
        return (df.withColumn("size", F.octet_length("content").cast("bigint"))
                  .withColumn("md5", F.md5("content")).drop("content"))
    return build
