import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
_SHARED = tempfile.mkdtemp(prefix="quarry-tests-")
# made before the test modules are imported: they build columns at module level
_SPARK = (
    SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
    .config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.checkpoint.dir", f"{_SHARED}/shared").config("spark.sql.warehouse.dir", f"{_SHARED}/warehouse").getOrCreate()
)
_SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield _SPARK
    _SPARK.stop()


def one(spark, column, *values):
    """The value of a column over rows of strings s (and t)."""
    rows = spark.createDataFrame([tuple(v) if isinstance(v, tuple) else (v, None) for v in values], "s string, t string")
    return [r[0] for r in rows.coalesce(1).select(column).collect()]
