import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from timedframe.operators.ordered import GROUP_LIMIT_CONF  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(params=["one window", "split groups"])
def grouping(request, spark):
    """Run a test with plain windows and again with every group counted as too large for a task."""
    if request.param == "split groups":
        spark.conf.set(GROUP_LIMIT_CONF, "7")
    yield request.param
    spark.conf.unset(GROUP_LIMIT_CONF)
