"""One session for all tests."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from inkwell.session import builder, enable


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    s = (
        builder().master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return enable(s)
