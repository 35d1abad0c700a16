import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", os.path.join(folder, "shared"))
        .config("spark.sql.warehouse.dir", os.path.join(folder, "warehouse"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
