import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sarmotion.session import ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    ship_package(session)
    session.sparkContext.addPyFile(os.path.join(os.path.dirname(os.path.abspath(__file__)), "scenes.py"))
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate one column expression."""

    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
