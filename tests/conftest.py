import os
import pathlib
import sys

from pyspark.sql import SparkSession
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]"))
        .appName("poplineage-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.log.structuredLogging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


@pytest.fixture(scope="session")
def spark():
    return session()
