import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tidemark.session import ship_package

    ship_package(s)
    yield s


@pytest.fixture()
def small_chunks(spark):
    """Force tiny chunks so chunk borders, halos and the scan recursion are exercised."""
    from tidemark.session import CHUNK_CONF

    spark.conf.set(CHUNK_CONF, "7")
    yield 7
    spark.conf.unset(CHUNK_CONF)
