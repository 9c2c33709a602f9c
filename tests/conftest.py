import os
import sys

import pytest
from pyspark import SparkConf
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = SparkConf().get("spark.checkpoint.dir") or f"file://{tmp_path_factory.mktemp('shared')}"
    s = (
        SparkSession.builder.master("local[*]").appName("formloom-tests")
        .config("spark.checkpoint.dir", shared)
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
