import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = os.environ.get("TABLEWISE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .appName("tablewise-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture(scope="session")
def frame(spark):
    """Eight companies with two text and three number columns."""
    rows = [
        (1, "Alder", "San Francisco", 1500, 86.0, 2015),
        (2, "Birch", "San Francisco", 500, 18.0, 2021),
        (3, "Cedar", "Paris", 150, 6.0, 2023),
        (4, "Dogwood", "Toronto", 400, 5.0, 2019),
        (5, "Elm", "Bangalore", 80, 0.5, 2023),
        (6, "Fir", "Bangalore", 120, 1.0, 2023),
        (7, "Ginkgo", "San Francisco", 1000, 14.0, 2016),
        (8, "Hazel", "New York", 300, 4.5, 2016),
    ]
    return spark.createDataFrame(
        rows,
        "record_seq long, company_name string, headquarters string, employees long,"
        " valuation_billion double, founded_year int",
    )
