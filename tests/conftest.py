import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def fruit(spark):
    """Four documents whose results are worked out by hand."""
    rows = [
        (1, "Apple banana apple"),
        (2, "banana cherry"),
        (3, "apple cherry cherry a"),
        (4, "apple durian"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def fruit_edges(spark):
    rows = [
        ("apple", "banana", 2),
        ("apple", "cherry", 2),
        ("apple", "durian", 1),
        ("banana", "cherry", 1),
    ]
    return spark.createDataFrame(rows, "src string, dst string, weight long")
