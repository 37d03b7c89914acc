from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from telemill import prepare_session  # noqa: E402


def local_session() -> SparkSession:
    folder = tempfile.mkdtemp(prefix="telemill-tests-")
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("telemill-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare_session(spark)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return local_session()
