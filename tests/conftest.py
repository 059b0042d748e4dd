"""One session for all tests, and small draw tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def draws(spark):
    """80 draws: numbers ((7 i + 8 j) mod 49) + 1, the special number the least one that is not drawn."""
    rows = []
    for i in range(80):
        numbers = sorted({(7 * i + 8 * j) % 49 + 1 for j in range(6)})
        rows.append((i, str(100000000 + i), datetime.date(2020, 1, 1) + datetime.timedelta(3 * i), numbers, next(n for n in range(1, 50) if n not in numbers)))
    return spark.createDataFrame(rows, "draw_index long, draw_id string, draw_date date, numbers array<int>, special_number int")
