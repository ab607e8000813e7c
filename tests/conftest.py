import logging
import os
import sys

import pytest

logging.getLogger("DataFrameQueryContextLogger").disabled = True
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aerolens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one_row(spark):
    return spark.range(1)


@pytest.fixture
def make_series(spark):
    """Hourly rows with gaps and nulls for several stations, one of them much longer."""
    import datetime as dt
    import random

    def make(sizes, seed=1, null_share=0.3):
        rng, rows = random.Random(seed), []
        for station, n in sizes.items():
            at = dt.datetime(2023, 1, 1)
            for _ in range(n):
                at += dt.timedelta(hours=rng.choice([1, 1, 1, 2, 40]))
                values = [None if rng.random() < null_share else round(rng.uniform(0, 300), 2) for _ in range(2)]
                rows.append((station, at, *values))
        return spark.createDataFrame(rows, "station_id string, timestamp timestamp_ntz, aqi double, pm25 double")
    return make
