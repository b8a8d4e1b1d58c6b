import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from check import session

    return session()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(small_dir):
    from check import database

    return database(small_dir)


@pytest.fixture
def readings(spark):
    """``[(meter, seq, ts, kw), ...]`` to a DataFrame."""

    def make(rows):
        df = spark.createDataFrame(rows, "meter_id STRING, seq BIGINT, ts STRING, active_power_kw DOUBLE")
        return df.selectExpr("meter_id", "timestamp(ts) AS ts", "seq", "active_power_kw")

    return make


@pytest.fixture
def series(spark):
    """``{meter: [values]}`` from 2024-01-01 on, one row per day."""

    def make(values, start="2024-01-01"):
        rows = [(m, i, float(v)) for m, vs in values.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "meter_id STRING, i INT, kwh DOUBLE")
        return df.selectExpr("meter_id", f"date_add(date'{start}', i) AS day", "kwh")

    return make
