import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"

FLIGHT_SCHEMA = (
    "Month bigint, DepHour bigint, UniqueCarrier string, Origin string, Dest string, DepDelay double, "
    "ArrDelay double, CarrierDelay double, WeatherDelay double, NASDelay double, SecurityDelay double, "
    "LateAircraftDelay double"
)
FIELDS = [f.split()[0] for f in FLIGHT_SCHEMA.split(", ")]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("tarmac-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def flight(**kw):
    """One flight row with neutral defaults (causes add up to ArrDelay)."""
    row = {
        "Month": 1, "DepHour": 10, "UniqueCarrier": "AA", "Origin": "JFK", "Dest": "LAX",
        "DepDelay": 20.0, "ArrDelay": 20.0, "CarrierDelay": 20.0, "WeatherDelay": 0.0, "NASDelay": 0.0,
        "SecurityDelay": 0.0, "LateAircraftDelay": 0.0,
    }
    row.update(kw)
    return tuple(row[f] for f in FIELDS)


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([flight(**r) for r in rows], FLIGHT_SCHEMA)

    return make


def counted(df):
    """``df`` read through a counter, and how many times its rows have been read as a whole."""
    spark = df.sparkSession
    rows, seen = df.count(), spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), lambda: seen.value / rows
