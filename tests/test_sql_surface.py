"""The SQL statements against the DataFrame analyses on data with NULLs, and the SQL functions."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, counted
from tarmac.functions import labels as L
from tarmac.plans import analyses as Q
from tarmac.plans import scope as D
from tarmac.plans import spark_sql as S
from tarmac.sources.flights import prepare

CAUSES = ["CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"]


def direct(key):
    return getattr(Q, key, None) or getattr(D, key)


@pytest.fixture(scope="module")
def odd_flights(spark):
    """NULL delays and months, a carrier without cause minutes, one without delays, and one with a single flight."""
    f = prepare(spark, "/root/testdata/sf0.01").flights
    h = F.pmod(F.xxhash64(*f.columns), F.lit(60))
    some = lambda c, k: F.when(h == k, None).otherwise(F.col(c)).alias(c)
    no_cause = lambda c: F.when(F.col("UniqueCarrier") == "C03", 0.0).otherwise(some(c, 5)).alias(c)
    delay = lambda c, k: F.when(F.col("UniqueCarrier") == "C04", None).otherwise(some(c, k)).alias(c)
    odd = f.select(some("Month", 1), some("DepHour", 2), "UniqueCarrier", "Origin", "Dest", delay("DepDelay", 3), delay("ArrDelay", 4), *map(no_cause, CAUSES))
    one = spark.createDataFrame([(3, 7, "ZZ", "AAA", "BBB", 1.0, 20.0, None, 0.0, 3.0, None, 1.0)], f.schema)
    return odd.union(one).select(*f.columns)


@pytest.mark.parametrize("key", sorted(S.STATEMENTS))
def test_statement_equals_the_dataframe(spark, odd_flights, key):
    S.register(spark, odd_flights, "airline_delays")
    got, want = S.run(spark, key), direct(key)(odd_flights)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_functions_equal_the_column_functions(spark):
    names = S.register_functions(spark)
    assert len(names) == len(set(names)) > 4
    df = spark.range(-1, 27).select(F.when(F.col("id") >= 0, F.col("id")).alias("x"))
    df.createOrReplaceTempView("some_numbers")
    got = spark.sql("SELECT tarmac_month_name(x), tarmac_season(x), tarmac_time_of_day(x), tarmac_route('A', CAST(x AS STRING)), tarmac_r2(x / 8), tarmac_hhmm_hour(x * 100 + 59) FROM some_numbers")
    from tarmac.functions.numeric import hhmm_hour, r2

    x = F.col("x")
    want = df.select(L.month_name(x), L.season(x), L.time_of_day(x), L.route(F.lit("A"), x.cast("string")), r2(x / 8), hhmm_hour(x * 100 + 59))
    assert list(map(tuple, got.collect())) == list(map(tuple, want.collect()))


@pytest.mark.parametrize("key", sorted(S.STATEMENTS | S.FORMS))
def test_statement_reads_the_facts_once(spark, key):
    """Also where a statement names the aggregate twice; and it joins nothing to the facts."""
    whole, passes = counted(prepare(spark, SF_SMALL).flights)
    S.register(spark, whole, "airline_delays")
    S.register_functions(spark)
    df = S.run(spark, key)
    assert df.collect() and passes() == 1
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
