"""Property checks on the derived flight table (sf0.001)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tarmac.operators.joins import reverse_pairs
from tarmac.plans import analyses as Q
from tarmac.plans import eda as E
from tarmac.sources.flights import prepare


def fl(spark):
    return prepare(spark, SF_SMALL).flights


def test_causes_sum_to_arrival_delay(spark):
    f = fl(spark)
    total = F.col("CarrierDelay") + F.col("WeatherDelay") + F.col("NASDelay") + F.col("SecurityDelay") + F.col(
        "LateAircraftDelay")
    assert f.filter(total != F.col("ArrDelay")).count() == 0
    assert f.filter(F.col("ArrDelay") < 15).count() == 0


def test_shares_and_rates_add_up(spark):
    f = fl(spark)
    assert abs(sum(r["pct_of_total_minutes"] for r in Q.q11_cause_totals(f).collect()) - 100) <= 0.05
    assert abs(sum(r["share_pct"] for r in E.eda_cause_share(f).collect()) - 100) <= 0.3
    for r in Q.q09_hour_risk(f).collect():  # whole minutes >= 15: the three buckets cover everything
        assert abs(r["major_delay_prob"] + r["mild_delay_prob"] + r["moderate_delay_prob"] - 100) <= 0.03


def test_reverse_pairs_symmetric(spark):
    g = fl(spark).groupBy("Origin", "Dest").agg(F.count(F.lit(1)).alias("n"))
    a = {(r["Origin"], r["Dest"]): (r["n_ab"], r["n_ba"]) for r in reverse_pairs(g, "Origin", "Dest", ["n"]).collect()}
    swapped = g.select(F.col("Dest").alias("Origin"), F.col("Origin").alias("Dest"), "n")
    b = {(r["Origin"], r["Dest"]): (r["n_ab"], r["n_ba"]) for r in
         reverse_pairs(swapped, "Origin", "Dest", ["n"]).collect()}
    assert a == {k: (v[0], v[1]) for k, v in a.items()}
    assert {k: v for k, v in b.items()} == {k: (v[1], v[0]) for k, v in a.items()}


def test_results_do_not_depend_on_partitioning(spark):
    f = fl(spark)
    for fn in (Q.q06_severity_profile, Q.q10_monthly_rolling, Q.q12_dominant_cause, Q.q07_volume_vs_delay):
        one = sorted(tuple(r) for r in fn(f.repartition(1)).collect())
        many = sorted(tuple(r) for r in fn(f.repartition(13, "Origin")).collect())
        assert one == many, fn.__name__


def test_iqr_filter_idempotent_under_fixed_bounds(spark):
    from tarmac.operators.clean import iqr_bounds, iqr_filter_with

    p = prepare(spark, SF_SMALL)
    once = iqr_filter_with(p.flights0, p.bounds, ["ArrDelay", "DepDelay"])
    twice = iqr_filter_with(once, p.bounds, ["ArrDelay", "DepDelay"])
    assert once.count() == twice.count() == p.flights.count()
    assert iqr_bounds(p.flights0, ["ArrDelay", "DepDelay"]).first() == p.bounds.first()


def test_approx_distinct_close_to_exact(spark):
    from tarmac.plans.scope import scope_total_airlines, scope_total_airports

    f = fl(spark)
    assert scope_total_airports(f, approx=True).first()[0] == scope_total_airports(f).first()[0]
    assert scope_total_airlines(f, approx=True).first()[0] == scope_total_airlines(f).first()[0]
