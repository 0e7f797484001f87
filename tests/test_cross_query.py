"""Cross-query validation: the single-scan marts must agree with the
stand-alone analyses they combine (same carrier / airport / route values)."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tarmac.plans import analyses as Q
from tarmac.plans import marts as M
from tarmac.sources.flights import prepare

SF = "/root/testdata/sf0.01"


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_airline_performance_matches_analyses(spark):
    f = prepare(spark, SF).flights
    mart = rows(M.mart_airline_performance(f), "airline")
    sev, con = rows(Q.q06_severity_profile(f), "airline"), rows(Q.q04_airline_consistency(f), "airline")
    mom, dom = rows(Q.q05_airline_momentum(f), "airline"), rows(Q.q12_dominant_cause(f), "airline")
    assert set(mart) == set(sev)
    for a, m in mart.items():
        for c in ("total_flights", "avg_delay", "severity_rank", "severe_delay_rate", "severity_profile"):
            assert m[c] == sev[a][c], (a, c)
        for src, cols in ((con, ("consistency_rank", "stddev_delay", "consistency_label", "performance_profile")),
                          (mom, ("avg_mom_change", "overall_trend")),
                          (dom, ("dominant_cause", "dominant_pct", "concentration_label"))):
            for c in cols:
                assert m[c] == (src[a][c] if a in src else None), (a, c)


def test_airport_profiles_match_analyses(spark):
    f = prepare(spark, SF).flights
    mart = rows(M.mart_airport_profiles(f), "airport")
    vol, prof = rows(Q.q07_volume_vs_delay(f, top=None), "airport"), rows(Q.q08_dep_arr_profile(f), "airport")
    assert set(mart) == set(vol) & set(prof)
    for a, m in mart.items():
        for c in ("volume_rank", "total_flights", "avg_delay", "delay_rank", "airport_profile"):
            assert m[c] == vol[a][c]
        for c in ("avg_dep_delay", "avg_arr_delay", "dep_vs_global", "delay_profile"):
            assert m[c] == prof[a][c]
        assert m["avg_delay"] == prof[a]["avg_arr_delay"]  # same origin-side mean in both analyses


def test_routes_match_analyses(spark):
    f = prepare(spark, SF).flights
    mart = M.mart_routes(f)
    q1 = {(r["route"], r["overall_avg_delay"], r["months_in_top10"]) for r in Q.q01_repeat_worst_routes(f).collect()}
    q3 = {(r["route"], r["category"], r["avg_recovery"]) for r in Q.q03_delay_recovery(f).collect()}
    got1 = {(r["route"], r["value"], r["months_in_top10"]) for r in mart.filter("list_name = 'Repeat Worst'").collect()}
    got3 = {(r["route"], r["list_name"], r["value"]) for r in mart.filter("list_name <> 'Repeat Worst'").collect()}
    assert got1 == q1 and got3 == q3


def test_kpis_match_analyses(spark):
    f = prepare(spark, SF_SMALL).flights
    kpi = {r["metric"]: r["value"] for r in M.mart_kpi(f).collect()}
    monthly = Q.q10_monthly_rolling(f).collect()
    assert float(kpi["avg_arrival_delay"]) == monthly[-1]["cumulative_avg"] or len(monthly) < 12
    best = min(monthly, key=lambda r: (r["avg_arr_delay"], r["Month"]))
    assert kpi["best_month"] == best["month_name"]
    shares = {r["delay_cause"]: r["pct_of_total_minutes"] for r in Q.q11_cause_totals(f).collect()}
    assert float(kpi["controllable_pct"]) == round(shares["Late Aircraft Delay"] + shares["Carrier Delay"], 2)
    assert int(kpi["total_flights"]) == f.count()
    carriers = f.groupBy("UniqueCarrier").agg(F.avg("ArrDelay").alias("a")).collect()
    assert kpi["most_delayed_airline"] == max(carriers, key=lambda r: (round(r["a"], 2), r["UniqueCarrier"]))[0]
