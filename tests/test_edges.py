"""Hand-made edge fixtures (FIXTURES.md §4)."""

import math

from pyspark.sql import functions as F

from tarmac.operators.aggregates import corr_matrix
from tarmac.operators.clean import iqr_bounds, iqr_filter
from tarmac.operators.joins import reverse_pairs
from tarmac.plans import analyses as Q


def test_iqr_filter_is_inclusive(spark):
    vals = [float(v) for v in list(range(0, 11)) + [-1000, 1000]]
    df = spark.createDataFrame([(v, 0.0) for v in vals], "a double, b double")
    b = iqr_bounds(df, ["a"]).first()
    # quartiles of 13 values (linear interpolation): q1 = 2, q3 = 8 -> bounds -7 / 17
    assert (b["a_q1"], b["a_q3"], b["a_lower"], b["a_upper"]) == (2.0, 8.0, -7.0, 17.0)
    edge = spark.createDataFrame([(-7.0, 0.0), (17.0, 0.0), (17.01, 0.0)], "a double, b double")
    from tarmac.operators.clean import iqr_filter_with

    kept = sorted(r["a"] for r in iqr_filter_with(edge, iqr_bounds(df, ["a"]), ["a"]).collect())
    assert kept == [-7.0, 17.0]
    assert sorted(r["a"] for r in iqr_filter(df, ["a"]).collect()) == [float(v) for v in range(0, 11)]


def test_bucket_gaps_reproduced(frame):
    df = frame([{"ArrDelay": v} for v in (14.9, 15.0, 30.0, 30.5, 31.0, 60.0, 60.5)])
    r = Q.q06_severity_profile(df).first()
    assert r["total_flights"] == 7
    assert r["severe_delay_flights"] == 1  # 60.5
    assert r["mild_delay_rate"] == round(100 * 2 / 7, 2)  # 15, 30; 14.9 and 30.5 fall in no bucket
    assert r["moderate_delay_rate"] == round(100 * 2 / 7, 2)  # 31, 60


def test_momentum_gap_and_zero_change(frame):
    rows = []
    for month, avg in ((1, 40.0), (2, 40.0), (4, 29.99), (5, 40.0)):
        rows += [{"UniqueCarrier": "GAP", "Month": month, "ArrDelay": avg}] * 30
    rows += [{"UniqueCarrier": "ONE", "Month": 3, "ArrDelay": 50.0}] * 30
    rows += [{"UniqueCarrier": "FEW", "Month": 3, "ArrDelay": 50.0}] * 29  # below HAVING
    df = frame(rows)
    ch = {(r["airline"], r["Month"]): r for r in Q.q05_monthly_changes(df).collect()}
    assert ch[("GAP", 2)]["mom_change"] == 0.0 and ch[("GAP", 2)]["trend_label"] == "Slight Worsening"
    assert ch[("GAP", 4)]["prev_month_avg"] == 40.0  # month 3 absent: previous present month
    assert ch[("GAP", 4)]["trend_label"] == "Strong Improvement"  # -10.01
    assert ch[("GAP", 5)]["trend_label"] == "Strong Worsening"  # +10.01
    assert ("FEW", 3) not in ch
    mom = {r["airline"]: r for r in Q.q05_airline_momentum(df).collect()}
    assert set(mom) == {"GAP"}  # a single month has no change
    g = mom["GAP"]
    assert g["months_tracked"] == 3 and g["months_improved"] == 1 and g["months_worsened"] == 1


def test_dominant_cause_rank_ties(frame):
    rows = [
        # T1: tie at rank 1 -> no rank 2 -> dropped by the rank-1/rank-2 join
        {"UniqueCarrier": "T1", "ArrDelay": 20.0, "CarrierDelay": 10.0, "LateAircraftDelay": 10.0},
        # T2: tie at rank 2 -> two output rows
        {"UniqueCarrier": "T2", "ArrDelay": 40.0, "CarrierDelay": 20.0, "NASDelay": 10.0, "WeatherDelay": 10.0},
        # OK: clear ranking
        {"UniqueCarrier": "OK", "ArrDelay": 40.0, "CarrierDelay": 4.0, "LateAircraftDelay": 30.0, "NASDelay": 6.0},
    ]
    out = Q.q12_dominant_cause(frame(rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r["airline"], []).append(r)
    assert "T1" not in by
    assert len(by["T2"]) == 2 and {r["second_cause"] for r in by["T2"]} == {"NAS Delay", "Weather Delay"}
    ok = by["OK"][0]
    assert ok["dominant_cause"] == "Late Aircraft Delay" and ok["dominant_pct"] == "75.00%"
    assert ok["vs_network"] == "Follows Network Pattern" and ok["concentration_label"] == "Highly Concentrated"


def test_reverse_pairs(spark):
    df = spark.createDataFrame(
        [("A", "B", 10.0), ("B", "A", 12.0), ("C", "D", 5.0), ("E", "E", 1.0), ("F", "G", 7.0), ("G", "F", 7.0)],
        "o string, d string, v double")
    got = {(r["o"], r["d"]): (r["v_ab"], r["v_ba"]) for r in reverse_pairs(df, "o", "d", ["v"]).collect()}
    assert got == {("A", "B"): (10.0, 12.0), ("F", "G"): (7.0, 7.0)}


def test_route_symmetry_tie_goes_to_reverse(frame):
    df = frame([{"Origin": "F", "Dest": "G", "ArrDelay": 30.0}, {"Origin": "G", "Dest": "F", "ArrDelay": 30.0}])
    r = Q.q02_route_symmetry(df).first()
    assert r["worse_direction"] == "G → F" and r["symmetry_label"] == "Symmetric"


def test_recovery_having_threshold(frame):
    rows = [{"Origin": "A", "Dest": "B", "DepDelay": 40.0, "ArrDelay": 30.0}] * 50
    rows += [{"Origin": "C", "Dest": "D", "DepDelay": 20.0, "ArrDelay": 30.01}] * 49
    out = Q.q03_delay_recovery(frame(rows)).collect()
    assert {r["route"] for r in out} == {"A → B"}
    assert {r["category"] for r in out} == {"Best Recovering", "Worst Recovering"}  # one route in both halves
    assert out[0]["recovery_label"] == "Strong Recovery"


def test_stddev_of_single_row_is_null(frame):
    out = Q.q04_airline_consistency(frame([{"UniqueCarrier": "X"}]), min_flights=1).first()
    assert out["stddev_delay"] is None and out["consistency_label"] == "Inconsistent"


def test_cause_never_present_has_null_mean(frame):
    df = frame([{"ArrDelay": 20.0, "CarrierDelay": 20.0}] * 3)
    got = {r["delay_cause"]: r for r in Q.q11_cause_totals(df).collect()}
    assert got["Security Delay"]["avg_when_present"] is None
    assert got["Security Delay"]["severity_rank"] == 1  # NULL sorts first under DESC, as in the reference's SQL
    assert got["Carrier Delay"]["pct_of_total_minutes"] == 100.0


def test_ground_ops_rank_literal_quirk(frame):
    rows = [{"Origin": "HUB", "DepDelay": 50.0, "ArrDelay": 20.0}] * 3 + [
        {"Origin": "X", "DepDelay": 10.0, "ArrDelay": 40.0}] * 3
    fixed = {r["airport"]: r for r in Q.q08_dep_arr_profile(frame(rows), min_flights=1).collect()}
    assert fixed["HUB"]["delay_profile"].endswith("Ground Ops Problem") and fixed["HUB"]["ground_ops_rank"] == 1
    lit = Q.q08_dep_arr_profile(frame(rows), min_flights=1, literal=True).collect()
    assert all(r["ground_ops_rank"] is None for r in lit)


def test_corr_matrix_pairwise_complete_matches_pandas(spark):
    import pandas as pd

    data = [(1.0, 2.0, None), (2.0, 4.5, 1.0), (3.0, 5.0, 3.0), (4.0, None, 2.0), (5.0, 9.0, 8.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(df, ["a", "b", "c"], scale=6).collect()}
    ref = pd.DataFrame(data, columns=["a", "b", "c"]).corr()
    for x in "abc":
        for y in "abc":
            assert math.isclose(got[(x, y)], round(ref.loc[x, y], 6), abs_tol=1e-6)


def test_nan_is_not_silently_averaged(spark):
    from tarmac.functions.numeric import nan_to_null

    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert df.agg(F.avg(nan_to_null("x"))).first()[0] == 2.0
