"""Golden vectors: figures published by the reference, re-derived through
the same layers our analyses use."""

from pyspark.sql import functions as F

from tarmac.plans.analyses import cause_attribution, consistency_layer, monthly_layer

# G1: the twelve monthly means published with the monthly analysis.
G1_AVG = [50.52, 51.67, 49.96, 48.25, 47.92, 52.56, 51.94, 50.10, 48.09, 45.60, 50.36, 52.92]
G1_ROLLING = [50.52, 51.10, 50.72, 49.96, 48.71, 49.58, 50.81, 51.53, 50.04, 47.93, 48.02, 49.63]
G1_MOM = [None, 1.15, -1.71, -1.71, -0.33, 4.64, -0.62, -1.84, -2.01, -2.49, 4.76, 2.56]
G1_CUM = [50.52, 51.10, 50.72, 50.10, 49.66, 50.15, 50.40, 50.37, 50.11, 49.66, 49.72, 49.99]
G1_VS = [0.00, 0.58, -0.76, -1.85, -1.74, 2.41, 1.54, -0.27, -2.02, -4.06, 0.64, 2.93]


def test_g1_monthly_window_layer(spark):
    monthly = spark.createDataFrame(
        [(m, 1000, a, 30.0) for m, a in enumerate(G1_AVG, start=1)],
        "Month bigint, total_flights bigint, avg_arr_delay double, severe_rate double")
    rows = monthly_layer(monthly).orderBy("Month").collect()
    assert [r["rolling_3m_avg"] for r in rows] == G1_ROLLING
    assert [r["mom_change"] for r in rows] == G1_MOM
    assert [r["cumulative_avg"] for r in rows] == G1_CUM
    assert [r["vs_cumulative_avg"] for r in rows] == G1_VS
    assert {r["trend_position"] for r in rows} == {"On Trend"}
    assert rows[-1]["cumulative_avg"] == 49.99  # the headline "average arrival delay"
    assert rows[9]["month_name"] == "October" and rows[9]["season"] == "Fall"


# G2: cause minutes / flights over 1,153,046 rows.
G2 = [
    ("Late Aircraft Delay", 23654200.0, 639609, 36.98),
    ("Carrier Delay", 17417627.0, 614404, 28.35),
    ("NAS Delay", 14100842.0, 607452, 23.21),
    ("Weather Delay", 2877178.0, 85276, 33.74),
    ("Security Delay", 104552.0, 5900, 17.72),
]


def test_g2_cause_attribution_layer(spark):
    long = spark.createDataFrame(
        [(c, m, f, a, 100.0, 1153046) for c, m, f, a in G2],
        "delay_cause string, total_minutes double, flights_affected bigint, avg_when_present double, "
        "max_single_flight double, _rows bigint")
    got = {r["delay_cause"]: r for r in cause_attribution(long).collect()}
    la, ca, nas, wx, sec = (got[c] for c, *_ in G2)
    assert [x["pct_of_total_minutes"] for x in (la, ca, nas, wx, sec)] == [40.67, 29.95, 24.25, 4.95, 0.18]
    assert [x["pct_flights_affected"] for x in (la, ca, nas, wx, sec)] == [55.47, 53.29, 52.68, 7.40, 0.51]
    assert [(x["impact_rank"], x["breadth_rank"], x["severity_rank"]) for x in (la, ca, nas, wx, sec)] == [
        (1, 1, 1), (2, 2, 3), (3, 3, 4), (4, 4, 2), (5, 5, 5)]
    assert [x["impact_label"] for x in (la, ca, nas, wx, sec)] == [
        "Dominant Cause", "Major Cause", "Major Cause", "Minor Cause", "Minor Cause"]
    assert [x["spread_label"] for x in (la, ca, nas, wx, sec)] == [
        "Wide & Severe", "Wide but Mild", "Narrow & Mild", "Narrow but Severe", "Narrow & Mild"]
    assert round(la["pct_of_total_minutes"] + ca["pct_of_total_minutes"], 2) == 70.62


def test_g3_shares(spark):
    from tarmac.functions.numeric import rnd
    from tarmac.operators.windows import share_of_total

    means = [("CarrierDelay", 18.73), ("WeatherDelay", 3.63), ("NASDelay", 14.99), ("SecurityDelay", 0.09),
             ("LateAircraftDelay", 25.25)]
    df = spark.createDataFrame(means, "cause string, m double")
    got = {r["cause"]: r["s"] for r in df.select("cause", rnd(share_of_total("m"), 1).alias("s")).collect()}
    assert [got[c] for c, _ in means] == [29.9, 5.8, 23.9, 0.1, 40.3]


def test_g5_consistency_labels(spark):
    stats = spark.createDataFrame(
        [("AQ", 200, 37.51, 24.90), ("HA", 200, 38.34, 26.23), ("F9", 200, 39.85, 26.80),
         ("B6", 200, 57.00, 31.00), ("UA", 200, 52.00, 28.00)],
        "airline string, total_flights bigint, avg_delay double, stddev_delay double")
    got = {r["airline"]: r for r in consistency_layer(stats).collect()}
    for a in ("AQ", "HA", "F9"):
        assert got[a]["performance_profile"] == "Best Overall"
        assert got[a]["consistency_label"] == "Moderately Consistent"
    assert got["B6"]["consistency_label"] == "Inconsistent" and got["B6"]["performance_profile"] == "Standard"


def test_g4_severity(spark):
    from tarmac.functions import labels as L
    from tarmac.functions.labels import lbl
    from tarmac.functions.numeric import pct

    r = spark.range(1).select(pct(F.lit(12532), F.lit(33297)).alias("p")).select("p", lbl("p", L.SEVERITY).alias("l"))
    row = r.first()
    assert row["p"] == 37.64 and row["l"] == "High Severity"
