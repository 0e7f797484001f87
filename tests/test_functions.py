from pyspark.sql import functions as F

from tarmac.functions import labels as L
from tarmac.functions.labels import lbl, month_name, route, season, time_of_day
from tarmac.functions.numeric import floor_div, hhmm_hour, pct, pct_text, r2


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_r2_half_away_from_zero_through_decimal(spark):
    # (50.52 + 51.67) / 2 = 51.095 is stored as 51.09499.. in binary; must round up.
    assert one(spark, r2((F.lit(50.52) + F.lit(51.67)) / 2)) == 51.10
    assert one(spark, r2(F.lit(1.005))) == 1.01
    assert one(spark, r2(F.lit(-2.345))) == -2.35
    assert one(spark, r2(F.lit(49.987))) == 49.99


def test_pct_and_text(spark):
    assert one(spark, pct(F.lit(12532), F.lit(33297))) == 37.64  # G4
    assert one(spark, pct(F.lit(1), F.lit(0))) is None
    assert one(spark, pct_text(F.lit(40.6))) == "40.60%"
    assert one(spark, pct_text(F.lit(None).cast("double"))) == "%"


def test_clock_hours(spark):
    assert one(spark, hhmm_hour(F.lit(1955))) == 19
    assert one(spark, hhmm_hour(F.lit(2400))) == 24
    assert one(spark, hhmm_hour(F.lit(2400), wrap=True)) == 0
    assert one(spark, hhmm_hour(F.lit(5))) == 0
    assert one(spark, floor_div(F.lit(-1), 7)) == -1  # floors like Python, not truncation


def test_route_is_null_propagating(spark):
    assert one(spark, route(F.lit("A"), F.lit("B"))) == "A → B"
    assert one(spark, route(F.lit("A"), F.lit(None).cast("string"))) is None


def ladder_values(spark, spec, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    return [r["l"] for r in df.select(lbl("x", spec).alias("l")).collect()]


def test_ladder_boundaries(spark):
    assert ladder_values(spark, L.SYMMETRY, [5, 5.01, 15, 15.01]) == [
        "Symmetric", "Mildly Asymmetric", "Mildly Asymmetric", "Strongly Asymmetric"]
    assert ladder_values(spark, L.RECOVERY, [10, 9.99, 0, -0.01, -10, -10.01]) == [
        "Strong Recovery", "Slight Recovery", "Slight Recovery", "Slight Worsening", "Slight Worsening",
        "Strong Worsening"]
    assert ladder_values(spark, L.CONSISTENCY, [20, 20.01, 30, 30.01, None]) == [
        "Highly Consistent", "Moderately Consistent", "Moderately Consistent", "Inconsistent", "Inconsistent"]
    assert ladder_values(spark, L.AIRLINE_TREND, [None, -10, -9.99, 0, 10, 10.01]) == [
        "First Month (no prior)", "Strong Improvement", "Slight Improvement", "Slight Worsening",
        "Slight Worsening", "Strong Worsening"]
    assert ladder_values(spark, L.OVERALL_TREND, [-2, -1.99, 1.99, 2]) == [
        "Overall Improving", "Stable", "Stable", "Overall Worsening"]
    assert ladder_values(spark, L.SEVERITY, [40, 39.99, 30, 20, 19.99]) == [
        "Critical", "High Severity", "High Severity", "Moderate Severity", "Low Severity"]
    assert ladder_values(spark, L.HOUR_RISK, [40, 30, 20, 19.99]) == [
        "Very High Risk", "High Risk", "Moderate Risk", "Low Risk"]
    assert ladder_values(spark, L.MONTH_TREND, [None, -5, -4.99, 0, 5, 5.01]) == [
        "Baseline", "Strong Improvement", "Slight Improvement", "Slight Worsening", "Slight Worsening",
        "Strong Worsening"]
    assert ladder_values(spark, L.TREND_POSITION, [5, 5.01, -5, -5.01]) == [
        "On Trend", "Above Trend", "On Trend", "Below Trend"]
    assert ladder_values(spark, L.IMPACT, [30, 29.99, 20, 10, 9.99]) == [
        "Dominant Cause", "Major Cause", "Major Cause", "Moderate Cause", "Minor Cause"]
    assert ladder_values(spark, L.CONCENTRATION, [50, 49.99, 40, 39.99]) == [
        "Highly Concentrated", "Moderately Concentrated", "Moderately Concentrated", "Distributed"]


def test_calendar_and_hours(spark):
    df = spark.range(1, 13).select(F.col("id").alias("m"))
    rows = df.select("m", month_name("m").alias("n"), season("m").alias("s")).orderBy("m").collect()
    assert [r["n"] for r in rows][:3] == ["January", "February", "March"]
    assert [r["s"] for r in rows] == ["Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer",
                                      "Summer", "Fall", "Fall", "Fall", "Winter"]
    hours = spark.range(0, 24).select(time_of_day("id").alias("t")).collect()
    labels = [r["t"] for r in hours]
    assert labels[4] == "Night / Red Eye" and labels[5] == "Early Morning" and labels[8] == "Early Morning"
    assert labels[9] == "Mid Morning" and labels[12] == "Afternoon" and labels[15] == "Peak Hours"
    assert labels[18] == "Evening" and labels[20] == "Evening" and labels[21] == "Night / Red Eye"
