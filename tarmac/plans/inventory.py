"""Stand-alone queries, one per fine-grained operator of the inventory
(profiling, cleaning, predicates, joins, aggregates, windows, top-k, set
operations, scalar functions, label ladders).

Each is a small, realistic use of the operator on the flight tables (or the
nation/region lookups they come from), so every operator is exercised by a
runnable query with its own SQL oracle. All read the full tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.functions import labels as L
from tarmac.functions.labels import ladder, lbl, month_name, route, season, time_of_day, two_axis
from tarmac.functions.numeric import floor_div, pct, pct_text, r2, rnd
from tarmac.operators import aggregates as A
from tarmac.operators import clean as C
from tarmac.operators import profile as P
from tarmac.operators.joins import equi_inner, lookup, reverse_pairs, top_two
from tarmac.operators.reshape import count_endpoints, distinct_union, unpivot_measures
from tarmac.operators.topk import both_ends, top_k, top_per_group
from tarmac.operators.windows import (
    lag_of,
    period_change,
    rank_over,
    rolling_mean,
    row_number_over,
    running_mean,
    share_of_total,
)
from tarmac.plans import analyses as Q
from tarmac.sources.flights import prepare
from tarmac.sources.tables import Tables
from tarmac.spec import DEFAULT, FlightSpec

S = DEFAULT
ARR, DEP, CAR, ORI, DST, MON, HR = S.arr, S.dep, S.carrier, S.origin, S.dest, S.month, S.hour
asc, desc = F.asc, F.desc


def _f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark, sf_dir).flights


def _f0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark, sf_dir).flights0


def _sched(df: DataFrame) -> DataFrame:
    """A scheduled ``hhmm`` departure time derived from the hour (minutes from the delay)."""
    return df.withColumn("CRSDepTime", F.col(HR) * 100 + F.pmod(F.col(ARR).cast("bigint"), F.lit(60)))


# ------------------------------------------------------------------ profiling
def prof_schema(spark, d):
    return P.schema_info(_f0(spark, d))


def prof_shape(spark, d):
    return P.shape(_f0(spark, d))


def prof_nulls(spark, d):
    return P.null_counts(_f0(spark, d))


def prof_duplicates(spark, d):
    return P.duplicate_count(_f0(spark, d))


def prof_distinct(spark, d):
    return P.distinct_values(_f0(spark, d), CAR)


def prof_describe(spark, d):
    return P.describe(_f0(spark, d), [ARR, DEP])


def prof_minmax(spark, d):
    return P.min_max(_f(spark, d), [ARR, DEP])


def prof_boxplot(spark, d):
    return P.boxplot_stages(_f0(spark, d), [ARR, DEP])


def prof_head(spark, d):
    f = _f(spark, d)
    return P.head(f, 5, f.columns)


def prof_invariants(spark, d):
    return P.check_invariants(_f(spark, d), ARR, S.cause_cols)


# ------------------------------------------------------------------ cleaning and predicates
def clean_dropna(spark, d):
    return C.drop_null_rows(_f0(spark, d), S.corr_cols)


def clean_drop_columns(spark, d):
    return C.drop_columns(_f0(spark, d), S.cause_cols)


def clean_cast_int(spark, d):
    return C.cast_int(_f0(spark, d), [ARR, DEP]).select(MON, CAR, ARR, DEP)


def clean_hhmm_to_hour(spark, d):
    s = _sched(_f0(spark, d))
    return C.add_hours(s, {"SchedHour": "CRSDepTime"}).select(HR, "CRSDepTime", "SchedHour")


def clean_trim(spark, d):
    padded = _f0(spark, d).select(F.concat(F.lit(" \t"), F.col(CAR), F.lit(" \n")).alias(CAR))
    return C.strip(padded, [CAR]).groupBy(CAR).agg(F.count(F.lit(1)).alias("flights"))


def clean_iqr_filter(spark, d):
    return C.iqr_filter(_f0(spark, d), S.measures)


def clean_override_hour(spark, d):
    s = _sched(_f(spark, d)).withColumn(HR, F.lit(-1).cast("bigint"))
    return C.override_hour(s, HR, "CRSDepTime").select(CAR, "CRSDepTime", HR)


def proj_columns(spark, d):
    return _f(spark, d).select(route(ORI, DST).alias("route"), F.col(MON).alias("month"), F.col(ARR).alias("delay"))


def filter_range(spark, d):
    return _f(spark, d).filter(F.col(ARR).between(31, 60)).select(CAR, ORI, DST, ARR)


def filter_in(spark, d):
    return _f(spark, d).filter(F.col(MON).isin(12, 1, 2)).select(MON, CAR, ARR)


def filter_null(spark, d):
    """Carrier-months that have no previous present month (first month)."""
    return Q.q05_monthly_changes(_f(spark, d)).filter(F.col("mom_change").isNull()).select("airline", MON, "avg_delay")


def filter_compare(spark, d):
    f = _f(spark, d)
    return f.filter((F.col(ORI) < F.col(DST)) & (F.col(ARR) > F.col(DEP))).select(ORI, DST, ARR, DEP)


def filter_having(spark, d):
    return (
        _f(spark, d).groupBy(ORI, DST).agg(F.count(F.lit(1)).alias("flights"))
        .filter(F.col("flights") >= 50).select(route(ORI, DST).alias("route"), "flights")
    )


def row_mask_and(spark, d):
    f = _f0(spark, d)
    mask = (F.col(ARR) >= 20) & (F.col(ARR) <= 90) & (F.col(DEP) >= 10) & (F.col(DEP) <= 80)
    return f.filter(mask).select(CAR, ARR, DEP)


# ------------------------------------------------------------------ joins
def join_reverse_pair(spark, d):
    g = _f(spark, d).groupBy(ORI, DST).agg(F.count(F.lit(1)).alias("flights"))
    return reverse_pairs(g, ORI, DST, ["flights"], method="join")


def join_equi_inner(spark, d):
    f = _f(spark, d)
    dep = f.groupBy(F.col(ORI).alias("airport")).agg(F.count(F.lit(1)).alias("departures"))
    arr = f.groupBy(F.col(DST).alias("airport")).agg(F.count(F.lit(1)).alias("arrivals"))
    return equi_inner(dep, arr, "airport")


def join_rank1_rank2(spark, d):
    """Each carrier's busiest and second-busiest month (RANK ties as in SQL)."""
    g = _f(spark, d).groupBy(F.col(CAR).alias("airline"), MON).agg(F.count(F.lit(1)).alias("flights"))
    ranked = g.withColumn("month_rank", rank_over(F.col("flights").desc(), ["airline"]))
    return top_two(ranked, "airline", "month_rank", {MON: "top_month", "flights": "top_flights"},
                   {MON: "second_month", "flights": "second_flights"}, method="join")


def join_cross_scalar(spark, d):
    """Each carrier's mean arrival delay against the network mean (same scan)."""
    g = _f(spark, d).groupBy(F.col(CAR).alias("airline")).agg(
        F.sum(ARR).alias("_s"), F.count(ARR).alias("_n"))
    w = Window.partitionBy()
    return g.select(
        "airline",
        r2(F.col("_s") / F.col("_n")).alias("avg_delay"),
        r2(F.sum("_s").over(w) / F.sum("_n").over(w)).alias("network_avg"),
    ).withColumn("vs_network", r2(F.col("avg_delay") - F.col("network_avg")))


def join_lookup(spark, d):
    """Region of each origin airport, looked up from the nation and region tables."""
    t = Tables(spark, d)
    nation, region = t.nation, t.region
    regions = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("airport"), F.col("r_name").alias("region"))
    dep = _f(spark, d).groupBy(F.col(ORI).alias("airport")).agg(F.count(F.lit(1)).alias("departures"))
    return lookup(dep, regions, "airport")


# ------------------------------------------------------------------ aggregates
def _by_carrier(spark, d, *aggs):
    return _f(spark, d).groupBy(F.col(CAR).alias("airline")).agg(*aggs)


def agg_count(spark, d):
    return _by_carrier(spark, d, F.count(F.lit(1)).alias("flights"))


def agg_count_distinct(spark, d):
    return _by_carrier(spark, d, F.count_distinct(ORI).alias("origins"), F.count_distinct(DST).alias("dests"))


def agg_min_max(spark, d):
    return _by_carrier(spark, d, F.min(ARR).alias("min_arr"), F.max(ARR).alias("max_arr"),
                       F.min(DEP).alias("min_dep"), F.max(DEP).alias("max_dep"))


def agg_avg(spark, d):
    return _by_carrier(spark, d, r2(F.avg(ARR)).alias("avg_arr"), r2(F.avg(DEP)).alias("avg_dep"))


def agg_stddev(spark, d):
    return _f(spark, d).groupBy(F.col(ORI).alias("airport")).agg(
        r2(F.stddev_samp(ARR)).alias("stddev_arr"), r2(F.stddev_samp(DEP)).alias("stddev_dep"))


def agg_sum(spark, d):
    return _by_carrier(spark, d, *[F.sum(c).alias(c) for c in S.cause_cols])


def agg_conditional_count(spark, d):
    return _f(spark, d).groupBy(MON).agg(F.count_if(F.col(ARR) > 60).alias("severe_flights"),
                                         F.count_if(F.col(ARR).between(15, 30)).alias("mild_flights"))


def agg_conditional_avg(spark, d):
    return _by_carrier(spark, d, *[r2(A.avg_if(F.col(c) > 0, c)).alias(c) for c in S.cause_cols])


def agg_rate_pct(spark, d):
    g = _f(spark, d).groupBy(F.col(ORI).alias("airport")).agg(
        F.count(F.lit(1)).alias("flights"), F.count_if(F.col(ARR) > 60).alias("severe"))
    return g.select("airport", pct("severe", "flights").alias("severe_rate"))


def agg_multi_key(spark, d):
    return _f(spark, d).groupBy(CAR, ORI, MON).agg(F.count(F.lit(1)).alias("flights"), r2(F.avg(ARR)).alias("avg_arr"))


def agg_of_agg(spark, d):
    r = _f(spark, d).groupBy(ORI, DST).agg(r2(F.avg(ARR)).alias("route_avg"))
    return r.groupBy(F.col(ORI).alias("airport")).agg(
        r2(F.avg("route_avg")).alias("mean_route_avg"), F.min("route_avg").alias("best_route_avg"),
        F.max("route_avg").alias("worst_route_avg"), F.count(F.lit(1)).alias("routes"))


def agg_quantile(spark, d):
    q = A.exact_quantiles(_f(spark, d).withColumnRenamed(CAR, "airline"), [ARR], [0.25, 0.5, 0.75], ["airline"])
    return q.select("airline", *[rnd(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


def agg_corr_matrix(spark, d):
    return A.corr_matrix(_f0(spark, d), S.corr_cols)


def agg_column_means(spark, d):
    m = A.column_means(_f0(spark, d), S.corr_cols, "column_name", "mean")
    return m.withColumn("mean", rnd("mean", 6))


def agg_global(spark, d):
    from tarmac.plans.scope import scope_summary

    return scope_summary(_f(spark, d))


SEASON_NAMES = ["Winter", "Spring", "Summer", "Fall"]


def agg_pivot(spark, d):
    f = _f(spark, d).withColumn("season", season(MON))
    p = f.groupBy(F.col(CAR).alias("airline")).pivot("season", SEASON_NAMES).agg(F.count(F.lit(1)))
    return p.select("airline", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s.lower()) for s in SEASON_NAMES])


def agg_ifs(spark, d):
    a, dp, m = F.col(ARR), F.col(DEP), F.col(MON)
    return _by_carrier(
        spark, d,
        A.ifs("count", [a > 60, F.col(HR).between(15, 20)]).alias("evening_severe"),
        A.ifs("sum", [m.isin(12, 1, 2), F.col("WeatherDelay") > 0], "WeatherDelay").alias("winter_weather_minutes"),
        r2(A.ifs("avg", [F.col(ORI) < F.col(DST), dp > 30], ARR)).alias("late_dep_avg_arr"),
    )


# ------------------------------------------------------------------ windows
def _carrier_month(spark, d):
    return _f(spark, d).groupBy(F.col(CAR).alias("airline"), MON).agg(
        r2(F.avg(ARR)).alias("avg_delay"), F.count(F.lit(1)).alias("flights"))


def win_rank_partition(spark, d):
    g = _carrier_month(spark, d)
    return g.withColumn("rank_in_month", rank_over(F.col("avg_delay").desc(), [MON]))


def win_rank_global(spark, d):
    g = _f(spark, d).groupBy(F.col(ORI).alias("airport")).agg(r2(F.avg(ARR)).alias("avg_delay"))
    return g.withColumns({"rank_desc": rank_over(F.col("avg_delay").desc()),
                          "rank_asc": rank_over(F.col("avg_delay").asc())})


def win_rank_in_case(spark, d):
    g = _by_carrier(spark, d, F.count(F.lit(1)).alias("flights"), r2(F.avg(ARR)).alias("avg_delay"))
    g = g.withColumns({"volume_rank": rank_over(F.col("flights").desc()),
                       "delay_rank": rank_over(F.col("avg_delay").desc())})
    return g.withColumns({
        "rank_difference": F.col("delay_rank") - F.col("volume_rank"),
        "profile": two_axis(F.col("volume_rank") <= 5, F.col("delay_rank") <= 5, L.AIRPORT_PROFILE_LABELS),
    })


def win_conditional_rank(spark, d):
    q = Q.q06_severity_profile(_f(spark, d))
    target = "High Severity"
    return q.select(
        "airline", "severity_profile", "severe_delay_rate",
        F.when(F.col("severity_profile") == target,
               rank_over(F.col("severe_delay_rate").desc_nulls_first(), ["severity_profile"])).alias("profile_rank"),
    )


def _monthly(spark, d):
    return _f(spark, d).groupBy(MON).agg(r2(F.avg(ARR)).alias("avg_delay"))


def win_lag(spark, d):
    return _monthly(spark, d).withColumn("prev_avg", lag_of("avg_delay", MON))


def win_delta(spark, d):
    return _monthly(spark, d).withColumn("change", period_change("avg_delay", MON))


def win_moving_avg(spark, d):
    g = _carrier_month(spark, d)
    return g.withColumn("moving_avg_3", r2(rolling_mean("avg_delay", MON, 3, ["airline"])))


def win_cumulative_avg(spark, d):
    g = _carrier_month(spark, d)
    run = running_mean("avg_delay", MON, ["airline"])
    return g.withColumns({"cumulative_avg": r2(run), "vs_cumulative": r2(F.col("avg_delay") - run)})


def win_share_of_total(spark, d):
    g = _by_carrier(spark, d, F.count(F.lit(1)).alias("flights"))
    return g.withColumn("share_pct", r2(share_of_total("flights")))


def win_share_of_group(spark, d):
    g = _carrier_month(spark, d)
    return g.withColumn("share_of_airline_pct", r2(share_of_total("flights", ["airline"]))).select(
        "airline", MON, "flights", "share_of_airline_pct")


def win_row_number(spark, d):
    g = _f(spark, d).groupBy(MON, route(ORI, DST).alias("route")).agg(F.count(F.lit(1)).alias("flights"))
    rn = row_number_over([F.col("flights").desc(), F.col("route").asc()], [MON])
    return g.withColumn("rn", rn).filter(F.col("rn") <= 3)


# ------------------------------------------------------------------ sort / top-k
def sort_multi(spark, d):
    g = _by_carrier(spark, d, r2(F.avg(ARR)).alias("avg_delay"), F.count(F.lit(1)).alias("flights"))
    return g.orderBy(desc("avg_delay"), asc("flights"), asc("airline"))


def sort_case_expr(spark, d):
    g = _f(spark, d).groupBy(F.col(HR).alias("dep_hour")).agg(r2(F.avg(ARR)).alias("avg_delay"))
    g = g.withColumn("time_of_day", time_of_day("dep_hour"))
    prio = F.when(F.col("time_of_day") == "Peak Hours", 1).when(F.col("time_of_day") == "Evening", 2).otherwise(3)
    return g.orderBy(prio, F.col("avg_delay").desc_nulls_last(), asc("dep_hour"))


def topk_limit(spark, d):
    g = _f(spark, d).groupBy(route(ORI, DST).alias("route")).agg(r2(F.avg(ARR)).alias("avg_delay"))
    return top_k(g, [desc("avg_delay"), asc("route")], 10)


def topk_both_ends(spark, d):
    g = _by_carrier(spark, d, r2(F.avg(ARR)).alias("avg_delay"))
    return both_ends(g, [asc("avg_delay"), asc("airline")], [desc("avg_delay"), asc("airline")], 5,
                     ("Best", "Worst"))


def topk_per_group(spark, d):
    g = _f(spark, d).groupBy(MON, route(ORI, DST).alias("route")).agg(r2(F.avg(ARR)).alias("avg_delay"))
    return top_per_group(g, [MON], [F.col("avg_delay").desc()], 3, "delay_rank")


# ------------------------------------------------------------------ set operations / reshape
def set_union_distinct(spark, d):
    return distinct_union(_f(spark, d), [ORI, DST], "airport")


def set_union_all(spark, d):
    f = _f(spark, d)
    o = f.groupBy(F.col(ORI).alias("airport")).agg(F.count(F.lit(1)).alias("flights")).withColumn("role", F.lit("origin"))
    t = f.groupBy(F.col(DST).alias("airport")).agg(F.count(F.lit(1)).alias("flights")).withColumn("role", F.lit("dest"))
    return o.unionByName(t)


def unpivot_causes(spark, d):
    wide = _f(spark, d).groupBy(F.col(CAR).alias("airline")).agg(*[F.sum(c).alias(c) for c in S.cause_cols])
    return unpivot_measures(wide, ["airline"], dict(S.causes), "delay_cause", "total_minutes")


def endpoint_explode(spark, d):
    return count_endpoints(_f(spark, d), [ORI, DST], "airport")


# ------------------------------------------------------------------ scalar functions
def fn_round2(spark, d):
    g = _f(spark, d).groupBy(ORI, DST).agg(F.avg(ARR).alias("m"))
    return g.select(ORI, DST, r2("m").alias("avg_2dp"), r2(F.col("m") / 7).alias("seventh_2dp"))


def fn_abs(spark, d):
    return _f(spark, d).groupBy(ORI, DST).agg(r2(F.avg(F.abs(F.col(DEP) - F.col(ARR)))).alias("mean_abs_gap"))


def fn_concat_route(spark, d):
    return _f(spark, d).select(route(ORI, DST).alias("route")).distinct()


def fn_pct_text(spark, d):
    g = _by_carrier(spark, d, F.count(F.lit(1)).alias("flights"))
    return g.select("airline", pct_text(r2(share_of_total("flights"))).alias("share_text"))


def fn_arith(spark, d):
    a, dp = F.col(ARR), F.col(DEP)
    return _by_carrier(spark, d, F.sum(a - dp).alias("sum_gap"), F.sum(a * 2).alias("sum_double"),
                       r2(F.avg((a + dp) / 2)).alias("avg_mid"))


def fn_floor_div(spark, d):
    b = floor_div(F.col(ARR).cast("bigint") - 50, 7).alias("bucket")
    return _f(spark, d).groupBy(b).agg(F.count(F.lit(1)).alias("flights"))


def fn_cast(spark, d):
    g = _monthly(spark, d)
    return g.select(MON, F.col("avg_delay").cast("bigint").alias("avg_int"),
                    F.col("avg_delay").cast("decimal(10,2)").cast("string").alias("avg_text"),
                    F.col(MON).cast("string").try_cast("bigint").alias("month_int"))


def fn_strip(spark, d):
    padded = _f0(spark, d).select(F.concat(F.lit("\t"), F.col(DST), F.lit("  ")).alias(DST))
    return C.strip(padded, [DST]).distinct()


def fn_month_name(spark, d):
    return _f(spark, d).select(MON).distinct().withColumn("month_name", month_name(MON))


def fn_season(spark, d):
    return _f(spark, d).select(MON).distinct().withColumn("season", season(MON))


def fn_time_of_day(spark, d):
    return _f(spark, d).select(HR).distinct().withColumn("time_of_day", time_of_day(HR))


def fn_threshold_label(spark, d):
    g = _f(spark, d).groupBy(route(ORI, DST).alias("route")).agg(r2(F.avg(ARR)).alias("avg_delay"))
    rungs = [(">=", 60, "Severe"), (">=", 45, "Heavy"), (">=", 30, "Moderate")]
    return g.withColumn("band", ladder("avg_delay", rungs, "Light"))


QUARTERS = {1: "Q1", 2: "Q1", 3: "Q1", 4: "Q2", 5: "Q2", 6: "Q2", 7: "Q3", 8: "Q3", 9: "Q3", 10: "Q4", 11: "Q4", 12: "Q4"}


def fn_simple_case(spark, d):
    m = F.col(MON)
    q = None
    for k, v in QUARTERS.items():
        q = F.when(m == k, F.lit(v)) if q is None else q.when(m == k, F.lit(v))
    return _f(spark, d).groupBy(q.alias("quarter")).agg(F.count(F.lit(1)).alias("flights"))


def fn_pct_format(spark, d):
    m = A.column_means(_f(spark, d), S.cause_cols, "cause", "mean_minutes")
    share = rnd(share_of_total("mean_minutes"), 1)
    return m.select("cause", F.concat(share.cast("decimal(38,1)").cast("string"), F.lit("%")).alias("share_text"),
                    rnd("mean_minutes", 2).alias("mean_2dp"))


def fn_literal_tag(spark, d):
    f = _f(spark, d)
    early = f.filter(F.col(HR) < 12).agg(F.count(F.lit(1)).alias("flights")).withColumn("part", F.lit("Before Noon"))
    late = f.filter(F.col(HR) >= 12).agg(F.count(F.lit(1)).alias("flights")).withColumn("part", F.lit("After Noon"))
    return early.unionByName(late)


def fn_conditional_value(spark, d):
    g = _by_carrier(spark, d, r2(F.avg(ARR)).alias("avg_arr"), r2(F.avg(DEP)).alias("avg_dep"))
    return g.withColumn("excess_when_arr_worse",
                        F.when(F.col("avg_arr") > F.col("avg_dep"), r2(F.col("avg_arr") - F.col("avg_dep"))))


# ------------------------------------------------------------------ label ladders on real groups
def _airport_stats(spark, d, key=ORI):
    return _f(spark, d).groupBy(F.col(key).alias("airport")).agg(
        F.count(F.lit(1)).alias("flights"), r2(F.avg(ARR)).alias("avg_delay"),
        r2(F.stddev_samp(ARR)).alias("stddev_delay"), r2(F.avg(F.col(DEP) - F.col(ARR))).alias("avg_recovery"),
        pct(F.count_if(F.col(ARR) > 60), F.count(F.lit(1))).alias("severe_rate"))


def lbl_symmetry(spark, d):
    return Q.q02_route_symmetry(_f(spark, d), top=None).select("route_ab", "delay_difference", "symmetry_label")


def lbl_recovery(spark, d):
    g = _airport_stats(spark, d)
    return g.select("airport", "avg_recovery", lbl("avg_recovery", L.RECOVERY).alias("recovery_label"))


def lbl_consistency(spark, d):
    g = _airport_stats(spark, d)
    return g.select("airport", "stddev_delay", lbl("stddev_delay", L.CONSISTENCY).alias("consistency_label"))


def lbl_performance(spark, d):
    g = _airport_stats(spark, d).withColumns({
        "consistency_rank": rank_over(F.col("stddev_delay").asc_nulls_last()),
        "avg_delay_rank": rank_over(F.col("avg_delay").asc_nulls_last())})
    return g.select("airport", "consistency_rank", "avg_delay_rank",
                    two_axis(F.col("consistency_rank") <= 3, F.col("avg_delay_rank") <= 3, L.PERFORMANCE_LABELS)
                    .alias("performance_profile"))


def lbl_airline_trend(spark, d):
    return Q.q05_monthly_changes(_f(spark, d), min_flights=1).select("airline", MON, "mom_change", "trend_label")


def _origin_month(spark, d):
    g = _f(spark, d).groupBy(F.col(ORI).alias("airport"), MON).agg(r2(F.avg(ARR)).alias("avg_delay"))
    return g.withColumn("mom_change", period_change("avg_delay", MON, ["airport"]))


def lbl_overall_trend(spark, d):
    g = _origin_month(spark, d).filter(F.col("mom_change").isNotNull())
    from tarmac.functions.numeric import exact

    return g.groupBy("airport").agg(r2(F.avg("mom_change")).alias("avg_mom_change"),
                                    lbl(exact(F.avg("mom_change")), L.OVERALL_TREND).alias("overall_trend"))


def lbl_severity(spark, d):
    g = _airport_stats(spark, d)
    return g.select("airport", "severe_rate", lbl("severe_rate", L.SEVERITY).alias("severity_profile"))


def bucket_delay(spark, d):
    f = _f(spark, d)
    return f.groupBy(F.col(HR).alias("dep_hour")).agg(*A.bucket_counts(ARR, {
        "mild": L.MILD_BUCKET, "moderate": L.MODERATE_BUCKET, "severe": (L.SEVERE_ABOVE, None)}),
        F.count(F.lit(1)).alias("flights"))


def lbl_airport_profile(spark, d):
    return Q.q07_volume_vs_delay(_f(spark, d), top=None).select("airport", "volume_rank", "delay_rank", "airport_profile")


def lbl_delay_profile(spark, d):
    return Q.q08_dep_arr_profile(_f(spark, d), min_flights=1).select("airport", "delay_profile", "ground_ops_rank")


def lbl_hour_risk(spark, d):
    g = _by_carrier(spark, d, pct(F.count_if(F.col(ARR) > 60), F.count(F.lit(1))).alias("major_delay_prob"))
    return g.withColumn("risk_label", lbl("major_delay_prob", L.HOUR_RISK))


def lbl_month_trend(spark, d):
    return _origin_month(spark, d).withColumn("mom_trend", lbl("mom_change", L.MONTH_TREND))


def lbl_trend_position(spark, d):
    g = _origin_month(spark, d).drop("mom_change")
    v = r2(F.col("avg_delay") - running_mean("avg_delay", MON, ["airport"]))
    return g.withColumn("vs_cumulative_avg", v).withColumn("trend_position", lbl("vs_cumulative_avg", L.TREND_POSITION))


def _origin_causes(spark, d):
    """Cause ranking per origin airport: the carrier-level operator with the
    origin column as its grouping key."""
    by_origin = FlightSpec(carrier=ORI)
    return Q.cause_ranks_per_carrier(_f(spark, d), by_origin).withColumnRenamed("airline", "airport")


def lbl_impact(spark, d):
    c = Q.cause_ranks_per_carrier(_f(spark, d))
    return c.select("airline", "delay_cause", "pct_of_airline_total",
                    lbl("pct_of_airline_total", L.IMPACT).alias("impact_label"))


def lbl_spread(spark, d):
    c = Q.cause_ranks_per_carrier(_f(spark, d)).withColumns({
        "breadth_rank": rank_over(F.col("flights_affected").desc_nulls_first(), ["airline"]),
        "severity_rank": rank_over(F.col("avg_when_present").desc_nulls_first(), ["airline"])})
    return c.select("airline", "delay_cause", "breadth_rank", "severity_rank",
                    two_axis(F.col("breadth_rank") <= 2, F.col("severity_rank") <= 2, L.SPREAD_LABELS)
                    .alias("spread_label"))


def lbl_network(spark, d):
    c = _origin_causes(spark, d).filter(F.col("cause_rank_within_airline") == 1)
    follows, deviates = L.NETWORK_LABELS
    return c.select("airport", "delay_cause", F.when(F.col("delay_cause") == L.NETWORK_CAUSE, F.lit(follows))
                    .otherwise(F.lit(deviates)).alias("vs_network"))


def lbl_concentration(spark, d):
    c = _origin_causes(spark, d).filter(F.col("cause_rank_within_airline") == 1)
    return c.select("airport", "delay_cause", "pct_of_airline_total",
                    lbl("pct_of_airline_total", L.CONCENTRATION).alias("concentration_label"))


OPERATOR_QUERIES = {
    name: fn
    for name, fn in list(globals().items())
    if callable(fn) and not name.startswith("_") and fn.__module__ == __name__
    and name.split("_")[0] in {"prof", "clean", "proj", "filter", "row", "join", "agg", "win", "sort", "topk", "set",
                               "unpivot", "endpoint", "fn", "lbl", "bucket"}
}
