"""The twelve delay analyses (Q1-Q12), as lazy DataFrame plans over the
flight fact table.

Shape rules used throughout:
* every fact-table pass is ``scan -> partial aggregate -> shuffle on a small
  key -> final aggregate``; windows, joins and labels only touch the
  aggregated rows (routes, carriers, airports, hours, months);
* analyses that the SQL writes as several scans unioned together (cause
  unpivots, origin/dest volumes) are one scan here;
* metrics are rounded to 2 dp *before* they are ranked or compared, as the
  reference does, so ties and label boundaries agree with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import labels as L
from tarmac.functions.labels import lbl, month_name, route, season, time_of_day, two_axis
from tarmac.functions.numeric import exact, pct, pct_text, r2
from tarmac.operators.aggregates import bucket_counts
from tarmac.operators.joins import reverse_pairs, top_two
from tarmac.operators.reshape import endpoints, unpivot_struct
from tarmac.operators.topk import both_ends, top_k, top_per_group
from tarmac.operators.windows import (
    lag_of,
    period_change,
    rank_over,
    rolling_mean,
    running_mean,
    share_of_total,
)
from tarmac.spec import DEFAULT, FlightSpec

asc, desc = F.asc, F.desc


def repeat_worst_layer(route_month: DataFrame, month: str = "Month", top: int = 10, min_months: int = 2) -> DataFrame:
    """From (route, month, rounded mean): routes in a month's top ``top`` more than once."""
    ranked = top_per_group(route_month, [month], [F.col("avg_delay").desc_nulls_first()], top, "delay_rank")
    return (
        ranked.groupBy("route")
        .agg(F.count(F.lit(1)).alias("months_in_top10"), r2(F.avg("avg_delay")).alias("overall_avg_delay"))
        .filter(F.col("months_in_top10") >= min_months)
        .orderBy(desc("months_in_top10"), desc("overall_avg_delay"), asc("route"))
    )


def q01_repeat_worst_routes(df: DataFrame, spec: FlightSpec = DEFAULT, top: int = 10, min_months: int = 2) -> DataFrame:
    """Routes that rank among each month's ``top`` worst more than once."""
    s = spec
    monthly = df.groupBy(s.origin, s.dest, s.month).agg(r2(F.avg(s.arr)).alias("avg_delay"))
    monthly = monthly.select(route(s.origin, s.dest).alias("route"), s.month, "avg_delay")
    return repeat_worst_layer(monthly, s.month, top, min_months)


def q02_route_symmetry(df: DataFrame, spec: FlightSpec = DEFAULT, top: int | None = 20) -> DataFrame:
    """Each direction's mean delay against its reverse direction."""
    return symmetry_layer(df.groupBy(spec.origin, spec.dest).agg(r2(F.avg(spec.arr)).alias("avg_delay")), spec, top)


def symmetry_layer(route_avg: DataFrame, spec: FlightSpec = DEFAULT, top: int | None = 20) -> DataFrame:
    """From (origin, dest, rounded mean): both directions side by side."""
    s = spec
    pairs = reverse_pairs(route_avg, s.origin, s.dest, ["avg_delay"])
    ab, ba = F.col("avg_delay_ab"), F.col("avg_delay_ba")
    out = pairs.select(
        route(s.origin, s.dest).alias("route_ab"),
        ab.alias("delay_ab"),
        route(s.dest, s.origin).alias("route_ba"),
        ba.alias("delay_ba"),
        r2(F.abs(ab - ba)).alias("delay_difference"),
        lbl(r2(F.abs(ab - ba)), L.SYMMETRY).alias("symmetry_label"),
        F.when(ab > ba, route(s.origin, s.dest)).otherwise(route(s.dest, s.origin)).alias("worse_direction"),
    )
    order = [desc("delay_difference"), asc("route_ab")]
    return top_k(out, order, top) if top else out.orderBy(*order)


def route_recovery_aggs(spec: FlightSpec = DEFAULT) -> list:
    s = spec
    return [
        r2(F.avg(s.dep)).alias("avg_dep_delay"),
        r2(F.avg(s.arr)).alias("avg_arr_delay"),
        r2(F.avg(F.col(s.dep) - F.col(s.arr))).alias("avg_recovery"),
        F.count(F.lit(1)).alias("total_flights"),
    ]


def recovery_layer(routes: DataFrame, min_flights: int = 50, k: int = 10) -> DataFrame:
    """Best k and worst k routes by mean recovery, from per-route aggregates."""
    rec = routes.filter(F.col("total_flights") >= min_flights).select(
        "route", "avg_dep_delay", "avg_arr_delay", "avg_recovery", "total_flights",
        lbl("avg_recovery", L.RECOVERY).alias("recovery_label"),
    )
    return both_ends(
        rec,
        [desc("avg_recovery"), asc("route")],
        [asc("avg_recovery"), asc("route")],
        k,
        L.RECOVERY_CATEGORIES,
    ).orderBy(asc("category"), desc("avg_recovery"), asc("route"))


def q03_delay_recovery(df: DataFrame, spec: FlightSpec = DEFAULT, min_flights: int = 50, k: int = 10) -> DataFrame:
    """Routes that make up (or lose) the most time in the air: best k and worst k."""
    s = spec
    routes = df.groupBy(s.origin, s.dest).agg(*route_recovery_aggs(spec)).withColumn(
        "route", route(s.origin, s.dest))
    return recovery_layer(routes, min_flights, k)


def airline_stats(df: DataFrame, spec: FlightSpec = DEFAULT, min_flights: int = 100) -> DataFrame:
    s = spec
    return (
        df.groupBy(F.col(s.carrier).alias("airline"))
        .agg(
            F.count(F.lit(1)).alias("total_flights"),
            r2(F.avg(s.arr)).alias("avg_delay"),
            r2(F.stddev_samp(s.arr)).alias("stddev_delay"),
            r2(F.min(s.arr)).alias("min_delay"),
            r2(F.max(s.arr)).alias("max_delay"),
        )
        .filter(F.col("total_flights") >= min_flights)
    )


def consistency_layer(stats: DataFrame, top: int = 3) -> DataFrame:
    """Ranks and labels from per-carrier (avg_delay, stddev_delay)."""
    ranked = stats.withColumns({
        "consistency_rank": rank_over(F.col("stddev_delay").asc_nulls_last()),
        "avg_delay_rank": rank_over(F.col("avg_delay").asc_nulls_last()),
    })
    return ranked.select(
        "consistency_rank", "airline", "total_flights", "avg_delay", "stddev_delay",
        lbl("stddev_delay", L.CONSISTENCY).alias("consistency_label"),
        "avg_delay_rank",
        two_axis(F.col("consistency_rank") <= top, F.col("avg_delay_rank") <= top, L.PERFORMANCE_LABELS)
        .alias("performance_profile"),
    ).orderBy(asc("consistency_rank"), asc("airline"))


def q04_airline_consistency(df: DataFrame, spec: FlightSpec = DEFAULT, min_flights: int = 100, top: int = 3) -> DataFrame:
    """Carriers ranked by the spread (sample stddev) of their arrival delay."""
    return consistency_layer(airline_stats(df, spec, min_flights), top)


def carrier_month_stats(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    s = spec
    return df.groupBy(F.col(s.carrier).alias("airline"), F.col(s.month)).agg(
        r2(F.avg(s.arr)).alias("avg_delay"), F.count(F.lit(1)).alias("total_flights"))


def monthly_change_layer(monthly: DataFrame, month: str = "Month", min_flights: int = 30) -> DataFrame:
    """Previous present month's mean, change and label per carrier-month."""
    kept = monthly.filter(F.col("total_flights") >= min_flights)
    return kept.select(
        "airline", month, "avg_delay", "total_flights",
        lag_of("avg_delay", month, ["airline"]).alias("prev_month_avg"),
        period_change("avg_delay", month, ["airline"]).alias("mom_change"),
    ).withColumn("trend_label", lbl("mom_change", L.AIRLINE_TREND))


def momentum_layer(changes: DataFrame) -> DataFrame:
    mom = F.col("mom_change")
    return (
        changes.filter(mom.isNotNull())
        .groupBy("airline")
        .agg(
            F.count(F.lit(1)).alias("months_tracked"),
            r2(F.avg(mom)).alias("avg_mom_change"),
            r2(F.min(mom)).alias("best_single_month_improvement"),
            r2(F.max(mom)).alias("worst_single_month_worsening"),
            F.count_if(mom < 0).alias("months_improved"),
            F.count_if(mom > 0).alias("months_worsened"),
            lbl(exact(F.avg(mom)), L.OVERALL_TREND).alias("overall_trend"),
        )
        .orderBy(asc("avg_mom_change"), asc("airline"))
    )


def q05_monthly_changes(df: DataFrame, spec: FlightSpec = DEFAULT, min_flights: int = 30) -> DataFrame:
    """Per carrier and month: rounded mean, previous present month's mean, change, label."""
    return monthly_change_layer(carrier_month_stats(df, spec), spec.month, min_flights)


def q05_airline_momentum(df: DataFrame, spec: FlightSpec = DEFAULT, min_flights: int = 30) -> DataFrame:
    """Month-over-month momentum of each carrier's mean arrival delay."""
    return momentum_layer(q05_monthly_changes(df, spec, min_flights))


def severity_aggs(spec: FlightSpec = DEFAULT) -> list:
    s = spec
    return [
        F.count(F.lit(1)).alias("total_flights"),
        *bucket_counts(s.arr, {
            "severe_delay_flights": (L.SEVERE_ABOVE, None),
            "mild_delay_flights": L.MILD_BUCKET,
            "moderate_delay_flights": L.MODERATE_BUCKET,
        }),
        r2(F.avg(s.arr)).alias("avg_delay"),
    ]


def severity_layer(counts: DataFrame) -> DataFrame:
    """Rates, rank and label from per-carrier bucket counts."""
    tot = F.col("total_flights")
    rates = counts.select(
        "airline", "total_flights", "severe_delay_flights",
        pct("severe_delay_flights", tot).alias("severe_delay_rate"),
        pct("mild_delay_flights", tot).alias("mild_delay_rate"),
        pct("moderate_delay_flights", tot).alias("moderate_delay_rate"),
        "avg_delay",
    )
    return rates.select(
        rank_over(F.col("severe_delay_rate").desc_nulls_first()).alias("severity_rank"),
        "airline", "total_flights", "severe_delay_flights", "severe_delay_rate",
        "mild_delay_rate", "moderate_delay_rate", "avg_delay",
        lbl("severe_delay_rate", L.SEVERITY).alias("severity_profile"),
    ).orderBy(desc("severe_delay_rate"), asc("airline"))


def q06_severity_profile(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Share of each carrier's flights in the mild / moderate / severe buckets."""
    return severity_layer(df.groupBy(F.col(spec.carrier).alias("airline")).agg(*severity_aggs(spec)))


def airport_endpoint_stats(df: DataFrame, spec: FlightSpec = DEFAULT, with_origin_sums: bool = False) -> DataFrame:
    """Per airport, from one scan: flights over both ends, departures, and the
    origin-side arrival-delay mean/stddev (optionally also the origin-side
    delay sums the departure/arrival profile needs).

    Each flight is emitted once per endpoint, carrying its delays only on the
    origin row; one aggregate then yields everything (the SQL needs three
    scans and a join).
    """
    s = spec
    carry = {"dep_flag": (F.lit(1), "int"), "d": (F.col(s.arr), "double")}
    if with_origin_sums:
        carry["od"] = (F.col(s.dep), "double")
    e = endpoints(df, [s.origin, s.dest], "airport", carry)
    aggs = [
        F.count(F.lit(1)).alias("total_flights"),
        F.count("dep_flag").alias("departures"),
        r2(F.avg("d")).alias("avg_delay"),
        r2(F.stddev_samp("d")).alias("stddev_delay"),
    ]
    if with_origin_sums:
        aggs += [F.sum("od").alias("_sd"), F.count("od").alias("_nd"), F.sum("d").alias("_sa"),
                 F.count("d").alias("_na")]
    return e.groupBy("airport").agg(*aggs)


def volume_layer(stats: DataFrame, min_departures: int = 500, top: int | None = 30, busy: int = 20) -> DataFrame:
    """Ranks among qualifying airports (ranked after the departures filter)."""
    kept = stats.filter(F.col("airport").isNotNull() & (F.col("departures") >= min_departures))
    ranked = kept.withColumns({
        "volume_rank": rank_over(F.col("total_flights").desc_nulls_first()),
        "delay_rank": rank_over(F.col("avg_delay").desc_nulls_first()),
    })
    out = ranked.select(
        "volume_rank", "airport", "total_flights", "avg_delay", "stddev_delay", "delay_rank",
        (F.col("delay_rank") - F.col("volume_rank")).alias("rank_difference"),
        two_axis(F.col("volume_rank") <= busy, F.col("delay_rank") <= busy, L.AIRPORT_PROFILE_LABELS)
        .alias("airport_profile"),
    )
    order = [asc("volume_rank"), asc("airport")]
    return top_k(out, order, top) if top else out.orderBy(*order)


def q07_volume_vs_delay(
    df: DataFrame, spec: FlightSpec = DEFAULT, min_departures: int = 500, top: int | None = 30, busy: int = 20
) -> DataFrame:
    """Airport traffic (as origin or destination) against delay as origin."""
    return volume_layer(airport_endpoint_stats(df, spec), min_departures, top, busy)


def origin_sums(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    s = spec
    return df.groupBy(F.col(s.origin).alias("airport")).agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.sum(s.dep).alias("_sd"), F.count(s.dep).alias("_nd"),
        F.sum(s.arr).alias("_sa"), F.count(s.arr).alias("_na"),
    )


def profile_layer(per: DataFrame, min_flights: int = 500, literal: bool = False) -> DataFrame:
    """Departure/arrival profile of each origin against the network means.

    ``per`` has one row per origin with ``total_flights`` (departures) and
    the delay sums/counts; the network means are the same sums added up with
    a window over those rows (before the HAVING filter), so no second scan
    and no cross join. ``literal=True`` keeps the reference's label mismatch
    in the rank step, which leaves ``ground_ops_rank`` NULL everywhere.
    """
    w = Window.partitionBy()
    g = per.select(
        "airport", "total_flights",
        r2(F.try_divide(F.col("_sd"), F.col("_nd"))).alias("avg_dep_delay"),
        r2(F.try_divide(F.col("_sa"), F.col("_na"))).alias("avg_arr_delay"),
        r2(F.try_divide(F.sum("_sd").over(w), F.sum("_nd").over(w))).alias("global_avg_dep"),
        r2(F.try_divide(F.sum("_sa").over(w), F.sum("_na").over(w))).alias("global_avg_arr"),
    ).filter(F.col("total_flights") >= min_flights)
    dep, arr = F.col("avg_dep_delay"), F.col("avg_arr_delay")
    gdep, garr = F.col("global_avg_dep"), F.col("global_avg_arr")
    P = L.DELAY_PROFILE_LABELS
    profile = (
        F.when((dep > gdep) & (arr <= garr), F.lit(P["ground_ops"]))
        .when((dep <= gdep) & (arr > garr), F.lit(P["destination"]))
        .when((dep > gdep) & (arr > garr), F.lit(P["systemic"]))
        .otherwise(F.lit(P["normal"]))
    )
    classified = g.select(
        "airport", "total_flights", "avg_dep_delay", "avg_arr_delay",
        r2(dep - arr).alias("avg_recovery"),
        r2(dep - gdep).alias("dep_vs_global"),
        r2(arr - garr).alias("arr_vs_global"),
        profile.alias("delay_profile"),
        F.when((dep > gdep) & (arr <= garr), r2(dep - gdep)).alias("ground_ops_severity"),
    )
    target = L.GROUND_OPS_LITERAL_TYPO if literal else P["ground_ops"]
    ranked = classified.withColumn(
        "ground_ops_rank",
        F.when(F.col("delay_profile") == target,
               rank_over(F.col("ground_ops_severity").desc_nulls_first(), ["delay_profile"])),
    )
    prio = F.lit(len(L.DELAY_PROFILE_ORDER))
    for i, k in reversed(list(enumerate(L.DELAY_PROFILE_ORDER, start=1))):
        prio = F.when(F.col("delay_profile") == P[k], F.lit(i)).otherwise(prio)
    return ranked.select(
        "airport", "total_flights", "avg_dep_delay", "avg_arr_delay", "avg_recovery",
        "dep_vs_global", "arr_vs_global", "delay_profile", "ground_ops_rank",
    ).orderBy(prio, F.col("ground_ops_rank").asc_nulls_last(), asc("airport"))


def q08_dep_arr_profile(
    df: DataFrame, spec: FlightSpec = DEFAULT, min_flights: int = 500, literal: bool = False
) -> DataFrame:
    """Each origin's departure and arrival means against the network means."""
    return profile_layer(origin_sums(df, spec), min_flights, literal)


def q09_hour_risk(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Probability of a major / mild / moderate delay by departure hour."""
    s = spec
    hours = df.groupBy(F.col(s.hour).alias("dep_hour")).agg(
        F.count(F.lit(1)).alias("total_flights"),
        *bucket_counts(s.arr, {
            "major_delay_flights": (L.SEVERE_ABOVE, None),
            "mild_delay_flights": L.MILD_BUCKET,
            "moderate_delay_flights": L.MODERATE_BUCKET,
        }),
        r2(F.avg(s.arr)).alias("avg_arr_delay"),
        r2(F.avg(s.dep)).alias("avg_dep_delay"),
    )
    return hour_layer(hours)


def hour_layer(hours: DataFrame) -> DataFrame:
    """Probabilities, ranks and labels from per-hour bucket counts and means."""
    tot = F.col("total_flights")
    probs = hours.select(
        "dep_hour", "total_flights", "avg_arr_delay", "avg_dep_delay",
        pct("major_delay_flights", tot).alias("major_delay_prob"),
        pct("mild_delay_flights", tot).alias("mild_delay_prob"),
        pct("moderate_delay_flights", tot).alias("moderate_delay_prob"),
        time_of_day("dep_hour").alias("time_of_day"),
    )
    ranked = probs.withColumns({
        "probability_rank": rank_over(F.col("major_delay_prob").desc_nulls_first()),
        "avg_delay_rank": rank_over(F.col("avg_arr_delay").desc_nulls_first()),
    })
    return ranked.select(
        "probability_rank", "dep_hour", "time_of_day", "total_flights", "major_delay_prob",
        "mild_delay_prob", "moderate_delay_prob", "avg_arr_delay", "avg_dep_delay",
        (F.col("probability_rank") - F.col("avg_delay_rank")).alias("rank_divergence"),
        lbl("major_delay_prob", L.HOUR_RISK).alias("risk_label"),
    ).orderBy(asc("probability_rank"), asc("dep_hour"))


def monthly_stats(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    s = spec
    return df.groupBy(s.month).agg(
        F.count(F.lit(1)).alias("total_flights"),
        r2(F.avg(s.arr)).alias("avg_arr_delay"),
        pct(F.count_if(F.col(s.arr) > L.SEVERE_ABOVE), F.count(F.lit(1))).alias("severe_rate"),
    )


def monthly_layer(monthly: DataFrame, m: str = "Month", window_months: int = 3) -> DataFrame:
    """Rolling, month-over-month and cumulative views of monthly rounded means."""
    avg = F.col("avg_arr_delay")
    rolled = monthly.select(
        m, "total_flights", "avg_arr_delay", "severe_rate",
        r2(rolling_mean(avg, m, window_months)).alias("rolling_3m_avg"),
        period_change(avg, m).alias("mom_change"),
        r2(running_mean(avg, m)).alias("cumulative_avg"),
        r2(avg - running_mean(avg, m)).alias("vs_cumulative_avg"),
    )
    return rolled.select(
        m, month_name(m).alias("month_name"), season(m).alias("season"), "total_flights",
        "avg_arr_delay", "rolling_3m_avg", "mom_change", lbl("mom_change", L.MONTH_TREND).alias("mom_trend"),
        "cumulative_avg", "vs_cumulative_avg", lbl("vs_cumulative_avg", L.TREND_POSITION).alias("trend_position"),
        "severe_rate",
    ).orderBy(asc(m))


def q10_monthly_rolling(df: DataFrame, spec: FlightSpec = DEFAULT, window_months: int = 3) -> DataFrame:
    """Monthly mean with rolling, month-over-month and cumulative views."""
    return monthly_layer(monthly_stats(df, spec), spec.month, window_months)


def cause_items(spec: FlightSpec, with_max: bool) -> list[tuple[str, dict]]:
    items = []
    for i, (c, label) in enumerate(spec.causes):
        cols = {
            "total_minutes": F.col(f"_t{i}"),
            "flights_affected": F.col(f"_f{i}"),
            "avg_when_present": r2(F.col(f"_a{i}")),
        }
        if with_max:
            cols["max_single_flight"] = F.col(f"_m{i}")
        items.append((label, cols))
    return items


def cause_aggs(spec: FlightSpec, with_max: bool) -> list:
    aggs = []
    for i, c in enumerate(spec.cause_cols):
        x = F.col(c)
        aggs += [F.sum(x).alias(f"_t{i}"), F.count_if(x > 0).alias(f"_f{i}"), F.avg(F.when(x > 0, x)).alias(f"_a{i}")]
        if with_max:
            aggs.append(F.max(x).alias(f"_m{i}"))
    return aggs


def cause_totals(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Per cause: minutes, flights with a positive value, mean when present, max.

    One scan for all five causes (the SQL scans once per cause), then the
    one-row result is unpivoted.
    """
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *cause_aggs(spec, True))
    return unpivot_struct(wide, ["_rows"], cause_items(spec, True), "delay_cause")


def cause_attribution(long: DataFrame) -> DataFrame:
    """Shares, ranks and labels from per-cause totals (``delay_cause,
    total_minutes, flights_affected, avg_when_present, max_single_flight``
    plus the fact row count ``_rows``)."""
    t = long.select(
        "*",
        r2(share_of_total("total_minutes")).alias("pct_of_total_minutes"),
        pct("flights_affected", "_rows").alias("pct_flights_affected"),
    ).withColumns({
        "impact_rank": rank_over(F.col("total_minutes").desc_nulls_first()),
        "breadth_rank": rank_over(F.col("flights_affected").desc_nulls_first()),
        "severity_rank": rank_over(F.col("avg_when_present").desc_nulls_first()),
    })
    return t.select(
        "impact_rank", "delay_cause", "total_minutes", "pct_of_total_minutes", "flights_affected",
        "pct_flights_affected", "avg_when_present", "max_single_flight", "breadth_rank", "severity_rank",
        lbl("pct_of_total_minutes", L.IMPACT).alias("impact_label"),
        two_axis(F.col("breadth_rank") <= 2, F.col("severity_rank") <= 2, L.SPREAD_LABELS).alias("spread_label"),
    ).orderBy(asc("impact_rank"), asc("delay_cause"))


def q11_cause_totals(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Network-level delay attribution over the five cause columns."""
    return cause_attribution(cause_totals(df, spec))


def cause_rank_layer(wide: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Long (airline, cause) rows with rank and share, from per-carrier cause aggregates."""
    long = unpivot_struct(wide, ["airline"], cause_items(spec, False), "delay_cause")
    return long.withColumns({
        "cause_rank_within_airline": rank_over(F.col("total_minutes").desc_nulls_first(), ["airline"]),
        "pct_of_airline_total": r2(share_of_total("total_minutes", ["airline"])),
    })


def cause_ranks_per_carrier(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Per carrier and cause: minutes, rank within the carrier and share of its total."""
    wide = df.groupBy(F.col(spec.carrier).alias("airline")).agg(*cause_aggs(spec, False))
    return cause_rank_layer(wide, spec)


def dominant_layer(ranked: DataFrame) -> DataFrame:
    pair = top_two(
        ranked, "airline", "cause_rank_within_airline",
        {"delay_cause": "dominant_cause", "pct_of_airline_total": "_dom_pct",
         "flights_affected": "dominant_flights", "avg_when_present": "dominant_avg_mins"},
        {"delay_cause": "second_cause", "pct_of_airline_total": "_sec_pct"},
    )
    follows, deviates = L.NETWORK_LABELS
    return pair.select(
        "airline", "dominant_cause",
        pct_text("_dom_pct").alias("dominant_pct"),
        "second_cause",
        pct_text("_sec_pct").alias("second_pct"),
        "dominant_flights", "dominant_avg_mins",
        F.when(F.col("dominant_cause") == L.NETWORK_CAUSE, F.lit(follows)).otherwise(F.lit(deviates))
        .alias("vs_network"),
        lbl("_dom_pct", L.CONCENTRATION).alias("concentration_label"),
        F.col("_dom_pct"),
    ).orderBy(asc("vs_network"), desc("_dom_pct"), asc("airline"), asc("second_cause")).drop("_dom_pct")


def q12_dominant_cause(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Each carrier's dominant and second delay cause (RANK ties kept as in SQL)."""
    return dominant_layer(cause_ranks_per_carrier(df, spec))
