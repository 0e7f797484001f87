"""Report-layer tables (the reference's spreadsheet and dashboard feeds,
whose files are not published; built from the prose description).

All marts are compositions of the analyses' layers over counted facts
(``tarmac.plans.cells``): one pass over the facts makes small cells, and all
of a mart's parts, and all marts over the same facts, roll those up. Building
a mart runs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.labels import month_name, rag, time_of_day
from tarmac.functions.numeric import r2
from tarmac.operators.aggregates import pivot_mean
from tarmac.operators.reshape import union_all
from tarmac.plans import analyses as Q
from tarmac.plans import cells as C
from tarmac.spec import DEFAULT, FlightSpec

CONTROLLABLE = ("Late Aircraft Delay", "Carrier Delay")


def _kv(df: DataFrame, metric: str, value) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), value.cast("string").alias("value"))


def mart_controllable_pct(df: DataFrame, spec: FlightSpec = DEFAULT, causes=CONTROLLABLE) -> DataFrame:
    """Airline-controllable share of cause minutes: the sum of the rounded
    shares of the controllable causes (40.67 + 29.95 = 70.62 in the reference)."""
    q = Q.q11_cause_totals(df, spec)
    return q.filter(F.col("delay_cause").isin(*causes)).agg(r2(F.sum("pct_of_total_minutes")).alias("controllable_pct"))


def mart_kpi(df: DataFrame, spec: FlightSpec = DEFAULT, controllable=CONTROLLABLE) -> DataFrame:
    """Headline KPIs as ``(metric, value)`` text rows, from ONE scan.

    The calendar cells give the per-month, per-carrier and per-part-of-day
    means plus the global totals (about 40 rows, by grouping sets); every KPI
    is then read off those rows in one more single-row pass.
    ``avg_arrival_delay`` is the unweighted mean of the rounded monthly means
    (the README figure); ``avg_arrival_delay_rows`` is the row-level mean.
    Ties: "best"/"least" take the smallest key, "worst"/"most" the largest.
    """
    return kpi_rows(C.calendar_cells(df, spec), spec, controllable)


def kpi_rows(calendar: DataFrame, spec: FlightSpec = DEFAULT, controllable=CONTROLLABLE) -> DataFrame:
    s = spec
    labels = dict(s.causes)
    base = calendar.withColumns({"m": F.col("month"), "c": F.col("airline"), "w": time_of_day("hour")})
    g = base.groupingSets([("m",), ("c",), ("w",), ()], "m", "c", "w").agg(
        F.grouping_id().alias("gid"),
        C.flights().alias("n"),
        C.mean("arr").alias("avg"),
        *[F.sum(f"t{i}").alias(c) for i, c in enumerate(s.cause_cols)],
    )
    gid = F.col("gid")
    by_month, by_carrier, by_window, overall = gid == 3, gid == 5, gid == 6, gid == 7

    def at(cond, col):
        return F.when(cond, col)

    k = g.agg(
        F.coalesce(F.max(at(overall, F.col("n"))), F.lit(0)).alias("total_flights"),
        r2(F.avg(at(by_month, F.col("avg")))).alias("avg_arrival_delay"),
        F.max(at(overall, F.col("avg"))).alias("avg_arrival_delay_rows"),
        *[F.max(at(overall, F.col(c))).alias(c) for c in s.cause_cols],
        F.min_by(at(by_month, month_name("m")), at(by_month, F.struct("avg", "m"))).alias("best_month"),
        F.max_by(at(by_month, month_name("m")), at(by_month, F.struct("avg", "m"))).alias("worst_month"),
        F.max_by(at(by_carrier, F.col("c")), at(by_carrier, F.struct("avg", "c"))).alias("most_delayed_airline"),
        F.min_by(at(by_carrier, F.col("c")), at(by_carrier, F.struct("avg", "c"))).alias("least_delayed_airline"),
        F.min_by(at(by_window, F.col("w")), at(by_window, F.struct("avg", "w"))).alias("best_time_window"),
    )
    # As in Q11: a cause without values has no share, and without any minutes there are no shares.
    total = sum((F.coalesce(c, F.lit(0.0)) for c in s.cause_cols[1:]), F.coalesce(s.cause_cols[0], F.lit(0.0)))
    shares = [r2(F.try_divide(F.lit(100.0) * F.col(c), total)) for c in s.cause_cols if labels[c] in controllable]
    some = F.coalesce(*shares).isNotNull()
    k = k.withColumn("controllable_pct", F.when(some, r2(sum((F.coalesce(x, F.lit(0.0)) for x in shares), F.lit(0.0)))))
    order = ["total_flights", "avg_arrival_delay", "avg_arrival_delay_rows", "controllable_pct", "best_month",
             "worst_month", "most_delayed_airline", "least_delayed_airline", "best_time_window"]
    rows = [F.struct(F.lit(name).alias("metric"), F.col(name).cast("string").alias("value")) for name in order]
    return k.select(F.inline(F.array(*rows)))


def mart_monthly_trend(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Q10 with best/worst month call-outs (ties: every tied month is flagged)."""
    return month_rows(C.calendar_cells(df, spec), spec)


def month_rows(calendar: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    from pyspark.sql import Window

    m = Q.monthly_layer(C.months(calendar, spec), spec.month)
    w = Window.partitionBy()
    return m.withColumns({
        "is_best_month": F.col("avg_arr_delay") == F.min("avg_arr_delay").over(w),
        "is_worst_month": F.col("avg_arr_delay") == F.max("avg_arr_delay").over(w),
    }).orderBy(spec.month)


def mart_cause_contribution(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return cause_rows(C.calendar_cells(df, spec), spec)


def cause_rows(calendar: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return Q.cause_attribution(C.causes(calendar, spec)).select(
        "impact_rank", "delay_cause", "total_minutes", "pct_of_total_minutes", "impact_label"
    )


def mart_airline_performance(df: DataFrame, spec: FlightSpec = DEFAULT, min_flights: int = 100,
                             min_monthly_flights: int = 30) -> DataFrame:
    """One row per carrier: severity (all carriers) left-joined with
    consistency, momentum and dominant cause, all rolled up from the calendar cells."""
    return airline_rows(C.calendar_cells(df, spec), spec, min_flights, min_monthly_flights)


def airline_rows(calendar: DataFrame, spec: FlightSpec = DEFAULT, min_flights: int = 100, min_monthly_flights: int = 30) -> DataFrame:
    sev = Q.severity_layer(C.severity_counts(calendar)).select(
        "airline", "total_flights", "avg_delay", "severity_rank", "severe_delay_rate", "severity_profile")
    con = Q.consistency_layer(C.carrier_spread(calendar, min_flights)).select(
        "airline", "consistency_rank", "stddev_delay", "consistency_label", "performance_profile")
    mom = Q.momentum_layer(Q.monthly_change_layer(C.carrier_months(calendar, spec), spec.month, min_monthly_flights)).select(
        "airline", "avg_mom_change", "overall_trend")
    dom = Q.dominant_layer(Q.cause_rank_layer(C.carrier_causes(calendar, spec), spec)).select(
        "airline", "dominant_cause", "dominant_pct", "concentration_label")
    # consistency and momentum have one row per carrier by construction; the
    # dominant-cause rows repeat only on a rank-2 tie and then agree on every
    # selected column, so distinct() makes them unique: plain left joins
    # never multiply a carrier here.
    out = sev.join(con, "airline", "left").join(mom, "airline", "left").join(dom.distinct(), "airline", "left")
    return out.orderBy("severity_rank", "airline")


def mart_routes(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Repeat-worst routes and best/worst recovery routes in one list, from the route cells."""
    routes = C.route_cells(df, spec)
    q1 = Q.repeat_worst_layer(C.route_months(routes, spec), spec.month).select(
        "route", F.lit("Repeat Worst").alias("list_name"), F.col("overall_avg_delay").alias("value"),
        F.col("months_in_top10"))
    q3 = Q.recovery_layer(C.route_gains(routes)).select(
        "route", F.col("category").alias("list_name"), F.col("avg_recovery").alias("value"),
        F.lit(None).cast("bigint").alias("months_in_top10"))
    return q1.unionByName(q3)


def mart_airport_profiles(df: DataFrame, spec: FlightSpec = DEFAULT, min_departures: int = 500) -> DataFrame:
    """Volume-versus-delay position and departure/arrival profile of every
    qualifying airport (no top-30 cut), from the route cells."""
    stats = C.airports(C.route_cells(df, spec))
    vol = Q.volume_layer(stats, min_departures, top=None)
    prof = Q.profile_layer(C.departures_of(stats), min_departures).select(
        "airport", "avg_dep_delay", "avg_arr_delay", "dep_vs_global", "arr_vs_global", "delay_profile")
    return vol.join(prof, "airport", "inner").orderBy("volume_rank", "airport")


def mart_rag_tier(df: DataFrame, spec: FlightSpec = DEFAULT, amber: float = 45.0, red: float = 55.0) -> DataFrame:
    """Red/Amber/Green tier of each carrier's mean arrival delay (cut-offs are parameters)."""
    s = spec
    g = df.groupBy(F.col(s.carrier).alias("airline")).agg(r2(F.avg(s.arr)).alias("avg_delay"))
    return g.withColumn("tier", rag("avg_delay", amber, red)).orderBy("airline")


def mart_dep_hour_risk(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return Q.q09_hour_risk(df, spec)


def mart_pivot_airline_month(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Carrier x month pivot of the rounded mean arrival delay (columns m01..m12)."""
    s = spec
    p = pivot_mean(df.withColumnRenamed(s.carrier, "airline"), "airline", s.month, list(range(1, 13)), s.arr)
    return p.select("airline", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)]).orderBy("airline")


def _section(df: DataFrame, section: str, item: str, value: str, label: str) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), F.col(value).cast("double").alias("value"), F.col(label).alias("label"))


def mart_executive(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """The executive dashboard in one long table ``(section, item, value,
    label)``: the nine KPIs (a number, or a name as label), months, causes and
    the airline ranking with each airline's measures. One scan."""
    calendar = C.calendar_cells(df, spec)
    number = F.col("value").try_cast("double")
    kpi = kpi_rows(calendar, spec).select(F.lit("kpi").alias("section"), F.col("metric").alias("item"), number.alias("value"), F.when(number.isNull(), F.col("value")).alias("label"))
    share = F.regexp_replace("dominant_pct", "%", "").cast("double")
    airline = airline_rows(calendar, spec).withColumn("dominant_share", share)
    measures = [F.struct(F.lit(f"airline: {value}").alias("section"), F.col("airline").cast("string").alias("item"), F.col(value).cast("double").alias("value"),
                         F.col(label).alias("label")) for value, label in AIRLINE_MEASURES]
    return union_all([kpi, _section(month_rows(calendar, spec), "month", "month_name", "avg_arr_delay", "mom_trend"),
                      _section(cause_rows(calendar, spec), "cause", "delay_cause", "pct_of_total_minutes", "impact_label"),
                      airline.select(F.inline(F.array(*measures)))])


#: The airline ranking's measures, each with the label beside it.
AIRLINE_MEASURES = [("severity_rank", "severity_profile"), ("total_flights", "performance_profile"), ("avg_delay", "severity_profile"), ("severe_delay_rate", "severity_profile"),
                    ("consistency_rank", "performance_profile"), ("stddev_delay", "consistency_label"), ("avg_mom_change", "overall_trend"), ("dominant_share", "dominant_cause")]


def mart_deep_dive(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """The root-cause dashboard: hours by risk, each airline's dominant cause,
    routes that regain or lose time. One scan."""
    of = C.analyses(*C.all_cells(df, spec), spec)
    routes = of["q03_delay_recovery"]()
    return union_all([
        _section(of["q09_hour_risk"](), "hour", "dep_hour", "major_delay_prob", "risk_label"),
        _section(of["q12_dominant_cause"](), "dominant cause", "airline", "dominant_avg_mins", "dominant_cause"),
        routes.select(F.col("category").alias("section"), F.col("route").alias("item"), F.col("avg_recovery").alias("value"), F.col("recovery_label").alias("label"))])


def mart_airport(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """The airport dashboard: volume against delay, and departure against the network."""
    both = mart_airport_profiles(df, spec)
    return union_all([_section(both, "volume and delay", "airport", "avg_delay", "airport_profile"),
                     _section(both, "departure and arrival", "airport", "dep_vs_global", "delay_profile")])
