"""Counted facts: small aggregates from one pass, which many results roll up.

``calendar`` cells are per carrier, month and departure hour, ``route`` cells
per origin, destination and month. Neither grows with the number of flights.
A cell holds counts, sums and squared deviations, never means, so cells add
up to any coarser key. They are kept (``tarmac.session.keep``): building a
result from them runs nothing, and all results over the same facts share
them until they are released.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import labels as L
from tarmac.functions.labels import route
from tarmac.functions.numeric import pct, r2
from tarmac.operators.aggregates import bucket_counts
from tarmac.plans import analyses as Q
from tarmac.session import keep
from tarmac.spec import DEFAULT, FlightSpec

BUCKETS = {"severe": (L.SEVERE_ABOVE, None), "mild": L.MILD_BUCKET, "moderate": L.MODERATE_BUCKET}


def cell_aggs(spec: FlightSpec) -> list[Column]:
    arr, dep = F.col(spec.arr), F.col(spec.dep)
    out = [F.count(F.lit(1)).alias("n"), F.count(arr).alias("arr_n"), F.sum(arr).alias("arr_sum"), F.var_pop(arr).alias("arr_var"), F.count(dep).alias("dep_n"),
           F.sum(dep).alias("dep_sum"), F.count(dep - arr).alias("gain_n"), F.sum(dep - arr).alias("gain_sum"), *bucket_counts(spec.arr, BUCKETS)]
    for i, c in enumerate(spec.cause_cols):
        x = F.col(c)
        out += [F.sum(x).alias(f"t{i}"), F.count_if(x > 0).alias(f"f{i}"), F.sum(F.when(x > 0, x)).alias(f"p{i}"), F.max(x).alias(f"m{i}")]
    return out


def _calendar_keys(spec: FlightSpec) -> list[Column]:
    return [F.col(spec.carrier).alias("airline"), F.col(spec.month).alias("month"), F.col(spec.hour).alias("hour")]


def _route_keys(spec: FlightSpec) -> list[Column]:
    return [F.col(spec.origin).alias("origin"), F.col(spec.dest).alias("dest"), F.col(spec.month).alias("month")]


def calendar_cells(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return keep(df.groupBy(*_calendar_keys(spec)).agg(*cell_aggs(spec)))


def route_cells(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return keep(df.groupBy(*_route_keys(spec)).agg(*cell_aggs(spec)))


def all_cells(df: DataFrame, spec: FlightSpec = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Both kinds of cells from the same pass: (calendar, route)."""
    keys = [(spec.carrier, "airline"), (spec.hour, "hour"), (spec.origin, "origin"), (spec.dest, "dest")]
    types = dict(df.dtypes)

    def kind(by_route: bool) -> Column:
        mine = [F.col(c) if (c in (spec.origin, spec.dest)) == by_route else F.lit(None).cast(types[c]) for c, _ in keys]
        return F.struct(F.lit(by_route).alias("by_route"), F.col(spec.month).alias("month"), *[v.alias(name) for v, (_, name) in zip(mine, keys)])

    # Grouping sets would do, but an equal plan of theirs is not recognised as kept where both ends of a list are united.
    twice = df.select(*[F.col(c) for c in (spec.arr, spec.dep, *spec.cause_cols)], F.inline(F.array(kind(False), kind(True))))
    both = keep(twice.groupBy("by_route", "month", *[name for _, name in keys]).agg(*cell_aggs(spec)))
    return both.where("NOT by_route"), both.where("by_route")


# -- sums of cells ------------------------------------------------------------

def flights() -> Column:
    return F.sum("n").cast("bigint")


def mean(of: str) -> Column:
    """Rounded mean of arr, dep or gain (departure less arrival delay)."""
    return r2(F.try_divide(F.sum(f"{of}_sum"), F.sum(f"{of}_n")))


def spread() -> Column:
    """Rounded sample standard deviation of the arrival delay, from the cells'
    own deviations and those of their means."""
    s, n = F.col("arr_sum"), F.col("arr_n")
    total = F.sum("arr_n")
    about = F.sum(F.col("arr_var") * n) + F.sum(F.try_divide(s * s, n)) - F.try_divide(F.sum(s) * F.sum(s), total)
    return r2(F.sqrt(F.greatest(F.try_divide(about, F.nullif(total - 1, F.lit(0))), F.lit(0.0)) + F.when(total < 2, F.lit(None).cast("double")).otherwise(F.lit(0.0))))


def bucket(name: str) -> Column:
    return F.sum(name).cast("bigint")


def cause_sums(spec: FlightSpec = DEFAULT, with_max: bool = False) -> list[Column]:
    out = []
    for i in range(len(spec.cause_cols)):
        hits = F.sum(f"f{i}").cast("bigint")
        out += [F.sum(f"t{i}").alias(f"_t{i}"), hits.alias(f"_f{i}"), F.try_divide(F.sum(f"p{i}"), hits).alias(f"_a{i}")]
        if with_max:
            out.append(F.max(f"m{i}").alias(f"_m{i}"))
    return out


# -- the analyses' inputs, rolled up ------------------------------------------

def severity_counts(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy("airline").agg(flights().alias("total_flights"), *[bucket(b).alias(f"{b}_delay_flights") for b in BUCKETS], mean("arr").alias("avg_delay"))


def carrier_spread(calendar: DataFrame, min_flights: int = 100) -> DataFrame:
    stats = calendar.groupBy("airline").agg(flights().alias("total_flights"), mean("arr").alias("avg_delay"), spread().alias("stddev_delay"))
    return stats.where(F.col("total_flights") >= min_flights)


def carrier_months(calendar: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return calendar.groupBy("airline", F.col("month").alias(spec.month)).agg(mean("arr").alias("avg_delay"), flights().alias("total_flights"))


def months(calendar: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return calendar.groupBy(F.col("month").alias(spec.month)).agg(
        flights().alias("total_flights"), mean("arr").alias("avg_arr_delay"), pct(bucket("severe"), flights()).alias("severe_rate"))


def hours(calendar: DataFrame) -> DataFrame:
    return calendar.groupBy(F.col("hour").alias("dep_hour")).agg(
        flights().alias("total_flights"), bucket("severe").alias("major_delay_flights"), bucket("mild").alias("mild_delay_flights"),
        bucket("moderate").alias("moderate_delay_flights"), mean("arr").alias("avg_arr_delay"), mean("dep").alias("avg_dep_delay"))


def causes(calendar: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    wide = calendar.agg(F.coalesce(flights(), F.lit(0).cast("bigint")).alias("_rows"), *cause_sums(spec, True))
    return Q.unpivot_struct(wide, ["_rows"], Q.cause_items(spec, True), "delay_cause")


def carrier_causes(calendar: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return calendar.groupBy("airline").agg(*cause_sums(spec))


def route_months(routes: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    monthly = routes.groupBy("origin", "dest", F.col("month").alias(spec.month)).agg(mean("arr").alias("avg_delay"))
    return monthly.select(route("origin", "dest").alias("route"), spec.month, "avg_delay")


def route_means(routes: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return routes.groupBy(F.col("origin").alias(spec.origin), F.col("dest").alias(spec.dest)).agg(mean("arr").alias("avg_delay"))


def route_gains(routes: DataFrame) -> DataFrame:
    return routes.groupBy("origin", "dest").agg(mean("dep").alias("avg_dep_delay"), mean("arr").alias("avg_arr_delay"), mean("gain").alias("avg_recovery"),
                                                flights().alias("total_flights")).withColumn("route", route("origin", "dest"))


def airports(routes: DataFrame) -> DataFrame:
    """Per airport: flights over both ends, departures, and the delays of the departures."""
    nothing = {c: F.lit(None) for c in ("arr_n", "arr_sum", "arr_var", "dep_n", "dep_sum")}
    start = F.struct(F.col("origin").alias("airport"), F.col("n").alias("out"), *[F.col(c) for c in nothing])
    end = F.struct(F.col("dest").alias("airport"), F.lit(0).cast("bigint").alias("out"), *[v.cast("bigint" if c.endswith("_n") else "double").alias(c) for c, v in nothing.items()])
    ends = routes.select("n", F.inline(F.array(start, end)))
    return ends.groupBy("airport").agg(
        flights().alias("total_flights"), F.sum("out").cast("bigint").alias("departures"), mean("arr").alias("avg_delay"), spread().alias("stddev_delay"),
        F.sum("dep_sum").alias("_sd"), F.coalesce(F.sum("dep_n"), F.lit(0)).alias("_nd"), F.sum("arr_sum").alias("_sa"), F.coalesce(F.sum("arr_n"), F.lit(0)).alias("_na"))


def departures_of(stats: DataFrame) -> DataFrame:
    """The rows of ``airports`` as input of the departure and arrival profile."""
    return stats.where("departures > 0").select("airport", F.col("departures").alias("total_flights"), "_sd", "_nd", "_sa", "_na")


def analyses(calendar: DataFrame, routes: DataFrame, spec: FlightSpec = DEFAULT) -> dict[str, Callable[[], DataFrame]]:
    """The twelve analyses, read from the cells."""
    s = spec
    return {
        "q01_repeat_worst_routes": lambda: Q.repeat_worst_layer(route_months(routes, s), s.month),
        "q02_route_symmetry": lambda: Q.symmetry_layer(route_means(routes, s), s),
        "q03_delay_recovery": lambda: Q.recovery_layer(route_gains(routes)),
        "q04_airline_consistency": lambda: Q.consistency_layer(carrier_spread(calendar)),
        "q05_airline_momentum": lambda: Q.momentum_layer(Q.monthly_change_layer(carrier_months(calendar, s), s.month)),
        "q06_severity_profile": lambda: Q.severity_layer(severity_counts(calendar)),
        "q07_volume_vs_delay": lambda: Q.volume_layer(airports(routes)),
        "q08_dep_arr_profile": lambda: Q.profile_layer(departures_of(airports(routes))),
        "q09_hour_risk": lambda: Q.hour_layer(hours(calendar)),
        "q10_monthly_rolling": lambda: Q.monthly_layer(months(calendar, s), s.month),
        "q11_cause_totals": lambda: Q.cause_attribution(causes(calendar, s)),
        "q12_dominant_cause": lambda: Q.dominant_layer(Q.cause_rank_layer(carrier_causes(calendar, s), s)),
    }
