"""Registry of runnable queries: key -> ``(spark, sf_dir) -> DataFrame``.

Keys are the inventory ids of the design survey. Every callable reads the
folder's tables (through the materialised flight table derived from them),
so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarmac.plans import analyses as Q
from tarmac.plans import eda as E
from tarmac.plans import marts as M
from tarmac.plans import scope as D
from tarmac.sources.flights import flights

Query = Callable[[SparkSession, str], DataFrame]


def on_flights(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(flights(spark, sf_dir), **kw)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


ANALYSES: dict[str, Query] = {
    "scope_total_flights": on_flights(D.scope_total_flights),
    "scope_total_airports": on_flights(D.scope_total_airports),
    "scope_total_airlines": on_flights(D.scope_total_airlines),
    "scope_arrdelay_range": on_flights(D.scope_arrdelay_range),
    "scope_depdelay_range": on_flights(D.scope_depdelay_range),
    "scope_avg_delays": on_flights(D.scope_avg_delays),
    "q01_repeat_worst_routes": on_flights(Q.q01_repeat_worst_routes),
    "q02_route_symmetry": on_flights(Q.q02_route_symmetry),
    "q03_delay_recovery": on_flights(Q.q03_delay_recovery),
    "q04_airline_consistency": on_flights(Q.q04_airline_consistency),
    "q05_airline_momentum": on_flights(Q.q05_airline_momentum),
    "q05_monthly_changes": on_flights(Q.q05_monthly_changes),
    "q06_severity_profile": on_flights(Q.q06_severity_profile),
    "q07_volume_vs_delay": on_flights(Q.q07_volume_vs_delay),
    "q08_dep_arr_profile": on_flights(Q.q08_dep_arr_profile),
    "q09_hour_risk": on_flights(Q.q09_hour_risk),
    "q10_monthly_rolling": on_flights(Q.q10_monthly_rolling),
    "q11_cause_totals": on_flights(Q.q11_cause_totals),
    "q12_dominant_cause": on_flights(Q.q12_dominant_cause),
    "eda_airline_means": on_flights(E.eda_airline_means),
    "eda_month_means": on_flights(E.eda_month_means),
    "eda_origin_means": on_flights(E.eda_origin_means),
    "eda_dest_means": on_flights(E.eda_dest_means),
    "eda_hour_means": on_flights(E.eda_hour_means),
    "eda_hour_counts": on_flights(E.eda_hour_counts),
    "eda_cause_means": on_flights(E.eda_cause_means),
    "eda_cause_share": on_flights(E.eda_cause_share),
    "eda_corr": on_flights(E.eda_corr),
    "eda_extremes": on_flights(E.eda_extremes),
    "mart_kpi": on_flights(M.mart_kpi),
    "mart_controllable_pct": on_flights(M.mart_controllable_pct),
    "mart_monthly_trend": on_flights(M.mart_monthly_trend),
    "mart_cause_contribution": on_flights(M.mart_cause_contribution),
    "mart_airline_performance": on_flights(M.mart_airline_performance),
    "mart_routes": on_flights(M.mart_routes),
    "mart_airport_profiles": on_flights(M.mart_airport_profiles),
    "mart_rag_tier": on_flights(M.mart_rag_tier),
    "mart_dep_hour_risk": on_flights(M.mart_dep_hour_risk),
    "mart_executive": on_flights(M.mart_executive),
    "mart_deep_dive": on_flights(M.mart_deep_dive),
    "mart_airport": on_flights(M.mart_airport),
    "mart_pivot_airline_month": on_flights(M.mart_pivot_airline_month),
}


def queries() -> dict[str, Query]:
    from tarmac.plans.inventory import OPERATOR_QUERIES
    from tarmac.plans.io_queries import IO_QUERIES
    from tarmac.plans.spark_sql import FORMS, STATEMENTS, sql_query

    sql = {f"sql_{k}": sql_query(k) for k in STATEMENTS}
    surface = {k: sql_query(k) for k in FORMS}
    return {**ANALYSES, **OPERATOR_QUERIES, **IO_QUERIES, **sql, **surface}


def oracle_sql() -> dict[str, str]:
    from tarmac.plans.oracle import SQL
    from tarmac.plans.oracle_ops import SQL as OPS
    from tarmac.plans.spark_sql import STATEMENTS

    same = {f"sql_{k}": SQL[k] for k in STATEMENTS}
    keys = queries()
    return {k: v for k, v in {**SQL, **OPS, **same}.items() if k in keys}
