"""Dataset-scope queries (D1-D6): one small aggregate each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import r2
from tarmac.spec import DEFAULT, FlightSpec


def scope_total_flights(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_flights"))


def _distinct(c, approx: bool, rsd: float):
    """Exact distinct count (two-phase distinct aggregation), or a mergeable
    HyperLogLog++ sketch when ``approx`` (constant memory per task)."""
    return F.approx_count_distinct(c, rsd) if approx else F.count_distinct(c)


def scope_total_airports(df: DataFrame, spec: FlightSpec = DEFAULT, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Distinct airports over both endpoints, in one scan (explode, not UNION)."""
    ends = df.select(F.explode(F.array(F.col(spec.origin), F.col(spec.dest))).alias("airport"))
    return ends.agg(_distinct(F.col("airport"), approx, rsd).alias("total_airports"))


def scope_total_airlines(df: DataFrame, spec: FlightSpec = DEFAULT, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    return df.agg(_distinct(F.col(spec.carrier), approx, rsd).alias("total_airlines"))


def scope_arrdelay_range(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return df.agg(F.min(spec.arr).alias("min_arrdelay"), F.max(spec.arr).alias("max_arrdelay"))


def scope_depdelay_range(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return df.agg(F.min(spec.dep).alias("min_depdelay"), F.max(spec.dep).alias("max_depdelay"))


def scope_avg_delays(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return df.agg(r2(F.avg(spec.arr)).alias("avg_arrdelay"), r2(F.avg(spec.dep)).alias("avg_depdelay"))


def scope_summary(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """All six scope figures from a single scan."""
    s = spec
    return df.agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.count_distinct(s.carrier).alias("total_airlines"),
        F.min(s.arr).alias("min_arrdelay"), F.max(s.arr).alias("max_arrdelay"),
        F.min(s.dep).alias("min_depdelay"), F.max(s.dep).alias("max_depdelay"),
        r2(F.avg(s.arr)).alias("avg_arrdelay"), r2(F.avg(s.dep)).alias("avg_depdelay"),
    )
