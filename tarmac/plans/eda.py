"""Exploratory aggregates of the notebook (E1-E10).

pandas ``groupby`` drops NULL keys and its means skip NaN; these plans
filter NULL keys explicitly (NaN is normalised to NULL at ingest). Means
are reported at 6 dp (the notebook prints full doubles).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.labels import month_name
from tarmac.functions.numeric import rnd
from tarmac.operators.aggregates import column_means, corr_matrix
from tarmac.operators.windows import share_of_total
from tarmac.spec import DEFAULT, FlightSpec

MEAN_SCALE = 6


def group_means(df: DataFrame, key: str, measures, scale: int = MEAN_SCALE) -> DataFrame:
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(*[rnd(F.avg(m), scale).alias(m) for m in measures])
    )


def eda_airline_means(df: DataFrame, spec: FlightSpec = DEFAULT, by: str | None = None) -> DataFrame:
    return group_means(df, spec.carrier, spec.measures).orderBy(F.desc(by or spec.arr), F.asc(spec.carrier))


def eda_month_means(df: DataFrame, spec: FlightSpec = DEFAULT, by: str | None = None) -> DataFrame:
    g = group_means(df, spec.month, spec.measures)
    return g.withColumn("Month_Name", month_name(spec.month)).orderBy(F.desc(by or spec.arr), F.asc(spec.month))


def eda_origin_means(df: DataFrame, spec: FlightSpec = DEFAULT, by: str | None = None) -> DataFrame:
    return group_means(df, spec.origin, spec.measures).orderBy(F.desc(by or spec.arr), F.asc(spec.origin))


def eda_dest_means(df: DataFrame, spec: FlightSpec = DEFAULT, by: str | None = None) -> DataFrame:
    return group_means(df, spec.dest, spec.measures).orderBy(F.desc(by or spec.arr), F.asc(spec.dest))


def eda_hour_means(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return group_means(df, spec.hour, spec.measures).orderBy(spec.hour)


def eda_hour_counts(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    return (
        df.filter(F.col(spec.hour).isNotNull())
        .groupBy(spec.hour)
        .agg(F.count(F.lit(1)).alias("flights"))
        .orderBy(spec.hour)
    )


def eda_cause_means(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    m = column_means(df, spec.cause_cols, "cause", "mean_minutes")
    return m.withColumn("mean_minutes", rnd("mean_minutes", MEAN_SCALE))


def eda_cause_share(df: DataFrame, spec: FlightSpec = DEFAULT) -> DataFrame:
    """Each cause's share of the summed cause means, at 1 dp (pie-chart labels)."""
    m = column_means(df, spec.cause_cols, "cause", "mean_minutes")
    share = rnd(share_of_total("mean_minutes"), 1)
    return m.select(
        "cause",
        rnd("mean_minutes", MEAN_SCALE).alias("mean_minutes"),
        share.alias("share_pct"),
        F.concat(share.cast("decimal(38,1)").cast("string"), F.lit("%")).alias("share_text"),
    )


def eda_corr(df: DataFrame, spec: FlightSpec = DEFAULT, scale: int = 4) -> DataFrame:
    return corr_matrix(df, spec.corr_cols, scale)


def eda_extremes(df: DataFrame, spec: FlightSpec = DEFAULT, scale: int = MEAN_SCALE) -> DataFrame:
    """Highest and lowest group per measure for carrier, month, origin and dest.

    One scan: each row is emitted once per dimension (as ``(dimension, key)``),
    a single aggregate gives every group's means, and a per-dimension window
    picks both ends (ties broken by the key, ascending).
    """
    s = spec
    dims = [("carrier", s.carrier), ("month", s.month), ("origin", s.origin), ("dest", s.dest)]
    items = [F.struct(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("key")) for n, c in dims]
    e = df.select(F.inline(F.array(*items)), *[F.col(m) for m in s.measures]).filter(F.col("key").isNotNull())
    g = e.groupBy("dimension", "key").agg(*[rnd(F.avg(m), scale).alias(m) for m in s.measures])
    ranks = {}
    for i, m in enumerate(s.measures):
        ranks[f"_hi{i}"] = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc(m), F.asc("key")))
        ranks[f"_lo{i}"] = F.row_number().over(Window.partitionBy("dimension").orderBy(F.asc(m), F.asc("key")))
    picks = []
    for i, m in enumerate(s.measures):
        for end, col in (("hi", "key"), ("hi", m), ("lo", "key"), ("lo", m)):
            picks.append(F.max(F.when(F.col(f"_{end}{i}") == 1, F.col(col))).alias(f"{end}{i}_{col}"))
    wide = g.withColumns(ranks).groupBy("dimension").agg(*picks)
    items = [
        F.struct(F.lit(m).alias("measure"), F.col(f"hi{i}_key").alias("highest"), F.col(f"hi{i}_{m}").alias("highest_mean"),
                 F.col(f"lo{i}_key").alias("lowest"), F.col(f"lo{i}_{m}").alias("lowest_mean"))
        for i, m in enumerate(s.measures)
    ]
    return wide.select("dimension", F.inline(F.array(*items)))
