"""Cleaning stages: null rows, column drops, casts, clock hours, whitespace,
and the interquartile-range outlier filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import hhmm_hour, nan_to_null

# Fixed value: the characters Python's ``str.strip()`` removes for ASCII text.
WHITESPACE = " \t\n\r\x0b\x0c"

# Fixed value: columns whose nulls drop a row in the reference's cleaning step.
NULL_CHECK_COLUMNS = [
    "ArrTime", "ActualElapsedTime", "CRSElapsedTime", "AirTime", "ArrDelay", "TaxiIn",
    "TaxiOut", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay",
]
DROP_COLUMNS = ["TailNum", "Unnamed: 0"]
KEY_COLUMNS = ["UniqueCarrier", "Origin", "Dest"]


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows NULL in any of ``subset`` (all columns when omitted)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def cast_int(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Float -> integer by truncation, NULL-safe (``try_cast``)."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast("bigint") for c in cols})


def add_hours(df: DataFrame, mapping: dict[str, str], wrap: bool = False) -> DataFrame:
    """``{new_col: hhmm_col}`` -> ``new_col = hhmm_col // 100``."""
    return df.withColumns({new: hhmm_hour(F.col(src), wrap) for new, src in mapping.items()})


def strip(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Trim leading/trailing whitespace of every kind (``trim`` only drops spaces)."""
    return df.withColumns({c: F.btrim(F.col(c), F.lit(WHITESPACE)) for c in cols})


def iqr_bounds(
    df: DataFrame, measures: Sequence[str], k: float = 1.5, approx: bool = False, accuracy: int = 100000
) -> DataFrame:
    """One-row frame of ``{m}_q1, {m}_q3, {m}_lower, {m}_upper`` per measure.

    Exact quantiles (linear interpolation, as pandas) come from a
    range-partitioned value histogram, of which only the parts that hold a
    quartile are sorted; ``approx=True`` takes ``percentile_approx`` (a
    mergeable sketch) instead. All measures share one scan of the same
    pre-filter frame.
    """
    df = df.withColumns({m: nan_to_null(F.col(m)) for m, t in df.dtypes if m in measures and t in ("double", "float")})
    if approx:
        aggs = []
        for m in measures:
            qs = F.percentile_approx(F.col(m), [0.25, 0.75], accuracy)
            aggs += [qs[0].cast("double").alias(f"{m}_q1"), qs[1].cast("double").alias(f"{m}_q3")]
        q = df.agg(*aggs)
    else:
        from tarmac.operators.aggregates import exact_quantiles

        return bounds_of(exact_quantiles(df, measures, [0.25, 0.75]), measures, k)
    return _spread(q, measures, k)


def bounds_of(quartiles: DataFrame, measures: Sequence[str], k: float = 1.5) -> DataFrame:
    """The bounds from rows (measure, [q1, q3])."""
    aggs = []
    for m in measures:
        mine = F.col("measure") == m
        aggs += [F.max(F.when(mine, F.col("q")[0])).alias(f"{m}_q1"), F.max(F.when(mine, F.col("q")[1])).alias(f"{m}_q3")]
    return _spread(quartiles.agg(*aggs), measures, k)


def _spread(q: DataFrame, measures: Sequence[str], k: float) -> DataFrame:
    out = []
    for m in measures:
        q1, q3 = F.col(f"{m}_q1"), F.col(f"{m}_q3")
        iqr = q3 - q1
        out += [q1, q3, (q1 - F.lit(k) * iqr).alias(f"{m}_lower"), (q3 + F.lit(k) * iqr).alias(f"{m}_upper")]
    return q.select(*out)


def iqr_filter_with(df: DataFrame, bounds: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Keep rows whose every measure lies inside its inclusive bounds.

    The bounds enter as scalar subqueries (``DataFrame.scalar``): Spark runs
    the one-row plan once, merges the four lookups into one struct, and the
    filter stays inside the scan's codegen stage. No cross join, no driver
    round trip.
    """
    cond = None
    for m in measures:
        lo = bounds.select(F.col(f"{m}_lower")).scalar()
        hi = bounds.select(F.col(f"{m}_upper")).scalar()
        c = (F.col(m) >= lo) & (F.col(m) <= hi)
        cond = c if cond is None else cond & c
    return df.filter(cond)


def iqr_filter(df: DataFrame, measures: Sequence[str], k: float = 1.5, approx: bool = False) -> DataFrame:
    """Outlier filter with bounds computed on ``df`` itself (lazy)."""
    return iqr_filter_with(df, iqr_bounds(df, measures, k, approx), measures)


def override_hour(df: DataFrame, hour_col: str = "DepHour", source: str = "CRSDepTime") -> DataFrame:
    """Redefine the hour from the scheduled clock time (done after filtering)."""
    return df.withColumn(hour_col, hhmm_hour(F.col(source)))


def pipeline_clean(raw: DataFrame, measures: Sequence[str] = ("ArrDelay", "DepDelay"), k: float = 1.5):
    """The whole cleaning pipeline on a raw flight frame.

    Returns ``(original, filtered)``: ``original`` after dropping incomplete
    rows, surplus columns, truncating clock times, deriving hours and trimming
    keys; ``filtered`` additionally passes the IQR filter and has its
    ``DepHour`` taken from the scheduled departure time.
    """
    df = drop_null_rows(raw, [c for c in NULL_CHECK_COLUMNS if c in raw.columns])
    df = drop_columns(df, DROP_COLUMNS)
    df = cast_int(df, ["DepTime", "ArrTime"])
    df = add_hours(df, {"DepHour": "DepTime", "ArrHour": "ArrTime"})
    original = strip(df, [c for c in KEY_COLUMNS if c in df.columns])
    return original, filter_cleaned(original, measures, k)


def filter_cleaned(original: DataFrame, measures: Sequence[str] = ("ArrDelay", "DepDelay"), k: float = 1.5) -> DataFrame:
    """The outlier filter on cleaned rows; ``DepHour`` from the scheduled time."""
    return override_hour(iqr_filter(original, list(measures), k))
