"""Data profiling in single-pass aggregates (the reference runs one eager
pass per call; here each profile is one job whose result is report sized)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import rnd


def _long(wide: DataFrame, items: list[tuple[str, dict[str, Column]]], label: str) -> DataFrame:
    structs = [F.struct(F.lit(t).alias(label), *[c.alias(n) for n, c in cols.items()]) for t, cols in items]
    return wide.select(F.inline(F.array(*structs)))


def schema_info(df: DataFrame) -> DataFrame:
    """``info()``: column name, type and non-NULL count, one row per column."""
    wide = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    items = [
        (f.name, {"data_type": F.lit(f.dataType.simpleString()), "non_null": F.col(f"n{i}")})
        for i, f in enumerate(df.schema.fields)
    ]
    return _long(wide, items, "column_name")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    return _long(wide, [(c, {"null_count": F.col(f"n{i}")}) for i, c in enumerate(cols)], "column_name")


# Fixed value: the surrogate row-number column of the reference's raw file.
SURROGATE_KEYS = ("Unnamed: 0",)


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None,
                    exclude: Sequence[str] = SURROGATE_KEYS) -> DataFrame:
    """Rows equal to an earlier row on ``cols`` (NULL equals NULL): sum(n - 1)
    over groups. By default every column except a surrogate row number
    (with it, no row could ever repeat). Rows meet by a 64-bit hash first, so
    eight bytes a row are shuffled; only rows whose hash repeats are compared
    in full, which keeps the count exact. Reads ``df`` twice."""
    cols = list(cols or [c for c in df.columns if c not in set(exclude)])
    keys = [F.col(f"`{c}`") for c in cols]
    hashed = df.select(*keys, F.xxhash64(*keys).alias("_hash"))
    again = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    g = hashed.join(again, "_hash", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """``unique()``: every distinct value including NULL."""
    return df.select(F.col(col)).distinct()


def distinct_of_each(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``unique()`` of several columns as (column_name, value) rows, from one
    scan: values are combined per column in each task before the shuffle."""
    items = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*items))).distinct()


def describe(df: DataFrame, cols: Sequence[str], scale: int = 4) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (exact, interpolated), max.

    One row per column, statistics rounded at ``scale``, all read from one
    range-partitioned value histogram of one scan. A column without values
    still gets a row (count 0).
    """
    from tarmac.operators.histogram import moments, quantiles, value_histogram

    hist = value_histogram(df, cols)
    both = moments(hist).join(quantiles(hist, [0.25, 0.5, 0.75]), "measure", "left")
    return both.select(
        F.col("measure").alias("column_name"), "count", rnd("mean", scale).alias("mean"), rnd("std", scale).alias("std"), "min",
        *[rnd(F.col("q")[i], scale).alias(name) for i, name in enumerate(("p25", "p50", "p75"))], "max")


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[a for i, c in enumerate(cols) for a in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))])
    items = [(c, {"min_value": F.col(f"lo{i}").cast("double"), "max_value": F.col(f"hi{i}").cast("double")})
             for i, c in enumerate(cols)]
    return _long(wide, items, "column_name")


def boxplot_stats(df: DataFrame, cols: str | Sequence[str], k: float = 1.5) -> DataFrame:
    """The numbers behind a box plot of each column: quartiles, whisker ends
    (furthest data point inside ``k``·IQR) and the outlier count. One scan."""
    from tarmac.operators.histogram import box_numbers, value_histogram

    return box_numbers(value_histogram(df, [cols] if isinstance(cols, str) else cols), k).withColumnRenamed("measure", "column_name")


def boxplot_stages(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """``boxplot_stats`` of each column before and after the outlier filter over
    all of them, with the column ``stage``, from one scan.

    Rows are counted by their values in all columns together; the histograms
    of both stages are sums of those counts, and the filter's bounds follow
    from the first.
    """
    from tarmac.operators.clean import bounds_of, iqr_filter_with
    from tarmac.operators.histogram import box_numbers, quantiles, value_histogram
    from tarmac.session import keep

    cols = list(cols)
    joint = keep(df.groupBy(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("_rows")))
    before = value_histogram(joint, cols, weight="_rows")
    inside = iqr_filter_with(joint, bounds_of(quantiles(before, [0.25, 0.75]), cols, k), cols)
    stages = [box_numbers(h, k).withColumn("stage", F.lit(name)) for name, h in (("before", before), ("after", value_histogram(inside, cols, weight="_rows")))]
    return stages[0].unionByName(stages[1]).withColumnRenamed("measure", "column_name")


def head(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows; sorted by ``order`` when given (Spark rows have no order)."""
    return (df.orderBy(*order) if order else df).limit(n)


def check_invariants(df: DataFrame, arr: str = "ArrDelay", causes: Sequence[str] = (), min_arr: float = 15,
                     flags: Sequence[str] = ()) -> DataFrame:
    """Dataset-scope checks as (check, violations) rows, one pass:
    arrival delay at least ``min_arr``; each flag column (cancelled,
    diverted) zero; cause minutes add up to the arrival delay."""
    items = [("arr_delay_at_least_min", {"violations": F.count_if(~(F.col(arr) >= min_arr))})]
    for f in flags:
        items.append((f"{f}_is_zero", {"violations": F.count_if(F.col(f) != 0)}))
    if causes:
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in causes[1:]), F.coalesce(F.col(causes[0]), F.lit(0.0)))
        items.append(("causes_sum_to_arr_delay", {"violations": F.count_if(total != F.col(arr))}))
    wide = df.agg(*[cols["violations"].alias(f"v{i}") for i, (_, cols) in enumerate(items)])
    return _long(wide, [(t, {"violations": F.col(f"v{i}")}) for i, (t, _) in enumerate(items)], "check_name")
