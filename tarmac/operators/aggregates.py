"""Aggregate building blocks: bucket counts and rates, conditional
aggregates, correlation matrix, column means, pivots. Each is a single
``agg`` so the fact table is scanned once and partial aggregation runs
map-side (a hot key costs one row per task in the shuffle, not its rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import as_col, pct, r2, rnd


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def avg_if(cond: Column, value: Column | str) -> Column:
    """``AVG(CASE WHEN cond THEN x END)``: NULL when nothing qualifies."""
    return F.avg(F.when(cond, as_col(value)))


def sum_if(cond: Column, value: Column | str) -> Column:
    return F.sum(F.when(cond, as_col(value)))


def bucket_counts(value: Column | str, buckets: dict[str, tuple[float | None, float | None]]) -> list[Column]:
    """``{name: (lo, hi)}`` -> ``count_if(lo <= x <= hi)``; an open end is None."""
    x = as_col(value)
    out = []
    for name, (lo, hi) in buckets.items():
        if lo is None:
            cond = x <= hi
        elif hi is None:
            cond = x > lo
        else:
            cond = x.between(lo, hi)
        out.append(F.count_if(cond).alias(name))
    return out


def rates(total: str, counts: dict[str, str], scale: int = 2) -> list[Column]:
    """``{rate_col: count_col}`` -> ``ROUND(100.0 * count / total, scale)``."""
    return [pct(F.col(c), F.col(total), scale).alias(r) for r, c in counts.items()]


def exact_quantiles(df: DataFrame, value_cols: Sequence[str], probs: Sequence[float],
                    keys: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles of several columns (per ``keys``
    group): rows ``(*keys, measure, q)`` with ``q`` an array aligned with ``probs``.

    Read from a range-partitioned value histogram: no task holds all values
    of a measure. All columns share one scan.
    """
    from tarmac.operators.histogram import quantiles, value_histogram

    return quantiles(value_histogram(df, value_cols, keys), probs, keys)


def corr_matrix(df: DataFrame, cols: Sequence[str], scale: int = 4) -> DataFrame:
    """Pearson correlation of every ordered pair, long form ``(col_a, col_b, corr)``.

    One pass, one row in and none made: rows are grouped by which of their
    values are present (usually a single group), and each group carries its
    count, the sums of the values and of their products. A pair's sums are
    those of the groups where both are present, so the matrix is
    pairwise-complete. Values are shifted by those of one complete row first
    (by 0 if no row is complete), which keeps the sums small beside the
    deviations when the values are far from zero; that row is read by a
    scalar subquery that stops at it. A constant column has no correlation
    (NULL), also with itself.
    """
    cols = list(cols)
    k = range(len(cols))
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    complete = df.dropna("any", subset=cols).limit(1).select(F.array(*x).alias("typical")).scalar()
    typical = [F.coalesce(complete[i], F.lit(0.0)) for i in k]
    present = sum((F.when(v.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, v in enumerate(x)), F.lit(0).cast("bigint"))
    shifted = df.select(present.alias("present"), *[F.coalesce(v - t, F.lit(0.0)).alias(f"z{i}") for i, (v, t) in enumerate(zip(x, typical))])
    pairs = [(i, j) for i in k for j in k if i <= j]
    groups = shifted.groupBy("present").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in k], *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in pairs])

    # From here on a row per group of rows, then a row per pair.
    of_pair = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("n"), F.col(f"s{i}").alias("sa"), F.col(f"s{j}").alias("sb"), F.col(f"p{i}_{i}").alias("aa"),
                        F.col(f"p{j}_{j}").alias("bb"), F.col(f"p{i}_{j}").alias("ab"), (F.col("present").bitwiseAND((1 << i) | (1 << j)) == ((1 << i) | (1 << j))).alias("both")) for i, j in pairs]
    both = lambda c: F.sum(F.when(F.col("both"), F.col(c))).alias(c)
    tri = groups.select(F.inline(F.array(*of_pair))).groupBy("i", "j").agg(*[both(c) for c in ("n", "sa", "sb", "aa", "bb", "ab")])

    def about_mean(product: str, a: str, b: str) -> Column:
        return F.col(product) - F.col(a) * F.col(b) / F.col("n")

    spread = F.sqrt(F.greatest(about_mean("aa", "sa", "sa"), F.lit(0.0))) * F.sqrt(F.greatest(about_mean("bb", "sb", "sb"), F.lit(0.0)))
    corr = F.try_divide(about_mean("ab", "sa", "sb"), F.nullif(spread, F.lit(0.0)))
    names = F.array(*[F.lit(c) for c in cols])
    a, b = F.element_at(names, F.col("i") + 1), F.element_at(names, F.col("j") + 1)
    one = tri.withColumn("corr", rnd(F.when(corr > 1, F.lit(1.0)).when(corr < -1, F.lit(-1.0)).otherwise(corr), scale))
    there, back = F.struct(a.alias("col_a"), b.alias("col_b"), F.col("corr")), F.struct(b.alias("col_a"), a.alias("col_b"), F.col("corr"))
    return one.select(F.inline(F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))))


def column_means(df: DataFrame, cols: Sequence[str], label: str = "column", value: str = "mean") -> DataFrame:
    """Mean of many columns in one pass, as long rows ``(label, value)``."""
    wide = df.agg(*[F.avg(F.col(c)).alias(c) for c in cols])
    items = [F.struct(F.lit(c).alias(label), F.col(c).alias(value)) for c in cols]
    return wide.select(F.inline(F.array(*items)))


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence, measure: str) -> DataFrame:
    """Pivot table of the rounded mean: one row per ``row`` key, one column per
    listed ``column`` value (listing the values avoids a distinct-values job)."""
    return df.groupBy(row).pivot(column, list(values)).agg(r2(F.avg(F.col(measure))))


def ifs(kind: str, conds: Sequence[Column], value: Column | str | None = None) -> Column:
    """Spreadsheet SUMIFS / AVERAGEIFS / COUNTIFS over several criteria."""
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    if kind == "count":
        return F.count_if(cond)
    if kind == "sum":
        return sum_if(cond, value)
    if kind == "avg":
        return avg_if(cond, value)
    raise ValueError(kind)
