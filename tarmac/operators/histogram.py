"""Value histograms and the order statistics read from them.

A histogram has one row per distinct value and measure, with its count, and
is range-partitioned by value: each partition holds a stretch of values, and
its number is a column. The value of any rank is then found from the counts
per partition (a few rows, summed up in order) and from the one partition
that holds the rank. No task ever holds all values of a measure, however
many there are, and every statistic below comes from one pass over the data:
the histogram is kept (see ``tarmac.session.keep``) while it is in use.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import keep

PART = "part"


def value_histogram(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """``(*keys, measure, value, n, part)`` of several columns, kept, from one scan.

    ``weight`` names a column of row counts (for data that are counted
    already). NULL values are counted in a row of their own.
    """
    items = [F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols]
    many = F.col(weight) if weight else F.lit(1).cast("bigint")
    long = df.select(*[F.col(k) for k in keys], many.alias("_w"), F.inline(F.array(*items)))
    counted = long.groupBy(*keys, "measure", "value").agg(F.sum("_w").alias("n"))
    ranged = counted.repartitionByRange(*[F.col(k).asc_nulls_first() for k in (*keys, "measure", "value")])
    return keep(ranged.withColumn(PART, F.spark_partition_id()))


def _same(a: str, b: str, cols: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols))


def quantiles(hist: DataFrame, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, measure, q)``: exact quantiles, linearly interpolated, as an
    array aligned with ``probs``. Groups without values have no row."""
    groups = [*keys, "measure"]
    known = hist.where("value IS NOT NULL")
    parts = known.groupBy(*groups, PART).agg(F.sum("n").alias("held"))
    in_order = Window.partitionBy(*groups).orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.select(*groups, PART, "held", (F.sum("held").over(in_order) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy(*groups)).alias("total"))
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in at])))
    here = placed.withColumn("ranks", F.filter(wanted, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")))).where(F.size("ranks") > 0)

    # Only the partitions with a wanted rank are read any further, each sorted by itself.
    hit = known.alias("h").join(here.alias("p"), _same("h", "p", [*groups, PART])).select("h.*", "before", "ranks", "total")
    within = Window.partitionBy(*groups, PART).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = hit.withColumn("upto", F.col("before") + F.sum("n").over(within))
    mine = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    found = upto.select(*groups, "value", "total", F.explode(mine).alias("rank"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("value")))

    ends = found.groupBy(*groups).agg(F.max("total").alias("total"), *[a for i, x in enumerate(at) for a in (value_at(F.floor(x)).alias(f"lo{i}"), value_at(F.ceil(x)).alias(f"hi{i}"))])
    out = []
    for i, x in enumerate(at):
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi))
    return ends.select(*groups, F.array(*out).alias("q"))


def moments(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, measure, count, mean, std, min, max)``: the mean first, then
    the squared deviations from it; both sums are partially aggregated."""
    groups = [*keys, "measure"]
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))
    first = hist.groupBy(*groups).agg(F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias("count"), F.try_divide(F.sum(v * n), F.sum(n)).alias("mean"),
                                      F.min(v).alias("min"), F.max(v).alias("max"))
    off = hist.alias("h").join(first.alias("m"), _same("h", "m", groups)).select("h.*", "mean", "count")
    d = v - F.col("mean")
    squares = off.groupBy(*groups).agg(F.sqrt(F.try_divide(F.sum(n * d * d), F.max("count") - 1)).alias("std"))
    return first.alias("m").join(squares.alias("s"), _same("m", "s", groups)).select(*[f"m.{c}" for c in (*groups, "count", "mean")], "std", "min", "max")


def box_numbers(hist: DataFrame, k: float = 1.5) -> DataFrame:
    """``(measure, q1, median, q3, whisker_low, whisker_high, outliers)``: whiskers
    end at the furthest value within ``k`` interquartile ranges of the box."""
    q = quantiles(hist, [0.25, 0.5, 0.75]).select("measure", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    v, span = F.col("value"), F.lit(k) * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - span, F.col("q3") + span)
    return hist.where("value IS NOT NULL").join(q, "measure").groupBy("measure", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0).cast("bigint")).alias("outliers"))
