"""Window helpers: ranks, period-over-period change, rolling and running means.

All of these are meant for *aggregated* frames (carriers x months, routes x
months, hours...). A window without PARTITION BY funnels its input into one
task, which is fine for a few thousand grouped rows and wrong for fact rows;
callers aggregate first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.numeric import as_col, r2


def _spec(partition: Sequence[str] | None, order: Sequence[Column]):
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return w.orderBy(*order)


def rank_over(order: Sequence[Column] | Column, partition: Sequence[str] | None = None) -> Column:
    """SQL ``RANK()`` as BIGINT (ties share a rank, gaps follow)."""
    order = [order] if isinstance(order, Column) else list(order)
    return F.rank().over(_spec(partition, order)).cast("bigint")


def row_number_over(order: Sequence[Column] | Column, partition: Sequence[str] | None = None) -> Column:
    order = [order] if isinstance(order, Column) else list(order)
    return F.row_number().over(_spec(partition, order)).cast("bigint")


def lag_of(value: Column | str, order: str, partition: Sequence[str] | None = None) -> Column:
    return F.lag(as_col(value)).over(_spec(partition, [F.col(order)]))


def period_change(value: Column | str, order: str, partition: Sequence[str] | None = None) -> Column:
    """``ROUND(x - LAG(x), 2)`` over the periods that are present (gaps are skipped)."""
    return r2(as_col(value) - lag_of(value, order, partition))


def rolling_mean(value: Column | str, order: str, rows: int, partition: Sequence[str] | None = None) -> Column:
    """Mean of the current and ``rows - 1`` preceding rows."""
    w = _spec(partition, [F.col(order)]).rowsBetween(-(rows - 1), Window.currentRow)
    return F.avg(as_col(value)).over(w)


def running_mean(value: Column | str, order: str, partition: Sequence[str] | None = None) -> Column:
    w = _spec(partition, [F.col(order)]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.avg(as_col(value)).over(w)


def share_of_total(value: Column | str, partition: Sequence[str] | None = None) -> Column:
    """``100 * x / SUM(x) OVER (PARTITION BY ...)`` (unrounded, NULL on a zero total)."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return F.try_divide(F.lit(100.0) * as_col(value), F.sum(as_col(value)).over(w))
