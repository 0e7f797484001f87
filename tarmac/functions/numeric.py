"""Numeric column helpers shared by every analysis.

All rounding goes through ``decimal(38,10)`` first: that absorbs binary
noise from double arithmetic (``51.095`` stored as ``51.09499…``) and then
rounds half away from zero, which is what ``ROUND(CAST(x AS NUMERIC), 2)``
does in the reference's SQL. A bare ``cast('decimal')`` would be
``decimal(10,0)`` in Spark and silently drop the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact(c: Column | str) -> Column:
    """Decimal view of a double, for threshold tests on derived averages."""
    return as_col(c).cast("decimal(38,10)")


def rnd(c: Column | str, scale: int = 2) -> Column:
    """Round half away from zero at ``scale`` digits; result is DOUBLE."""
    return F.round(exact(c), scale).cast("double")


def r2(c: Column | str) -> Column:
    return rnd(c, 2)


def pct(part: Column | str, total: Column | str, scale: int = 2) -> Column:
    """``ROUND(100.0 * part / total, scale)``; NULL instead of an error on 0."""
    return rnd(F.try_divide(F.lit(100.0) * as_col(part), as_col(total)), scale)


def pct_text(c: Column | str, scale: int = 2) -> Column:
    """Percentage text keeping trailing zeros (``40.60%``).

    Mirrors a SQL ``CONCAT`` that skips NULL arguments: a NULL number gives ``%``.
    """
    txt = as_col(c).cast(f"decimal(38,{scale})").cast("string")
    return F.concat(F.coalesce(txt, F.lit("")), F.lit("%"))


def hhmm_hour(c: Column | str, wrap: bool = False) -> Column:
    """Hour of an ``hhmm`` clock number: floor division by 100 (2400 -> 24)."""
    h = F.floor(as_col(c) / F.lit(100)).cast("bigint")
    return F.pmod(h, F.lit(24)) if wrap else h


def floor_div(c: Column | str, d: int) -> Column:
    """Python-style ``//`` (floors toward minus infinity, unlike SQL ``div``)."""
    return F.floor(as_col(c) / F.lit(d)).cast("bigint")


def nan_to_null(c: Column | str) -> Column:
    """pandas skips NaN in means; Spark propagates it. Normalise at ingest."""
    x = as_col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def as_bigint(c: Column | str) -> Column:
    return as_col(c).cast("bigint")
