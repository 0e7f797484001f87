"""Sorting and top-k shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.windows import rank_over


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``ORDER BY … LIMIT k`` -> TakeOrderedAndProject (a per-partition heap,
    then a k-row merge). ``order`` should end in a unique tiebreak so the
    kept rows do not depend on partitioning."""
    return df.orderBy(*order).limit(k)


def both_ends(
    df: DataFrame,
    best_order: Sequence[Column],
    worst_order: Sequence[Column],
    k: int,
    labels: tuple[str, str],
    tag: str = "category",
) -> DataFrame:
    """Best-k and worst-k of the same frame, tagged and unioned.

    A row can land in both halves when fewer than 2k rows exist.
    """
    best = top_k(df, best_order, k).withColumn(tag, F.lit(labels[0]))
    worst = top_k(df, worst_order, k).withColumn(tag, F.lit(labels[1]))
    return best.unionByName(worst)


def top_per_group(
    df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank"
) -> DataFrame:
    """Rows ranked ``<= k`` inside each group (RANK semantics: ties all kept).

    Catalyst plants a WindowGroupLimit below the shuffle, so each map task
    forwards at most its own top-k per group.
    """
    return df.withColumn(rank_col, rank_over(list(order), list(partition))).filter(F.col(rank_col) <= k)
