"""Join shapes used by the analyses. Every join here runs on *aggregates*
(routes, airports, carriers), never on fact rows, so both sides are bounded
by the number of distinct keys; AQE picks broadcast or shuffle by measured
size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.windows import row_number_over


def reverse_pairs(
    df: DataFrame, a: str, b: str, values: Sequence[str], keep_once: bool = True, suffixes=("_ab", "_ba"),
    method: str = "group",
) -> DataFrame:
    """Pair every (a, b) row with its reverse (b, a) row; ``df`` has one row per (a, b).

    ``method="join"`` is the literal inner self-join on the swapped key with
    the theta predicate ``a < b`` keeping each unordered pair once. The
    default ``"group"`` gives the same rows without a join: rows are keyed by
    the unordered pair (least, greatest) and each direction's values are
    picked by a conditional aggregate; pairs missing a direction, and
    self-loops, drop out. It reads ``df`` once (the join form plans the input
    twice, because the theta predicate is pushed into one side only).
    """
    sa, sb = suffixes
    if method == "join":
        left = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"), *[F.col(v).alias(v + sa) for v in values])
        right = df.select(F.col(a).alias("_ra"), F.col(b).alias("_rb"), *[F.col(v).alias(v + sb) for v in values])
        j = left.join(right, (F.col("_a") == F.col("_rb")) & (F.col("_b") == F.col("_ra")), "inner")
        if keep_once:
            j = j.filter(F.col("_a") < F.col("_b"))
        return j.select(F.col("_a").alias(a), F.col("_b").alias(b), *[v + s for v in values for s in suffixes])
    if not keep_once:
        fwd = reverse_pairs(df, a, b, values, True, suffixes, method)
        back = fwd.select(F.col(b).alias(a), F.col(a).alias(b), *[F.col(v + s).alias(v + o) for v in values
                                                                   for s, o in ((sb, sa), (sa, sb))])
        return fwd.unionByName(back)
    x, y = F.col(a), F.col(b)
    forward = x < y
    keyed = df.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(
        F.least(x, y).alias(a), F.greatest(x, y).alias(b), forward.alias("_fwd"), *[F.col(v) for v in values])
    g = keyed.groupBy(a, b).agg(
        F.count_if(F.col("_fwd")).alias("_nf"), F.count_if(~F.col("_fwd")).alias("_nb"),
        *[F.max(F.when(F.col("_fwd"), F.col(v))).alias(v + sa) for v in values],
        *[F.max(F.when(~F.col("_fwd"), F.col(v))).alias(v + sb) for v in values],
    )
    return g.filter((F.col("_nf") == 1) & (F.col("_nb") == 1)).select(
        a, b, *[v + s for v in values for s in suffixes])


def equi_inner(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return left.join(right, key, "inner")


def top_two(
    ranked: DataFrame,
    key: str,
    rank_col: str,
    first: dict[str, str],
    second: dict[str, str],
    method: str = "window",
) -> DataFrame:
    """Each key's rank-1 row paired with its rank-2 rows.

    RANK semantics are kept on purpose: a tie at rank 1 leaves no rank 2 (the
    key drops out), a tie at rank 2 yields one output row per tied row.
    ``first``/``second`` map source column -> output name.

    ``method="join"`` is the literal inner join of the rank-1 rows with the
    rank-2 rows. The default ``"window"`` gives the same rows without a
    join: whenever a rank-2 row exists the rank-1 row is unique (RANK skips
    2 after a tie at 1), so its values can be attached to the rank-2 rows
    with a window over the key. ``ranked`` is already partitioned by the
    key, so this adds no shuffle and reads the input once.
    """
    if method == "join":
        r1 = ranked.filter(F.col(rank_col) == 1).select(F.col(key), *[F.col(c).alias(n) for c, n in first.items()])
        r2 = ranked.filter(F.col(rank_col) == 2).select(F.col(key), *[F.col(c).alias(n) for c, n in second.items()])
        return r1.join(r2, key, "inner")
    w = Window.partitionBy(key)
    top = F.col(rank_col) == 1
    pick = {n: F.max(F.when(top, F.col(c))).over(w) for c, n in first.items()}
    out = ranked.filter(F.col(rank_col) <= 2).withColumns(pick).filter(F.col(rank_col) == 2)
    return out.select(F.col(key), *[F.col(n) for n in first.values()],
                      *[F.col(c).alias(n) for c, n in second.items()])


def lookup(left: DataFrame, right: DataFrame, key: str, order: Sequence[str] | None = None, how="left") -> DataFrame:
    """Exact-match lookup (VLOOKUP / INDEX-MATCH): at most one right row per key.

    The right side is deduplicated to its first row per key under ``order``
    (default: the key itself, i.e. any row, deterministically the smallest
    row by all columns), so the left side never multiplies.
    """
    cols = list(order) if order else [c for c in right.columns if c != key]
    first = (
        right.withColumn("_rn", row_number_over([F.col(c).asc_nulls_last() for c in cols], [key]))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )
    return left.join(first, key, how)
