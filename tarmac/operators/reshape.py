"""Set operations and reshaping: endpoint counting, unions, unpivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endpoints(
    df: DataFrame, cols: Sequence[str], name: str, carry: dict[str, tuple[Column, str]] | None = None
) -> DataFrame:
    """One row per (row, role): an entity seen as origin *or* dest appears in both.

    ``carry`` maps ``out_col -> (column, type)`` of values kept only on the
    first role's row (NULL on the others), so a single scan can feed both
    "volume over both ends" and "stats as origin" aggregates. The generator
    runs inside the scan stage; the partial aggregate that follows keeps the
    shuffle at one row per key per task.
    """
    carry = carry or {}
    structs = []
    for i, c in enumerate(cols):
        fields = [F.col(c).alias(name)]
        for k, (v, typ) in carry.items():
            fields.append((v.cast(typ) if i == 0 else F.lit(None).cast(typ)).alias(k))
        structs.append(F.struct(*fields))
    return df.select(F.inline(F.array(*structs)))


def count_endpoints(df: DataFrame, cols: Sequence[str] = ("Origin", "Dest"), name: str = "airport") -> DataFrame:
    """Rows per entity over several role columns, in one scan (``UNION ALL`` of
    per-role group-bys, then re-summed, in the reference)."""
    return (
        df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias(name))
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("total_flights"))
    )


def distinct_union(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """``SELECT a UNION SELECT b``: distinct values over several columns (NULL kept)."""
    return df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias(name)).distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def unpivot_measures(
    df: DataFrame, keys: Sequence[str], mapping: dict[str, str], label: str = "measure", value: str = "value"
) -> DataFrame:
    """Wide -> long with a display label per column (one pass, ``stack``)."""
    args = ", ".join(f"'{lbl}', `{c}`" for c, lbl in mapping.items())
    expr = f"stack({len(mapping)}, {args}) AS (`{label}`, `{value}`)"
    return df.selectExpr(*[f"`{k}`" for k in keys], expr)


def unpivot_struct(
    df: DataFrame, keys: Sequence[str], items: Sequence[tuple[str, dict[str, Column]]], label: str
) -> DataFrame:
    """Unpivot groups of already aggregated columns into long rows.

    ``items`` is ``[(label_text, {out_col: column}), ...]``; every item must
    produce the same output columns. Used to turn a one-pass, many-column
    aggregate into the long (cause, metrics...) shape without rescanning.
    """
    structs = [F.struct(F.lit(text).alias(label), *[c.alias(n) for n, c in cols.items()]) for text, cols in items]
    return df.select(*[F.col(k) for k in keys], F.inline(F.array(*structs)))
