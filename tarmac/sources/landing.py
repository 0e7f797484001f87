"""A raw file loaded, cleaned and accounted for in one pass.

The file is parsed once. Rows that pass the row-local cleaning are the
table; every row with a token that is no value of its column's type is also
among the rejects, with those tokens; and the pass counts what it saw (rows
read, kept, dropped as incomplete, and bad tokens per column). Both parts are
one Parquet write, each row in it once and marked, so a failed load leaves
nothing half-counted, and neither part needs a second parse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.clean import NULL_CHECK_COLUMNS
from tarmac.session import compiled
from tarmac.sources.flights import RAW_COLUMNS, text_frame, typed_with_tokens

KEPT, BAD = "_kept", "_bad"


@dataclass(frozen=True)
class Load:
    table: DataFrame  # the cleaned rows
    rejects: DataFrame  # (rejected: array of (column, token), then the row as parsed)
    counts: dict[str, int]  # rows_read, rows_kept, rows_incomplete, rows_rejected, bad_<column>

    def report(self) -> DataFrame:
        """(counted, rows) of the load."""
        spark = self.table.sparkSession
        return spark.createDataFrame(list(self.counts.items()), "counted string, rows bigint")


def load_csv(spark: SparkSession, path: str, target: str, columns=None) -> Load:
    """Parse ``path``, write the cleaned rows and the rejects under ``target``.

    A row with a bad token counts it as NULL, so the row stays in the table
    unless the column must be present; either way the rejects have it.
    """
    from tarmac.streaming.ingest import clean_rows

    cols = columns or RAW_COLUMNS
    typed, token = typed_with_tokens(text_frame(spark, path, cols), cols)
    checked = [c for c in NULL_CHECK_COLUMNS if c in typed.columns]
    complete = F.lit(True)
    for c in checked:
        complete = complete & F.col(f"`{c}`").isNotNull()
    bad = F.coalesce(F.lit(None).cast("string"), *token.values()).isNotNull()
    seen = Observation()
    per_column = [F.count(t).alias(f"bad_{n}") for n, t in token.items()]
    counted = typed.withColumn(KEPT, complete).observe(
        seen, F.count(F.lit(1)).alias("rows_read"), F.count_if(KEPT).alias("rows_kept"), F.count_if(~F.col(KEPT)).alias("rows_incomplete"),
        F.count_if(bad).alias("rows_rejected"), *per_column)
    names = [F.col(f"`{n}`") for n, _ in cols]
    found = F.array(*[F.when(t.isNotNull(), F.struct(F.lit(n).alias("column"), t.alias("token"))) for n, t in token.items()])
    rejected = F.when(bad, F.filter(found, lambda x: x.isNotNull())).alias(BAD)  # most rows have none to look for
    out = counted.where(F.col(KEPT) | bad).select(*names, KEPT, rejected)
    with compiled(spark):
        out.write.parquet(target)

    stored = spark.read.schema(out.schema).parquet(target)
    return Load(clean_rows(stored.where(KEPT).select(*names)), stored.where(F.col(BAD).isNotNull()).select(F.col(BAD).alias("rejected"), *names),
                {k: v or 0 for k, v in seen.get.items()})
