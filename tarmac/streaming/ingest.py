"""Incremental load of raw flight files into the cleaned fact table.

The reference loads its cleaned frame into a table in fixed-size INSERT
batches. The Spark-native equivalent is a Structured Streaming file source
feeding the *row-local* cleaning stages (missing-value tokens, incomplete
rows, surplus columns, clock-time casts, hours, whitespace) into a Parquet
sink. The file source and sink are exactly-once through the checkpoint, so
a restarted or half-failed run neither loses nor duplicates a file.

The IQR filter is not applied in the stream: its bounds depend on the whole
table, so it runs at read time over the accumulated table
(``tarmac.operators.clean.iqr_filter``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tarmac.operators.clean import DROP_COLUMNS, KEY_COLUMNS, NULL_CHECK_COLUMNS, add_hours, cast_int, drop_columns
from tarmac.operators.clean import drop_null_rows, strip
from tarmac.sources.flights import RAW_COLUMNS, _string_schema, header_schema, named, typed_from_strings


def clean_rows(df: DataFrame) -> DataFrame:
    """Row-local part of the cleaning pipeline (safe on any micro-batch)."""
    cols = set(df.columns)
    df = drop_null_rows(df, [c for c in NULL_CHECK_COLUMNS if c in cols])
    df = drop_columns(df, DROP_COLUMNS)
    clocks = [c for c in ("DepTime", "ArrTime") if c in cols]
    if clocks:
        df = cast_int(df, clocks)
        df = add_hours(df, {c.replace("Time", "Hour"): c for c in clocks})
    return strip(df, [c for c in KEY_COLUMNS if c in cols])


def raw_stream(spark: SparkSession, landing_dir: str, columns=None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming CSV source over a landing folder, by header names (text first,
    typed after). A file with another header fails the stream."""
    cols = columns or RAW_COLUMNS
    try:
        schema = header_schema(spark, landing_dir, cols)  # the order that the files have
    except AnalysisException:  # nothing has landed yet
        schema = _string_schema(cols)
    r = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return typed_from_strings(named(r.csv(landing_dir)), cols)


def start_ingest(
    spark: SparkSession,
    landing_dir: str,
    table_dir: str,
    checkpoint_dir: str,
    columns=None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the clean-and-append stream; ``available_now`` drains the folder and stops."""
    cleaned = clean_rows(raw_stream(spark, landing_dir, columns, max_files_per_trigger))
    w = cleaned.writeStream.format("parquet").option("path", table_dir).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.outputMode("append").start()


def ingest_available(spark: SparkSession, landing_dir: str, table_dir: str, checkpoint_dir: str,
                     columns=None) -> DataFrame:
    """Drain everything that has landed, then return the table (batch read)."""
    q = start_ingest(spark, landing_dir, table_dir, checkpoint_dir, columns, available_now=True)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(table_dir)
