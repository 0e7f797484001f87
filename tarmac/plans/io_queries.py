"""Registered queries for the sources and sinks: each writes through the
connector under the shared checkpoint folder and reads the result back, so
the round trip itself is what gets compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.plans.cells import all_cells, analyses
from tarmac.session import keeping
from tarmac.sources.flights import FLIGHT_COLUMNS, folder, prepare, read_flights_csv
from tarmac.sources.landing import Load, load_csv
from tarmac.sources.sinks import VersionedTable, export_all, export_manifest, write_csv

def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """The original (unfiltered) frame written as CSV, scanned back with the
    text-first reader (NA tokens, tolerant casts)."""
    p = prepare(spark, d)
    path = write_csv(p.flights0, f"{p.run_dir()}/original")
    return read_flights_csv(spark, path, FLIGHT_COLUMNS)


def src_table(spark: SparkSession, d: str) -> DataFrame:
    """The filtered frame as the SQL table ``airline_delays``."""
    from tarmac.plans.spark_sql import _VIEW_LOCK, VIEW, register

    flights = prepare(spark, d).flights
    with _VIEW_LOCK:
        register(spark, flights)
        return spark.sql(f"SELECT * FROM {VIEW}")


def sink_csv(spark: SparkSession, d: str) -> DataFrame:
    """Original and filtered frames written as CSV; the filtered one read back."""
    p = prepare(spark, d)
    write_csv(p.flights0, f"{p.run_dir()}/original")
    path = write_csv(p.flights, f"{p.run_dir()}/filtered")
    return read_flights_csv(spark, path, FLIGHT_COLUMNS)


def sink_table(spark: SparkSession, d: str) -> DataFrame:
    """Replace-load of the filtered frame behind one table name, twice; the
    first version's reader stays valid, the second is current."""
    p = prepare(spark, d)
    table = VersionedTable(spark, "tarmac_airline_delays", f"{p.run_dir()}/airline_delays")
    table.load(p.flights0)
    return table.load(p.flights)


def sink_query_exports(spark: SparkSession, d: str) -> DataFrame:
    """One export per analysis, all from one pass over the facts; the manifest
    has the rows that were written."""
    p = prepare(spark, d)
    with keeping():
        return export_manifest(spark, export_all(analyses(*all_cells(p.flights)), f"{p.run_dir()}/exports"))


IO_QUERIES = {
    "src_csv": src_csv,
    "src_table": src_table,
    "sink_csv": sink_csv,
    "sink_table": sink_table,
    "sink_query_exports": sink_query_exports,
}


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The original frame landed as CSV files and loaded by the streaming
    ingest (fresh checkpoint per call, so the whole landing folder is read)."""
    from tarmac.streaming.ingest import ingest_available

    p = prepare(spark, d)
    landing = write_csv(p.flights0, f"{p.run_dir()}/landing")
    run = p.run_dir()
    return ingest_available(spark, landing, f"{run}/table", f"{run}/checkpoint", FLIGHT_COLUMNS)


IO_QUERIES["stream_ingest"] = stream_ingest


def _raw_run(spark: SparkSession, d: str) -> str:
    """A new folder for a call on the raw file, which needs no prepared facts."""
    return f"{folder(spark, d)}/runs/{uuid.uuid4().hex}"


def _raw_csv(spark: SparkSession, d: str) -> str:
    from tarmac.sources.raw import derive_raw, write_raw_csv

    return write_raw_csv(derive_raw(spark, d), f"{_raw_run(spark, d)}/raw")


def src_csv_raw(spark: SparkSession, d: str) -> DataFrame:
    """The raw 30-column file scanned with pandas' missing-value tokens."""
    from tarmac.sources.flights import read_flights_csv as read

    return read(spark, _raw_csv(spark, d))


_LOADED: dict[str, Load] = {}


def _load(spark: SparkSession, d: str) -> Load:
    """The raw file loaded once in a session: each folder's CSV is parsed one
    time, and the bounds, the filter, the checks and the rejects read what that wrote."""
    key = f"{spark.sparkContext.applicationId}|{folder(spark, d)}"
    if key not in _LOADED:
        _LOADED[key] = load_csv(spark, _raw_csv(spark, d), f"{_raw_run(spark, d)}/load")
    return _LOADED[key]


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d).table


def pipeline_rejects(spark: SparkSession, d: str) -> DataFrame:
    """What the load of the raw file counted: rows read, kept, dropped as
    incomplete, with bad tokens; and the bad tokens of each numeric column."""
    return _load(spark, d).report()


def pipeline_rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each bad token of the raw file with its row's number, column and text."""
    one = _load(spark, d).rejects.select(F.col("`Unnamed: 0`").alias("row_number"), F.inline("rejected"))
    return one.select("row_number", "column", "token")


def prof_distinct_flags(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values, NULL included, of the raw file's flag columns."""
    from tarmac.operators.profile import distinct_of_each

    return distinct_of_each(src_csv_raw(spark, d), ["CancellationCode", "Diverted", "Cancelled"])


def pipeline_clean(spark: SparkSession, d: str) -> DataFrame:
    """The notebook's whole cleaning pipeline on the raw file: incomplete
    rows, dropped columns, truncated clock times, hours, trimmed keys, IQR
    filter, scheduled departure hour. Returns the filtered frame."""
    from tarmac.operators.clean import filter_cleaned

    return filter_cleaned(_cleaned(spark, d))


def pipeline_original(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned, unfiltered frame of the same pipeline (the "original" CSV)."""
    return _cleaned(spark, d)


IO_QUERIES.update({"src_csv_raw": src_csv_raw, "pipeline_clean": pipeline_clean,
                   "pipeline_original": pipeline_original,
                   "pipeline_rejects": pipeline_rejects, "pipeline_rejected_rows": pipeline_rejected_rows, "prof_distinct_flags": prof_distinct_flags})


def prof_invariants_raw(spark: SparkSession, d: str) -> DataFrame:
    """Dataset-scope checks on the cleaned raw file, including the
    cancelled / diverted flags that only the raw layout carries."""
    from tarmac.operators.profile import check_invariants

    original = pipeline_original(spark, d)
    causes = ["CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"]
    return check_invariants(original, "ArrDelay", causes, flags=("Cancelled", "Diverted"))


IO_QUERIES["prof_invariants_raw"] = prof_invariants_raw
