"""The ingest + cleaning pipeline on a hand-made dirty CSV in the reference's layout."""

import csv
import os
import tempfile

from tarmac.operators.clean import pipeline_clean
from tarmac.operators.profile import distinct_values, duplicate_count, null_counts
from tarmac.sources.flights import RAW_COLUMNS, read_flights_csv

HEADER = [c for c, _ in RAW_COLUMNS]


def raw_row(i, **kw):
    r = {c: "0" for c in HEADER}
    r.update({
        "Unnamed: 0": str(i), "Year": "2008", "Month": "1", "DayofMonth": "3", "DayOfWeek": "4",
        "DepTime": "1955.0", "CRSDepTime": "1945", "ArrTime": "2211.0", "CRSArrTime": "2200",
        "UniqueCarrier": "AA", "FlightNum": "100", "TailNum": "N1", "ActualElapsedTime": "120.0",
        "CRSElapsedTime": "115.0", "AirTime": "100.0", "ArrDelay": "20.0", "DepDelay": "10.0",
        "Origin": "JFK", "Dest": "LAX", "Distance": "2475", "TaxiIn": "5.0", "TaxiOut": "15.0",
        "Cancelled": "0", "CancellationCode": "N", "Diverted": "0", "CarrierDelay": "20.0",
        "WeatherDelay": "0.0", "NASDelay": "0.0", "SecurityDelay": "0.0", "LateAircraftDelay": "0.0",
    })
    r.update(kw)
    return r


def write(rows):
    d = tempfile.mkdtemp(prefix="tarmac-dirty-")
    path = os.path.join(d, "dirty.csv")
    with open(path, "w", newline="") as fh:
        w = csv.DictWriter(fh, fieldnames=HEADER)
        w.writeheader()
        for r in rows:
            w.writerow(r)
    return path


def test_dirty_csv_pipeline(spark):
    rows = [
        raw_row(0, UniqueCarrier=" AA ", Origin="\tJFK"),
        raw_row(1, DepTime="2400.0", CRSDepTime="2359"),
        raw_row(2, DepTime="5", CRSDepTime="5"),
        raw_row(3, CarrierDelay="NA"),
        raw_row(4, WeatherDelay=""),
        raw_row(5, NASDelay="NaN"),
        raw_row(6, ArrTime="NA", TailNum="NA"),
        raw_row(7, Cancelled="1", CancellationCode="B", ArrTime="", ArrDelay=""),
        raw_row(8),
        raw_row(9),  # equal to row 8 except for the row number
    ]
    raw = read_flights_csv(spark, write(rows))
    nulls = {r["column_name"]: r["null_count"] for r in null_counts(raw).collect()}
    assert nulls["CarrierDelay"] == 1 and nulls["WeatherDelay"] == 1 and nulls["NASDelay"] == 1
    assert nulls["ArrTime"] == 2 and nulls["TailNum"] == 1 and nulls["ArrDelay"] == 1
    assert duplicate_count(raw, HEADER).first()[0] == 0  # with the row number every row is unique
    assert duplicate_count(raw).first()[0] == 1  # rows 8 and 9 repeat once the row number is left out
    assert {r["Cancelled"] for r in distinct_values(raw, "Cancelled").collect()} == {0, 1}

    original, filtered = pipeline_clean(raw)
    assert original.count() == 5  # rows 3-7 dropped (incomplete / cancelled)
    assert "TailNum" not in original.columns and "Unnamed: 0" not in original.columns
    assert {r["UniqueCarrier"] for r in original.collect()} == {"AA"}
    assert {r["Origin"] for r in original.collect()} == {"JFK"}
    hours = sorted((r["DepTime"], r["DepHour"]) for r in original.collect())
    assert hours[0] == (5, 0) and hours[-1] == (2400, 24)
    assert dict(original.dtypes)["DepTime"] == "bigint"
    # after filtering the hour comes from the scheduled departure time
    fh = sorted((r["CRSDepTime"], r["DepHour"]) for r in filtered.collect())
    assert (2359, 23) in fh and all(h == c // 100 for c, h in fh)
