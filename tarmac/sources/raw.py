"""A raw, reference-shaped flight file derived from the driver's tables.

The reference starts from a 30-column CSV with a leading row number,
missing-value tokens, float clock times and untrimmed keys. This module
renders the derived flights in that layout (every field as text, the way
it sits in a file), so the whole cleaning pipeline can run on realistic
input that grows with the tables:

* ``NA``, empty and ``NaN`` tokens in cause and time columns (rows dropped
  by the null check),
* carriers padded with spaces, origins with a tab, destinations with a
  trailing space (trimmed),
* actual clock times as floats (``1955.0``), midnight written ``2400.0``,
* flights that never arrived are cancelled, with a code, or diverted,
* some distances and taxi times are no numbers.

Every rule is a function of integer keys, so the SQL oracle reproduces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import compiled
from tarmac.sources.flights import RAW_COLUMNS, derive_keyed


def _hhmm(minutes: Column) -> Column:
    return (F.floor(minutes / 60) * 100 + minutes % 60).cast("bigint")


def derive_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw file's rows, all columns as strings in the reference's order."""
    r = derive_keyed(spark, sf_dir)
    ok, ln, hr, dep, arr = (F.col(c) for c in ("ok", "ln", "hr", "dep", "arr"))
    sched = hr * 60 + ok % 60
    dep_clock = F.pmod(sched + dep, F.lit(1440))
    arr_clock = F.pmod(sched + 95 + arr, F.lit(1440))
    carrier = F.concat(F.lit("C"), F.lpad(F.col("ci").cast("string"), 2, "0"))
    late = arr - F.col("wx") - F.col("sec") - F.col("nas") - F.col("car")

    lost = ok % 37 == 0  # no arrival time

    def num(c: Column) -> Column:
        return c.cast("double").cast("string")

    def token(cond: Column, tok: str, value: Column) -> Column:
        return F.when(cond, F.lit(tok)).otherwise(value)

    cols = {
        "Unnamed: 0": (ok * 8 + ln).cast("string"),
        "Year": F.lit("2008"),
        "Month": F.col("mon").cast("string"),
        "DayofMonth": (ok % 28 + 1).cast("string"),
        "DayOfWeek": (ok % 7 + 1).cast("string"),
        "DepTime": F.when(ok % 97 == 0, F.lit("2400.0")).otherwise(num(_hhmm(dep_clock))),
        "CRSDepTime": (hr * 100 + ok % 60).cast("string"),
        "ArrTime": token(ok % 37 == 0, "NA", num(_hhmm(arr_clock))),
        "CRSArrTime": _hhmm(F.pmod(sched + 95, F.lit(1440))).cast("string"),
        "UniqueCarrier": F.when(ok % 11 == 0, F.concat(F.lit(" "), carrier, F.lit(" "))).otherwise(carrier),
        "FlightNum": (ok % 7000 + 1).cast("string"),
        "TailNum": token(ok % 41 == 0, "NA", F.concat(F.lit("N"), (ok % 900 + 100).cast("string"), F.lit("AA"))),
        "ActualElapsedTime": num(F.lit(95) + arr - dep),
        "CRSElapsedTime": F.lit("95.0"),
        "AirTime": num(F.lit(75) + arr - dep),
        "ArrDelay": num(arr),
        "DepDelay": num(dep),
        "Origin": F.when(ok % 13 == 1, F.concat(F.lit("\t"), F.col("origin"))).otherwise(F.col("origin")),
        "Dest": F.when(ok % 17 == 2, F.concat(F.col("dest"), F.lit(" "))).otherwise(F.col("dest")),
        "Distance": token(ok % 211 == 1, "far", (ok % 2200 + 300).cast("string")),
        "TaxiIn": token(ok % 199 == 3, "12min", num(ok % 10 + 5)),
        "TaxiOut": num(ok % 15 + 10),
        "Cancelled": F.when(lost & (ok % 2 == 0), F.lit("1")).otherwise(F.lit("0")),
        "CancellationCode": F.when(lost & (ok % 2 == 0), F.element_at(F.array(*map(F.lit, "ABC")), (ok % 3 + 1).cast("int"))).when(lost, F.lit("NA")).otherwise(F.lit("N")),
        "Diverted": F.when(lost & (ok % 2 == 1), F.lit("1")).otherwise(F.lit("0")),
        "CarrierDelay": token(ok % 23 == 0, "NA", num(F.col("car"))),
        "WeatherDelay": token(ok % 29 == 0, "", num(F.col("wx"))),
        "NASDelay": token(ok % 31 == 0, "NaN", num(F.col("nas"))),
        "SecurityDelay": num(F.col("sec")),
        "LateAircraftDelay": num(late),
    }
    return r.select(*[cols[name].alias(name) for name, _ in RAW_COLUMNS])


def write_raw_csv(df: DataFrame, path: str) -> str:
    """CSV that keeps leading/trailing whitespace inside fields (Spark trims
    it on write by default), with the row number under a blank name, as pandas
    writes its index."""
    with compiled(df.sparkSession):
        (df.withColumnRenamed("Unnamed: 0", "").write.mode("overwrite").option("header", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path
