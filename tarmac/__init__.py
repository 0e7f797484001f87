"""Delay analytics on Spark: cleaning, profiling and the delay analyses as
lazy DataFrame operators over a flight fact table.

Typical use::

    from tarmac import build_session, prepare
    from tarmac.plans import analyses as Q

    spark = build_session()
    flights = prepare(spark, "/path/to/tables").flights
    Q.q06_severity_profile(flights).show()
"""

from tarmac.session import build_session, materialize, shared_dir
from tarmac.sources.flights import prepare, read_flights_csv
from tarmac.spec import DEFAULT, FlightSpec

__all__ = ["DEFAULT", "FlightSpec", "build_session", "materialize", "prepare", "read_flights_csv", "shared_dir"]
