import os
import tempfile

from conftest import SF_SMALL
from tarmac.sources.flights import FLIGHT_COLUMNS, prepare
from tarmac.sources.sinks import write_csv
from tarmac.streaming.ingest import ingest_available


def test_stream_ingest_is_incremental_and_exactly_once(spark):
    f0 = prepare(spark, SF_SMALL).flights0
    base = tempfile.mkdtemp(prefix="tarmac-stream-")
    landing, table, ckpt = (os.path.join(base, x) for x in ("landing", "table", "ckpt"))
    jan, rest = f0.filter("Month = 1"), f0.filter("Month <> 1")
    write_csv(jan, os.path.join(landing, "batch1"))
    # the file source reads one folder level: move part files up by writing straight into landing
    first = ingest_available(spark, os.path.join(landing, "batch1"), table, ckpt, FLIGHT_COLUMNS)
    assert first.count() == jan.count()
    # a restart over the same folder adds nothing
    again = ingest_available(spark, os.path.join(landing, "batch1"), table, ckpt, FLIGHT_COLUMNS)
    assert again.count() == jan.count()
    write_csv(rest, os.path.join(landing, "batch1"), mode="append")
    full = ingest_available(spark, os.path.join(landing, "batch1"), table, ckpt, FLIGHT_COLUMNS)
    assert full.count() == f0.count()
    assert sorted(tuple(r) for r in full.collect()) == sorted(tuple(r) for r in f0.collect())
