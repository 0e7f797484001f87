import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, counted
from tarmac.plans import analyses as Q
from tarmac.plans.cells import all_cells, analyses
from tarmac.session import keeping
from tarmac.sources.flights import prepare
from tarmac.sources.sinks import VersionedTable, export_all, export_manifest, write_table


def test_csv_exports_round_trip(spark):
    f = prepare(spark, SF_SMALL).flights
    root = tempfile.mkdtemp(prefix="tarmac-exports-")
    fns = {"q06": lambda: Q.q06_severity_profile(f), "q09": lambda: Q.q09_hour_risk(f)}
    paths = export_all(fns, root, fmt="csv")
    assert set(paths) == {"q06", "q09"}
    for p, _ in paths.values():
        parts = [x for x in os.listdir(p) if x.endswith(".csv")]
        assert len(parts) == 1  # report-sized results are written as one file
    got = {r["export_name"]: r["rows"] for r in export_manifest(spark, paths).collect()}
    assert got == {"q06": Q.q06_severity_profile(f).count(), "q09": Q.q09_hour_risk(f).count()}
    q06 = paths["q06"][0]
    header = open(os.path.join(q06, [x for x in os.listdir(q06) if x.endswith(".csv")][0])).readline()
    assert header.strip().split(",")[:2] == ["severity_rank", "airline"]


def test_write_table_replaces(spark):
    f = prepare(spark, SF_SMALL).flights
    path = os.path.join(tempfile.mkdtemp(prefix="tarmac-table-"), "t")
    t1 = write_table(f.limit(10), "tarmac_test_table", path)
    assert t1.count() == 10
    t2 = write_table(f.limit(3), "tarmac_test_table", path)
    assert t2.count() == 3


def test_versions_switch_under_one_name(spark, tmp_path):
    table = VersionedTable(spark, "tarmac_versions", f"file://{tmp_path}/t")
    assert table.versions() == []
    old = table.load(spark.range(10))
    new = table.load(spark.range(3))
    assert (old.count(), new.count(), spark.table("tarmac_versions").count()) == (10, 3, 3)
    with pytest.raises(Exception, match="(?i)divi"):  # a load that fails changes nothing
        table.load(spark.range(5).selectExpr("id div (id - 2) AS id"))
    again = VersionedTable(spark, "tarmac_versions", f"file://{tmp_path}/t")
    assert again.current().count() == 3 and len(again.versions()) == 2
    table.load(spark.range(4))
    dropped = table.drop_old(keep=2)
    assert len(dropped) == 1 and len(table.versions()) == 2 and table.read(dropped[0]).count() == 0
    assert [table.read(v).count() for v in table.versions()] == [3, 4]


def test_exports_read_the_facts_once(spark, tmp_path):
    whole, passes = counted(prepare(spark, SF_SMALL).flights)
    with keeping():
        of = analyses(*all_cells(whole))
        assert passes() == 0 and len(of) == 12
        written = export_all(of, f"file://{tmp_path}/x")
    assert passes() == 1
    assert {n: rows for n, (_, rows) in written.items()} == {n: spark.read.parquet(path).count() for n, (path, _) in written.items()}


@pytest.mark.parametrize("nulls", [False, True])
def test_analyses_from_cells_equal_the_direct_ones(spark, nulls):
    facts = prepare(spark, "/root/testdata/sf0.01").flights
    if nulls:  # NULLs in measures and keys, and a carrier without cause minutes
        some = lambda c, m: F.when(F.hash("ArrDelay", "DepDelay", "Origin") % m == 0, None).otherwise(F.col(c)).alias(c)
        no_cause = lambda c: F.when(F.col("UniqueCarrier") == "C03", 0.0).otherwise(F.col(c)).alias(c)
        facts = facts.select(some("Month", 13), "DepHour", some("UniqueCarrier", 11), some("Origin", 17), "Dest", some("DepDelay", 5), some("ArrDelay", 7),
                             *[no_cause(c) for c in ("CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay")])
    with keeping():
        for name, build in analyses(*all_cells(facts)).items():
            got, want = build(), getattr(Q, name)(facts)
            assert got.columns == want.columns
            assert list(map(tuple, got.collect())) == list(map(tuple, want.collect())), name
