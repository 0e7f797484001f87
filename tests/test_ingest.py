"""CSV by name, rejected tokens, NaN, input changes, and writers that keep out of each other's way."""

import os
import re
import shutil

import pytest

from tarmac.operators.clean import iqr_bounds
from tarmac.plans import marts as M
from tarmac.plans.catalog import queries
from tarmac.sources.flights import RAW_COLUMNS, prepare, read_flights_csv, reject_counts
from tarmac.sources.landing import load_csv

from conftest import SF_SMALL, flight, FLIGHT_SCHEMA

COLS = [("DepDelay", "double"), ("ArrDelay", "double"), ("Flights", "bigint")]


def write(path, *lines):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-{len(os.listdir(path))}.csv", "w") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


def test_columns_are_found_by_name(spark, tmp_path):
    p = write(tmp_path / "a", "Extra,ArrDelay,DepDelay,Flights", "x,2,1,9007199254740993")
    r = read_flights_csv(spark, p, COLS).first()
    assert (r.DepDelay, r.ArrDelay, r.Flights) == (1.0, 2.0, 9007199254740993)
    with pytest.raises(ValueError, match="lacks DepDelay"):
        read_flights_csv(spark, write(tmp_path / "b", "ArrDelay,Flights", "2,1"), COLS)


def test_another_header_in_the_folder_fails(spark, tmp_path):
    write(tmp_path / "a", "ArrDelay,DepDelay,Flights", "2,1,3")
    p = write(tmp_path / "a", "DepDelay,ArrDelay,Flights", "1,2,3")
    with pytest.raises(Exception, match="(?i)header"):
        read_flights_csv(spark, p, COLS).collect()


def test_nan_and_rejects(spark, tmp_path):
    p = write(tmp_path / "a", "DepDelay,ArrDelay,Flights", '" NaN",NAN,12.7', "12x,NA,3", "4,5,abc", ",,")
    rows = [tuple(r) for r in read_flights_csv(spark, p, COLS).collect()]
    assert rows == [(None, None, 12), (None, None, 3), (4.0, 5.0, None), (None, None, None)]
    assert {r["column"]: r["rejected"] for r in reject_counts(spark, p, COLS).collect()} == {"DepDelay": 1, "ArrDelay": 0, "Flights": 1}
    with pytest.raises(Exception, match="not a number"):
        read_flights_csv(spark, p, COLS, on_reject="fail").collect()


def test_nan_does_not_reach_the_bounds(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 6)] + [(float("nan"),)], "x double")
    r = iqr_bounds(df, ["x"]).first()
    assert (r.x_q1, r.x_q3) == (2.0, 4.0)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_changed_inputs_are_seen(spark, tmp_path, scheme):
    d = tmp_path / "sf"
    shutil.copytree(SF_SMALL, d)
    before = prepare(spark, f"{scheme}{d}").flights0.count()
    half = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 2 = 0").toPandas()
    os.chmod(d, 0o755)
    os.remove(d / "lineitem.parquet")
    spark.createDataFrame(half).coalesce(1).write.parquet(f"file://{d}/lineitem.parquet")
    assert prepare(spark, f"{scheme}{d}", refresh=True).flights0.count() < before


def test_a_rebuild_leaves_earlier_readers_alone(spark):
    old = prepare(spark, SF_SMALL)
    n = old.flights0.count()
    new = prepare(spark, SF_SMALL, rebuild=True)
    assert old.flights0.count() == new.flights0.count() == n and old.flights0.inputFiles() != new.flights0.inputFiles()


def test_writers_in_any_order(spark):
    q = queries()
    names = ["src_csv", "sink_csv", "sink_table", "sink_query_exports", "stream_ingest", "src_csv_raw", "pipeline_clean", "pipeline_original", "prof_invariants_raw"]
    built = {n: q[n](spark, SF_SMALL) for n in names}
    q["src_csv"](spark, SF_SMALL)
    assert all(built[n].count() > 0 for n in reversed(names))


@pytest.mark.parametrize("causes", [(0.0,) * 5, (None, 1.0, 2.0, 3.0, 4.0), (5.0, 1.0, 0.0, 0.0, 4.0), (None,) * 5])
def test_kpi_agrees_with_its_mart(spark, causes):
    names = ["CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"]
    df = spark.createDataFrame([flight(**dict(zip(names, causes)))], FLIGHT_SCHEMA)
    kpi = {r.metric: r.value for r in M.mart_kpi(df).collect()}["controllable_pct"]
    mart = M.mart_controllable_pct(df).first()[0]
    assert (None if kpi is None else float(kpi)) == mart


def test_pandas_index_under_a_blank_name(spark, tmp_path):
    cols = [("Unnamed: 0", "bigint"), *COLS]
    p = write(tmp_path / "a", ",DepDelay,ArrDelay,Flights", "0,1.0,2.0,3", "1,NA,4.0,5")
    assert [tuple(r) for r in read_flights_csv(spark, p, cols).collect()] == [(0, 1.0, 2.0, 3), (1, None, 4.0, 5)]
    assert read_flights_csv(spark, p, COLS).count() == 2  # and it may be left out
    kept = read_flights_csv(spark, write(tmp_path / "b", "_c0,DepDelay,ArrDelay,Flights", "7,1.0,2.0,3"), [("_c0", "bigint"), *COLS]).first()
    assert kept["_c0"] == 7


def test_the_reference_header_loads(spark, tmp_path):
    header = ["", *[n for n, _ in RAW_COLUMNS[1:]]]
    p = write(tmp_path / "a", ",".join(header), ",".join(str(i) for i in range(len(header))))
    r = read_flights_csv(spark, p).first()
    assert r["Unnamed: 0"] == 0 and r["LateAircraftDelay"] == len(header) - 1


def test_load_counts_rejects_in_its_pass(spark, tmp_path):
    p = write(tmp_path / "a", "DepDelay,ArrDelay,Flights", "1,2,3", "x,2,3", "1,y,z", "1,NA,3", "NaN,5,12.0")
    load = load_csv(spark, p, f"file://{tmp_path}/out", COLS)
    assert load.counts == {"rows_read": 5, "rows_kept": 3, "rows_incomplete": 2, "rows_rejected": 2, "bad_DepDelay": 1, "bad_ArrDelay": 1, "bad_Flights": 1}
    assert sorted(map(str, map(tuple, load.table.collect()))) == sorted(map(str, [(1.0, 2.0, 3), (None, 2.0, 3), (None, 5.0, 12)]))
    found = sorted((x["column"], x["token"]) for r in load.rejects.collect() for x in r["rejected"])
    assert found == [("ArrDelay", "y"), ("DepDelay", "x"), ("Flights", "z")]
    assert {r["counted"]: r["rows"] for r in load.report().collect()} == load.counts


def test_load_without_rows(spark, tmp_path):
    load = load_csv(spark, write(tmp_path / "a", "DepDelay,ArrDelay,Flights"), f"file://{tmp_path}/out", COLS)
    assert load.counts["rows_read"] == 0 and load.table.count() == 0 and load.rejects.count() == 0


def code_bytes(df, capsys):
    """The largest generated method of a plan."""
    df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)), default=0)


def test_typing_stays_below_what_the_jvm_compiles(spark, tmp_path, capsys):
    names = [n for n, _ in RAW_COLUMNS]
    p = write(tmp_path / "a", ",".join(names), ",".join(str(i) for i in range(len(names))))
    assert code_bytes(read_flights_csv(spark, p), capsys) < 8000


def test_numbers_are_not_looked_up_among_the_missing_tokens(spark, tmp_path):
    p = write(tmp_path / "a", "DepDelay,ArrDelay,Flights", "1,2,3")
    plan = read_flights_csv(spark, p, COLS)._jdf.queryExecution().analyzed().toString()
    assert " IN (" not in plan and "btrim" not in plan


def test_odd_tokens_of_a_number(spark, tmp_path):
    tokens = ["7", " 8 ", "12.0", "1e3", "NaN", "-nan", " NaN ", " NA ", "1.#IND", "x", "9223372036854775808"]
    p = write(tmp_path / "a", "DepDelay,ArrDelay,Flights", *[f"1,2,{t}" for t in tokens])
    want = [7, 8, 12, 1000, None, None, None, None, None, None]
    assert [r["Flights"] for r in read_flights_csv(spark, p, COLS).collect()][:-1] == want
    load = load_csv(spark, p, f"file://{tmp_path}/out", COLS)
    assert [x["token"] for r in load.rejects.collect() for x in r["rejected"]] == ["x"] and load.counts["rows_kept"] == len(tokens)


def test_a_loaded_row_is_stored_once(spark, tmp_path):
    p = write(tmp_path / "a", "DepDelay,ArrDelay,Flights", "1,2,3", "x,2,3", "1,NA,3", '1," y ",3', '" 7 ",5,"\t8"')
    load = load_csv(spark, p, f"file://{tmp_path}/out", COLS)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4  # all but the incomplete row without a bad token
    assert sorted(map(str, map(tuple, load.table.collect()))) == sorted(map(str, [(1.0, 2.0, 3), (None, 2.0, 3), (7.0, 5.0, 8)]))
    assert sorted((x["column"], x["token"]) for r in load.rejects.collect() for x in r["rejected"]) == [("ArrDelay", " y "), ("DepDelay", "x")]
    assert load.counts["rows_read"] == 5 and load.counts["rows_kept"] == 3 and load.counts["rows_rejected"] == 2


def test_writes_of_wide_rows_are_compiled(spark, tmp_path, monkeypatch):
    from tarmac.sources import raw

    seen, limit = [], "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit, None)
    frame = spark.range(1).selectExpr("'0' AS `Unnamed: 0`")
    rename = type(frame).withColumnRenamed
    monkeypatch.setattr(type(frame), "withColumnRenamed", lambda *a: seen.append(spark.conf.get(limit)) or rename(*a))
    raw.write_raw_csv(frame, f"file://{tmp_path}/raw")
    assert seen == ["8000"] and spark.conf.get(limit, None) == before


def test_the_raw_file_needs_no_prepared_facts(spark, tmp_path):
    from tarmac.sources import flights as source

    d = tmp_path / "sf"
    shutil.copytree(SF_SMALL, d)
    q = queries()
    assert q["src_csv_raw"](spark, str(d)).count() > q["pipeline_original"](spark, str(d)).count() > 0
    root = source.folder(spark, str(d))
    assert not [k for k in source._MEMO if k[1] == root]
    assert source.prepare(spark, str(d)).root == root
