"""Physical-plan shape: no Cartesian products, no Python in the hot path,
one fact scan for the analyses the reference writes as several, and the
IQR filter pushed into the scan."""

import contextlib
import dataclasses
import io

import pytest

from tarmac.plans import catalog
from conftest import SF_SMALL, counted
from tarmac.session import keeping

QUERIES = catalog.queries()
WRITE_KEYS = {"src_csv", "sink_csv", "sink_table", "sink_query_exports", "stream_ingest", "src_csv_raw",
              "pipeline_clean", "pipeline_original", "prof_invariants_raw", "pipeline_rejects", "pipeline_rejected_rows", "prof_distinct_flags"}

#: Queries whose layers share one aggregate.
ONE_PASS = [k for k in QUERIES if k.startswith("mart_")]


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - WRITE_KEYS))
def test_no_cartesian_or_python(spark, key):
    p = plan(QUERIES[key](spark, SF_SMALL), "simple")
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p, f"{key}: {bad}"


@pytest.fixture
def passes(spark):
    """How many times the fact table has been read as a whole, counted while queries run."""
    from tarmac.sources import flights as source

    before = source.prepare(spark, SF_SMALL)
    at = next(k for k, v in source._MEMO.items() if v is before)
    whole, read = counted(before.flights0)
    inside = source.filter_by_bounds(whole, before.bounds.first(), source.DEFAULT.measures)
    source._MEMO[at] = dataclasses.replace(before, flights0=whole, flights=inside)
    with keeping():
        yield read
    source._MEMO[at] = before


@pytest.mark.parametrize("key", ["q07_volume_vs_delay", "q08_dep_arr_profile", "q11_cause_totals", "q12_dominant_cause",
                                 "scope_total_airports", "eda_corr", "eda_extremes", "endpoint_explode",
                                 "q02_route_symmetry", "prof_describe", "prof_boxplot", "agg_quantile",
                                 *ONE_PASS])
def test_one_pass_over_the_facts(spark, passes, key):
    """Building a query reads nothing; running it reads the facts once (the
    correlations also look at the beginning for a typical row)."""
    df = QUERIES[key](spark, SF_SMALL)
    assert passes() == 0
    df.collect()
    assert passes() == 1 or (key == "eda_corr" and passes() <= 2)


def test_iqr_bounds_pushed_into_scan(spark):
    p = plan(QUERIES["q06_severity_profile"](spark, SF_SMALL), "formatted")
    assert "PushedFilters" in p and "GreaterThanOrEqual(ArrDelay" in p and "LessThanOrEqual(DepDelay" in p
    assert "ReadSchema: struct<UniqueCarrier:string,DepDelay:double,ArrDelay:double>" in p


def test_top_k_per_group_uses_partial_limit(spark):
    p = plan(QUERIES["q01_repeat_worst_routes"](spark, SF_SMALL), "simple")
    assert "WindowGroupLimit" in p
