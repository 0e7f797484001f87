"""Distributed order statistics, box plots and correlations against numpy and
pandas, each from one pass over the data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, counted
from tarmac.operators import histogram as H
from tarmac.operators.aggregates import corr_matrix, exact_quantiles
from tarmac.operators.profile import boxplot_stages, boxplot_stats, describe
from tarmac.session import keep, keeping, release
from tarmac.sources.flights import prepare

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_million_distinct_doubles(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(F.sin(F.col("id") * 0.7310585).alias("x"))
    hist = H.value_histogram(df, ["x"])
    sizes = [r["count"] for r in hist.groupBy(H.PART).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 400_000 and sum(sizes) > 999_000
    got = H.quantiles(hist, PROBS).first()["q"]
    want = np.quantile(np.array(df.toPandas()["x"]), PROBS)
    assert np.allclose(got, want, rtol=0, atol=1e-15)


@pytest.mark.parametrize("seed", range(4))
def test_groups_ties_and_nulls(spark, seed):
    rng = np.random.default_rng(seed)
    n = 500
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], n, p=[0.9, 0.05, 0.03, 0.02]), "x": rng.integers(0, 9, n).astype(float), "y": rng.normal(1e9, 1, n)})
    pdf.loc[rng.random(n) < 0.2, "x"] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "g string, x double, y double")
    got = {(r["g"], r["measure"]): r["q"] for r in exact_quantiles(df, ["x", "y"], PROBS, ["g"]).collect()}
    groups = pdf.fillna({"g": "null"}).groupby("g")
    for (g, part), m in ((k, m) for k in groups for m in ("x", "y")):
        values = part[m].dropna()
        key = (None if g == "null" else g, m)
        if values.empty:
            assert key not in got
        else:
            assert np.allclose(got[key], np.quantile(values, PROBS), rtol=1e-15, atol=0)


def test_describe_with_and_without_values(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.5, None, None), (10.0, None, None)], "a double, b double, c double")
    got = {r["column_name"]: r for r in describe(df, ["a", "b", "c"]).collect()}
    want = pd.Series([1.0, 2.5, 10.0]).describe()
    assert [got["a"][k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == [round(v, 4) for v in want]
    assert (got["b"]["count"], got["b"]["mean"], got["b"]["p50"]) == (0, None, None)
    assert (got["c"]["count"], got["c"]["std"], got["c"]["p50"]) == (1, None, 5.0)


def test_box_plots_before_and_after(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": np.round(rng.normal(50, 20, 800)), "b": np.round(rng.exponential(30, 800))})
    got = {(r["stage"], r["column_name"]): r for r in boxplot_stages(spark.createDataFrame(pdf), ["a", "b"]).collect()}
    bounds = {c: pdf[c].quantile([0.25, 0.75]).tolist() for c in pdf}
    keep_rows = np.logical_and.reduce([pdf[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, q3) in bounds.items()])
    for stage, frame in (("before", pdf), ("after", pdf[keep_rows])):
        for c in pdf:
            q1, med, q3 = frame[c].quantile([0.25, 0.5, 0.75])
            inside = frame[c].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
            r = got[stage, c]
            assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, med, q3), abs=1e-12)
            assert (r["whisker_low"], r["whisker_high"], r["outliers"]) == (frame[c][inside].min(), frame[c][inside].max(), int((~inside).sum()))
    assert {r["column_name"] for r in boxplot_stats(spark.createDataFrame(pdf), "a").collect()} == {"a"}


def test_correlation_far_from_zero_and_with_nulls(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 400)
    pdf = pd.DataFrame({"a": 1e9 + x, "b": -3e8 + x + rng.normal(0, 1, 400), "c": rng.normal(0, 1e-3, 400), "d": np.full(400, 7e11)})
    for c, share in (("b", 0.3), ("c", 0.5)):
        pdf.loc[rng.random(400) < share, c] = np.nan
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double, d double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in corr_matrix(df, list(pdf), scale=9).collect()}
    assert len(got) == 16
    for a in "abc":
        for b in "abc":
            both = pdf[[a, b]].dropna() if a != b else pdf[[a]].dropna().assign(_=pdf[a])
            u, v = both.iloc[:, 0] - both.iloc[:, 0].mean(), both.iloc[:, 1] - both.iloc[:, 1].mean()
            assert got[a, b] == pytest.approx((u * v).sum() / np.sqrt((u * u).sum() * (v * v).sum()), abs=2e-6 if a != b else 1e-9)
    assert all(got["d", c] is None and got[c, "d"] is None for c in "abcd")


@pytest.mark.parametrize("name", ["describe", "boxplot_stages", "quantiles", "corr"])
def test_one_pass(spark, name):
    df, passes = counted(prepare(spark, SF_SMALL).flights0)
    cols = ["ArrDelay", "DepDelay"]
    run = {"describe": lambda: describe(df, cols), "boxplot_stages": lambda: boxplot_stages(df, cols), "quantiles": lambda: exact_quantiles(df, cols, [0.5], ["Month"]),
           "corr": lambda: corr_matrix(df, cols)}[name]
    with keeping():
        frame = run()
        assert passes() == 0  # building it runs nothing
        assert frame.collect()
        # The correlation's shift stops at the first row of the first partition.
        assert passes() == 1 if name != "corr" else 1 <= passes() < 3


def test_kept_frames_are_shared_and_released(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    with keeping():
        one, other = keep(df), keep(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
        assert one is other and one.storageLevel.useMemory
        assert one.count() == 7
    assert not df.storageLevel.useMemory
    release()
