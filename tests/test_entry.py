import __spark_entry__ as ENTRY


def test_entry_smoke(spark):
    df = ENTRY.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["severity_rank", "airline", "total_flights", "severe_delay_flights", "severe_delay_rate",
                          "mild_delay_rate", "moderate_delay_rate", "avg_delay", "severity_profile"]
    assert [r["severity_rank"] for r in rows] == sorted(r["severity_rank"] for r in rows)
