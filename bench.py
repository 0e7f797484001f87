"""Benchmark: the reference's workload (scope queries, Q1-Q12, notebook EDA,
report marts) at one scale factor.

Prints ONE JSON line. ``value`` is the sum of per-query wall-clock seconds
(each query collected to the driver, but for results of the size of the facts,
which go to a sink that drops them; warm: best of ``BENCH_REPEAT`` runs; what a
query keeps is released after each run) plus the preparation (derive flights from the TPC-H-style tables, write it,
compute and write the IQR bounds), rebuilt from scratch each time and timed
the same way (best of ``BENCH_REPEAT``; the first run includes JVM warm-up).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3), BENCH_EVENT_LOG (optional folder: write Spark's
event log there; every query runs under its own job group, so
``tools/stage_report.py`` can attribute input and shuffle bytes to it).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarmac.plans.catalog import ANALYSES, queries  # noqa: E402
from tarmac.session import build_session, keeping  # noqa: E402
from tarmac.sources.flights import prepare  # noqa: E402

#: The analyses, and what stands before them: profiling, cleaning, sinks.
MORE = ["prof_describe", "prof_duplicates", "prof_boxplot", "pipeline_clean", "agg_corr_matrix", "sink_csv", "sink_query_exports"]
HEADLINE = [*ANALYSES, *MORE]
#: Results of the size of the facts: run into a sink that drops them, not to the driver.
WIDE = {"pipeline_clean", "sink_csv"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    event_dir = os.environ.get("BENCH_EVENT_LOG") or tempfile.mkdtemp(prefix="run-bench-events-")
    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir}
    spark = build_session(cpus, app="tarmac-bench", shuffle_partitions=cpus, extra=extra)
    sc = spark.sparkContext

    prepare_sec = None
    sc.setJobGroup("prepare_flights", "prepare_flights")
    for _ in range(repeat):
        t0 = time.perf_counter()
        prep = prepare(spark, sf_dir, rebuild=True)
        dt = time.perf_counter() - t0
        prepare_sec = dt if prepare_sec is None else min(prepare_sec, dt)

    every = queries()
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in HEADLINE:
        sc.setJobGroup(name, name)
        best = None
        for _ in range(repeat):
            t = time.perf_counter()
            with keeping():
                df = every[name](spark, sf_dir)
                if name in WIDE:
                    df.write.format("noop").mode("overwrite").save()
                    out = []
                else:
                    out = df.collect()
            dt = time.perf_counter() - t
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 4)
        rows[name] = len(out)

    sc.setJobGroup("(bench)", "(bench)")
    n_flights = prep.flights.count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    total = prepare_sec + sum(times.values())
    app_id = sc.applicationId
    spark.stop()  # flushes the event log
    io = _io_report(event_dir, app_id)
    print(json.dumps({
        "metric": "delay_workload_total",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {"prepare_flights": round(prepare_sec, 4), **times},
        "sf": sf,
        "cpus": cpus,
        "fact_rows": n_flights,
        "rows": rows,
        "shuffle_bytes": {k: v.get("shuffle_write_bytes", 0) for k, v in io.items()},
        "stages": {k: v.get("stages", 0) for k, v in io.items()},
    }))


def _io_report(event_dir: str, app_id: str) -> dict:
    """Per-query shuffle bytes and stage counts from this run's event log
    (summed over all repeats of the query)."""
    from tools.stage_report import report

    try:
        logs = [os.path.join(event_dir, d) for d in os.listdir(event_dir) if app_id in d]
        return report(logs[0]) if logs else {}
    except Exception:  # noqa: BLE001 - the metric is informational
        return {}


if __name__ == "__main__":
    main()
