"""Per-query I/O from a Spark event log: input bytes read, shuffle bytes
written, stages and tasks, grouped by the job group bench.py sets per query.

Usage: python tools/stage_report.py <event-log-file-or-dir> [--json]
"""

from __future__ import annotations

import json
import os
import sys
from collections import defaultdict


def _acc(stage_info: dict, name: str) -> int:
    for a in stage_info.get("Accumulables", []):
        if a.get("Name") == name:
            try:
                return int(a.get("Value", 0))
            except (TypeError, ValueError):
                return 0
    return 0


def _lines(fn: str):
    """Event-log lines, plain or zstd-compressed (Spark's default codec)."""
    if fn.endswith(".zstd"):
        import io

        import zstandard

        with open(fn, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    else:
        with open(fn) as fh:
            yield from fh


def report(path: str) -> dict[str, dict[str, int]]:
    if os.path.isdir(path):
        files = [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.startswith(("events_", "local-", "app"))
                 and not f.startswith("appstatus")]
    else:
        files = [path]
    stage_group: dict[int, str] = {}
    out: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for fn in files:
        for line in _lines(fn):
            if line.strip():
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    props = ev.get("Properties") or {}
                    group = props.get("spark.jobGroup.id") or "(none)"
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                    out[group]["jobs"] += 1
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    group = stage_group.get(info["Stage ID"], "(none)")
                    if "Failure Reason" in info:
                        out[group]["failed_stages"] += 1
                        continue
                    r = out[group]
                    r["stages"] += 1
                    r["tasks"] += info.get("Number of Tasks", 0)
                    r["input_bytes"] += _acc(info, "internal.metrics.input.bytesRead")
                    r["shuffle_write_bytes"] += _acc(info, "internal.metrics.shuffle.write.bytesWritten")
                    r["shuffle_records"] += _acc(info, "internal.metrics.shuffle.write.recordsWritten")
    return {k: dict(v) for k, v in out.items()}


def main() -> None:
    rep = report(sys.argv[1])
    if "--json" in sys.argv:
        print(json.dumps(rep))
        return
    print(f"{'query':34s} {'input MB':>9s} {'shuffle KB':>11s} {'shuf rows':>10s} {'stages':>6s} {'tasks':>6s}")
    for k in sorted(rep):
        r = rep[k]
        print(f"{k:34s} {r.get('input_bytes', 0) / 1e6:9.2f} {r.get('shuffle_write_bytes', 0) / 1e3:11.1f} "
              f"{r.get('shuffle_records', 0):10d} {r.get('stages', 0):6d} {r.get('tasks', 0):6d}")


if __name__ == "__main__":
    main()
