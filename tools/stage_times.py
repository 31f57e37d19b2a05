"""Summarise a Spark event log: job count, total job time, slowest stages.

Usage: python tools/stage_times.py <event log folder or file> [top_n]
Reads plain or zstd-compressed logs (the event log Spark writes with
``spark.eventLog.enabled``; e.g. ``BENCH_EVENT_LOG_DIR`` for bench.py).
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) if os.path.isdir(path) else [path]
    if os.path.isdir(path) and not files:
        files = sorted(f for f in glob.glob(os.path.join(path, "*")) if os.path.isfile(f))
    for f in files:
        with open(f, "rb") as fh:
            head = fh.read(4)
            fh.seek(0)
            if head == b"\x28\xb5\x2f\xfd":  # zstd frame
                import zstandard
                yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            else:
                yield from io.TextIOWrapper(fh, encoding="utf-8")


def summarize(path: str) -> dict:
    stages, jobs = [], {}
    for line in _lines(path):
        e = json.loads(line)
        kind = e.get("Event")
        if kind == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
            stages.append((round(dur, 3), si["Stage ID"], si["Number of Tasks"], si["Stage Name"][:80]))
        elif kind == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None]
        elif kind == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][1] = e["Completion Time"]
    job_sec = sum((b - a) / 1000 for a, b in jobs.values() if b)
    return {"jobs": len(jobs), "job_sec": round(job_sec, 3), "stages": sorted(stages, reverse=True)}


def main():
    if len(sys.argv) < 2:
        raise SystemExit(__doc__)
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    s = summarize(sys.argv[1])
    print(f"jobs={s['jobs']} job_sec={s['job_sec']} stages={len(s['stages'])}")
    for dur, sid, tasks, name in s["stages"][:top]:
        print(f"{dur:8.3f}s  stage {sid:4d}  tasks {tasks:5d}  {name}")


if __name__ == "__main__":
    main()
