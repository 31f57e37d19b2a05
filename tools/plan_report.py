"""Summarise the physical plan of registered queries (after AQE has run).

Usage: python tools/plan_report.py [sf_dir] [name ...]
For each query: exchanges, join strategies, window group limits, and for
each parquet scan the columns read and filters pushed down.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def summarize(df) -> dict:
    df.write.format("noop").mode("overwrite").save()          # run, so AQE settles the plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = []
    for line in plan.splitlines():
        if "FileScan parquet" not in line:
            continue
        src = re.search(r"Location: [^\[]*\[([^\]]*)\]", line)
        pushed = re.search(r"PushedFilters: (\[[^\]]*\])", line)
        schema = re.search(r"ReadSchema: (struct<.*>)", line)
        name = src.group(1).rstrip("/").split("/")[-1] if src else "?"
        scans.append((name, pushed.group(1) if pushed else "[]", schema.group(1) if schema else "?"))
    return {
        "exchanges": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        + plan.count("Exchange SinglePartition"),
        "single_partition_exchanges": plan.count("Exchange SinglePartition"),
        "broadcast_joins": plan.count("BroadcastHashJoin"),
        "sort_merge_joins": plan.count("SortMergeJoin"),
        "nested_loop_joins": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "window_group_limits": plan.count("WindowGroupLimit"),
        "sort_aggregates": plan.count("SortAggregate"),
        "python_udfs": plan.count("ArrowEvalPython") + plan.count("BatchEvalPython"),
        "python_state": plan.count("FlatMapGroupsInPandasWithState"),
        "scans": [(a[:60], b[:160], c[:160]) for a, b, c in scans],
    }


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from cinestat.plans import registry
    from cinestat.session import local_session
    spark = local_session(8)
    for name, q in registry.REGISTRY.items():
        if names and name not in names:
            continue
        s = summarize(q.fn(spark, sf_dir))
        scans = s.pop("scans")
        print(f"== {name}: " + ", ".join(f"{k}={v}" for k, v in s.items()))
        for src, pushed, schema in scans:
            print(f"     scan {src}: {schema} pushed={pushed}")


if __name__ == "__main__":
    main()
