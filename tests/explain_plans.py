"""Summarise the physical plans of the headline queries into PLANS.md.

Usage: python tests/explain_plans.py [sf_dir]

Each query is executed once (so AQE's final plan is known), then its final
plan is scanned for the properties the design relies on: number of shuffle
exchanges, broadcast exchanges, sort-merge joins, Python evaluation nodes,
windows without a partition key, cross/nested-loop joins and pushed filters.
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = [
    "closure_by_franchise", "names_stage3", "dictionary_match", "franchise_flag", "resolve_address",
    "dedup_first", "stratified_split", "sample_to", "oversample_keep", "roc_auc", "pr_points",
    "assign_batches", "point_in_polygon", "region_fallback", "closure_rollup", "quarterly_trend",
    "bulk_enrich", "assemble_features",
]


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def top_level(plan: str) -> str:
    """Keep the final adaptive plan only and drop the bodies of cached
    relations (they repeat the cached plan)."""
    plan = plan.split("== Initial Plan ==")[0]
    out, skip = [], None
    for line in plan.split("\n"):
        ind = len(re.match(r"^([ :|+\-]*)", line).group(1))
        if skip is not None and ind > skip:
            continue
        skip = None
        out.append(line)
        if "InMemoryRelation" in line:
            skip = ind
    return "\n".join(out)


def summarise(plan: str) -> dict:
    p = top_level(plan)
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|"
                                   r"Exchange SinglePartition", p)),
        "single_partition": p.count("Exchange SinglePartition"),
        "broadcasts": p.count("BroadcastExchange"),
        "smj": p.count("SortMergeJoin"),
        "bhj": p.count("BroadcastHashJoin"),
        "nested_loop_or_cartesian": p.count("BroadcastNestedLoopJoin") + p.count("CartesianProduct"),
        "python": p.count("BatchEvalPython") + p.count("ArrowEvalPython") + p.count("MapInPandas")
        + p.count("PythonMapInArrow"),
        "cached_scans": p.count("InMemoryTableScan"),
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", p))),
    }


def main(argv):
    from bizlens.session import local_session
    import __spark_entry__ as E

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(shuffle_partitions=16)
    spark.sparkContext.setLogLevel("OFF")
    q = E.queries()
    rows = []
    for name in QUERIES:
        s = summarise(final_plan(q[name](spark, sf)))
        spark.catalog.clearCache()
        rows.append((name, s))
        print(name, s, flush=True)
    keys = list(rows[0][1])
    lines = ["# PLANS", "",
             f"Final (AQE) physical plans of the headline queries at `{sf}` on `local[*]`, "
             "16 shuffle partitions; generated by `tests/explain_plans.py`.  Bodies of cached "
             "relations are counted once.  `single_partition` counts exchanges to one partition: "
             "they only ever carry bounded tables (dictionary <= top_n rows, bucket tables "
             "<= 2^bits rows, top-k, class counts).", "",
             "| query | " + " | ".join(keys) + " |", "| --- | " + " | ".join("---" for _ in keys) + " |"]
    for name, s in rows:
        lines.append(f"| {name} | " + " | ".join(str(s[k]) for k in keys) + " |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main(sys.argv)
