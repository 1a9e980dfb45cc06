"""Write PLANS.md: the physical shape of every registered query.

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md

For each query the final adaptive plan (after the DataFrame itself ran) is
summarised: shuffle exchanges, single-partition exchanges (all of
them are one-row aggregates, offset tables or subqueries), join strategies,
Parquet read schemas and pushed filters, and Python stages.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoplytics.plans.registry import load_all  # noqa: E402
from shoplytics.session import get_spark  # noqa: E402


def summarise(plan: str) -> dict:
    # A finished adaptive plan prints its final and its initial form; count
    # the final one.
    plan = plan.split("== Initial Plan ==")[0]
    joins = Counter(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                               r"BroadcastNestedLoopJoin|CartesianProduct)", plan))
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|"
                                    r"RoundRobinPartitioning|SinglePartition)", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "joins": ", ".join(f"{k} {v}" for k, v in sorted(joins.items())) or "-",
        "pushed": sorted({p for p in re.findall(r"PushedFilters: \[([^\]]+)\]", plan)}),
        "python": sorted(set(re.findall(r"(ArrowEvalPython|BatchEvalPython|"
                                        r"FlatMapGroupsInPandasWithState|MapInPandas|"
                                        r"FlatMapGroupsInPandas)", plan))),
        "wscg": len(re.findall(r"WholeStageCodegen", plan)),
    }


# Headline queries whose whole final plan is printed.
FULL = ("events_per_minute", "search_first_page", "basket_contents")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("plan-report", shuffle_partitions=16)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `scripts/plan_report.py` on `{sf_dir}` (local mode, AQE on).")
    print("Counts are of the final adaptive plan; streaming queries show the plan")
    print("of the read-back of their result table.\n")
    print("| Query | Exchanges | Single-partition | Joins | Pushed filters | Python stages |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, q in load_all().items():
        df = q.run(spark, sf_dir)
        df.collect()  # runs the DataFrame's own adaptive plan to its final form
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        pushed = "; ".join(s["pushed"])[:120] or "-"
        print(f"| {name} | {s['exchanges']} | {s['single']} | {s['joins']} | {pushed} | "
              f"{', '.join(s['python']) or '-'} |")
    for name in FULL:
        df = load_all()[name].run(spark, sf_dir)
        df.collect()
        print(f"\n## `{name}` (final adaptive plan)\n")
        print("```")
        print(df._jdf.queryExecution().executedPlan().toString()
              .split("== Initial Plan ==")[0].rstrip())
        print("```")


if __name__ == "__main__":
    main()
