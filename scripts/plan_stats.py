"""Physical-plan statistics per registered query (after AQE, from a real run):
scans, shuffles, broadcasts, windows, sort-merge joins, Python UDF nodes.

usage: python scripts/plan_stats.py [sf_dir] [name ...]
"""
from __future__ import annotations

import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def stats(plan: str) -> dict:
    keys = {"scan": r"Scan (parquet|ExistingRDD|[A-Za-z]+)", "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobin",
            "broadcast": r"BroadcastExchange", "window": r"\bWindow\b", "smj": r"SortMergeJoin",
            "bhj": r"BroadcastHashJoin", "bnlj": r"BroadcastNestedLoopJoin|CartesianProduct",
            "python": r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas",
            "subquery": r"Subquery subquery"}
    return {k: len(re.findall(v, plan)) for k, v in keys.items()}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if "/" not in a]
    from filelake.catalog import QUERIES
    from filelake.session import local_session
    spark = local_session(8)
    for name in names or sorted(QUERIES):
        df = QUERIES[name](spark, sf_dir)
        t = time.time()
        df.collect()
        el = time.time() - t
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"{name:26s} {el:6.2f}s {stats(plan)}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
