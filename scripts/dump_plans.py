"""Write docs/PLANS.md: formatted physical plans (after AQE) of the main
operators on the stored sf0.01 fixture manifest.

usage: python scripts/dump_plans.py [sf_dir]
"""
from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from filelake.operators import clean, consolidate, dedup, snapshot
    from filelake.plans import batches
    from filelake.session import local_session
    from filelake.sources import fixture as FX

    spark = local_session(8)
    m = FX.manifest(spark, sf_dir)
    cases = {
        "dedup_plan (deepest keeper)": lambda: dedup.dedup_plan(m, FX.ROOT, min_size=100),
        "dedup_summary": lambda: dedup.dedup_summary(m, FX.ROOT, min_size=100),
        "snapshot by_extension": lambda: snapshot.snapshot(m, FX.ROOT).by_extension,
        "snapshot samples (group limit)": lambda: snapshot.snapshot(m, FX.ROOT).samples,
        "consolidate_plan": lambda: consolidate.consolidate_plan(m, FX.ROOT, FX.TARGET),
        "empty_dirs_plan": lambda: clean.empty_dirs_plan(FX.directories(spark, m), m, FX.ROOT),
        "delete batches": lambda: batches.delete_batches(dedup.dedup_plan(m, FX.ROOT, min_size=100)),
    }
    out = ["# Physical plans\n",
           "Generated by `scripts/dump_plans.py` on the stored sf0.01 fixture manifest "
           "(`local[8]`, AQE on). Final adaptive plans, after execution; the stored "
           "intermediates appear as parquet scans of the checkpoint folder.\n"]
    for title, fn in cases.items():
        df = fn()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"file:/[^\],]*/(filelake-[a-z0-9-]+?)-[0-9a-f]{32}", r"<ckpt>/\1", plan)
        plan = re.sub(r"#\d+L?", "", plan)
        out.append(f"\n## {title}\n\n```\n{plan.strip()}\n```\n")
    Path(__file__).resolve().parents[1].joinpath("docs", "PLANS.md").write_text("".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
