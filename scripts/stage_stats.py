"""Jobs / stages / tasks and wall time per registered query (status tracker,
no UI): the objective count of work a query plans.

usage: python scripts/stage_stats.py [sf_dir] [name ...]
"""
from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and "/" in argv[1] else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if "/" not in a]
    from filelake.catalog import QUERIES
    from filelake.session import local_session
    spark = local_session(8)
    sc = spark.sparkContext
    st = sc.statusTracker()
    for name in names or sorted(QUERIES):
        QUERIES[name](spark, sf_dir).collect()  # warm
        sc.setJobGroup(name, name)
        t = time.time()
        QUERIES[name](spark, sf_dir).collect()
        el = time.time() - t
        jobs = st.getJobIdsForGroup(name)
        stages = set()
        for j in jobs:
            info = st.getJobInfo(j)
            if info:
                stages.update(info.stageIds)
        tasks = 0
        for s in stages:
            si = st.getStageInfo(s)
            if si and si.numCompletedTasks:
                tasks += si.numCompletedTasks
        done = [s for s in stages if st.getStageInfo(s) and st.getStageInfo(s).numCompletedTasks]
        print(f"{name:26s} {el:6.2f}s jobs={len(jobs):3d} stages_run={len(done):3d} tasks={tasks:5d}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
