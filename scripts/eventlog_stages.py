"""Slowest stages from a Spark event log folder (zstd or plain JSON lines).

usage: python scripts/eventlog_stages.py <event-log-dir> [top]
"""
from __future__ import annotations

import glob
import io
import json
import sys


def _lines(path):
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def main(argv):
    top = int(argv[2]) if len(argv) > 2 else 15
    stages = []
    for f in glob.glob(f"{argv[1]}/**/*", recursive=True):
        if "events" not in f.rsplit("/", 1)[-1] and "eventlog" not in f:
            continue
        try:
            for line in _lines(f):
                e = json.loads(line)
                if e.get("Event") == "SparkListenerStageCompleted":
                    si = e["Stage Info"]
                    stages.append((si["Completion Time"] - si["Submission Time"], si["Stage ID"],
                                   si["Number of Tasks"], si["Stage Name"][:80]))
        except (IsADirectoryError, UnicodeDecodeError, json.JSONDecodeError):
            continue
    stages.sort(reverse=True)
    for s in stages[:top]:
        print(f"{s[0]:7d} ms  stage {s[1]:4d}  tasks {s[2]:4d}  {s[3]}")
    print(f"stages {len(stages)}, total {sum(s[0] for s in stages)} ms")


if __name__ == "__main__":
    main(sys.argv)
