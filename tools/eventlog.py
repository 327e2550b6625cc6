"""Summarise a Spark event log: per stage, task count and task-time spread.

Usage: python tools/eventlog.py <event-log file or eventlog_v2 directory> [top_n]

A stage whose slowest task takes many times its median is skewed; the
summary lists the stages with the largest max/median ratio and the largest
total task time, with shuffle read/write bytes.
"""

from __future__ import annotations

import io
import json
import os
import statistics
import sys
from collections import defaultdict


def _lines(path):
    """Event lines from a plain or zstd file, or every events_* file of a v2 folder."""
    files = [path]
    if os.path.isdir(path):
        files = sorted((os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_")),
                       key=lambda p: int(os.path.basename(p).split("_")[1]))
    for fp in files:
        if fp.endswith(".zstd"):
            import zstandard

            with open(fp, "rb") as raw:
                text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
                yield from text
        else:
            with open(fp) as f:
                yield from f


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    tasks = defaultdict(list)
    shuffle = defaultdict(lambda: [0, 0])
    names = {}
    if True:
        for line in _lines(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerStageSubmitted":
                info = ev["Stage Info"]
                names[(info["Stage ID"], info["Stage Attempt ID"])] = info.get("Stage Name", "")[:60]
            elif kind == "SparkListenerTaskEnd":
                key = (ev["Stage ID"], ev["Stage Attempt ID"])
                ti = ev["Task Info"]
                tasks[key].append(ti["Finish Time"] - ti["Launch Time"])
                m = ev.get("Task Metrics") or {}
                shuffle[key][0] += (m.get("Shuffle Read Metrics") or {}).get("Remote Bytes Read", 0) + \
                    (m.get("Shuffle Read Metrics") or {}).get("Local Bytes Read", 0)
                shuffle[key][1] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    rows = []
    for key, ds in tasks.items():
        med = statistics.median(ds)
        rows.append((key, len(ds), max(ds), med, sum(ds), max(ds) / med if med else float("inf")))
    print(f"{'stage':>10} {'tasks':>6} {'max_ms':>8} {'med_ms':>8} {'sum_ms':>8} {'skew':>6} "
          f"{'shuf_rd':>10} {'shuf_wr':>10}  name")
    for r in sorted(rows, key=lambda r: -r[4])[:top]:
        (sid, att), n, mx, med, tot, skew = r
        rd, wr = shuffle[(sid, att)]
        print(f"{sid:>7}.{att:<2} {n:>6} {mx:>8} {med:>8.0f} {tot:>8} {skew:>6.1f} {rd:>10} {wr:>10}  "
              f"{names.get((sid, att), '')}")


if __name__ == "__main__":
    main()
