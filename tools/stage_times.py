"""Summarise stage durations from a Spark event log (no UI, no server).

Usage: python tools/stage_times.py <event-log-file-or-folder> [top_n]
"""

from __future__ import annotations

import json
import os
import sys


def _files(path: str) -> list[str]:
    """The newest application's log: a plain file, or a rolling ``eventlog_v2_*`` folder of ``events_*`` parts."""
    if not os.path.isdir(path):
        return [path]
    entries = sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith("."))
    newest = max(entries, key=os.path.getmtime)
    if os.path.isdir(newest):
        parts = [os.path.join(newest, f) for f in os.listdir(newest) if f.startswith("events_")]
        return sorted(parts, key=lambda f: int(os.path.basename(f).split("_")[1]))
    return [newest]


def _lines(name: str):
    if name.endswith(".zstd") or name.endswith(".zst"):
        import io

        import zstandard

        with open(name, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(name, encoding="utf-8") as fh:
            yield from fh


def load(path: str):
    for name in _files(path):
        for line in _lines(name):
            if line.strip():
                yield json.loads(line)


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    stages, tasks = {}, {}
    for ev in load(path):
        kind = ev.get("Event")
        if kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            sid = info["Stage ID"]
            dur = (info.get("Completion Time", 0) - info.get("Submission Time", 0)) / 1000
            stages[sid] = (dur, info["Number of Tasks"], info["Stage Name"][:70])
        elif kind == "SparkListenerTaskEnd":
            sid = ev["Stage ID"]
            ti = ev["Task Info"]
            tasks.setdefault(sid, []).append((ti["Finish Time"] - ti["Launch Time"]) / 1000)
    rows = sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]
    print(f"{'stage':>6} {'secs':>7} {'tasks':>6} {'task max':>9} {'task sum':>9}  name")
    for sid, (dur, n, name) in rows:
        t = tasks.get(sid, [0])
        print(f"{sid:>6} {dur:7.2f} {n:6d} {max(t):9.2f} {sum(t):9.2f}  {name}")
    print(f"stages: {len(stages)}, total stage seconds: {sum(v[0] for v in stages.values()):.1f}")


if __name__ == "__main__":
    main()
