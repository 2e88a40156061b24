"""Plain-Python reference implementations used as test oracles."""

from __future__ import annotations

import math
from collections import defaultdict


def sessions(rows, thresh=3600, mode="total"):
    """rows: dicts with seg_id, user_id, video_id, local_start_time, start_point, end_point, speed.
    Returns {seg_id: (run, gap, session)} following the reference's loops."""
    by_user = defaultdict(list)
    for r in rows:
        if r["user_id"] is not None:
            by_user[r["user_id"]].append(r)
    out = {}
    for u, rs in by_user.items():
        rs.sort(key=lambda r: (r["local_start_time"] is None, r["local_start_time"] or 0, r["seg_id"]))
        run, prev = 0, object()
        runs = []
        for i, r in enumerate(rs):
            if i == 0 or prev is None or r["video_id"] is None or prev != r["video_id"]:
                run += 1
            prev = r["video_id"]
            runs.append(run)
        gaps = []
        for i, r in enumerate(rs):
            g = None
            if i + 1 < len(rs) and runs[i + 1] == runs[i] and r["speed"] not in (0, None):
                nt = rs[i + 1]["local_start_time"]
                if nt is not None and r["local_start_time"] is not None:
                    g = nt - (r["local_start_time"] + (r["end_point"] - r["start_point"]) / r["speed"])
                    if math.isnan(g):
                        g = None
            gaps.append(g)
        sess, cur_run = 0, None
        for i, r in enumerate(rs):
            if runs[i] != cur_run:
                cur_run, sess = runs[i], 0
            out[r["seg_id"]] = (runs[i], gaps[i], sess)
            g = gaps[i]
            if g is not None:
                v = (math.floor(g) % 86400) if mode == "seconds_component" else g
                if v >= thresh:
                    sess += 1
    return out


def rep_count(intervals, t=5.0):
    n = 0
    for i in range(len(intervals)):
        for j in range(i + 1, len(intervals)):
            (s1, e1), (s2, e2) = intervals[i], intervals[j]
            if None in (s1, e1, s2, e2):
                continue
            if max(s1, s2) <= min(e1, e2) - t:
                n += 1
    return n


def dedupe(rows):
    by_user = defaultdict(list)
    for r in rows:
        by_user[r["user_id"]].append(r)
    keep = set()
    for u, rs in by_user.items():
        rs.sort(key=lambda r: (r["timestamp"], r["event_id"]))
        prev = object()
        for i, r in enumerate(rs):
            if i == 0 or prev is None or r["item_id"] is None or prev != r["item_id"]:
                keep.add(r["event_id"])
            prev = r["item_id"]
    return keep


def union_length(intervals):
    iv = sorted((s, e) for s, e in intervals if e > s)
    total, cur_s, cur_e = 0.0, None, None
    for s, e in iv:
        if cur_e is None or s > cur_e:
            if cur_e is not None:
                total += cur_e - cur_s
            cur_s, cur_e = s, e
        else:
            cur_e = max(cur_e, e)
    if cur_e is not None:
        total += cur_e - cur_s
    return total
