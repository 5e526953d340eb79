"""Plain, slow versions of what the operators compute, to hold them against."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def shingles(texts, k=3):
    out = set()
    for t in texts:
        w = words(t)
        out |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def alike(a, b, t):
    return bool(a) and bool(b) and len(a & b) >= t * len(a | b) - 1e-9


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    return {x: min(g) for g in groups.values() for x in g}


def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def counting_rows(rows):
    """rows: dicts of trace_messages; those that count, by trace and node."""
    out = defaultdict(dict)
    for r in rows:
        if r["trace_id"] is None:
            continue
        old = out[r["trace_id"]].get(r["node"])
        if old is None or (old["received_at"], old["msg_id"]) < (r["received_at"], r["msg_id"]):
            out[r["trace_id"]][r["node"]] = r
    return out


def sound(rows, read_calls, is_blank, means):
    """TESTDATA.md's rule for one trace, read line by line."""
    rows = [rows[n] for n in sorted(rows)]
    if [r["node"] for r in rows] != list(range(len(rows))) or any(r["parent"] != (r["node"] - 1 if r["node"] else None) for r in rows):
        return False
    roles = [means.get((r["role"] or "").strip().lower()) for r in rows]
    calls = [read_calls(r["tool_calls"]) for r in rows]
    if None in roles or None in calls:
        return False
    waiting = Counter()
    for r, role, own in zip(rows, roles, calls):
        if role == "tool":
            key = (r["tool_call_id"] or "").strip()
            if not waiting[key]:
                return False
            waiting[key] -= 1
        waiting.update(c[0] for c in own)
    if any(waiting.values()) or not any(role == "user" and not is_blank(r["content"]) for r, role in zip(rows, roles)):
        return False
    pending = False
    for r, role, own in zip(rows, roles, calls):
        if role == "user":
            if pending:
                return False
            pending = True
        elif role == "assistant" and (own or not is_blank(r["content"])):
            pending = False
    return not pending and roles[-1] == "assistant" and not calls[-1] and not is_blank(rows[-1]["content"])


def cheapest(bits, weights, penalty):
    """The optimal segmentation by trying every boundary set."""
    n, best = len(bits), None
    for mask in range(1 << (n - 1)):
        starts = [0] + [i + 1 for i in range(n - 1) if mask >> i & 1]
        total = penalty * (len(starts) - 1)
        for a, b in zip(starts, starts[1:] + [n]):
            for bit in range(64):
                ones = sum(w for x, w in zip(bits[a:b], weights[a:b]) if x >> bit & 1)
                total += min(ones, sum(weights[a:b]) - ones) / 64
        best = total if best is None else min(best, total)
    return best
