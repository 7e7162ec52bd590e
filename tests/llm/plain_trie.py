"""A plain prefix trie of rebuilt conversations, by dictionaries, for the tests."""

import hashlib
import zlib


def rebuilt(rows, keep=9, family=5):
    """``{conv_id: [(role, text), ...]}`` from ``(conv_id, turn, role, text)`` rows, as the contract rebuilds them."""
    by_conv = {}
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        by_conv.setdefault(conv, []).append((turn, role or "", text or ""))
    ordered = {
        c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1], x[2]))]
        for c, ts in by_conv.items()
    }
    out = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % keep
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        out[c] = ordered.get(base, [])[:h] + own[h:]
    return out


def trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    out = []
    for prefix, node in nodes.items():
        sub = [p for p in nodes if p[: len(prefix)] == prefix]
        kids = [p for p in sub if len(p) == len(prefix) + 1]
        leaves = sum(1 for p in sub if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in sub))
        saved = sum((len(nodes[p]["members"]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in sub)
        parent = min(nodes[prefix[:-1]]["members"]) if prefix else None
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.append((min(node["members"]), len(prefix), parent, len(node["members"]), len(kids), leaves, saved, ends))
    return sorted(out, key=repr)
