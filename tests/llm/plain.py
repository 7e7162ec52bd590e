"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().lower().decode()


def joined(nodes, pairs):
    """Smallest node that each node is connected with."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, words):
    split = lower(text).encode().split()
    if 0 < len(split) < words:
        return {tuple(split)}
    return {tuple(split[k : k + words]) for k in range(len(split) - words + 1)}


def near_classes(rows, words, percent):
    """``(set size, smallest id)`` by id."""
    sets = {i: shingles(text, words) for i, text in rows}
    ids = sorted(i for i in sets if sets[i])
    pairs = []
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                pairs.append((a, b))
    return {i: (len(sets[i]), root) for i, root in joined(sets, pairs).items()}


def hits(text, items, window):
    """Positions of hit words, and the ids of items with an occurrence."""
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item_id, item in items:
        w = WORD.findall(lower(item))
        size = min(window, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[j : j + size]:
                    hit.update(range(p, p + size))
                    found.add(str(item_id))
    return words, hit, sorted(found)


def by(rows, key):
    groups = defaultdict(list)
    for row in rows:
        groups[key(row)].append(row)
    return groups
