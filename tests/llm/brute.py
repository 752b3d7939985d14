"""Plain-Python statements of what the operators must return."""

import collections


def shingles(text, k=5):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def near_duplicates(rows):
    """rows: (id, text) with distinct non-null ids -> {id: (n, component, kept)}.

    Every pair that shares a rare-first prefix shingle is compared in full."""
    sets = {i: shingles(t) for i, t in rows}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    df = collections.Counter(s for x in first for s in x)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    at = collections.defaultdict(list)
    for x, i in first.items():
        order = sorted(x, key=lambda s: (df[s], s))
        seen = set()
        for s in order[: len(x) - -(-75 * len(x) // 100) + 1]:
            for y, j in at[s]:
                if j not in seen:
                    seen.add(j)
                    if 100 * min(len(x), len(y)) >= 75 * max(len(x), len(y)):
                        both = len(x & y)
                        if 100 * both >= 75 * (len(x) + len(y) - both):
                            union(i, j)
            if df[s] > 1:
                at[s].append((x, i))
    for i, x in sets.items():
        if x:
            union(i, first[x])
    return {i: (len(x), find(i), find(i) == i) for i, x in sets.items()}
