"""Plain versions that several tests share."""

from offerlens.llm.shingles import shingle_set


def brute_components(docs):
    """Smallest reachable id and set size of each document, by comparing all pairs that share a shingle."""
    sets = {d: set(shingle_set(t).tolist()) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d in sorted(sets):
        seen = set()
        for s in sets[d]:
            seen.update(holders.setdefault(s, []))
            holders[s].append(d)
        for o in seen:
            x, y = sets[d], sets[o]
            if 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((find(d), find(o)))
                parent[v] = u
    return {d: find(d) for d in sets}, {d: len(s) for d, s in sets.items()}
