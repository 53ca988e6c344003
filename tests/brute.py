"""Straightforward single-process versions of the scalable operators, for small inputs."""

from itertools import combinations


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def close(a, b, ratio=88):
    return 200 * lcs(a, b) >= ratio * (len(a) + len(b))


def linked(a, b):
    """a, b: ordered item lists."""
    sa, sb = {i for i in a[:10] if i}, {i for i in b[:10] if i}
    if not sa or not sb:
        return False
    ov = len(sa & sb) / min(len(sa), len(sb))
    return ov >= 0.6 or (a[0] is not None and a[0] == b[0] and ov >= 0.3)


def link_groups(nodes, is_linked):
    """node -> smallest node of its connected component."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if is_linked(a, b):
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {n: find(n) for n in nodes}


def greedy_heads(terms, is_close):
    """term -> first member of the first group holding a close term, by (length, text)."""
    groups = []
    for term in sorted(set(terms), key=lambda t: (len(t), t)):
        home = next((g for g in groups if any(is_close(term, m) for m in g)), None)
        if home is None:
            groups.append([term])
        else:
            home.append(term)
    return {m: g[0] for g in groups for m in g}
