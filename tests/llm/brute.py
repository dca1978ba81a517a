"""Plain Python versions of what the operators compute."""

from collections import defaultdict


def components(nodes, linked):
    """Smallest reachable node of every node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for n in nodes:
        groups[root(n)].append(n)
    return {n: min(members) for members in groups.values() for n in members}
