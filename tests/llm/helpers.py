"""Plain functions the tests of this folder hold results against."""

from __future__ import annotations


def smallest_reachable(nodes: list, linked) -> dict:
    """Node to the smallest node it reaches over pairs for which ``linked`` holds."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
