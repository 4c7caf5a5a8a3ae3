"""A prefix tree over ordered sets, walked with a query set.

Tokens are ordered by how many of the tree's sets have them, most first, then by hash, so sets
that are alike have a long path in common and differ near the leaves. The tree is kept as its
sets in lexicographic order: the first tokens that a set shares with the one before it are
their common path, so walking the sets in order and stepping back to the shared depth visits
every node of the tree once, with the overlap so far kept per depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def linked(query: np.ndarray, sets: list[np.ndarray], percent: int = 80) -> Iterator[int]:
    """The indices of the sets that overlap `query` by at least `percent` of the union.

    All are sorted arrays of distinct numbers. At each depth, what is found so far and what the
    rest of the query could still add bounds every set below: a subtree that cannot reach the
    overlap that the query's own length asks for is skipped whole, and so is a set that cannot
    reach the overlap that both lengths ask for.
    """
    if not len(query) or not sets:
        return
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(tokens), np.uint32)
    place[np.lexsort((tokens, -count))] = np.arange(len(tokens))
    ranked = [np.sort(x) for x in np.split(place[at], np.cumsum([len(x) for x in sets])[:-1])]
    common = np.intersect1d(tokens, query, assume_unique=True)
    known = np.sort(place[np.searchsorted(tokens, common)])  # no other token of the query can be met
    order = sorted(range(len(sets)), key=lambda i: ranked[i].byteswap().tobytes())
    least = -(-percent * len(query) // 100)
    path, found, rank, dead = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64), -1
    for i in order:
        own = ranked[i]
        n = min(len(path), len(own))
        differ = np.flatnonzero(path[:n] != own[:n])
        depth = int(differ[0]) if len(differ) else n
        if 0 <= dead <= depth:
            continue  # below a pruned node; the path stays that of the pruned set
        dead = -1
        if len(own) < least or len(own) * percent > 100 * len(query):
            path, found, rank = path[:depth], found[: depth + 1], rank[: depth + 1]
            continue
        rest = own[depth:]
        at = np.searchsorted(known, rest)
        hit = known[np.minimum(at, len(known) - 1)] == rest if len(known) else np.zeros(len(rest), bool)
        path = own
        found = np.concatenate([found[: depth + 1], found[depth] + np.cumsum(hit)])
        rank = np.concatenate([rank[: depth + 1], at + hit])
        bound = found + (len(known) - rank)
        below = np.flatnonzero(bound < least)
        if len(below):
            dead = int(below[0])
            continue
        overlap = int(found[-1])
        if 100 * overlap >= percent * (len(query) + len(own) - overlap):
            yield i
