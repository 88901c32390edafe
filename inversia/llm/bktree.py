"""A forest of BK-trees over 64-bit fingerprints, in numpy.

Each shard has one tree. A node's children hang on edges that carry their integer Hamming distance
to it, one child per distance. A search for all values within a radius starts at the root and, at a
node at distance d, follows only edges from d - radius to d + radius, by the triangle inequality.
Trees grow, and searches run, level by level for many shards and queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DISTANCES = 65
#: Pairs of query and node held at once.
FRONTIER = 200_000


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """Trees over ``values`` (uint64, different within a shard); ``shard``: sorted shard numbers."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values
        _, first, place = np.unique(shard, return_index=True, return_inverse=True)
        self.roots = first[place]
        self.sizes = np.bincount(place)[place]
        waiting = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
        at = self.roots[waiting]
        keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(waiting):
            edge = at * DISTANCES + distance(values[waiting], values[at])
            own, newest, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(own)
            children.append(waiting[newest])
            at = waiting[newest][back]
            rest = at != waiting
            waiting, at = waiting[rest], at[rest]
        key, child = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(key)
        self._key, self._child = key[order], child[order]

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (a, b), a < b, of positions in one shard at most ``radius`` apart, in parts."""
        several = np.flatnonzero(self.sizes > 1)
        ends = np.cumsum(self.sizes[several])
        start = 0
        while start < len(several):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FRONTIER)))
            yield from self._search(several[start:stop], radius)
            start = stop

    def _search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node = self.roots[query]
        reach = np.arange(-radius, radius + 1)
        while len(query):
            d = distance(self.values[query], self.values[node])
            near = (d <= radius) & (query < node)
            if near.any():
                yield query[near], node[near]
            near = (d <= radius) & (query > node)
            if near.any():
                yield node[near], query[near]
            edges = d[:, None] + reach
            wanted = node[:, None] * DISTANCES + edges
            place = np.searchsorted(self._key, wanted)
            place[place == len(self._key)] = 0
            found = (edges >= 0) & (edges < DISTANCES) & (self._key[place] == wanted) if len(self._key) else np.zeros(wanted.shape, bool)
            query, node = np.broadcast_to(query[:, None], wanted.shape)[found], self._child[place[found]]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Labels of both ends of every pair become the smallest reachable one, in place.

    ``labels[i] <= i`` always, and a label's label is itself when this returns."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]
