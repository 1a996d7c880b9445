"""BK-trees over bit fingerprints, many side by side.

In a BK-tree the children of a node are keyed by their integer Hamming distance to it, and a
child's subtree holds only fingerprints at exactly that distance. By the triangle inequality a
search with radius r from a node at distance d follows only the edges from d - r to d + r.

A forest holds one tree per shard. All its trees are built and searched level by level in numpy.
"""

from collections.abc import Iterator

import numpy as np

#: Pairs of a query and a tree node that a search holds at once.
FRONTIER = 1_000_000


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; a and b: (n, words) uint64."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.append(True, sorted_keys[1:] != sorted_keys[:-1]) if len(sorted_keys) else np.zeros(0, dtype=bool)


class Forest:
    """prints: (n, words) uint64; shard: ascending number of each one's tree."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints, n = prints, len(prints)
        self.reach = prints.shape[1] * 64 + 1
        starts = np.flatnonzero(_firsts(shard))
        self.sizes = np.diff(np.append(starts, n))
        self.root = np.repeat(starts, self.sizes)
        at = self.root.copy()
        pending = np.flatnonzero(self.root != np.arange(n))
        keys, nodes = [], []
        while len(pending):
            key = at[pending] * self.reach + hamming(prints[pending], prints[at[pending]])
            order = np.argsort(key, kind="stable")
            first = _firsts(key[order])
            child = pending[order[first]]
            keys.append(key[order[first]])
            nodes.append(child)
            at[pending[order]] = child[np.cumsum(first) - 1]
            pending = np.sort(pending[order[~first]])
        keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        nodes = np.concatenate(nodes) if nodes else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def earlier(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance) for every two within the radius in one tree, node before query, in blocks of queries."""
        cost = np.cumsum(np.repeat(self.sizes, self.sizes))
        start, n = 0, len(self.prints)
        while start < n:
            base = cost[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(cost, base + FRONTIER, side="right")))
            yield self._search(np.arange(start, stop), radius)
            start = stop

    def _search(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, found = self.root[query], []
        while len(query):
            d = hamming(self.prints[query], self.prints[node])
            hit = (d <= radius) & (node < query)
            found.append((query[hit], node[hit], d[hit]))
            low = np.searchsorted(self.keys, node * self.reach + np.maximum(d - radius, 0), side="left")
            high = np.searchsorted(self.keys, node * self.reach + np.minimum(d + radius, self.reach - 1), side="right")
            n = high - low
            at = np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            query, node = np.repeat(query, n), self.nodes[at]
            ahead = node < query  # every node below comes later than its parent
            query, node = query[ahead], node[ahead]
        return tuple(np.concatenate(x) for x in zip(*found))

    def components(self, radius: int) -> np.ndarray:
        """For each print the first one that it reaches over links within the radius, in its tree."""
        label = np.arange(len(self.prints))
        for a, b, _ in self.earlier(radius):
            while len(a):
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
        return label

    def nearest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within the radius: of each print with its nearest earlier one and its first earlier one."""
        pairs = []
        for a, b, d in self.earlier(radius):
            for order in (np.lexsort((b, d, a)), np.lexsort((b, a))):
                first = order[_firsts(a[order])]
                pairs.append(np.stack([a[first], b[first]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), dtype=np.int64)
        return pairs[:, 0], pairs[:, 1]
