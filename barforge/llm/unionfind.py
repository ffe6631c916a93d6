"""A forest of disjoint sets over numpy arrays, for the links that one task finds."""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join_all(self, node: int, others: np.ndarray) -> None:
        """Joins a node with each of ``others``. Most of a dense group is joined already; only nodes with another parent are walked."""
        root = self.find(node)
        for j in others[self.up[others] != root]:
            j = self.find(j)
            if j != root:
                self.up[max(j, root)] = root = min(j, root)

    def join_matrix(self, near: np.ndarray, row: int, column: int) -> None:
        """Joins node row + i with node column + j wherever near[i, j]."""
        for i in np.flatnonzero(near.any(1)):
            self.join_all(row + i, np.flatnonzero(near[i]) + column)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each node that isn't its set's smallest, with that smallest node."""
        up = self.up
        while not np.array_equal(nxt := up[up], up):
            up = nxt
        nodes = np.flatnonzero(up != np.arange(len(up)))
        return nodes, up[nodes]
