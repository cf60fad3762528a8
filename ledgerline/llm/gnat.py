"""A multiway hyperplane tree in the manner of GNAT.

Each node has a few split points; a row goes to the nearest one, so cells are bounded by the hyperplanes half way between points.  For
every split point the node stores the range of distances from it to the rows of every sibling cell.  A query that wants rows whose
inner product with it lies in a window asks, for the squared lengths a cell holds, for an annulus of distances; a cell goes as soon as
the range seen from one split point cannot meet that annulus.  Nothing that lies in a window is ever eliminated.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Split points of a node, rows of the sample from which a node is split, levels at most.
WAYS, SAMPLE_LEAF, LEVELS = 8, 128, 12


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``x`` (rows) to ``points`` (columns); exact up to the root for whole numbers."""
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def spread_points(rows: np.ndarray, ways: int) -> np.ndarray:
    """Up to ``ways`` different rows, each the farthest from those before it, among the first ``3 * ways`` rows."""
    pool = rows[: 3 * ways]
    chosen = [0]
    gap = distances(pool, pool[:1])[:, 0]
    while len(chosen) < ways and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(pool, pool[chosen[-1] :][:1])[:, 0])
    return pool[chosen]


@dataclass
class Tree:
    """``points[n]`` and ``child[n]`` by node; a child of -1 or less is leaf ``-1 - child``.  Ranges are set by :meth:`learn`."""
    points: list[np.ndarray] = field(default_factory=list)
    child: list[list[int]] = field(default_factory=list)
    leaves: int = 1
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    norm: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, sample: np.ndarray, ways: int = WAYS, leaf: int = SAMPLE_LEAF) -> Tree:
        """Split points from a sample in random order; without rows, or with equal ones only, the tree is a single leaf."""
        tree = cls(leaves=0)

        def grow(rows: np.ndarray, level: int) -> int:
            points = spread_points(rows, ways) if len(rows) > leaf and level < LEVELS else rows[:0]
            if len(points) < 2:
                tree.leaves += 1
                return -tree.leaves
            node = len(tree.points)
            tree.points.append(points)
            tree.child.append([])
            own = distances(rows, points).argmin(axis=1)
            tree.child[node] = [grow(rows[own == j], level + 1) for j in range(len(points))]
            return node

        grow(sample, 0)
        return tree

    def descend(self, x: np.ndarray):
        """``node``, positions of the rows of ``x`` in it, their distances to its points and the cell of each."""
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, at = todo.pop()
            d = distances(x[at], self.points[node])
            own = d.argmin(axis=1)
            yield node, at, d, own
            for j, down in enumerate(self.child[node]):
                if down >= 0 and (inside := at[own == j]).size:
                    todo.append((down, inside))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(x), np.int64)
        for node, at, _, own in self.descend(x):
            down = np.array(self.child[node])[own]
            leaf[at[down < 0]] = -1 - down[down < 0]
        return leaf

    def ranges(self, x: np.ndarray):
        """``node``, ``point``, ``cell``, least and greatest distance of the rows of a cell; point -1 has squared lengths instead."""
        square = (x * x).sum(axis=1)
        for node, at, d, own in self.descend(x):
            for j in np.unique(own):
                rows = own == j
                yield node, -1, int(j), float(square[at[rows]].min()), float(square[at[rows]].max())
                for i, (a, b) in enumerate(zip(d[rows].min(axis=0), d[rows].max(axis=0))):
                    yield node, i, int(j), float(a), float(b)

    def learn(self, found) -> None:
        """Take the ranges over all rows; a cell without rows keeps an empty range."""
        shape = [len(p) for p in self.points]
        self.low = [np.full((k, k), np.inf) for k in shape]
        self.high = [np.full((k, k), -np.inf) for k in shape]
        self.norm = [np.array([[np.inf] * k, [-np.inf] * k]) for k in shape]
        for node, point, cell, low, high in found:
            if point < 0:
                self.norm[node][:, cell] = low, high
            else:
                self.low[node][point, cell], self.high[node][point, cell] = low, high

    def meets(self, q: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and leaves that may hold a row whose inner product with the query lies in one of its windows.

        Window ``k`` is ``low[k]`` to ``high[k]`` and belongs to row ``query[k]`` of ``q``.
        """
        if not self.points:
            hit = np.unique(query)
            return hit, np.zeros(len(hit), np.int64)
        square = (q * q).sum(axis=1)
        out, todo = [], [(0, np.arange(len(query)))]
        while todo:
            node, win = todo.pop()
            d = distances(q[query[win]], self.points[node])
            own = square[query[win]][:, None]
            outer = own + self.norm[node][1][None, :] - 2 * low[win][:, None]
            inner = own + self.norm[node][0][None, :] - 2 * high[win][:, None]
            slack = 1e-6 * (1 + np.sqrt(np.maximum(outer, 0)))
            outer, inner = np.sqrt(np.maximum(outer, 0)) + slack, np.sqrt(np.clip(inner, 0, None))
            outer[own + self.norm[node][1][None, :] - 2 * low[win][:, None] < 0] = -np.inf
            for j, down in enumerate(self.child[node]):
                a, b = self.low[node][:, j][None, :], self.high[node][:, j][None, :]
                alive = ((a <= d + outer[:, j, None]) & (b >= d - outer[:, j, None]) & (b + d + slack[:, j, None] >= inner[:, j, None])).all(axis=1)
                if not alive.any():
                    continue
                if down >= 0:
                    todo.append((down, win[alive]))
                else:
                    hit = np.unique(query[win[alive]])
                    out.append((hit, np.full(len(hit), -1 - down)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
