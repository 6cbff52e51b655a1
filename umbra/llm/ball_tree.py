"""A ball tree over sparse rows: centroids and radii bound inner products of whole subtrees."""

from __future__ import annotations

import heapq

import numpy as np


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class Best:
    """The ``k`` best (score, id) so far; of equal scores the smallest ids. An id that is None comes last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def least(self) -> int:
        """A score must reach it to matter."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def add(self, score: int, id_: int | None) -> None:
        entry = (score, -(1 << 64) if id_ is None else -id_)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def rows(self) -> list[tuple[int, int | None]]:
        return [(score, None if id_ == -(1 << 64) else -id_) for score, id_ in self.heap]


class BallTree:
    """Rows of non-negative integers in compressed form: ``starts`` (rows + 1), columns ``terms`` and ``values``.

    Nodes are split between two rows far apart, down to ``leaf`` rows: each row goes to the nearer one, or half of them to each if one
    would get less than an eighth. A node keeps its centroid and the largest distance by which a row goes beyond it; as no number is
    negative, only coordinates above the centroid's can raise a product. All sums that a bound rests on are of numbers
    that are not negative, so their rounding is a tiny share of them, by more than which bounds are widened.
    """

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int = 64):
        sizes = np.diff(starts)
        self.names, terms = np.unique(terms, return_inverse=True)
        width = max(1, len(self.names))
        self.nodes: list[tuple[int, int, int, int]] = []  # first and last row in the new order, children or -1
        order, centre_node, centre_term, centre_value, radius = [], [], [], [], []

        def grow(rows: np.ndarray, size: np.ndarray, term: np.ndarray, value: np.ndarray) -> int:
            node, n = len(self.nodes), len(rows)
            self.nodes.append((len(order), len(order) + n, -1, -1))
            centre = np.bincount(term, value, width) / n
            own = np.concatenate([[0], np.cumsum(size)])[:-1]
            per_row = lambda x: np.add.reduceat(np.append(x, 0.0), own) * (size > 0)
            length = float(centre @ centre)
            near = per_row((value - centre[term]) ** 2 - centre[term] ** 2) + length
            radius.append(float(np.sqrt(per_row(np.maximum(value - centre[term], 0) ** 2).max())))
            there = np.flatnonzero(centre)
            centre_node.append(np.full(len(there), node))
            centre_term.append(there)
            centre_value.append(centre[there])
            if n <= leaf:
                order.extend(rows.tolist())
                return node
            dense = lambda r: np.bincount(term[own[r] : own[r] + size[r]], value[own[r] : own[r] + size[r]], width)
            one = dense(int(np.argmax(near)))
            two = dense(int(np.argmax(per_row(value * value) - 2 * per_row(value * one[term]))))
            along = per_row(value * (two - one)[term])
            upper = along > float(two @ two - one @ one) / 2
            if not n / 8 <= upper.sum() <= n - n / 8:
                upper = np.zeros(n, bool)
                upper[np.argsort(along, kind="stable")[n // 2 :]] = True
            which = np.repeat(upper, size)
            first = len(order)
            left = grow(rows[~upper], size[~upper], term[~which], value[~which])
            right = grow(rows[upper], size[upper], term[which], value[which])
            self.nodes[node] = (first, first + n, left, right)
            return node

        if len(sizes):
            grow(np.arange(len(sizes)), sizes, terms, values.astype(np.float64))
        self.order, self.radius = np.array(order, np.int64), np.array(radius)
        place = np.empty(len(sizes), np.int64)
        place[self.order] = np.arange(len(sizes))
        self.rows = len(sizes)
        # Entries by (term, row), centroids by (term, node): a query touches its own terms only.
        key = terms * max(1, self.rows) + np.repeat(place, sizes)
        by = np.argsort(key)
        self.key, self.value = key[by], values[by]
        node, term, value = (np.concatenate([*x, np.empty(0)]) for x in (centre_node, centre_term, centre_value))
        by = np.argsort(term, kind="stable")
        self.centre_node, self.centre_value = node[by].astype(np.int64), value[by]
        self.centre_start = np.searchsorted(term[by], np.arange(len(self.names) + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node a number that no product of one of its rows exceeds. ``terms`` are places in ``names``."""
        starts, ends = self.centre_start[terms], self.centre_start[terms + 1]
        at, weight = ranges(starts, ends), np.repeat(weights.astype(np.float64), ends - starts)
        middle = np.bincount(self.centre_node[at], self.centre_value[at] * weight, len(self.nodes))
        held = np.bincount(self.centre_node[at], weight**2, len(self.nodes))  # of terms that the node has
        return (middle + np.sqrt(held) * self.radius) * (1 + 1e-9) + 1

    def search(self, names: np.ndarray, weights: np.ndarray, ids: list, best: Best) -> int:
        """Adds the rows that matter to ``best``: nodes by falling bounds, leaves scored in integers. Gives the number of leaves met."""
        at = np.searchsorted(self.names, names)
        held = at < len(self.names)
        held[held] = self.names[at[held]] == names[held]
        terms, weights, met = at[held], weights[held], 0
        if not len(terms):
            return met
        bounds = self.bounds(terms, weights)
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= best.least:
            _, node = heapq.heappop(queue)
            first, last, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= best.least:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            met += 1
            starts, ends = np.searchsorted(self.key, terms * self.rows + first), np.searchsorted(self.key, terms * self.rows + last)
            entries = ranges(starts, ends)
            scores = np.zeros(last - first, np.int64)
            np.add.at(scores, self.key[entries] % self.rows - first, self.value[entries] * np.repeat(weights, ends - starts))
            for row in np.flatnonzero(scores >= best.least).tolist():
                best.add(int(scores[row]), ids[self.order[first + row]])
        return met
