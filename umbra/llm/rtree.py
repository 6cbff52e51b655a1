"""A packed R-tree over integer vectors, and a search for the best inner products within windows of scores."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def tiles(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of ``x`` [n, d] in groups of at most ``leaf``: sorted by a coordinate, cut into slabs, each of them by the next."""
    spread = np.argsort(-x.std(axis=0), kind="stable") if len(x) else np.arange(x.shape[1])

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(rows) // leaf)
        if pages <= 1:
            return [rows] if len(rows) else []
        left = max(1, x.shape[1] - depth)
        slabs = max(2, int(np.ceil(pages ** (1 / left))))
        rows = rows[np.argsort(x[rows, spread[depth % x.shape[1]]], kind="stable")]
        step = leaf * -(-pages // slabs)
        return [tile for at in range(0, len(rows), step) for tile in cut(rows[at : at + step], depth + 1)]

    return cut(np.arange(len(x)), 0)


class RTree:
    """Boxes over the rows (vector, label, id) of one page: leaves of at most ``leaf`` rows of one label, and ``fan_out`` leaves to a node."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, leaf: int = 64, fan_out: int = 8):
        groups = [np.flatnonzero(labels == value) for value in np.unique(labels)]
        parts = [rows[tile] for rows in groups for tile in tiles(x[rows], leaf)]
        order = np.concatenate(parts)
        self.x, self.labels, self.ids = x[order], labels[order], ids[order]
        ends = np.cumsum([len(p) for p in parts])
        self.span = np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)
        first = self.span[:, 0]
        box = [np.minimum.reduceat(self.x, first), np.maximum.reduceat(self.x, first)]
        kind = [self.labels[first], self.labels[first]]
        least = np.minimum.reduceat(self.ids, first)
        above = np.arange(0, len(parts), fan_out)
        self.leaves = len(parts)
        self.children = np.stack([above, np.append(above[1:], len(parts))], axis=1)
        # Leaves come first, then the nodes above them.
        self.low = np.concatenate([box[0], np.minimum.reduceat(box[0], above)])
        self.high = np.concatenate([box[1], np.maximum.reduceat(box[1], above)])
        self.kind_low = np.concatenate([kind[0], np.minimum.reduceat(kind[0], above)])
        self.kind_high = np.concatenate([kind[1], np.maximum.reduceat(kind[1], above)])
        self.least = np.concatenate([least, np.minimum.reduceat(least, above)])
        self.largest = float(np.abs(self.x).max(initial=0))


class Search:
    """For each query (vector, label, id) and each of its windows [low, high] the ``k`` best rows among the pages seen so far.

    With ``same`` rows of the query's label count, else those of other labels; a row with the query's id never does. Higher
    scores come first, of equal ones smaller ids.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.x, self.labels, self.ids, self.low, self.high, self.same = x, labels, ids, low, high, same
        self.up, self.down = np.maximum(x, 0), np.minimum(x, 0)
        self.score = np.full((*low.shape, k), NONE)
        self.found = np.full((*low.shape, k), NO_ID)
        self.largest = float(np.abs(x).max(initial=0))

    def page(self, tree: RTree, block: int = 1024) -> None:
        for at in range(0, len(self.x), block):
            self._page(tree, np.arange(at, min(at + block, len(self.x))))

    def _exact(self, tree: RTree) -> bool:
        """Are all products and their sums whole numbers that doubles hold?"""
        return self.largest * tree.largest * self.x.shape[1] < 2.0**53

    def _intervals(self, tree: RTree, queries: np.ndarray, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each query with what may lie in each box, coordinate by coordinate."""
        low, high = tree.low[nodes].T, tree.high[nodes].T
        least = self.up[queries] @ low + self.down[queries] @ high
        most = self.up[queries] @ high + self.down[queries] @ low
        if not self._exact(tree):
            wide = 1e-9 * self.largest * tree.largest * self.x.shape[1]
            least, most = least - wide, most + wide
        return least, most

    def _alive(self, tree: RTree, queries: np.ndarray, nodes: slice) -> np.ndarray:
        """Upper bounds [queries, nodes], minus infinity where no row of the box can matter."""
        least, most = self._intervals(tree, queries, nodes)
        own = self.labels[queries][:, None]
        kind_low, kind_high = tree.kind_low[nodes], tree.kind_high[nodes]
        fits = (kind_low <= own) & (own <= kind_high) if self.same else (kind_low != own) | (kind_high != own)
        wanted = np.zeros(most.shape, bool)
        for w in range(self.low.shape[1]):
            kth, last = self.score[queries, w, -1][:, None], self.found[queries, w, -1][:, None]
            better = (most > kth) | (most == kth) & (tree.least[nodes] < last)
            wanted |= better & (most >= self.low[queries, w][:, None]) & (least <= self.high[queries, w][:, None])
        return np.where(fits & wanted, most, -np.inf)

    def _page(self, tree: RTree, queries: np.ndarray) -> None:
        """Best first: in every round each query opens the box of its queue with the largest bound; queries that open the same box do so together."""
        total, above = len(tree.low), slice(tree.leaves, len(tree.low))
        queue = np.full((len(queries), total), -np.inf)
        queue[:, above] = self._alive(tree, queries, above)
        open_ = np.arange(len(queries))
        while len(open_):
            node = queue[open_].argmax(axis=1)
            some = queue[open_, node] > -np.inf
            open_, node = open_[some], node[some]
            queue[open_, node] = -np.inf
            for box in np.unique(node).tolist():
                who = open_[node == box]
                if box < tree.leaves:  # what was found since it was queued may have ruled it out
                    still = self._alive(tree, queries[who], slice(box, box + 1))[:, 0] > -np.inf
                    self._leaf(tree, queries[who[still]], box)
                else:
                    nodes = slice(*tree.children[box - tree.leaves])
                    queue[who, nodes] = self._alive(tree, queries[who], nodes)

    def _leaf(self, tree: RTree, queries: np.ndarray, box: int) -> None:
        if not len(queries):
            return
        first, last = tree.span[box]
        rows, ids = tree.x[first:last], tree.ids[first:last]
        if self._exact(tree):
            score = (self.x[queries] @ rows.T).astype(np.int64)
        else:
            whole = self.x[queries].astype(object), rows.astype(object)
            to_int = np.vectorize(int, otypes=[object])
            score = np.clip(to_int(whole[0]) @ to_int(whole[1]).T, NONE + 1, NO_ID - 1).astype(np.int64)
        own = self.labels[queries][:, None]
        fits = ((tree.labels[first:last] == own) == self.same) & (ids != self.ids[queries][:, None])
        for w in range(self.low.shape[1]):
            ok = fits & (score >= np.maximum(self.low[queries, w], self.score[queries, w, -1])[:, None]) & (score <= self.high[queries, w][:, None])
            some = np.flatnonzero(ok.any(axis=1))
            if not len(some):
                continue
            who = queries[some]
            scores = np.concatenate([self.score[who, w], np.where(ok[some], score[some], NONE)], axis=1)
            names = np.concatenate([self.found[who, w], np.where(ok[some], ids, NO_ID)], axis=1)
            best = np.lexsort((names, ~scores), axis=-1)[:, : self.score.shape[2]]  # ~ turns the order of whole numbers without overflow
            self.score[who, w] = np.take_along_axis(scores, best, 1)
            self.found[who, w] = np.take_along_axis(names, best, 1)
