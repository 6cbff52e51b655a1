"""A robust-pruned directed neighbour graph in numpy: greedy searches propose, relaxed pruning keeps diverse edges."""

from __future__ import annotations

import numpy as np

NOBODY = -1


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps squares finite."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of unit vectors: b [n, d] to each of a [n, m, d]."""
    return 2 - 2 * np.matmul(a, b[:, :, None])[..., 0]


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, trace: bool = False):
    """The ``beam`` nearest nodes met by a greedy search for each query: (nodes, squared distances), nearest first.

    With ``trace`` also every node whose neighbours were looked at, with its distance (NOBODY pads).
    """
    count = len(queries)
    nodes = np.full((count, beam), NOBODY)
    far = np.full((count, beam), np.inf, np.float32)
    done = np.zeros((count, beam), bool)
    seen = np.zeros((count, len(x)), bool)
    nodes[:, 0], far[:, 0], seen[:, entry] = entry, 2 - 2 * (queries @ x[entry]), True
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    live = np.arange(count)
    while len(live):
        waiting = ~done[live] & (nodes[live] != NOBODY)
        some = waiting.any(axis=1)
        live, first = live[some], waiting[some].argmax(axis=1)
        if not len(live):
            break
        at = nodes[live, first]
        done[live, first] = True
        if trace:
            step = np.full(count, NOBODY), np.zeros(count, np.float32)
            step[0][live], step[1][live] = at, far[live, first]
            steps.append(step)
        near = edges[at]
        fresh = (near != NOBODY) & ~seen[live[:, None], near]
        near = np.where(fresh, near, NOBODY)
        seen[live[:, None], np.where(fresh, near, at[:, None])] = True
        gap = np.where(fresh, _squared(x[near], queries[live]), np.inf).astype(np.float32)
        all_nodes, all_far = np.concatenate([nodes[live], near], 1), np.concatenate([far[live], gap], 1)
        all_done = np.concatenate([done[live], np.zeros(near.shape, bool)], 1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        nodes[live] = np.take_along_axis(all_nodes, order, 1)
        far[live] = np.take_along_axis(all_far, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
    if not trace:
        return nodes, far
    return nodes, far, np.stack([s[0] for s in steps], 1), np.stack([s[1] for s in steps], 1)


def robust_prune(x: np.ndarray, points: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` edges for each point, nearest first; a candidate goes when a kept one is ``alpha`` times nearer to it than the point is."""
    proposed = np.where(proposed == points[:, None], NOBODY, proposed)
    order = np.argsort(proposed, axis=1, kind="stable")
    proposed = np.take_along_axis(proposed, order, 1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = NOBODY
    vectors = x[proposed]
    gap = np.where(proposed == NOBODY, np.inf, _squared(vectors, x[points]))
    kept = np.full((len(points), degree), NOBODY)
    here = np.arange(len(points))
    for slot in range(degree):
        best = gap.argmin(axis=1)
        there = np.isfinite(gap[here, best])
        if not there.any():
            break
        kept[there, slot] = proposed[here, best][there]
        between = _squared(vectors, vectors[here, best])
        gap = np.where(there[:, None] & (alpha * alpha * between <= gap), np.inf, gap)
        gap[here, best] = np.inf
    return kept


def build(x: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, batch: int = 256, seed: int = 1) -> tuple[np.ndarray, int]:
    """(edges [n, >= degree], entry) over unit vectors; every node is reachable from the entry."""
    n = len(x)
    entry = int((x @ x.mean(axis=0)).argmax())
    edges = np.full((n, degree), NOBODY)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        points = order[at : at + min(batch, max(at // 4, 1))]
        at += len(points)
        nodes, _, visited, _ = beam_search(x, edges, entry, x[points], min(beam, n), trace=True)
        edges[points] = robust_prune(x, points, np.concatenate([nodes, visited], 1), degree, alpha)
        _link_back(x, edges, points, degree, alpha)
    return _reachable(x, edges, entry), entry


def _link_back(x: np.ndarray, edges: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the edges from neighbours back to ``points``; a node with too many is pruned."""
    to, source = edges[points].ravel(), np.repeat(points, degree)
    to, source = to[to != NOBODY], source[to != NOBODY]
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    nodes, start, many = np.unique(to, return_index=True, return_counts=True)
    added = np.full((len(nodes), many.max()), NOBODY)
    added[np.repeat(np.arange(len(nodes)), many), np.arange(len(to)) - np.repeat(start, many)] = source
    own = edges[nodes]
    room = (own != NOBODY).sum(axis=1) + many <= degree
    both = np.concatenate([own, added], 1)
    packed = np.take_along_axis(both, np.argsort(both == NOBODY, axis=1, kind="stable"), 1)
    # a back edge may be there already
    edges[nodes[room]] = _without_repeats(packed[room][:, :degree])
    if not room.all():
        edges[nodes[~room]] = robust_prune(x, nodes[~room], both[~room], degree, alpha)


def _without_repeats(rows: np.ndarray) -> np.ndarray:
    rows = np.sort(rows, axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = NOBODY
    return rows


def _reachable(x: np.ndarray, edges: np.ndarray, entry: int) -> np.ndarray:
    """Adds edges from the nearest reachable node until every node can be reached."""
    while True:
        met = np.zeros(len(x), bool)
        front = np.array([entry])
        met[entry] = True
        while len(front):
            near = np.unique(edges[front])
            front = near[(near != NOBODY) & ~met[near]]
            met[front] = True
        lost = np.flatnonzero(~met)
        if not len(lost):
            return edges
        known = np.flatnonzero(met)
        nearest = np.concatenate([known[(x[lost[i : i + 1024]] @ x[known].T).argmax(axis=1)] for i in range(0, len(lost), 1024)])
        nodes, first = np.unique(nearest, return_index=True)
        more = np.full((len(x), 1), NOBODY)
        more[nodes, 0] = lost[first]
        edges = np.concatenate([edges, more], 1)
