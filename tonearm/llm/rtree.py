"""An R-tree packed by sort-tile-recursive, and best-first search in it by inner product.

For a query q and a box [lo, hi] each coordinate's product with q lies between q_i lo_i and q_i hi_i, so the sums of the smaller and of the
larger ones bound the inner products of all rows in the box. All numbers are integers and all sums exact.
"""

from __future__ import annotations

import heapq
from bisect import insort

import numpy as np

LEAF, FANOUT, TILED = 128, 8, 4
#: Queries whose bounds are held at a time.
CHUNK = 1024


def str_order(x: np.ndarray, label: np.ndarray, axes: list[int], leaf: int = LEAF, tiled: int = TILED) -> np.ndarray:
    """Row numbers in packing order: by label, and within a label in tiles over the first ``tiled`` of ``axes``; every ``leaf`` rows are a leaf."""
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    return np.concatenate([_tile(rows, x, axes[:tiled], leaf) for rows in np.split(order, cuts)]) if len(order) else order


def _tile(rows: np.ndarray, x: np.ndarray, axes: list[int], leaf: int) -> np.ndarray:
    leaves = -(-len(rows) // leaf)
    if leaves <= 1 or not axes:
        return rows
    slabs = int(np.ceil(leaves ** (1 / len(axes))))
    size = leaf * -(-leaves // slabs)
    rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
    return np.concatenate([_tile(rows[at : at + size], x, axes[1:], leaf) for at in range(0, len(rows), size)])


class Tree:
    """Rows in packing order with the boxes and label ranges of all nodes, leaves first, root last."""

    def __init__(self, x: np.ndarray, label: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> None:
        self.x, self.label, self.leaf, self.fanout = x, label, leaf, fanout
        starts = np.arange(0, len(x), leaf)
        lo, hi = [np.minimum.reduceat(x, starts)], [np.maximum.reduceat(x, starts)]
        low, high = [np.minimum.reduceat(label, starts)], [np.maximum.reduceat(label, starts)]
        self.levels = [0]
        while len(lo[-1]) > 1:
            self.levels.append(self.levels[-1] + len(lo[-1]))
            starts = np.arange(0, len(lo[-1]), fanout)
            lo.append(np.minimum.reduceat(lo[-1], starts))
            hi.append(np.maximum.reduceat(hi[-1], starts))
            low.append(np.minimum.reduceat(low[-1], starts))
            high.append(np.maximum.reduceat(high[-1], starts))
        self.lo, self.hi = np.concatenate(lo), np.concatenate(hi)
        self.label_low, self.label_high = np.concatenate(low).tolist(), np.concatenate(high).tolist()
        self.leaves, self.nodes = len(lo[0]), len(self.lo)
        ends = [*self.levels[1:], self.nodes]
        #: The children of each inner node.
        self.children = [range(0)] * self.leaves
        for below, start, end in zip(self.levels, self.levels[1:], ends[1:]):
            self.children += [range(below + k * fanout, min(below + (k + 1) * fanout, start)) for k in range(end - start)]

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) inner product of each query with any row of each node."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.lo.T + down @ self.hi.T, up @ self.hi.T + down @ self.lo.T


class Rows:
    """Ids of a tree's rows: ``none`` marks null ids, which sort last; ``place`` tells rows of equal ids apart."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, place: np.ndarray) -> None:
        self.ids, self.none, self.place = ids, none, place


def _best(scores: np.ndarray, at: np.ndarray, rows: Rows, most: int) -> list[tuple[int, bool, int]]:
    """The first ``most`` of the rows ``at`` as (-score, none, id)."""
    if len(at) > most:
        at = at[np.lexsort((rows.ids[at], rows.none[at], -scores[at]))[:most]]
    return [(-int(s), bool(n), int(i)) for s, n, i in zip(scores[at], rows.none[at], rows.ids[at])]


def _added(held: list, found: list, most: int) -> None:
    for f in found:
        insort(held, f)
    del held[most:]


def nearest(tree: Tree, rows: Rows, q: np.ndarray, label: np.ndarray, place: np.ndarray, held: list[list], most: int) -> None:
    """Adds to ``held`` of each query the rows of its own label, but for the row at its ``place``, that are among its ``most`` first."""
    meets = np.flatnonzero((label >= tree.label_low[-1]) & (label <= tree.label_high[-1]))
    for at in range(0, len(meets), CHUNK):
        part = meets[at : at + CHUNK]
        for k, bounds in zip(part.tolist(), tree.bounds(q[part])[1]):
            own, mine, upper = held[k], int(label[k]), bounds.tolist()
            queue = [(-upper[-1], tree.nodes - 1)]
            while queue:
                bound, node = heapq.heappop(queue)
                # Boxes strictly below the kth go; the queue is in falling order, so all that is left goes too.
                if len(own) == most and -bound < -own[-1][0]:
                    break
                if node < tree.leaves:
                    a = node * tree.leaf
                    scores = tree.x[a : a + tree.leaf] @ q[k]
                    take = (tree.label[a : a + tree.leaf] == mine) & (rows.place[a : a + tree.leaf] != place[k])
                    if len(own) == most:
                        take &= scores >= -own[-1][0]
                    hits = np.flatnonzero(take)
                    if len(hits):
                        _added(own, _best(scores, hits, Rows(rows.ids[a : a + tree.leaf], rows.none[a : a + tree.leaf], rows.place), most), most)
                else:
                    kth = -own[-1][0] if len(own) == most else None
                    for child in tree.children[node]:
                        if tree.label_low[child] <= mine <= tree.label_high[child] and (kth is None or upper[child] >= kth):
                            heapq.heappush(queue, (-upper[child], child))


def in_windows(tree: Tree, rows: Rows, q: np.ndarray, label: np.ndarray, windows: list[list[tuple[int, int]]], held: list[list[list]], most: int) -> None:
    """Adds to ``held`` of each query and window (least, largest score) the rows of other labels that are among the window's ``most`` first."""
    pure = tree.label_low[-1] if tree.label_low[-1] == tree.label_high[-1] else None
    meets = np.array([k for k, w in enumerate(windows) if w and (pure is None or label[k] != pure)], np.int64)
    for at in range(0, len(meets), CHUNK):
        part = meets[at : at + CHUNK]
        for k, least, largest in zip(part.tolist(), *tree.bounds(q[part])):
            mine, lower, upper, asked = int(label[k]), least.tolist(), largest.tolist(), windows[k]
            #: From which score on each window still takes rows: its lower end, or its kth.
            need = [max(lo, -h[-1][0]) if len(h) == most else lo for (lo, _), h in zip(asked, held[k])]
            top, bottom = max(hi for _, hi in asked), min(need)
            queue = [(-min(upper[-1], top), tree.nodes - 1)]
            while queue:
                bound, node = heapq.heappop(queue)
                if -bound < bottom:
                    break
                if node < tree.leaves:
                    a = node * tree.leaf
                    scores = tree.x[a : a + tree.leaf] @ q[k]
                    hits = np.flatnonzero((scores >= bottom) & (scores <= top) & (tree.label[a : a + tree.leaf] != mine))
                    if not len(hits):
                        continue
                    here = Rows(rows.ids[a : a + tree.leaf], rows.none[a : a + tree.leaf], rows.place)
                    for w, (lo, hi) in enumerate(asked):
                        inside = hits[(scores[hits] >= need[w]) & (scores[hits] <= hi)]
                        if len(inside):
                            _added(held[k][w], _best(scores, inside, here, most), most)
                            if len(held[k][w]) == most:
                                need[w] = max(lo, -held[k][w][-1][0])
                    bottom = min(need)
                else:
                    for child in tree.children[node]:
                        if tree.label_low[child] == tree.label_high[child] == mine:
                            continue
                        if any(upper[child] >= n and lower[child] <= hi for n, (_, hi) in zip(need, asked)):
                            heapq.heappush(queue, (-min(upper[child], top), child))
