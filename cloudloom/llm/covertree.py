"""Cover trees over integer vectors, and the dual-tree search for largest inner products.

A node has a centre, which is one of its points, and the largest distance from it to a point below it.
The children of a node are a greedy net at half its scale: their centres are further apart than that, and each point
is with a centre no further away. A pair (query node, data node) is passed over if

    <q, p> + |q| r_p + |p| r_q + r_q r_p

for their centres and radii is less than the worst k-th score among the node's queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Most points of a leaf of the data, and of the queries: few queries with one floor prune better.
LEAF, QUERY_LEAF = 32, 6


def exact_products(a: Tree, b: Tree, at: np.ndarray | slice, cols: np.ndarray | slice) -> np.ndarray:
    """Inner products of integer rows, exactly: in doubles where all sums stay below 2^53, else in Python integers kept within 64 bits."""
    if a.peak * b.peak * a.rows.shape[1] < 2**53:
        return (a.x[at] @ b.x[cols].T).astype(np.int64)
    whole = a.rows[at].astype(object) @ b.rows[cols].astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


@dataclass
class Node:
    begin: int
    end: int
    radius: float
    centre: np.ndarray
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None  # of the children
    norms: np.ndarray | None = None
    radii: np.ndarray | None = None
    deep: np.ndarray | None = None  # which of them have children
    spans: np.ndarray | None = None  # their begins and ends

    def gather(self) -> None:
        if self.children:
            self.centres = np.array([c.centre for c in self.children])
            self.norms = np.sqrt((self.centres**2).sum(1))
            self.radii = np.array([c.radius for c in self.children])
            self.deep = np.array([bool(c.children) for c in self.children])
            self.spans = np.array([(c.begin, c.end) for c in self.children])


class Tree:
    """A cover tree; ``order`` lists the rows so that each node holds a run of them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order: list[int] = []
        x = rows.astype(np.float64)

        def build(at: np.ndarray, centre: int, reach: np.ndarray) -> Node:
            begin = len(order)
            node = Node(begin, begin + len(at), float(reach.max()), x[centre])
            if len(at) <= leaf or node.radius == 0:
                order.extend(at.tolist())
                return node
            left, gap, lone = at, reach, []
            half = node.radius / 2
            while len(left):
                near = gap <= half
                mine, its = left[near], gap[near]
                (node.children.append(build(mine, centre, its)) if len(mine) > 4 else lone.append((mine, its)))
                left = left[~near]
                if len(left):
                    centre = int(left[0])
                    gap = np.sqrt(((x[left] - x[centre]) ** 2).sum(1))
            for mine, its in lone:  # small nets are leaves after the others
                child = Node(len(order), len(order) + len(mine), float(its.max()), x[mine[np.argmin(its)]])
                order.extend(mine.tolist())
                node.children.append(child)
            node.gather()
            return node

        if len(rows):
            gap = np.sqrt(((x - x[0]) ** 2).sum(1))
            self.root: Node | None = build(np.arange(len(rows)), 0, gap)
        else:
            self.root = None
        self.rows, self.ids, self.x = rows[order], ids[order], x[order]
        self.peak = float(np.abs(x).max(initial=0))


@dataclass
class Best:
    """The best ``k`` (score, id) of each query so far; ``floor`` is a score that k others are known to reach."""

    scores: np.ndarray
    ids: np.ndarray
    floor: np.ndarray

    @classmethod
    def empty(cls, n: int, k: int, floor: np.ndarray | None = None) -> Best:
        low = np.iinfo(np.int64).min
        return cls(np.full((n, k), low, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64), np.full(n, low, np.int64) if floor is None else floor.copy())

    def add(self, at: slice, scores: np.ndarray, ids: np.ndarray, skip: np.ndarray) -> None:
        """Offer the products of some queries with some rows; ``skip`` marks pairs of a row with itself."""
        take = (scores >= self.floor[at][:, None]) & ~skip
        if not take.any():
            return
        rows = np.flatnonzero(take.any(1))
        k, place = self.scores.shape[1], np.arange(self.scores.shape[0])[at][rows]
        low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        cols = np.flatnonzero(take.any(0))
        sub = take[np.ix_(rows, cols)]
        s = np.concatenate([self.scores[place], np.where(sub, scores[np.ix_(rows, cols)], low)], 1)
        i = np.concatenate([self.ids[place], np.where(sub, ids[cols][None, :], high)], 1)
        best = np.lexsort((i, np.where(s == low, high, -np.maximum(s, low + 1))), axis=1)[:, :k]
        self.scores[place], self.ids[place] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        self.floor[place] = np.maximum(self.floor[place], np.where(self.ids[place][:, -1] < high, self.scores[place][:, -1], low))


def search(queries: Tree, data: Tree, best: Best) -> int:
    """Offer ``best`` every pair of the two trees that could matter; returns how many products were taken.

    All children of a pair of nodes are bounded at once, as a matrix; leaves that are left are multiplied together.
    """
    taken = 0

    def floors(nodes: list[Node]) -> np.ndarray:
        return np.array([best.floor[n.begin : n.end].min() for n in nodes], np.float64)

    def bounds(qs: list[Node], d: Node, among: np.ndarray) -> np.ndarray:
        """The most that each query node can score with each of some children of ``d``, a little over for the rounding."""
        centre, radius = np.array([q.centre for q in qs]), np.array([q.radius for q in qs])[:, None]
        norm = np.sqrt((centre**2).sum(1))[:, None]
        most = centre @ d.centres[among].T + norm * d.radii[among] + radius * (d.norms[among] + d.radii[among])
        return most + np.abs(most) * 1e-9

    def offer(begin: int, end: int, d: Node, among: np.ndarray) -> None:
        nonlocal taken
        spans = d.spans[among]
        sizes = spans[:, 1] - spans[:, 0]
        cols = np.arange(sizes.sum()) + np.repeat(spans[:, 0] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
        at = slice(begin, end)
        products = exact_products(queries, data, at, cols)
        taken += products.size
        best.add(at, products, data.ids[cols], queries.ids[at][:, None] == data.ids[cols][None, :])

    def with_leaves(q: Node, d: Node, among: np.ndarray) -> None:
        """``among``: children of ``d`` without children."""
        if not q.children:
            offer(q.begin, q.end, d, among)
            return
        may = bounds(q.children, d, among) >= floors(q.children)[:, None]
        i = 0
        while i < len(q.children):  # query leaves that follow each other go together, by what any of them may need
            j = i + 1
            if not q.deep[i]:
                while j < len(q.children) and not q.deep[j]:
                    j += 1
                if (wanted := may[i:j].any(0)).any():
                    offer(q.spans[i, 0], q.spans[j - 1, 1], d, among[wanted])
            elif may[i].any():
                with_leaves(q.children[i], d, among[may[i]])
            i = j

    def visit(q: Node, d: Node) -> None:
        if not d.children:
            lone = Node(d.begin, d.end, d.radius, d.centre, [d])
            lone.gather()
            with_leaves(q, lone, np.array([0]))
            return
        if q.children and q.radius > d.radius:
            for c in q.children:
                if (bounds([c], d, slice(None)) >= floors([c])).any():
                    visit(c, d)
            return
        most = bounds([q], d, slice(None))[0]
        order = np.argsort(-most, kind="stable")
        leaves = order[~d.deep[order]]
        if len(leaves := leaves[most[leaves] >= floors([q])[0]]):
            with_leaves(q, d, leaves)
        for i in order[d.deep[order]].tolist():
            if most[i] < floors([q])[0]:
                break
            visit(q, d.children[i])

    if queries.root and data.root:
        visit(queries.root, data.root)
    return taken
