"""Exact top-k inner products by a dual-tree search over cover trees.

A node is a centre and the points within its radius. Its children's centres are a net of its points at half the radius: every point
is within half the radius of some centre (covering), and centres are farther than that from each other (separation), as each
new centre is the point farthest from those before it. A point goes to its nearest centre, and a child keeps the true radius of what
it holds. A node of few points is a leaf, and so is one whose net would hold over a quarter of its points: such points have
no structure at this scale, and balls of one or two of them cost more to visit than to score.

For a query node with centre q and radius r, and a candidate node with centre p and radius s, no inner product between their points
exceeds q.p + r|p| + s|q| + r*s. The search walks pairs of nodes, best bound first, and drops a pair whose bound is below the
worst kth score that any query of the query node has so far; scores known from elsewhere may be given as a floor. Pairs of leaves are scored by a
matrix product of whole numbers; scores are exact while every product sum stays below 2 ** 53, and are computed with Python's
integers otherwise.
"""

from __future__ import annotations

import heapq

import numpy as np

LEAF = 96
#: Rows of a node whose mutual distances are held at once.
NET_ROWS = 2048


class Node:
    __slots__ = ("at", "center", "kids", "norm", "radius")

    def __init__(self, at, center, radius, kids):
        self.at, self.center, self.radius, self.kids = at, center, radius, kids
        self.norm = float(np.sqrt(center @ center))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - c) ** 2).sum(1), 0))


def net(x: np.ndarray, first: np.ndarray, radius: float, most: int) -> tuple[list[np.ndarray], np.ndarray] | None:
    """Centres, farthest first, until all rows of x are within ``radius`` of one; and each row's nearest. None if it takes more than ``most``."""
    own, near, centers = np.zeros(len(x), np.int64), distances(x, first), [first]
    while near.max() > radius:
        if len(centers) >= most:
            return None
        c = x[int(near.argmax())]
        d = distances(x, c)
        closer = d < near
        own[closer] = len(centers)
        near = np.minimum(near, d)
        centers.append(c)
    return centers, own


def build(x: np.ndarray, leaf: int = LEAF) -> Node | None:
    """x: rows as float64. Nodes hold row numbers; equal rows end in one leaf of radius 0."""
    if not len(x):
        return None

    def grow(at: np.ndarray, center: np.ndarray) -> Node:
        d = distances(x[at], center)
        radius = float(d.max()) * (1 + 1e-9) + 1e-9
        found = net(x[at], center, radius / 2, max(2, len(at) // 4)) if len(at) > leaf and d.max() > 0 else None
        if found is None:
            return Node(at, center, radius, ())
        centers, own = found
        return Node(at, center, radius, tuple(grow(at[own == i], c) for i, c in enumerate(centers) if (own == i).any()))

    mean = x.mean(0)
    return grow(np.arange(len(x)), x[int(((x - mean) ** 2).sum(1).argmin())])


def bounds(q: np.ndarray, r: np.ndarray, p: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products for all pairs of balls, with a margin for rounding."""
    a, b = np.sqrt((q * q).sum(1)), np.sqrt((p * p).sum(1))
    x = q @ p.T + np.outer(r, b) + np.outer(a, s) + np.outer(r, s)
    return x + (np.abs(x) + np.outer(a, b)) * 1e-9 + 1e-6


class Best:
    """The k best (score, id) of each query: higher score first, then smaller id. ``worst``: what a score must reach, the floor at first."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.worst = k, np.full(n, -np.inf) if floor is None else floor.astype(np.float64)
        self.rows: list[list[tuple]] = [[] for _ in range(n)]

    def add(self, q: int, scores: list, ids: list) -> None:
        rows = heapq.nsmallest(self.k, self.rows[q] + [(-s, i) for s, i in zip(scores, ids, strict=True)])
        self.rows[q] = rows
        if len(rows) == self.k:
            self.worst[q] = max(self.worst[q], -rows[-1][0])


def exact_scores(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles, exactly."""
    if q.size and p.size and float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1] < 2**53:
        return q @ p.T
    big = lambda a: np.array([[int(v) for v in r] for r in a], dtype=object)
    return big(q) @ big(p).T


def search(q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int, leaf: int = LEAF, floor: np.ndarray | None = None) -> tuple[list[list[tuple]], dict[str, int]]:
    """For each query its k best (score, id) among ``p``, its own id left out, as far as they reach its floor; and how many node pairs were scored and dropped."""
    best, told = Best(len(q), k, floor), {"scored": 0, "dropped": 0, "leaves": 0}
    a, b = build(q, leaf), build(p, leaf)
    if a is None or b is None:
        return best.rows, told
    told["leaves"] = _leaves(a) * _leaves(b)

    def bound(u: Node, v: Node) -> float:
        x = float(u.center @ v.center) + u.radius * v.norm + v.radius * u.norm + u.radius * v.radius
        return x + (abs(x) + u.norm * v.norm) * 1e-9 + 1e-6

    n, heap = 0, [(-bound(a, b), 0, a, b)]
    while heap:
        top, _, u, v = heapq.heappop(heap)
        if -top < best.worst[u.at].min():  # an equal score may still win by a smaller id
            told["dropped"] += 1
            continue
        if not u.kids and not v.kids:
            told["scored"] += 1
            for start in range(0, len(v.at), NET_ROWS):
                at_p = v.at[start : start + NET_ROWS]
                s, ids = exact_scores(q[u.at], p[at_p]), p_ids[at_p]
                hopeful = np.flatnonzero((s >= best.worst[u.at][:, None]).astype(bool).any(1))
                for i, row in zip(u.at[hopeful].tolist(), s[hopeful], strict=True):
                    at = np.flatnonzero((ids != q_ids[i]) & (row >= best.worst[i]).astype(bool))
                    if len(at) > k:
                        at = at[np.lexsort((ids[at], -row[at]))[:k]]
                    best.add(i, [int(v) for v in row[at]], ids[at].tolist())
            continue
        us, vs = ((u,), v.kids) if not u.kids or (v.kids and v.radius >= u.radius) else (u.kids, (v,))
        for x in us:
            for y in vs:
                n += 1
                if (m := bound(x, y)) >= best.worst[x.at].min():
                    heapq.heappush(heap, (-m, n, x, y))
                else:
                    told["dropped"] += 1
    return best.rows, told


def _leaves(n: Node) -> int:
    return sum(map(_leaves, n.kids)) if n.kids else 1
