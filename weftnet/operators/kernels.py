"""Sequential graph routines over NumPy arrays, without Spark.

They run inside grouped functions, on arrays broadcast once, or on the driver for
small networks. Ties in heaps go to the smaller node id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

INF = float("inf")


@dataclass
class Digraph:
    """Directed arcs in the order of their ids."""

    n: int
    src: np.ndarray
    dst: np.ndarray
    out_at: np.ndarray = field(init=False)
    out_arc: np.ndarray = field(init=False)
    levels: list | None = field(init=False, default=None)

    def __post_init__(self):
        self.out_arc = np.argsort(self.src, kind="stable")
        self.out_at = np.searchsorted(self.src[self.out_arc], np.arange(self.n + 1))

    def neighbours(self) -> list[list[tuple[int, int]]]:
        if not hasattr(self, "_near"):
            self._near: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
            for a, (u, v) in enumerate(zip(self.src.tolist(), self.dst.tolist())):
                self._near[u].append((v, a))
        return self._near

    def level_of(self) -> np.ndarray | None:
        """Longest number of arcs to each node; None if there is a cycle."""
        degree, level = np.bincount(self.dst, minlength=self.n), np.zeros(self.n, np.int64)
        front, seen = np.flatnonzero(degree == 0), 0
        while len(front):
            seen += len(front)
            arcs = np.concatenate([self.out_arc[self.out_at[u] : self.out_at[u + 1]] for u in front.tolist()] or [np.zeros(0, np.int64)])
            to = self.dst[arcs]
            np.maximum.at(level, to, level[self.src[arcs]] + 1)
            np.subtract.at(degree, to, 1)
            to = np.unique(to)
            front = to[degree[to] == 0]
        return level if seen == self.n else None

    def sweep_order(self) -> bool:
        """Prepare level sweeps: arcs by (level of head, head, id). False if there is a cycle."""
        if self.levels is None:
            level = self.level_of()
            self.levels = []
            if level is not None:
                at = level[self.dst]
                order = np.lexsort((np.arange(len(self.dst)), self.dst, at))
                for arcs in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if len(arcs):
                        begins = np.flatnonzero(np.diff(self.dst[arcs], prepend=-1))
                        self.levels.append((arcs, begins, self.dst[arcs][begins]))
        return bool(self.levels)


def sweep(g: Digraph, cost: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Distances (sources x nodes) over a graph without cycles, all sources at once."""
    out = np.full((len(sources), g.n), INF)
    out[np.arange(len(sources)), sources] = 0.0
    for arcs, begins, heads in g.levels:
        reach = out[:, g.src[arcs]] + cost[arcs]
        out[:, heads] = np.minimum(out[:, heads], np.minimum.reduceat(reach, begins, axis=1))
    return out


def sweep_path(g: Digraph, cost: np.ndarray, dist: np.ndarray, src: int, dst: int) -> list[int]:
    """Arcs of a shortest path by distances of one source; of arcs that fit, the smallest id."""
    if not hasattr(g, "_into"):
        g._in_arc = np.argsort(g.dst, kind="stable")
        g._into = np.searchsorted(g.dst[g._in_arc], np.arange(g.n + 1))
    path, v = [], dst
    while v != src:
        arcs = g._in_arc[g._into[v] : g._into[v + 1]]
        a = int(arcs[np.flatnonzero(dist[g.src[arcs]] + cost[arcs] == dist[v])[0]])
        path.append(a)
        v = int(g.src[a])
    return path[::-1]


def shortest(g: Digraph, cost: list[float], src: int, dst: int) -> tuple[float, list[int]]:
    """Distance and arcs of a shortest path; (inf, []) without one. Infinite costs mean no arc."""
    near, best, by, heap = g.neighbours(), {src: 0.0}, {}, [(0.0, src)]
    while heap:
        d, u = heapq.heappop(heap)
        if u == dst:
            path = []
            while u != src:
                path.append(by[u])
                u = int(g.src[by[u]])
            return d, path[::-1]
        if d > best[u]:
            continue
        for v, a in near[u]:
            nd = d + cost[a]
            if nd < best.get(v, INF):
                best[v], by[v] = nd, a
                heapq.heappush(heap, (nd, v))
    return INF, []


@dataclass
class Net:
    """Undirected network. ``leaf`` nodes are reached, never passed."""

    n: int
    u: np.ndarray
    v: np.ndarray
    length: np.ndarray
    leaf: np.ndarray
    mid: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def near(self) -> list[list[tuple[int, int, float]]]:
        """(neighbour, edge, length) of each node, in edge order."""
        if not hasattr(self, "_near"):
            self._near: list[list[tuple[int, int, float]]] = [[] for _ in range(self.n)]
            for e, (a, b, w) in enumerate(zip(self.u.tolist(), self.v.tolist(), self.length.tolist())):
                self._near[a].append((b, e, w))
                self._near[b].append((a, e, w))
        return self._near


class Forest:
    """Nearest-hub trees; hubs can be added later."""

    def __init__(self, net: Net, hubs=()):
        self.net = net
        self.dist = [INF] * net.n
        self.edge = [-1] * net.n
        self.above = [-1] * net.n
        self.hub = [-1] * net.n
        self.add(hubs)

    def add(self, hubs) -> None:
        near, leaf = self.net.near(), self.net.leaf
        dist, edge, above, hub, heap = self.dist, self.edge, self.above, self.hub, []
        for h in hubs:
            dist[h], edge[h], above[h], hub[h] = 0.0, -1, -1, h
            heapq.heappush(heap, (0.0, h))
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a] or leaf[a]:
                continue
            for b, e, w in near[a]:
                if d + w < dist[b]:
                    dist[b], edge[b], above[b], hub[b] = d + w, e, a, hub[a]
                    heapq.heappush(heap, (d + w, b))

    def outward(self) -> list[int]:
        """Reached nodes, each after the one above it."""
        above = np.array(self.above, np.int64)
        up, depth = np.where(above < 0, np.arange(self.net.n), above), (above >= 0).astype(np.int64)
        while (more := depth[up]).any():  # twice as far up each time
            depth, up = depth + more, up[up]
        order = np.argsort(depth, kind="stable")
        return order[np.array(self.dist)[order] < INF].tolist()

    def regions(self) -> dict[int, list[int]]:
        """The nodes of each hub."""
        out: dict[int, list[int]] = {}
        for b, h in enumerate(self.hub):
            if h >= 0:
                out.setdefault(h, []).append(b)
        return out

    def loads(self, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Load of each edge, and what each node carries for itself and those below."""
        carried, load, edge, above = demand.astype(float).tolist(), [0.0] * len(self.net.u), self.edge, self.above
        for b in reversed(self.outward()):
            if edge[b] >= 0:
                load[edge[b]] = carried[b]
                carried[above[b]] += carried[b]
        return np.array(load), np.array(carried)


def steiner_paths(net: Net, region, hub: int, points: list[tuple[int, float]], edge_cap: float, branch_m: float = 0.0, mid_m: float = 0.0):
    """Attach points, nearest first, to a growing tree within a region.

    Tree edges are free until full; a new edge costs its length, and ``branch_m``
    (plus ``mid_m`` at mid-block nodes) where it makes a node of two tree edges a
    branch. Returns (meters, {edge: load}), or None if a point finds no way.
    """
    near, load, degree = net.near(), {}, {}

    def branch(a: int) -> float:
        if a == hub or degree.get(a, 0) < 2:
            return 0.0
        return branch_m + (mid_m if net.mid[a] else 0.0)

    meters = 0.0
    for point, q in points:
        best, by, heap, done = {point: 0.0}, {}, [(0.0, point)], False
        while heap:
            d, a = heapq.heappop(heap)
            if a == hub:
                done = True
                break
            if d > best[a] or (a != point and net.leaf[a]):
                continue
            for b, e, w in near[a]:
                if b != hub and b not in region:
                    continue
                if e in load:
                    if edge_cap > 0 and load[e] + q > edge_cap + 1e-9:
                        continue
                    step = 0.0
                else:
                    step = w + branch(a) + branch(b)
                if d + step < best.get(b, INF):
                    best[b], by[b] = d + step, (a, e)
                    heapq.heappush(heap, (d + step, b))
        if not done:
            return None
        a = hub
        while a != point:
            a, e = by[a]
            if e not in load:
                load[e] = 0.0
                meters += float(net.length[e])
                for end in (int(net.u[e]), int(net.v[e])):
                    degree[end] = degree.get(end, 0) + 1
            load[e] += q
    return meters, load


def dual_ascent(n: int, src, dst, cost, root: int, terminals) -> tuple[float, list[int] | None]:
    """Lower bound on a Steiner arborescence and, if there is one, the arcs of a tree.

    For each terminal in turn, the nodes that reach it over arcs of reduced cost 0 form
    a set; the cheapest arc into the set pays for all arcs into it, until the root is in.
    The tree joins shortest root paths by reduced cost. (inf, None) if a terminal can't
    be reached.
    """
    left = [float(c) for c in cost]
    into: list[list[int]] = [[] for _ in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for a, (s, d) in enumerate(zip(src, dst)):
        into[d].append(a)
        out[s].append(a)
    bound = 0.0
    goals = [t for t in dict.fromkeys(terminals) if t != root]
    for t in goals:
        while True:
            group, todo = {t}, [t]
            for w in todo:
                for a in into[w]:
                    if left[a] <= 0 and src[a] not in group:
                        group.add(src[a])
                        todo.append(src[a])
            if root in group:
                break
            cut = [a for w in todo for a in into[w] if src[a] not in group]
            if not cut:
                return INF, None
            least = min(left[a] for a in cut)
            bound += least
            for a in cut:
                left[a] -= least
    best, by, heap = {root: 0.0}, {}, [(0.0, root)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > best[u]:
            continue
        for a in out[u]:
            if d + left[a] < best.get(dst[a], INF):
                best[dst[a]], by[dst[a]] = d + left[a], a
                heapq.heappush(heap, (best[dst[a]], dst[a]))
    tree = set()
    for t in goals:
        while t != root and by[t] not in tree:
            tree.add(by[t])
            t = src[by[t]]
    return bound, sorted(tree)
