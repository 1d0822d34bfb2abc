"""Least-cost search on one window, on arrays: buckets of nodes are relaxed together."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cached_property

import numpy as np

from gridloom.functions.grid import FORBIDDEN
from gridloom.functions.neighborhood import Step, between, factor

#: Bytes up to which a window's weights are all kept.
WEIGHT_BYTES = 1 << 29
ALGORITHMS = ("dijkstra", "bidirectional_dijkstra", "astar", "bellman_ford")


class Window:
    """A raster window and its directed steps; node = row * width + col."""

    def __init__(self, values: np.ndarray, steps: Sequence[Step], ignore_max: bool = True) -> None:
        self.values, self.steps, self.ignore_max = values, list(steps), ignore_max
        self.height, self.width = values.shape
        self.open = (values >= 0) & ((values != FORBIDDEN) if ignore_max else True)
        self.jumps = [r * self.width + c for r, c in self.steps]

    def weight(self, step: int, nodes: np.ndarray) -> np.ndarray:
        """The weights of a step's edges from some nodes; inf where there is none.

        Small windows keep all weights; in large ones they are worked out where they are needed.
        """
        if 8 * len(self.steps) * self.values.size <= WEIGHT_BYTES:
            return self.weights[step][nodes]
        dr, dc = self.steps[step]
        r, c = np.divmod(nodes, self.width)
        out = np.full(len(nodes), np.inf)
        own = np.flatnonzero((r + dr >= 0) & (r + dr < self.height) & (c + dc >= 0) & (c + dc < self.width))
        total, ok = np.zeros(len(own)), np.ones(len(own), bool)
        for x, y in [(0, 0), (dr, dc), *between(dr, dc)]:
            at = nodes[own] + x * self.width + y
            total += self.values.flat[at]
            ok &= self.open.flat[at]
        out[own] = np.where(ok, total * factor(dr, dc), np.inf)
        return out

    @cached_property
    def weights(self) -> list[np.ndarray]:
        """For each step the weight of its edge from every node."""
        out = []
        for dr, dc in self.steps:
            w = np.full((self.height, self.width), np.inf)
            r0, r1, c0, c1 = max(0, -dr), self.height - max(0, dr), max(0, -dc), self.width - max(0, dc)
            if r0 < r1 and c0 < c1:
                total, ok = np.zeros((r1 - r0, c1 - c0)), np.ones((r1 - r0, c1 - c0), bool)
                for r, c in sorted([(0, 0), (dr, dc), *between(dr, dc)], key=lambda x: (abs(2 * x[0] - dr) + abs(2 * x[1] - dc), x)):
                    part = (slice(r0 + r, r1 + r), slice(c0 + c, c1 + c))
                    total += self.values[part]
                    ok &= self.open[part]
                w[r0:r1, c0:c1] = np.where(ok, total * factor(dr, dc), np.inf)
            out.append(w.ravel())
        return out

    @cached_property
    def bucket(self) -> float:
        """The width of a bucket: about the median edge."""
        nodes = np.flatnonzero(self.open.ravel())
        nodes = nodes[:: max(1, len(nodes) // 10_000)]
        some = np.concatenate([self.weight(k, nodes) for k in range(len(self.steps))]) if self.steps else np.empty(0)
        some = some[np.isfinite(some)]
        return float(np.median(some)) + 1e-9 if len(some) else 1.0

    def heuristic(self, target: int, weight: float = 1.0, source: int | None = None, radius: int | None = None) -> np.ndarray:
        """The distance in cells to the target times the least cost times a weight.

        For weight 1 this is a lower bound. With ``radius`` only costs in the box of source and target,
        that much wider on each side, count; then it may be none, and paths may be longer.
        """
        values, free = self.values, self.open
        if radius is not None and source is not None:
            (r, c), (tr, tc) = divmod(source, self.width), divmod(target, self.width)
            box = slice(max(0, min(r, tr) - radius), max(r, tr) + radius + 1), slice(max(0, min(c, tc) - radius), max(c, tc) + radius + 1)
            values, free = values[box], free[box]
        least = float(values[free].min()) if free.any() else 0.0
        r, c = np.divmod(np.arange(self.height * self.width), self.width)
        return np.hypot(r - target // self.width, c - target % self.width) * least * weight


class Search:
    """Distances from some nodes, bucket by bucket; with ``parents`` also the node before each on its path."""

    def __init__(
        self,
        window: Window,
        start: dict[int, float],
        buckets: bool = True,
        bound: np.ndarray | None = None,
        parents: bool = False,
    ) -> None:
        self.window, self.buckets, self.bound = window, buckets, bound
        self.parents = np.full(window.height * window.width, -1, np.int64) if parents else None
        self.dist = np.full(window.height * window.width, np.inf)
        nodes = [n for n in start if window.open.flat[n]]
        self.dist[nodes] = [start[n] for n in nodes]
        self.pending = np.array(nodes, np.int64)
        self.settled = -math.inf  # distances below this one are final
        self.best = math.inf  # nodes that can't do better are left out

    def step(self) -> bool:
        """Settle one more bucket; False if nothing is left. ``changed``: the nodes that got better."""
        dist, w = self.dist, self.window
        self.changed: list[np.ndarray] = []
        if self.bound is not None and len(self.pending):
            self.pending = self.pending[dist[self.pending] + self.bound[self.pending] < self.best * (1 + 1e-12)]
        if not len(self.pending):
            self.settled = math.inf
            return False
        limit = dist[self.pending].min() + w.bucket if self.buckets else math.inf
        while True:
            now = dist[self.pending] < limit
            front = self.pending[now]
            if not len(front):
                break
            rest = [self.pending[~now]]
            for step, jump in enumerate(w.jumps):
                cost = dist[front] + w.weight(step, front)
                ok = np.isfinite(cost)
                to, cost = front[ok] + jump, cost[ok]
                better = cost < dist[to]
                to, cost = to[better], cost[better]  # a step leads each node elsewhere
                dist[to] = cost
                if self.parents is not None:
                    self.parents[to] = to - jump
                rest.append(to)
                self.changed.append(to)
            self.pending = np.unique(np.concatenate(rest))
        self.settled = limit
        return True

    def chain(self, node: int) -> list[int]:
        """Nodes from one back to where the search began.

        A node's parent changes only when the node gets better, so a chain ends even where steps cost nothing.
        """
        found = [node]
        while self.parents[found[-1]] >= 0:
            found.append(int(self.parents[found[-1]]))
        return found


Heuristic = Callable[[np.ndarray, np.ndarray, int, int], np.ndarray]


def routes(
    window: Window,
    source: int,
    targets: Sequence[int],
    algorithm: str = "dijkstra",
    heuristic_weight: float = 1.0,
    heuristic: Heuristic | None = None,
    heuristic_radius: int | None = None,
) -> list[tuple[float, list[int]]]:
    """(cost, nodes) for each target from one search; (inf, []) if it can't be reached.

    ``heuristic``: rows and columns of nodes, row and column of the target -> bounds of the costs between them, for
    A*. One that is no lower bound, like a weight above 1, may give longer paths.
    """
    size = window.height * window.width
    valid = [0 <= t < size and bool(window.open.flat[t]) for t in targets]
    if not (0 <= source < size and window.open.flat[source]) or not any(valid):
        return [(math.inf, [])] * len(targets)
    wanted = [t for t, ok in zip(targets, valid, strict=True) if ok]
    single = len(set(wanted)) == 1
    if algorithm == "bidirectional_dijkstra" and single and wanted[0] != source:
        found = _two_sided(window, source, wanted[0])
        return [found if ok else (math.inf, []) for ok in valid]
    bound = None
    if algorithm == "astar" and single:
        if heuristic is None:
            bound = window.heuristic(wanted[0], heuristic_weight, source, heuristic_radius)
        else:
            bound = heuristic(*np.divmod(np.arange(size), window.width), *divmod(wanted[0], window.width)) * heuristic_weight
    search = Search(window, {source: 0.0}, algorithm != "bellman_ford", bound, parents=True)
    while search.settled <= search.dist[wanted].max() and search.step():
        search.best = search.dist[wanted[0]] if bound is not None else math.inf
    dist = search.dist
    return [(float(dist[t]), search.chain(t)[::-1]) if ok and np.isfinite(dist[t]) else (math.inf, []) for t, ok in zip(targets, valid, strict=True)]


def _two_sided(window: Window, source: int, target: int) -> tuple[float, list[int]]:
    """The path from searches that meet; the graph is undirected."""
    ahead, back = (Search(window, {end: 0.0}, parents=True) for end in (source, target))
    best, meet = math.inf, -1
    while ahead.settled + back.settled < best:
        side, other = (ahead, back) if ahead.settled <= back.settled else (back, ahead)
        if not side.step():
            break
        if side.changed:
            nodes = np.concatenate(side.changed)
            both = side.dist[nodes] + other.dist[nodes]
            if len(both) and both.min() < best:
                best, meet = float(both.min()), int(nodes[both.argmin()])
    if meet < 0:
        return math.inf, []
    path = ahead.chain(meet)[::-1] + back.chain(meet)[1:]
    # Weights are summed from the source on, as the other algorithms do.
    cost, steps = 0.0, {jump: i for i, jump in enumerate(window.jumps)}
    for a, b in zip(path, path[1:], strict=False):
        cost += float(window.weight(steps[b - a], np.array([a]))[0])
    return cost, path
