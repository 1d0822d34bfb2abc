"""Costs between the borders of small tiles: an overlay graph that the searches of all sources share.

A window is cut into inner tiles of INNER cells a side. From outside a search enters an inner tile by cells of its halo
(or by cells at the window's border), and leaves it by cells within a step of its sides. The costs between all of these are worked
out once for each inner tile; a search of any source then only adds and compares such costs, tile by tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.functions.neighborhood import Step
from gridloom.operators.search import Window

#: The side of an inner tile, and distances that are worked on at a time.
INNER, AT_ONCE = 64, 1 << 19


#: Rows and columns of a window, or one number for both.
Span = int | tuple[int, int]


def _sides(span: Span) -> tuple[int, int]:
    return (span, span) if isinstance(span, int) else span


@lru_cache(maxsize=8)
def frame(span: Span, halo: int) -> np.ndarray:
    """Cells within two halos of a window's border: its halo, and the cells that lie in its neighbours' halos."""
    height, width = _sides(span)
    near = np.ones((height, width), bool)
    near[2 * halo : height - 2 * halo, 2 * halo : width - 2 * halo] = False
    return np.flatnonzero(near)


@lru_cache(maxsize=8)
def ring(span: Span, halo: int) -> np.ndarray:
    """A window's own cells that lie in its neighbours' halos."""
    height, width = _sides(span)
    near = np.zeros((height, width), bool)
    near[halo : height - halo, halo : width - halo] = True
    near[2 * halo : height - 2 * halo, 2 * halo : width - 2 * halo] = False
    return np.flatnonzero(near)


def from_each(window: Window, nodes: np.ndarray) -> np.ndarray:
    """[node, cell]: least costs from each node to every cell of a window, all relaxed together."""
    size = window.height * window.width
    dist = np.full(len(nodes) * size, np.inf)
    copies = np.arange(len(nodes)) * size
    pending = copies + nodes
    dist[pending] = 0.0
    while len(pending):
        limit = dist[pending].min() + window.bucket
        while True:
            now = dist[pending] < limit
            front, rest = pending[now], [pending[~now]]
            if not len(front):
                break
            own = front % size
            for step, jump in enumerate(window.jumps):
                cost = dist[front] + window.weight(step, own)
                to = front + jump
                ok = np.flatnonzero(np.isfinite(cost))
                better = ok[cost[ok] < dist[to[ok]]]
                dist[to[better]] = cost[better]
                rest.append(to[better])
            pending = np.unique(np.concatenate(rest))
    return dist.reshape(len(nodes), size)


def inner_costs(values: np.ndarray, halo: int, wanted: list[Step], ignore_max: bool, inner: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entries, exits, costs[entry, exit]) of each inner tile, row by row; cells are numbered in the window."""
    height, width = values.shape
    at_border = np.zeros(height * width, bool)
    at_border[frame(values.shape, halo)] = True
    at_border = at_border.reshape(height, width)
    for top in range(0, height, inner):
        for left in range(0, width, inner):
            bottom, right = min(height, top + inner), min(width, left + inner)
            r0, c0, r1, c1 = max(0, top - halo), max(0, left - halo), min(height, bottom + halo), min(width, right + halo)
            window = Window(values[r0:r1, c0:c1], wanted, ignore_max)
            core = np.zeros(window.open.shape, bool)
            core[top - r0 : bottom - r0, left - c0 : right - c0] = True
            side = core.copy()
            side[top - r0 + halo : bottom - r0 - halo, left - c0 + halo : right - c0 - halo] = False
            border = at_border[r0:r1, c0:c1] & core
            entries, exits = (np.flatnonzero((mask & window.open).ravel()) for mask in (~core | border, side | border))
            costs = np.empty((len(entries), len(exits)))
            many = max(1, AT_ONCE // core.size)
            for at in range(0, len(entries), many):
                costs[at : at + many] = from_each(window, entries[at : at + many])[:, exits]
            r, c = np.divmod(np.concatenate([entries, exits]), c1 - c0)
            nodes = (r + r0) * width + c + c0
            yield nodes[: len(entries)], nodes[len(entries) :], costs


def with_costs(tiles: DataFrame, span: Span, halo: int, wanted: list[Step], ignore_max: bool, inner: int | None = None) -> DataFrame:
    """Tiles (tr, tc, values) and their ``costs_between``: for each inner tile its entries, exits and costs, packed."""
    inner = inner or INNER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tr, tc, data in zip(pdf["tr"], pdf["tc"], pdf["values"], strict=True):
                found = inner_costs(np.frombuffer(data, np.int32).reshape(_sides(span)), halo, wanted, ignore_max, inner)
                packed = [np.array([inner, len(a), len(b)], np.int64).tobytes() + a.tobytes() + b.tobytes() + costs.tobytes() for a, b, costs in found]
                yield pd.DataFrame({"tr": [tr], "tc": [tc], "values": [data], "costs_between": [packed]})

    return tiles.repartition("tr", "tc").mapInPandas(run, "tr int, tc int, values binary, costs_between array<binary>")


def read(packed) -> tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    out, inner = [], INNER
    for data in packed:
        inner, n, m = np.frombuffer(data, np.int64, 3).tolist()
        nodes = np.frombuffer(data, np.int64, n + m, 24)
        out.append((nodes[:n], nodes[n:], np.frombuffer(data, np.float64, n * m, 24 + 8 * (n + m)).reshape(n, m)))
    return inner, out


def spread(between, span: Span, halo: int, known: np.ndarray, told: np.ndarray, new: np.ndarray) -> np.ndarray:
    """``known`` costs (in place), after ``new`` cells were ``told`` theirs: right at all cells where inner tiles are left or the window is."""
    inner, tiles = between
    height, width = _sides(span)
    down, across = -(-height // inner), -(-width // inner)
    seen: dict[int, np.ndarray] = {}
    heap: list[tuple[float, int]] = []

    def tell(nodes: np.ndarray, source: int) -> None:
        """Inner tiles by whose entries these cells come in; their own tile only if they come from outside."""
        r, c = np.divmod(nodes, width)
        costs = known[nodes]
        low_r, high_r, low_c, high_c = (r - halo) // inner, (r + halo) // inner, (c - halo) // inner, (c + halo) // inner
        for i in range(max(0, int(low_r.min())), min(down - 1, int(high_r.max())) + 1):
            for j in range(max(0, int(low_c.min())), min(across - 1, int(high_c.max())) + 1):
                here = (low_r <= i) & (i <= high_r) & (low_c <= j) & (j <= high_c)
                if i * across + j != source and here.any():
                    heapq.heappush(heap, (float(costs[here].min()), i * across + j))

    known[new] = told[new]
    tell(new, -1)
    while heap:
        _, tile = heapq.heappop(heap)
        entries, exits, costs = tiles[tile]
        now = known[entries]
        fresh = np.flatnonzero(now < seen[tile]) if tile in seen else np.flatnonzero(np.isfinite(now))
        if not len(fresh):
            continue
        seen[tile] = now
        found = (now[fresh, None] + costs[fresh]).min(axis=0)
        better = np.flatnonzero(found < known[exits])
        if len(better):
            known[exits[better]] = found[better]
            tell(exits[better], tile)
    return known
