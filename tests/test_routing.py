import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import AlgorithmNotImplementedError, NoPathFoundError, PairwiseError
from gridloom.finder import PathFinder, add_paths, contains_paths, points
from gridloom.functions.grid import FORBIDDEN, RasterMeta
from gridloom.functions.neighborhood import between, factor, steps
from gridloom.operators import edges as E
from gridloom.operators import metrics as M
from gridloom.operators import overlay, route
from gridloom.operators.search import ALGORITHMS, Window, routes
from gridloom.sources.detect import array_cells

# Example grids whose edge counts, sums of weights and least costs are known, as given below.
R5 = [[1, 1, 1, 1, 1], [1, 2, 2, 2, 1], [1, 2, 3, 2, 1], [1, 2, 2, 2, 1], [1, 1, 1, 1, 1]]
R3 = [[1, 2, 3], [2, 3, 4], [3, 4, 5]]


def cells(spark, values):
    return array_cells(spark, np.array(values), RasterMeta(len(values), len(values[0]))).cells.select("row", "col", "value")


def dijkstra(values, k, source):
    h, w = values.shape
    dist, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        r, c = divmod(u, w)
        for dr, dc in steps(k):
            bag = [(r, c), *((r + a, c + b) for a, b in between(dr, dc)), (r + dr, c + dc)]
            if all(0 <= a < h and 0 <= b < w and values[a, b] != FORBIDDEN for a, b in bag):
                v, n = (r + dr) * w + c + dc, d + sum(int(values[a, b]) for a, b in bag) * factor(dr, dc)
                if n < dist.get(v, math.inf):
                    dist[v] = n
                    heapq.heappush(heap, (n, v))
    return dist


@pytest.mark.parametrize(
    "values, k, n, total, cost",
    [
        (R5, 0, 40, 60.0, 8.0),
        (R5, 1, 72, 133.539105243, 7.767766953),
        (R5, 2, 120, 316.896679398, 7.767766953),
        (R5, 3, 176, 643.604712574, 7.767766953),
        (R3, 0, 12, 36.0, 12.0),
        (R3, 1, 20, 69.941125497, 8.485281374),
        (R3, 2, 28, 123.606756957, 8.485281374),
    ],
)
def test_golden_edges_and_costs(spark, values, k, n, total, cost):
    w = len(values[0])
    for how in (E.edges, E.edges_by_cells):
        got = how(cells(spark, values), w, k).agg(F.count("u"), F.sum("w")).first()
        assert got[0] == n and got[1] == pytest.approx(total, abs=1e-8)
    window = Window(np.array(values), route.directed(k))
    for algorithm in ALGORITHMS:
        assert routes(window, 0, [w * w - 1], algorithm)[0][0] == pytest.approx(cost, abs=1e-8)


def test_forbidden_cells_and_outgoing(spark):
    walled = [[FORBIDDEN, 2, 3], *R3[1:]]
    assert 2 * E.edges(cells(spark, walled), 3, 0).count() == 20
    assert 2 * E.edges(cells(spark, walled), 3, 0, ignore_max=False).count() == 24
    assert E.outgoing(cells(spark, R3), 3, 1, 1, 0).count() == 4
    assert E.outgoing(cells(spark, R3), 3, 0, 0, 0).count() == 2
    assert E.outgoing(cells(spark, [R3[0], R3[1], [3, FORBIDDEN, 5]]), 3, 1, 1, 0).count() == 3
    lone = [[1, FORBIDDEN, 1], [FORBIDDEN, FORBIDDEN, 1], [1, 1, 1]]
    found = cells(spark, lone).where(F.col("value") != FORBIDDEN)
    assert [r[0] for r in E.isolated(found, E.edges(found, 3, 0), 3).collect()] == [0]


def test_edges_by_cells_do_not_pass_the_driver(spark, tmp_path):
    """Cells from a small file, which Spark would broadcast whole."""
    cells(spark, R5).write.parquet(str(tmp_path / "cells"))
    found = E.edges_by_cells(spark.read.parquet(str(tmp_path / "cells")), 5, 2)
    assert found.count() == 120
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(6))
def test_searches_agree_with_a_heap(seed):
    rng = random.Random(seed)
    h, w, k = rng.randint(2, 14), rng.randint(2, 14), rng.randint(0, 3)
    values = np.array([[FORBIDDEN if rng.random() < 0.2 else rng.randint(1, 9) for _ in range(w)] for _ in range(h)])
    free = [int(n) for n in np.flatnonzero(values.ravel() != FORBIDDEN)]
    source, target = rng.choice(free), rng.choice(free)
    expected = dijkstra(values, k, source).get(target, math.inf)
    window = Window(values, route.directed(k))
    for algorithm in ALGORITHMS:
        cost, path = routes(window, source, [target], algorithm)[0]
        assert cost == pytest.approx(expected)
        assert (path[0], path[-1]) == (source, target) if math.isfinite(expected) else path == []


def test_tiles_agree_with_one_window(spark):
    rng = random.Random(5)
    values = np.array([[FORBIDDEN if rng.random() < 0.25 else rng.randint(1, 9) for _ in range(17)] for _ in range(13)])
    source = int(np.flatnonzero(values.ravel() != FORBIDDEN)[0])
    got = {r.node: r.dist for r in route.tiled_distances(cells(spark, values), 13, 17, source, 2, side=5).collect()}
    expected = dijkstra(values, 2, source)
    assert got.keys() == expected.keys() and all(got[n] == pytest.approx(d) for n, d in expected.items())


def test_dispatch(spark):
    c = cells(spark, R5)
    solve = lambda s, t, **o: [(r.source, r.target, r.cost) for r in route.solve(c, 5, 5, route.requests(spark, s, t, **o)).orderBy("ord").collect()]
    assert [x[:2] for x in solve([0, 4], [20, 24])] == [(0, 20), (0, 24), (4, 20), (4, 24)]
    assert [x[:2] for x in solve([0, 4], [20, 24], pairwise=True)] == [(0, 20), (4, 24)]
    many = solve([0, 4, 2], 24)
    assert [x[:2] for x in many] == [(0, 24), (4, 24), (2, 24)] and many[0][2] == pytest.approx(solve(24, 0)[0][2])
    with pytest.raises(PairwiseError):
        route.requests(spark, [1, 2], [1, 2, 3], pairwise=True)
    with pytest.raises(AlgorithmNotImplementedError):
        route.solve(c, 5, 5, route.requests(spark, 0, 1), algorithm="magic")


def test_metrics_of_the_diagonal(spark):
    paths = spark.createDataFrame([(0, [0, 6, 12, 18, 24])], "path_id long, node_ids array<long>")
    by = M.length_by_category(paths, cells(spark, R5), 5)
    got = {r.category: r.length for r in by.collect()}
    assert got == pytest.approx({1: 6 * math.sqrt(2) / 4, 2: 8 * math.sqrt(2) / 4, 3: 2 * math.sqrt(2) / 4})
    t = M.totals(by).first()
    assert (t.total_length, t.total_cost) == pytest.approx((4 * math.sqrt(2), 9.899495), abs=1e-6)
    assert M.shares(by).agg(F.sum("percent")).first()[0] == pytest.approx(100)


def test_points():
    assert points((1, 2)) == (1.0, 2.0) == points([(1, 2)]) == points(np.array([1, 2]))
    assert points([(1, 2), (3, 4)]) == [(1.0, 2.0), (3.0, 4.0)]
    for bad in ("x", [], [1, 2, 3]):
        with pytest.raises(ValueError):
            points(bad)


def test_finder_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = RasterMeta(60, 60, 1.0, 0.0, 500000.0, 0.0, -1.0, 5600000.0, 32632)
    finder = PathFinder(spark, rng.integers(1, 10, (60, 60)), (500010, 5599990), (500045, 5599955), neighborhood=1, buffer=20, meta=m)
    one = finder.find()
    row = one.first()
    assert row.total_cost == pytest.approx(row.cost) and row.total_length > 0 and sum(row.length_by_category.values()) == pytest.approx(row.total_length)
    assert math.dist((row.coords[0].x, row.coords[0].y), (500010, 5599990)) < 1.5
    assert all(finder.find(algorithm=a, metrics=False).first().cost == pytest.approx(row.cost) for a in ALGORITHMS)
    pairs = finder.find([(500010, 5599990), (500020, 5599980)], [(500045, 5599955), (500040, 5599950)])
    assert pairs.count() == 4 and finder.get(2).count() == 1
    wide = PathFinder(spark, rng.integers(1, 2, (60, 60)), (500010, 5599990), (500045, 5599955), neighborhood=2, meta=m)
    assert wide.buffer >= 200
    finder.save_paths(str(tmp_path / "p.geojson"))
    assert spark.read.json(str(tmp_path / "p.geojson")).count() == 4
    finder.save_raster(str(tmp_path / "r.tif"))
    assert spark.read.format("binaryFile").load(str(tmp_path / "r.tif")).count() == 1
    both = add_paths(one, one)
    assert both.count() == 1 and contains_paths(both, one)
    finder.close()


def test_no_path(spark):
    wall = np.ones((9, 9), int)
    wall[:, 4] = FORBIDDEN
    m = RasterMeta(9, 9, 1.0, 0.0, 0.0, 0.0, -1.0, 9.0)
    finder = PathFinder(spark, wall, (1.5, 4.5), (7.5, 4.5), neighborhood=1, buffer=50, meta=m)
    with pytest.raises(NoPathFoundError):
        finder.find()


def walled(k, low=1):
    rng = np.random.default_rng(k)
    values = np.where(rng.random((31, 43)) < 0.2, FORBIDDEN, rng.integers(low, 30, (31, 43)))
    values[0, 0] = values[30, 42] = values[3, 40] = values[20, 2] = 1
    values[10:13, 10:13] = FORBIDDEN
    values[11, 11] = 1  # walled in
    return values, [0, 30 * 43 + 42, 3 * 43 + 40, 20 * 43 + 2, 11 * 43 + 11]


def check_routes(found, values, k):
    """Costs are those of a heap, and paths have these costs."""
    window = Window(values, route.directed(k))
    steps_of = {jump: i for i, jump in enumerate(window.jumps)}
    known = {}
    rows = found.collect()
    for r in rows:
        inside = min(r.source, r.target) >= 0 and max(r.source, r.target) < values.size
        if inside and r.source not in known:
            known[r.source] = dijkstra(values, k, r.source) if values.ravel()[r.source] != FORBIDDEN else {}
        want = known[r.source].get(r.target, math.inf) if inside else math.inf
        assert r.cost == pytest.approx(want) and bool(r.node_ids) == math.isfinite(want)
        if r.node_ids:
            assert (r.node_ids[0], r.node_ids[-1]) == (r.source, r.target)
            assert sum(float(window.weight(steps_of[b - a], np.array([a]))[0]) for a, b in zip(r.node_ids, r.node_ids[1:])) == pytest.approx(r.cost)
    return len(rows)


@pytest.mark.parametrize("how", [{}, {"algorithm": "astar"}, {"overlay_sources": 1}])
@pytest.mark.parametrize("k, side, low", [(1, 16, 0), (3, 20, 1)])
def test_routes_by_tiles(spark, monkeypatch, k, side, low, how):
    monkeypatch.setattr(overlay, "INNER", 7)
    monkeypatch.setattr(route, "BATCH", 2)
    values, ends = walled(k, low)
    for wanted, n in (
        (route.requests(spark, ends[0], ends[1:] + [-1, 5000]), 6),
        (route.requests(spark, ends[:3], [ends[3], ends[0], int(np.flatnonzero(values.ravel() == FORBIDDEN)[0])]), 9),
    ):
        assert check_routes(route.solve(cells(spark, values), 31, 43, wanted, k, side=side, **how), values, k) == n


def test_one_tile_answers_like_many(spark):
    values, ends = walled(2)
    for algorithm in ALGORITHMS:
        wanted = route.requests(spark, ends[0], ends[1:] + [-1, 5000])
        assert check_routes(route.solve(cells(spark, values), 31, 43, wanted, 2, algorithm), values, 2) == 6
    assert check_routes(route.solve(cells(spark, values).limit(0), 31, 43, route.requests(spark, -1, -2)), values, 1) == 1


def test_costs_between_borders():
    """Each inner tile's costs are those of a heap within its window."""
    values, _ = walled(1)
    values = np.ascontiguousarray(values[:24, :24]).astype(np.int32)
    seen = np.zeros(values.size, bool)
    for entries, exits, costs in overlay.inner_costs(values, 1, route.directed(1), True, 8):
        assert costs.shape == (len(entries), len(exits))
        seen[exits] = True
    inner = list(overlay.inner_costs(values, 1, route.directed(1), True, 24))
    (entries, exits, costs), = inner
    some = dijkstra(values, 1, int(entries[3]))
    assert costs[3].tolist() == pytest.approx([some.get(int(n), math.inf) for n in exits])
    assert seen[overlay.ring(24, 1)].sum() == (values.ravel()[overlay.ring(24, 1)] != FORBIDDEN).sum()


def test_goal_direction_searches_fewer_tiles(spark):
    values = np.full((60, 60), 5)
    values[28:32] = 3
    c, wanted = cells(spark, values), spark.createDataFrame([(0, 30 * 60 + 2, 30 * 60 + 25)], "ord long, start long, end long")
    searched = []
    for goal in (None, route.Goal(), route.Goal(lambda r, col, tr, tc: np.hypot(r - tr, col - tc) * 3.0)):
        held = route.Tiled(c, 60, 60, route.directed(1), 10)
        held.search(wanted.select("start"), wanted.select("start", "end"), goal)
        searched.append(held.searched)
        assert held.paths(wanted).first().cost == pytest.approx(dijkstra(values, 1, 30 * 60 + 2)[30 * 60 + 25])
    whole = route.Tiled(c, 60, 60, route.directed(1), 10)
    whole.search(wanted.select("start"))
    assert max(searched[1:]) < searched[0] < whole.searched


def test_bands_are_lower_bounds():
    values, _ = walled(3)
    goal = route.Goal()
    bands = [("r", i, int(values[max(0, i * 8 - 3) : i * 8 + 11].min())) for i in range(4)] + [("c", i, int(values[:, max(0, i * 8 - 3) : i * 8 + 11].min())) for i in range(6)]
    goal.learn(bands, 8, float(values.min()))
    dist = dijkstra(values, 3, 0)
    nodes = np.array(list(dist))
    assert (goal.ahead(nodes // 43, nodes % 43, (0, 0)) <= np.array([dist[n] for n in nodes.tolist()]) + 1e-9).all()


def test_own_searches_need_one_window(spark, monkeypatch):
    monkeypatch.setattr(route, "WINDOW_CELLS", 10)
    with pytest.raises(ValueError, match="one window"):
        route.solve(cells(spark, R5), 5, 5, route.requests(spark, 0, 24), algorithm=lambda window, start, ends: [(42.0, [start, *ends])])


def test_steps_without_cost_do_not_go_round(spark):
    values = np.zeros((9, 30), int)
    values[4, 3:27] = 7
    for side in (1024, 10):
        assert check_routes(route.solve(cells(spark, values), 9, 30, route.requests(spark, 0, [1, 29, 4 * 30 + 15]), 1, side=side), values, 1) == 3


def test_weights_by_need(monkeypatch):
    rng = np.random.default_rng(2)
    values = np.where(rng.random((20, 30)) < 0.1, FORBIDDEN, rng.integers(0, 50, (20, 30)))
    for ignore in (True, False):
        kept = Window(values, route.directed(3), ignore)
        nodes = np.arange(600)
        by_need = Window(values, route.directed(3), ignore)
        monkeypatch.setattr("gridloom.operators.search.WEIGHT_BYTES", 1 << 29)
        want = [kept.weight(i, nodes) for i in range(len(kept.steps))]
        monkeypatch.setattr("gridloom.operators.search.WEIGHT_BYTES", 0)
        assert all(np.array_equal(w, by_need.weight(i, nodes)) for i, w in enumerate(want))


def test_own_heuristics_and_searches(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(3, 60, (25, 40))
    wanted = route.requests(spark, 0, 999)
    solve = lambda **how: route.solve(cells(spark, values), 25, 40, wanted, 2, **how).first()
    best = solve()
    none = lambda r, c, tr, tc: np.zeros(len(r))
    assert solve(algorithm="astar", heuristic=none).cost == best.cost
    assert solve(algorithm="astar", heuristic_radius=1000).cost == best.cost <= solve(
        algorithm="astar",
        heuristic_radius=0,
        heuristic_weight=3.0,
    ).cost
    row = solve(algorithm=lambda window, start, ends: [(float(len(ends)), [start, *ends]) for _ in ends])
    assert (row.cost, list(row.node_ids)) == (1.0, [0, 999])
    window = Window(np.where(np.arange(1000).reshape(25, 40) < 500, 9, 2), route.directed(1))
    assert window.heuristic(0, 1.0, 39, 3)[39] == 39 * 9 and window.heuristic(0)[39] == 39 * 2


def test_two_sided_paths_are_paths():
    rng = np.random.default_rng(9)
    values = np.where(rng.random((30, 30)) < 0.15, FORBIDDEN, rng.integers(1, 90, (30, 30)))
    window = Window(values, route.directed(2))
    free = np.flatnonzero(window.open.ravel())
    for a, b in rng.choice(free, (25, 2)).tolist():
        (cost, nodes), (other, _) = routes(window, a, [b], "bidirectional_dijkstra")[0], routes(window, a, [b])[0]
        assert cost == pytest.approx(other) and (not nodes or (nodes[0], nodes[-1]) == (a, b))


def test_narrow_rasters_have_long_tiles():
    """As many cells as square ones, so that rounds grow with the cells and not with the length."""
    assert route.tile_sides(24_000, 50, 128, 2) == (327, 50) and route.tile_sides(50, 24_000, 128, 2) == (50, 327)
    assert route.tile_sides(144_000, 50, route.TILE, 1) == (20_971, 50)
    assert route.tile_sides(31, 43, 16, 1) == (16, 16) and route.tile_sides(300, 3, 20, 5) == (40, 10)


def test_tiles_do_not_pass_the_driver(spark):
    held = route.Tiled(cells(spark, np.ones((60, 7), int)), 60, 7, route.directed(1), 10)
    asks = held._by_tile(spark.createDataFrame([(0, 0, 0)], "start long, tr int, tc int"), 1, "start")
    assert "Broadcast" not in asks._jdf.queryExecution().executedPlan().toString()
    assert len(asks.first()["values"]) == 4 * (14 + 2) * (7 + 2)


@pytest.mark.parametrize("turned", [False, True])
def test_overlay_searches_end_near_their_targets(spark, turned):
    rng = np.random.default_rng(8)
    values = np.where(rng.random((90, 7)) < 0.15, FORBIDDEN, rng.integers(1, 30, (90, 7)))
    values[0, 0] = values[20, 3] = values[30, 5] = 1
    values = values.T.copy() if turned else values
    h, w = values.shape
    at = lambda r, c: c * w + r if turned else r * w + c
    wanted = spark.createDataFrame([(0, 0, at(20, 3)), (1, 0, at(30, 5))], "ord long, start long, end long")
    near, whole = (route.Tiled(cells(spark, values), h, w, route.directed(1), 10, many=True) for _ in range(2))
    near.search(wanted.select("start").distinct(), wanted.select("start", "end"))
    whole.search(wanted.select("start").distinct())
    assert near.searched < whole.searched
    known = dijkstra(values, 1, 0)
    assert [r.cost for r in near.paths(wanted).orderBy("ord").collect()] == pytest.approx([known[at(20, 3)], known[at(30, 5)]])
