"""Least-cost routes over a raster in tiles.

A request table has (ord, source, target) node ids. Requests are grouped by source, or by
target if these are fewer, as the graph is undirected. A raster that fits one tile is searched in the tasks of its
sources. Larger ones stay in tiles: a tile knows least costs only at its border, and hands those of its own cells that lie in a
neighbour's halo on to it. Rounds go on until no border improves; paths are then walked back from tile to tile.
With many sources, the costs between the borders of small tiles are worked out once, for all of them (``overlay``). No
raster passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridloom.errors import AlgorithmNotImplementedError, NoPathFoundError, PairwiseError
from gridloom.functions.grid import FORBIDDEN, line_cells
from gridloom.functions.neighborhood import Step, steps
from gridloom.operators import overlay
from gridloom.operators.search import ALGORITHMS, Heuristic, Search, Window, routes
from gridloom.session import ship, store

#: The side of a tile in cells, and sources from which on a search uses border-to-border costs.
TILE, OVERLAY_SOURCES = 1024, 256
#: Cells up to which a window is one tile for a search of one's own.
WINDOW_CELLS = 1 << 26
#: Rounds after which changed tiles are merged into the state.
MERGE = 8
#: Targets up to which a source's search ends where these can't gain, and starts that a task takes of a tile.
BOUNDED_TARGETS, BATCH = 32, 64
#: Pairs of sources and targets whose best costs the driver keeps between rounds.
BOUNDED_PAIRS = 10_000
#: Sides of tiles with border-to-border costs, for steps of one cell and for longer ones.
OVERLAY_TILES = 512, 256


def directed(of: Sequence[Step] | int | str) -> list[Step]:
    """All steps, with the reverse of each."""
    found = steps(of) if isinstance(of, int | str) else list(of)
    return sorted({*found, *((-r, -c) for r, c in found)})


#: A search of one's own: a window, a start and ends -> (cost, nodes) for each end.
Backend = Callable[[Window, int, list[int]], list[tuple[float, list[int]]]]
RESULT = "ord long, source long, target long, cost double, node_ids array<long>"


def solve(
    cells: DataFrame,
    height: int,
    width: int,
    requests: DataFrame,
    of: Sequence[Step] | int | str = 1,
    algorithm: str | Backend = "dijkstra",
    ignore_max: bool = True,
    heuristic_weight: float = 1.0,
    heuristic: Heuristic | None = None,
    heuristic_radius: int | None = None,
    side: int | None = None,
    overlay_sources: int | None = None,
) -> DataFrame:
    """A row for each request: ord, source, target, cost, node_ids (inf and empty if there is no path).

    ``algorithm``: a name, or a function from a Window, a start and ends to their (cost, nodes), which needs the raster as one
    tile (up to WINDOW_CELLS cells, else ValueError). For ``heuristic`` and its weight and radius see ``search.routes``.
    Rasters of more than ``side`` (TILE) cells a side are searched tile by tile. There all algorithms search alike; "astar" also leaves out
    tiles and border cells from which no target can be reached at less than the best cost known so far, by the heuristic or else by
    lower bounds from the least costs of rows and columns of tiles. From ``overlay_sources`` (OVERLAY_SOURCES) distinct starts on, costs between
    the borders of small tiles take the place of searches. Costs agree; of several least-cost paths either may be told.
    """
    if not callable(algorithm) and algorithm not in ALGORITHMS:
        raise AlgorithmNotImplementedError(algorithm)
    spark = cells.sparkSession
    ship(spark)
    wanted = directed(of)
    side = side or TILE
    sides = requests.agg(F.countDistinct("source").alias("s"), F.countDistinct("target").alias("t")).first()
    turned = sides["t"] < sides["s"]
    start, end = ("target", "source") if turned else ("source", "target")
    asked = requests.select(F.col("ord").cast("long"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"))
    if callable(algorithm) and height * width > WINDOW_CELLS:
        raise ValueError(f"a search of one's own needs the raster as one window; {height} x {width} cells are more than {WINDOW_CELLS}")
    if callable(algorithm) or max(height, width) <= side:
        found = _in_one_tile(cells, height, width, asked, wanted, algorithm, ignore_max, heuristic_weight, heuristic, heuristic_radius)
    else:
        many = min(sides["s"], sides["t"]) >= (OVERLAY_SOURCES if overlay_sources is None else overlay_sources)
        goal = Goal(heuristic, heuristic_weight) if algorithm == "astar" else None
        found = tiled_routes(cells, height, width, asked, wanted, side, ignore_max, goal, many)
    nodes = F.reverse("node_ids") if turned else F.col("node_ids")
    a, b = ("end", "start") if turned else ("start", "end")
    return found.select("ord", F.col(a).alias("source"), F.col(b).alias("target"), "cost", nodes.alias("node_ids"))


def _whole(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(values binary): the raster as one row."""
    inside = cells.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))

    def build(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.full((height, width), -1, np.int32)
        values[pdf["row"], pdf["col"]] = pdf["value"]
        return pd.DataFrame({"values": [values.tobytes()]})

    return inside.select(F.lit(0).alias("whole"), "row", "col", "value").groupBy("whole").applyInPandas(build, "values binary")


def _beside(rows: DataFrame, cells: DataFrame, height: int, width: int) -> DataFrame:
    """Rows by start, dealt over tasks, each with the raster as one tile."""
    return rows.repartition("start").join(F.broadcast(_whole(cells, height, width)), how="cross")  # one row: the tile


def _from_one_tile(cells: DataFrame, height: int, width: int, starts: DataFrame, wanted: list[Step], ignore_max: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for start, values in zip(pdf["start"].tolist(), pdf["values"], strict=True):
                held = held or Window(np.frombuffer(values, np.int32).reshape(height, width), wanted, ignore_max)
                search = Search(held, {start: 0.0})
                while search.step():
                    pass
                nodes = np.flatnonzero(np.isfinite(search.dist))
                yield pd.DataFrame({"start": start, "node": nodes, "dist": search.dist[nodes]})

    return _beside(starts, cells, height, width).mapInPandas(run, "start long, node long, dist double")


def _in_one_tile(cells, height, width, asked, wanted, algorithm, ignore_max, weight, heuristic, radius) -> DataFrame:
    """(ord, start, end, cost, node_ids): the tile meets the requests of each start, and one search answers these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for first, ends, ords, values in zip(pdf["start"], pdf["ends"], pdf["ords"], pdf["values"], strict=True):
                held = held or Window(np.frombuffer(values, np.int32).reshape(height, width), wanted, ignore_max)
                ends = ends.tolist()
                found = algorithm(held, first, ends) if callable(algorithm) else routes(held, first, ends, algorithm, weight, heuristic, radius)
                yield pd.DataFrame({"ord": ords, "start": first, "end": ends, "cost": [c for c, _ in found], "node_ids": [n for _, n in found]})

    groups = asked.groupBy("start").agg(F.collect_list("end").alias("ends"), F.collect_list("ord").alias("ords"))
    found = _beside(groups, cells, height, width).mapInPandas(run, "ord long, start long, end long, cost double, node_ids array<long>")
    missing = F.col("cost").isNull()  # a raster without cells has no tile
    return asked.join(found.select("ord", "cost", "node_ids"), "ord", "left").select(
        "ord", "start", "end", F.when(missing, F.lit(math.inf)).otherwise(F.col("cost")).alias("cost"), F.coalesce("node_ids", _none()).alias("node_ids")
    )


def _none() -> Column:
    return F.array().cast("array<long>")


def distances(
    cells: DataFrame,
    height: int,
    width: int,
    sources: DataFrame,
    of: Sequence[Step] | int | str = 1,
    ignore_max: bool = True,
    side: int | None = None,
) -> DataFrame:
    """(source, node, dist): least costs from each source to every node it reaches."""
    starts = sources.select(F.col("source").cast("long").alias("start")).distinct()
    starts = starts.where((F.col("start") >= 0) & (F.col("start") < height * width))
    side = side or TILE
    if max(height, width) <= side:
        return _from_one_tile(cells, height, width, starts, directed(of), ignore_max).withColumnRenamed("start", "source")
    held = Tiled(cells, height, width, directed(of), side, ignore_max)
    return held.distances(starts).withColumnRenamed("start", "source")


def tiled_distances(
    cells: DataFrame,
    height: int,
    width: int,
    source: int,
    of: Sequence[Step] | int | str = 1,
    side: int = TILE,
    ignore_max: bool = True,
) -> DataFrame:
    """(node, dist) for every node that ``source`` reaches, exactly, with one tile of up to ``side`` * ``side`` cells in memory at a time."""
    start = cells.sparkSession.createDataFrame([(source,)], "source long")
    return distances(cells, height, width, start, of, ignore_max, side).drop("source")


def requests(spark, sources: int | Sequence[int], targets: int | Sequence[int], pairwise: bool = False) -> DataFrame:
    """The request table: one to one, one to many, many to one, pairs by place, or all pairs, source by source."""
    s, t = ([x] if isinstance(x, int) else list(x) for x in (sources, targets))
    if pairwise and len(s) > 1 and len(t) > 1:
        if len(s) != len(t):
            raise PairwiseError(f"{len(s)} sources and {len(t)} targets can't be paired")
        rows = list(zip(s, t, strict=True))
    else:
        rows = [(a, b) for a in s for b in t]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, source long, target long")


def one_path(found: DataFrame) -> tuple[float, list[int]]:
    """The single result; NoPathFoundError if there is none."""
    row = found.first()
    if not row["node_ids"]:
        raise NoPathFoundError(row["source"], row["target"])
    return row["cost"], list(row["node_ids"])


def heuristic(row: Column, col: Column, target_row: Column, target_col: Column, least: Column, weight: float = 1.0) -> Column:
    """The bound of A*: distance in cells times the least cost times a weight."""
    return F.hypot((row - target_row).cast("double"), (col - target_col).cast("double")) * least * weight


def least_value(cells: DataFrame, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(least): the smallest cost of free cells, of a box (row0, col0, row1, col1) if given, ends included."""
    free = cells.where(F.col("value") != FORBIDDEN)
    if box:
        free = free.where(F.col("row").between(box[0], box[2]) & F.col("col").between(box[1], box[3]))
    return free.agg(F.min("value").cast("double").alias("least"))


def least_near_line(cells: DataFrame, source: tuple[int, int], target: tuple[int, int], radius: int = 200) -> DataFrame:
    """(least): the smallest cost of free cells within ``radius`` rows and columns of the line between two cells."""
    line = cells.sparkSession.range(1).select(F.explode(line_cells(*map(F.lit, (*source, *target)))).alias("p")).select(F.col("p.row").alias("r"), F.col("p.col").alias("c"))
    rows = line.select(
        F.explode(F.sequence(F.col("r") - radius, F.col("r") + radius)).alias("row"),
        "c",
    ).groupBy("row").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    # Along a monotone line the cells near it in a row are one range of columns.
    near = cells.where(F.col("value") != FORBIDDEN).join(rows, "row").where(F.col("col").between(F.col("low") - radius, F.col("high") + radius))
    return near.agg(F.min("value").cast("double").alias("least"))


def tile_sides(height: int, width: int, side: int, halo: int) -> tuple[int, int]:
    """Rows and columns of a tile: ``side`` each, or as many cells in a longer tile where the raster is narrower, so that rounds stay few."""
    area = side * side
    if width < side <= height:
        cols = max(width, 2 * halo)
        return min(height, area // cols), cols
    if height < side <= width:
        rows = max(height, 2 * halo)
        return rows, min(width, area // rows)
    return side, side


def tiles(cells: DataFrame, height: int, width: int, halo: int, sides: tuple[int, int] = (TILE, TILE)) -> DataFrame:
    """(tr, tc, values binary): tiles with a border of ``halo`` cells of their neighbours, int32, -1 where there is no cell."""
    rows, cols = sides
    across, size = cols + 2 * halo, (rows + 2 * halo) * (cols + 2 * halo)

    def offered(c: str, side: int) -> Column:
        first, last = F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)
        return F.sequence(first.cast("int"), last.cast("int"))

    inside = cells.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    placed = inside.withColumn("tr", F.explode(offered("row", rows))).withColumn("tc", F.explode(offered("col", cols))).where(f"tr >= 0 and tc >= 0 and tr * {rows} < {height} and tc * {cols} < {width}")
    place = (F.col("row") - F.col("tr") * rows + halo) * across + F.col("col") - F.col("tc") * cols + halo

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.full(size, -1, np.int32)
        values[pdf["place"]] = pdf["value"]
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "values": [values.tobytes()]})

    return placed.select("tr", "tc", place.alias("place"), "value").groupBy("tr", "tc").applyInPandas(build, "tr int, tc int, values binary")


def _few_targets(ends: DataFrame) -> dict[int, dict[int, float]]:
    """start -> target -> inf, for starts with few targets; empty if these are more than BOUNDED_PAIRS (no search then ends early)."""
    few = ends.groupBy("start").agg(F.collect_set("end").alias("ends")) if ends.limit(BOUNDED_PAIRS + 1).count() <= BOUNDED_PAIRS else None
    rows = few.where(F.size("ends") <= BOUNDED_TARGETS).collect() if few is not None else []
    return {r["start"]: dict.fromkeys(sorted(r["ends"]), math.inf) for r in rows}


class Goal:
    """What a search may leave out: bounds of the cost still ahead, by a heuristic of one's own or from bands of tiles."""

    def __init__(self, own: Heuristic | None = None, weight: float = 1.0) -> None:
        self.own, self.weight = own, weight
        self.rows = self.cols = np.zeros(1)
        self.sides, self.least = (1, 1), 0.0

    def learn(self, bands: list[tuple[str, int, int]], sides: int | tuple[int, int], least: float) -> None:
        """``bands``: ("r" or "c", number, least value): whoever passes a band pays at least its least value for each of its cells.

        ``sides``: the rows and the columns of a tile.
        """
        self.sides = (sides, sides) if isinstance(sides, int) else sides
        for kind, side in zip("rc", self.sides, strict=True):
            found = {n: v for k, n, v in bands if k == kind}
            sums = np.zeros(max(found, default=0) + 2)
            sums[1:] = np.cumsum([found.get(n, 0) * side for n in range(len(sums) - 1)])
            if kind == "r":
                self.rows = sums
            else:
                self.cols = sums
        self.least = least

    def ahead(self, r: np.ndarray, c: np.ndarray, target: tuple[int, int]) -> np.ndarray:
        if self.own is not None:
            return self.own(r, c, *target) * self.weight

        def bands(at: np.ndarray, to: int, sums: np.ndarray, side: int) -> np.ndarray:
            at, to = at // side, to // side
            low, high = np.minimum(at, to), np.maximum(at, to)
            return np.maximum(sums[high] - sums[np.minimum(low + 1, high)], 0)  # of the bands strictly between

        by_bands = np.maximum(bands(r, target[0], self.rows, self.sides[0]), bands(c, target[1], self.cols, self.sides[1]))
        return np.maximum(by_bands, np.hypot(r - target[0], c - target[1]) * self.least) * self.weight


class Tiled:
    """Searches on a raster in tiles; a task holds one tile at a time.

    ``search`` leaves the least costs at the borders in ``state`` (start, tr, tc, frame), and every hand-over in
    ``told`` (start, tr, tc, round, nodes, costs). In each round the tiles that were told better costs search on
    from these, and tell their neighbours what improved within reach.
    """

    def __init__(
        self,
        cells: DataFrame,
        height: int,
        width: int,
        wanted: list[Step],
        side: int = TILE,
        ignore_max: bool = True,
        many: bool = False,
    ) -> None:
        self.spark, self.height, self.width, self.wanted, self.ignore_max = cells.sparkSession, height, width, wanted, ignore_max
        ship(self.spark)
        self.halo = max((max(abs(r), abs(c)) for r, c in wanted), default=1)
        if side < 2 * self.halo:
            raise ValueError("a tile must be at least twice as wide as a step")
        if many:
            side = min(side, OVERLAY_TILES[0 if self.halo == 1 else 1])
        #: Rows and columns of a tile, and of its window, which has halos too.
        self.sides = tile_sides(height, width, side, self.halo)
        self.span = self.sides[0] + 2 * self.halo, self.sides[1] + 2 * self.halo
        held = tiles(cells, height, width, self.halo, self.sides)
        if many:
            held = overlay.with_costs(held, self.span, self.halo, wanted, ignore_max)
        self.many = many
        self.tiles = store(held, "tiles")
        #: How many searches of a tile the rounds took.
        self.searched = 0

    def _tile_of(self, node: str) -> list[Column]:
        return [
            F.floor(F.floor(F.col(node) / self.width) / self.sides[0]).cast("int").alias("tr"),
            F.floor(F.pmod(F.col(node), F.lit(self.width)) / self.sides[1]).cast("int").alias("tc"),
        ]

    def _learn(self, goal: Goal) -> None:
        """Least values of rows and columns of tiles, halos included: a few numbers for each row and column of tiles."""
        ignore = self.ignore_max

        def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for tr, tc, data in zip(pdf["tr"], pdf["tc"], pdf["values"], strict=True):
                    values = np.frombuffer(data, np.int32)
                    values = values[(values >= 0) & ((values != FORBIDDEN) if ignore else True)]
                    if len(values):
                        yield pd.DataFrame({"kind": ["r", "c"], "n": [tr, tc], "least": [int(values.min())] * 2})

        found = self.tiles.select("tr", "tc", "values").mapInPandas(least, "kind string, n int, least int").groupBy("kind", "n").agg(F.min("least").alias("least"))
        bands = [tuple(r) for r in found.collect()]
        goal.learn(bands, self.sides, float(min((v for *_, v in bands), default=0)))

    def search(self, starts: DataFrame, ends: DataFrame | None = None, goal: Goal | None = None) -> Tiled:
        """Find least costs from each of ``starts`` (start); with ``ends`` (start, end) only as far as these need."""
        if goal is not None and goal.own is None:
            self._learn(goal)
        news = starts.select("start", *self._tile_of("start"), F.lit(0).alias("round"), F.array("start").alias("nodes"), F.array(F.lit(0.0)).alias("costs"))
        news = store(news, "told")
        batches = max(1, -(-news.count() // BATCH))
        state = news.select("start", "tr", "tc", F.lit(-1).alias("round"), F.lit(None).cast("binary").alias("frame")).limit(0)
        best = _few_targets(ends) if ends is not None else {}
        parts, told, number, left = [state], [news], 0, True
        out = "start long, tr int, tc int, frame binary, nodes array<long>, costs array<double>, end long, reached double"
        while left:
            keys = news.select("start", "tr", "tc")
            known = reduce(DataFrame.unionByName, parts).join(keys, ["start", "tr", "tc"], "left_semi")
            both = known.unionByName(news.drop("round"), allowMissingColumns=True)
            improve = _improver(self.wanted, self.ignore_max, self.sides, self.halo, self.height, self.width, goal, self.many, best)
            got = self._by_tile(both, batches, "start", "round", "frame", "nodes", "costs").mapInPandas(improve, out)
            seen = Observation()  # counted as the round is written
            got = store(got.observe(seen, *[F.count(c).alias(c) for c in ("nodes", "frame", "end")]), "round")
            number += 1
            left = seen.get["nodes"]
            self.searched += seen.get["frame"]
            for start, end, cost in got.where("end is not null").select("start", "end", "reached").collect() if seen.get["end"] else ():  # of the few targets only
                best[start][end] = min(best[start][end], cost)
            parts.append(got.where("frame is not null").select("start", "tr", "tc", F.lit(number).alias("round"), "frame"))
            news = got.where("nodes is not null").select("start", "tr", "tc", F.lit(number).alias("round"), "nodes", "costs")
            told.append(news)
            if len(parts) > MERGE:
                parts = [store(self._latest(parts), "state")]
        self.state = self._latest(parts).drop("round")
        self.told = reduce(DataFrame.unionByName, told)
        return self

    def _by_tile(self, rows: DataFrame, batches: int, *columns: str) -> DataFrame:
        """A row for each tile and batch of starts: their ``columns`` as ``asks``, with the tile."""
        batch = F.pmod(F.xxhash64("start"), F.lit(batches)).alias("batch")
        asked = rows.groupBy("tr", "tc", batch).agg(F.collect_list(F.struct(*columns)).alias("asks"))
        # Merged by shuffles: packed tiles are small as files, and a broadcast would pass the whole raster through the driver in each round.
        return asked.join(self.tiles.hint("merge"), ["tr", "tc"])

    def _latest(self, parts: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, parts)
        return every.groupBy("start", "tr", "tc").agg(F.max_by("frame", "round").alias("frame"), F.max("round").alias("round"))

    def distances(self, starts: DataFrame) -> DataFrame:
        """(start, node, dist) for every node that a start reaches; each tile is searched once more from its border."""
        self.search(starts)
        (rows, cols), halo, span, width, wanted, ignore = self.sides, self.halo, self.span, self.width, self.wanted, self.ignore_max
        first = starts.select("start", *self._tile_of("start"), F.lit(True).alias("own"))
        frame = overlay.frame(span, halo)

        def unfold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    window, top, left = Window(np.frombuffer(row.values, np.int32).reshape(span), wanted, ignore), row.tr * rows - halo, row.tc * cols - halo
                    for ask in row.asks:
                        start, border = ask["start"], np.frombuffer(ask["frame"], np.float64)
                        seeds = {n: d for n, d in zip(frame.tolist(), border.tolist(), strict=True) if math.isfinite(d)}
                        if ask["own"]:
                            seeds[(start // width - top) * span[1] + start % width - left] = 0.0
                        search = Search(window, seeds)
                        while search.step():
                            pass
                        dist = search.dist.reshape(span)[halo : halo + rows, halo : halo + cols]
                        r, c = np.nonzero(np.isfinite(dist))
                        yield pd.DataFrame({"start": start, "node": (r + row.tr * rows) * width + c + row.tc * cols, "dist": dist[r, c]})

        held = self.state.join(first, ["start", "tr", "tc"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
        held = self._by_tile(held, max(1, -(-starts.count() // BATCH)), "start", "frame", "own")
        return held.mapInPandas(unfold, "start long, node long, dist double")

    def paths(self, requests: DataFrame) -> DataFrame:
        """(ord, start, end, cost, node_ids) for requests (ord, start, end): ends are walked back tile by tile.

        A walk leaves a tile at a border cell whose cost a neighbour told in some round; there it goes on with what that neighbour had been
        told before, so rounds fall from tile to tile and every walk ends, steps without cost included.
        """
        walk = _walker(self.wanted, self.ignore_max, self.sides, self.halo, self.width)
        told = self.told.groupBy("start", "tr", "tc").agg(F.collect_list(F.struct("round", "nodes", "costs")).alias("told"))
        told = store(told, "told")
        now = requests.select("ord", "start", F.col("end").alias("node"), F.lit(0).alias("part"), F.lit(2**31 - 1).alias("before"))
        parts: list[DataFrame] = []
        batches = max(1, -(-requests.count() // BATCH))
        while not now.isEmpty():
            at = now.select("*", *self._tile_of("node")).groupBy("start", "tr", "tc").agg(F.collect_list(F.struct("ord", "node", "part", "before")).alias("walks"))
            at = self._by_tile(at.join(told, ["start", "tr", "tc"]), batches, "start", "walks", "told")
            got = store(at.mapInPandas(walk, "ord long, start long, part int, nodes array<long>, cost double, next long, before int"), "walked")
            parts.append(got)
            now = got.where("next is not null").select("ord", "start", F.col("next").alias("node"), (F.col("part") + 1).alias("part"), "before")
        if not parts:
            return requests.select("ord", "start", "end", F.lit(math.inf).alias("cost"), _none().alias("node_ids"))
        every = reduce(DataFrame.unionByName, parts).groupBy("ord").agg(
            F.array_sort(F.collect_list(F.struct("part", "nodes"))).alias("parts"),
            F.min_by("cost", "part").alias("cost"),
        )
        nodes = F.reverse(F.flatten(F.col("parts.nodes")))
        out = requests.join(every, "ord", "left")
        return out.select("ord", "start", "end", F.coalesce("cost", F.lit(math.inf)).alias("cost"), F.coalesce(nodes, _none()).alias("node_ids"))


def _improver(wanted: list[Step], ignore_max: bool, sides: tuple[int, int], halo: int, height: int, width: int, goal: Goal | None, many: bool, best_of: dict):
    rows, cols = sides
    span = rows + 2 * halo, cols + 2 * halo
    across, size = span[1], span[0] * span[1]
    frame = overlay.frame(span, halo)
    ring = overlay.ring(span, halo)
    in_frame = np.searchsorted(frame, ring)

    def useful(r, c, costs, ends, best) -> np.ndarray:
        """Border cells from which a target may still be reached at less than its best cost."""
        if ends is None:
            return np.ones(len(r), bool)
        limit = best * (1 + 1e-12)
        if goal is None or not np.isfinite(best).any():
            return costs <= limit.max()
        keep = np.zeros(len(r), bool)
        for end, most in zip(ends.tolist(), limit.tolist(), strict=True):
            keep |= costs + goal.ahead(r, c, divmod(end, width)) <= most
        return keep

    def improve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles with what is new for them -> borders that changed, what neighbours should know, costs of targets inside."""
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                window = Window(np.frombuffer(row.values, np.int32).reshape(span), wanted, ignore_max)
                between = overlay.read(row.costs_between) if many else None
                asks: dict[int, list] = {}
                for ask in row.asks:
                    asks.setdefault(ask["start"], []).append(ask)
                for start, told in asks.items():
                    out += one(int(row.tr), int(row.tc), window, between, start, told)
            yield pd.DataFrame(out, columns=["start", "tr", "tc", "frame", "nodes", "costs", "end", "reached"])

    def one(tr: int, tc: int, window: Window, between, start: int, asks: list) -> list[tuple]:
        out = []
        top, left = tr * rows - halo, tc * cols - halo
        last = max((a for a in asks if a["frame"] is not None), key=lambda a: a["round"], default=None)
        old = np.full(len(frame), np.inf) if last is None else np.frombuffer(last["frame"], np.float64)
        fresh = [a for a in asks if a["nodes"] is not None]
        r, c = np.divmod(np.concatenate([a["nodes"] for a in fresh]), width)
        place, costs = (r - top) * across + c - left, np.concatenate([a["costs"] for a in fresh])
        ends, best = (np.array([*x]) for x in (best_of[start].keys(), best_of[start].values())) if start in best_of else (None, None)
        keep = useful(r, c, costs, ends, best)
        told = np.full(size, np.inf)
        np.minimum.at(told, place[keep], costs[keep])
        known = np.full(size, np.inf)
        known[frame] = old
        new = np.flatnonzero((told < known) & window.open.ravel())
        if not len(new):
            return out
        places = np.empty(0, np.int64)  # of targets in this tile
        if ends is not None:
            er, ec = ends // width - top, ends % width - left
            here = (er >= halo) & (er < halo + rows) & (ec >= halo) & (ec < halo + cols)
            places = er[here] * across + ec[here]
        # A start may lie anywhere in its tile, and a target too.
        if between is not None and not len(places) and not (told[new] == 0).any():
            found = overlay.spread(between, span, halo, known, told, new)
        else:
            search = Search(window, {})
            search.dist, search.pending = known, new
            search.dist[new] = told[new]
            while search.step():
                if ends is not None:
                    best[here] = np.minimum(best[here], search.dist[places])
                    if search.settled > best.max() * (1 + 1e-12):
                        break  # what is left can't bring a target nearer
            found = search.dist
            if ends is not None:
                gets = found[places]
                out += [(start, tr, tc, None, None, None, end, cost) for end, cost in zip(ends[here].tolist(), gets.tolist(), strict=True) if math.isfinite(cost)]
                best[here] = np.minimum(best[here], gets)
        out.append((start, tr, tc, found[frame].tobytes(), None, None, None, None))
        better = ring[found[ring] < old[in_frame]]
        r, c = np.divmod(better, across)
        r, c, costs = r + top, c + left, found[better]
        keep = useful(r, c, costs, ends, best)
        r, c, costs = r[keep], c[keep], costs[keep]
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                ar, ac = tr + dr, tc + dc
                near = (r >= ar * rows - halo) & (r < (ar + 1) * rows + halo) & (c >= ac * cols - halo) & (c < (ac + 1) * cols + halo)
                if (dr or dc) and ar >= 0 and ac >= 0 and ar * rows < height and ac * cols < width and near.any():
                    out.append((start, ar, ac, None, r[near] * width + c[near], costs[near], None, None))
        return out

    return improve


def _walker(wanted: list[Step], ignore_max: bool, sides: tuple[int, int], halo: int, width: int):
    span = sides[0] + 2 * halo, sides[1] + 2 * halo
    across = span[1]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Nodes beside their tiles -> the nodes back to a border cell that a neighbour told of (``next``), or to the start."""
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                window = Window(np.frombuffer(row.values, np.int32).reshape(span), wanted, ignore_max)
                for ask in row.asks:
                    out += one(int(row.tr) * sides[0] - halo, int(row.tc) * sides[1] - halo, window, ask)
            yield pd.DataFrame(out, columns=["ord", "start", "part", "nodes", "cost", "next", "before"]).astype({"next": "Int64"})

    def one(top: int, left: int, window: Window, ask) -> list[tuple]:
        out, before = [], None
        told = sorted(ask["told"], key=lambda t: t["round"])
        at = lambda w: (w["node"] // width - top) * across + w["node"] % width - left
        for w in sorted(ask["walks"], key=lambda w: (w["before"], w["ord"])):
            if before != w["before"]:
                before, seeds = w["before"], {}
                for t in told:
                    if t["round"] < before:
                        for node, cost in zip(t["nodes"].tolist(), t["costs"].tolist(), strict=True):
                            place = (node // width - top) * across + node % width - left
                            if place not in seeds or cost < seeds[place][0]:
                                seeds[place] = cost, t["round"]
                search = Search(window, {p: cost for p, (cost, _) in seeds.items()}, parents=True)
                ends = [at(x) for x in ask["walks"] if x["before"] == before]
                while search.settled <= search.dist[ends].max() and search.step():
                    pass
            place = at(w)
            cost = float(search.dist[place])
            if not math.isfinite(cost):
                continue
            chain = search.chain(place)
            r, c = np.divmod(np.array(chain), across)
            nodes = ((r + top) * width + c + left).tolist()
            earlier = seeds[chain[-1]][1]
            last = earlier == 0  # only the start itself is told in round 0
            out.append((w["ord"], ask["start"], w["part"], nodes if last else nodes[:-1], cost, None if last else nodes[-1], earlier))
        return out

    return walk


def tiled_routes(
    cells: DataFrame,
    height: int,
    width: int,
    requests: DataFrame,
    wanted: list[Step],
    side: int = TILE,
    ignore_max: bool = True,
    goal: Goal | None = None,
    many: bool = False,
) -> DataFrame:
    """(ord, start, end, cost, node_ids) for requests (ord, start, end)."""
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < height * width)
    valid = requests.where(inside("start") & inside("end"))
    held = Tiled(cells, height, width, wanted, side, ignore_max, many)
    held.search(valid.select("start").distinct(), valid.select("start", "end").distinct(), goal)
    got = held.paths(valid).select("ord", "cost", "node_ids")
    out = requests.join(got, "ord", "left")
    return out.select("ord", "start", "end", F.coalesce("cost", F.lit(math.inf)).alias("cost"), F.coalesce("node_ids", _none()).alias("node_ids"))


def reached(found: DataFrame) -> DataFrame:
    return found.where(F.col("cost") < math.inf)
