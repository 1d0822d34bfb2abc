"""Rasters as tiles of packed cells, painted by scan lines.

A tile is a row (tr, tc, values) with its cells as 32-bit numbers, so a cell takes 4 bytes and no row of its own. Features are cut to
the tiles they touch, each with only those of its sides that matter there; what travels is features, and tiles where an overlay
needs their old values. A task streams the features of a tile past it, in painting order, so neither many features on one tile
nor many tiles fill its memory. Masks and windows need no exchange at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions.grid import FORBIDDEN, RasterMeta
from gridloom.operators.costs import CostTable, apply_costs
from gridloom.session import ship

#: The side of a tile, and the value of cells that are not there.
SIDE, MISSING = 256, -1
_SIDES = "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"
_TILES = "tr int, tc int, values binary"


@dataclass(frozen=True)
class Step:
    """One overlay: ``put`` a feature's own value, ``set`` one value, or ``multiply`` by it; cells that hold ``ignore`` stay."""

    features: DataFrame
    how: str
    value: float = 0.0
    ignore: int | None = None
    wrap: bool = False
    #: Columns of features: the value to put, and the order of painting (features of one number count as one).
    own: Column | None = None
    order: Column | None = None


def axis(meta: RasterMeta, kind: str, first: int, n: int) -> np.ndarray:
    """Centres of rows or columns, worked out as for single cells."""
    at = np.arange(first, first + n) + 0.5
    return meta.c + meta.a * at + meta.b * 0.5 if kind == "x" else meta.f + meta.d * 0.5 + meta.e * at


def filled(sides: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """[row, column]: cells whose centre is inside sides (ax, ay, bx, by), by the even-odd rule.

    Each side crosses some rows; on each it turns over all cells to the left of the crossing. Crossings are counted
    by their column first, and added up from the right.
    """
    turned = np.zeros((len(ys), len(xs) + 1), np.int32)
    rising = xs if len(xs) < 2 or xs[0] < xs[-1] else xs[::-1]
    for at in range(0, len(sides), 4096):
        ax, ay, bx, by = sides[at : at + 4096].T
        side, row = np.nonzero((ay[:, None] > ys) != (by[:, None] > ys))
        x = (bx[side] - ax[side]) * (ys[row] - ay[side]) / (by[side] - ay[side]) + ax[side]
        np.add.at(turned, (row, np.searchsorted(rising, x, "left")), 1)
    inside = (turned[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] % 2).astype(bool)
    return inside if rising is xs else inside[:, ::-1]


def near(hull: Sequence[G.Point], buffer: float, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """[row, column]: cells whose centre is within ``buffer`` of a point, a segment or a convex polygon."""
    x, y = np.meshgrid(xs, ys)
    if len(hull) == 1:
        return np.hypot(x - hull[0][0], y - hull[0][1]) <= buffer
    least = np.full(x.shape, np.inf)
    pairs = list(zip(hull, [*hull[1:], hull[0]], strict=True)) if len(hull) > 2 else [tuple(hull)]
    for (ax, ay), (bx, by) in pairs:
        dx, dy = bx - ax, by - ay
        length = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / length, 0.0, 1.0) if length else 0.0
        least = np.minimum(least, np.hypot(x - (ax + t * dx), y - (ay + t * dy)))
    inside = filled(np.array([(*a, *b) for a, b in pairs], float), xs, ys) if len(hull) > 2 else False
    return (least <= buffer) | inside


@dataclass(frozen=True)
class Blocks:
    """A raster, or a window of it that starts at (row0, col0) of the tiles' own grid; ``meta`` is that of the window."""

    df: DataFrame
    meta: RasterMeta
    side: int = SIDE
    row0: int = 0
    col0: int = 0

    @staticmethod
    def even(spark: SparkSession, meta: RasterMeta, value: int = FORBIDDEN, side: int = SIDE) -> Blocks:
        """A raster of one value: tile numbers, whose cells are made where they are needed."""
        across, down = -(-meta.width // side), -(-meta.height // side)
        n = F.col("id")
        tiles = spark.range(across * down).select(F.floor(n / across).cast("int").alias("tr"), (n % across).cast("int").alias("tc"), F.lit(None).cast("binary").alias("values"))
        return Blocks(tiles, meta, side).painted([], value)

    @staticmethod
    def of_cells(cells: DataFrame, meta: RasterMeta, side: int = SIDE) -> Blocks:
        """A table of cells (row, col, value), packed; the last step in which cells travel as rows."""
        ship(cells.sparkSession)
        inside = cells.where(F.col("row").between(0, meta.height - 1) & F.col("col").between(0, meta.width - 1))
        place = (F.col("row") % side) * side + F.col("col") % side
        rows = inside.select(F.floor(F.col("row") / side).cast("int").alias("tr"), F.floor(F.col("col") / side).cast("int").alias("tc"), place.cast("int").alias("place"), "value")

        def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            values = np.full(side * side, MISSING, np.int32)
            values[pdf["place"]] = pdf["value"]
            return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "values": [values.tobytes()]})

        return Blocks(rows.groupBy("tr", "tc").applyInPandas(pack, _TILES), meta, side)

    def _grid(self) -> RasterMeta:
        """The metadata of the tiles' own grid."""
        x, y = self.meta.corner(-self.row0, -self.col0)
        return replace(self.meta, height=self.meta.height + self.row0, width=self.meta.width + self.col0, c=x, f=y)

    def cells(self) -> DataFrame:
        """(row, col, value), row and col from the window's corner; each tile unfolds where it lies."""
        side, row0, col0, height, width = self.side, self.row0, self.col0, self.meta.height, self.meta.width

        def unfold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tr, tc, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    values = np.frombuffer(data, np.int32).reshape(side, side)
                    r, c = np.nonzero(values != MISSING)
                    rows, cols = r + (tr * side - row0), c + (tc * side - col0)
                    own = (rows >= 0) & (rows < height) & (cols >= 0) & (cols < width)
                    columns = [rows[own].astype(np.int32), cols[own].astype(np.int32), values[r[own], c[own]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in columns], ["row", "col", "value"])

        ship(self.df.sparkSession)
        return self.df.mapInArrow(unfold, "row int, col int, value int")

    def crop(self, row0: int, row1: int, col0: int, col1: int) -> Blocks:
        """The window of half-open ranges; tiles outside are left out, and no cell moves."""
        top, left = self.row0 + row0, self.col0 + col0
        meet = lambda c, low, n: F.col(c).between(low // self.side, (low + n - 1) // self.side)
        kept = self.df.where(meet("tr", top, row1 - row0) & meet("tc", left, col1 - col0))
        return replace(self, df=kept, meta=self.meta.window(row0, col0, row1 - row0, col1 - col0), row0=top, col0=left)

    def masked(self, hull: Sequence[G.Point], buffer: float, outside: int = FORBIDDEN) -> Blocks:
        """Cells whose centre is not within ``buffer`` of the hull become ``outside``."""
        side, grid = self.side, self._grid()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for tr, tc, data in zip(pdf["tr"], pdf["tc"], pdf["values"], strict=True):
                    values = np.frombuffer(data, np.int32).reshape(side, side)
                    far = ~near(hull, buffer, axis(grid, "x", tc * side, side), axis(grid, "y", tr * side, side))
                    out.append(np.where(far & (values != MISSING), np.int32(outside), values).tobytes())
                yield pdf.assign(values=out)

        return replace(self, df=self.df.mapInPandas(run, _TILES))

    def _cut(self, step: Step, number: int) -> DataFrame:
        """A feature's sides for each tile it touches: those that cross the tile's rows and don't lie wholly before its first column."""
        grid, side = self._grid(), self.side
        own = F.lit(None).cast("double") if step.own is None else step.own.cast("double")
        order = F.lit(0).cast("long") if step.order is None else step.order.cast("long")
        box = step.features.where(F.size("polygon") > 0).select(own.alias("value"), order.alias("ord"), G.sides_of(F.col("polygon")).alias("sides"), G.bbox(F.col("polygon")).alias("b"))
        numbers = lambda ends, zero, scale: [(F.col(e) - F.lit(zero)) / F.lit(scale) for e in ends]
        rows, cols = numbers(("b.miny", "b.maxy"), grid.f, grid.e), numbers(("b.minx", "b.maxx"), grid.c, grid.a)
        low = lambda p: F.floor(F.greatest(F.lit(0.0), F.least(*p) - 1) / side)
        high = lambda p, n: F.floor(F.least(F.lit(float(n - 1)), F.greatest(*p) + 1) / side)
        box = box.select("value", "ord", "sides", low(rows).alias("r0"), high(rows, grid.height).alias("r1"), low(cols).alias("c0"), high(cols, grid.width).alias("c1"))
        box = box.where("r0 <= r1 and c0 <= c1")
        tiles = box.withColumn("tr", F.explode(F.sequence("r0", "r1"))).withColumn("tc", F.explode(F.sequence("c0", "c1")))
        edge = lambda at, zero, scale: F.lit(zero) + F.lit(scale) * at
        y0, y1 = edge(F.col("tr") * side, grid.f, grid.e), edge((F.col("tr") + 1) * side, grid.f, grid.e)
        x0 = F.least(edge(F.col("tc") * side, grid.c, grid.a), edge((F.col("tc") + 1) * side, grid.c, grid.a))
        matters = lambda s: (
            (F.greatest(s["a"]["y"], s["b"]["y"]) >= F.least(y0, y1)) & (F.least(s["a"]["y"], s["b"]["y"]) <= F.greatest(y0, y1)) & (F.greatest(s["a"]["x"], s["b"]["x"]) >= x0)
        )
        found = tiles.select(F.col("tr").cast("int").alias("tr"), F.col("tc").cast("int").alias("tc"), F.lit(number).alias("step"), "ord", "value", F.filter("sides", matters).alias("sides"))
        return found.where(F.size("sides") > 0).withColumn("values", F.lit(None).cast("binary"))

    def painted(self, steps: Sequence[Step], fill: int = FORBIDDEN) -> Blocks:
        """All overlays in order, in one pass; tiles without values start with ``fill``."""
        ship(self.df.sparkSession)
        tiles = self.df.select("tr", "tc", F.lit(-1).alias("step"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("double").alias("value"), F.lit(None).cast(_SIDES).alias("sides"), "values")
        run = _painter(self._grid(), self.side, [(s.how, s.value, s.ignore, s.wrap) for s in steps], fill)
        if not steps:
            return replace(self, df=tiles.mapInArrow(run, _TILES))
        rows = reduce(DataFrame.unionByName, [self._cut(s, i) for i, s in enumerate(steps)], tiles)
        ordered = rows.repartition("tr", "tc").sortWithinPartitions("tr", "tc", "step", "ord")
        return replace(self, df=ordered.mapInArrow(run, _TILES))


def _painter(grid: RasterMeta, side: int, steps: list[tuple], fill: int):
    def apply(values: np.ndarray, inside: np.ndarray, step: int, own: float | None) -> None:
        how, value, ignore, wrap = steps[step]
        hit = inside & (values != MISSING)
        if ignore is not None:
            hit &= values != ignore
        if how == "multiply":
            new = np.floor(values[hit] * float(value))
            new = np.mod(new, 65536) if wrap else np.minimum(new, FORBIDDEN)
        else:
            new = own if how == "put" else int(value) % 65536 if wrap else min(int(value), FORBIDDEN)
        values[hit] = new

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = group = values = inside = None

        def tile() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.int32()), pa.array([place[1]], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["tr", "tc", "values"])

        for batch in batches:
            tr, tc, step, order, own = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            flat = lists.flatten()
            corners = np.stack([flat.field(end).field(v).to_numpy(zero_copy_only=False) for end in range(2) for v in range(2)], axis=1) if len(flat) else np.empty((0, 4))
            ends = np.cumsum([n or 0 for n in lists.value_lengths().to_pylist()])
            for i in range(batch.num_rows):
                here = (tr[i], tc[i])
                if here != place or (step[i], order[i]) != group:
                    if group is not None and group[0] >= 0 and values is not None:
                        apply(values, inside, group[0], painted_as)
                    if here != place:
                        if values is not None:
                            yield tile()
                        place, values = here, None
                        xs, ys = axis(grid, "x", here[1] * side, side), axis(grid, "y", here[0] * side, side)
                    group, painted_as, inside = (step[i], order[i]), own[i], np.zeros((side, side), bool)
                if step[i] < 0:
                    data = batch.column(6)[i].as_py()
                    if data is not None:
                        values = np.frombuffer(data, np.int32).reshape(side, side).copy()
                    else:
                        values = np.full((side, side), fill, np.int32)
                        values[max(0, grid.height - here[0] * side) :] = MISSING
                        values[:, max(0, grid.width - here[1] * side) :] = MISSING
                elif values is not None:  # tiles that are not there are not painted
                    inside |= filled(corners[(ends[i - 1] if i else 0) : ends[i]], xs, ys)
        if place is not None and values is not None:
            if group[0] >= 0:
                apply(values, inside, group[0], painted_as)
            yield tile()

    return run


def paintable(meta: RasterMeta) -> bool:
    """Whether rows and columns follow the axes, as scan lines need."""
    return meta.b == 0 and meta.d == 0


def rasterized(features: DataFrame, meta: RasterMeta, fill: int = FORBIDDEN, side: int = SIDE) -> Blocks:
    """The highest cost of the features over each cell, else ``fill``: values are painted from the lowest on."""
    value = F.bround(F.coalesce(F.col("cost"), F.lit(float(fill))), 0).cast("int")
    across, down = -(-meta.width // side), -(-meta.height // side)
    spark, n = features.sparkSession, F.col("id")
    tiles = spark.range(across * down).select(F.floor(n / across).cast("int").alias("tr"), (n % across).cast("int").alias("tc"), F.lit(None).cast("binary").alias("values"))
    return Blocks(tiles, meta, side).painted([Step(features, "put", own=value, order=value)], fill)


def steps_of(features: DataFrame, ordinal: str = "feature_id", costs: CostTable | None = None, ignore: int | None = FORBIDDEN, **how) -> list[Step]:
    """The steps of one overlay, from the arguments of ``raster.overlay``, ``overlay_costs`` or ``overlay_zones``."""
    zone, forbidden = how.pop("zone_col", None), how.pop("forbidden_zone", None)
    last = how.pop("forbidden_value", FORBIDDEN)
    if "value" not in how:
        priced = (apply_costs(features, costs) if costs else features).where("cost is not null and not isnan(cost) and cost <> 0")
        order = priced.groupBy("cost").agg(F.min(ordinal).cast("long").alias("_ord"))
        return [Step(priced.join(order, "cost"), "put", ignore=ignore, own=F.least(F.floor("cost"), F.lit(FORBIDDEN)), order=F.col("_ord"))]
    kind = "multiply" if how.get("multiply") else "set"
    one = lambda rows: Step(rows, kind, how["value"], ignore, how.get("wrap", False))
    if zone is None or forbidden is None:
        return [one(features)]
    name = F.col(f"`{zone}`")
    return [one(features.where(name != forbidden)), Step(features.where(name == forbidden), "set", last, ignore)]
