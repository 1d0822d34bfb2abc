"""Raster metadata, and the arithmetic between cells, node ids and coordinates."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A forbidden cell: the largest value of uint16.
FORBIDDEN = 65535


@dataclass(frozen=True)
class RasterMeta:
    """Shape, affine transform (x = a*col + b*row + c, y = d*col + e*row + f) and spatial reference."""

    height: int
    width: int
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0
    srid: int | None = None
    dtype: str = "uint16"

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """minx, miny, maxx, maxy."""
        xs = [self.c, self.c + self.a * self.width]
        ys = [self.f, self.f + self.e * self.height]
        return min(xs), min(ys), max(xs), max(ys)

    def window(self, row_off: int, col_off: int, height: int, width: int) -> RasterMeta:
        """The part of the raster that starts there; its own rows and columns begin at 0."""
        x, y = self.corner(row_off, col_off)
        return replace(self, height=height, width=width, c=x, f=y)

    def corner(self, row: float, col: float) -> tuple[float, float]:
        """The upper left corner of a cell."""
        return self.c + self.a * col + self.b * row, self.f + self.d * col + self.e * row

    def centre(self, row: float, col: float) -> tuple[float, float]:
        return self.corner(row + 0.5, col + 0.5)

    def index(self, x: float, y: float) -> tuple[int, int]:
        """(row, col) of the cell with this point; not checked against the bounds."""
        det = self.a * self.e - self.b * self.d
        dx, dy = x - self.c, y - self.f
        return math.floor((self.a * dy - self.d * dx) / det), math.floor((self.e * dx - self.b * dy) / det)

    def inside(self, row: int, col: int) -> bool:
        return 0 <= row < self.height and 0 <= col < self.width

    def node(self, x: float, y: float) -> int:
        row, col = self.index(x, y)
        if not self.inside(row, col):
            raise ValueError(f"({x}, {y}) lies outside the raster")
        return row * self.width + col


def node_id(row: Column, col: Column, width: int) -> Column:
    return row.cast("long") * F.lit(width) + col.cast("long")


def node_row(node: Column, width: int) -> Column:
    return F.floor(node / F.lit(width)).cast("int")


def node_col(node: Column, width: int) -> Column:
    return F.pmod(node, F.lit(width)).cast("int")


def row_of(x: Column, y: Column, m: RasterMeta) -> Column:
    det = m.a * m.e - m.b * m.d
    return F.floor((F.lit(m.a) * (y - m.f) - F.lit(m.d) * (x - m.c)) / det).cast("int")


def col_of(x: Column, y: Column, m: RasterMeta) -> Column:
    det = m.a * m.e - m.b * m.d
    return F.floor((F.lit(m.e) * (x - m.c) - F.lit(m.b) * (y - m.f)) / det).cast("int")


def x_of(row: Column, col: Column, m: RasterMeta, centre: bool = False) -> Column:
    """The x of a cell's upper left corner, or of its centre."""
    s = 0.5 if centre else 0.0
    return F.lit(m.c) + F.lit(m.a) * (col + s) + F.lit(m.b) * (row + s)


def y_of(row: Column, col: Column, m: RasterMeta, centre: bool = False) -> Column:
    s = 0.5 if centre else 0.0
    return F.lit(m.f) + F.lit(m.d) * (col + s) + F.lit(m.e) * (row + s)


def segment_length(dr: Column, dc: Column) -> Column:
    """Length in cells; a step that stays counts as 1."""
    return F.when((dr == 0) & (dc == 0), F.lit(1.0)).otherwise(F.sqrt((dr * dr + dc * dc).cast("double")))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of coordinates."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def line_cells(r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """Cells (row, col) of the digital line between two cells, along its longer axis.

    The shorter axis is rounded half up towards the end of the ascending direction, so the
    line is the same from either end.
    """
    dr, dc = r1 - r0, c1 - c0
    steep = F.abs(dr) > F.abs(dc)
    u0, u1 = F.when(steep, r0).otherwise(c0), F.when(steep, r1).otherwise(c1)
    v0, v1 = F.when(steep, c0).otherwise(r0), F.when(steep, c1).otherwise(r1)
    swap = u0 > u1
    first, last = F.when(swap, u1).otherwise(u0), F.when(swap, u0).otherwise(u1)
    low, high = F.when(swap, v1).otherwise(v0), F.when(swap, v0).otherwise(v1)
    span, rise = last - first, F.abs(high - low)
    sign = F.when(high >= low, F.lit(1)).otherwise(F.lit(-1))

    def cell(u: Column) -> Column:
        steps = F.when(span == 0, F.lit(0)).otherwise(F.floor((2 * rise * (u - first) + span) / F.greatest(2 * span, F.lit(1))))
        v = (low + sign * steps).cast("int")
        return F.struct(F.when(steep, u).otherwise(v).cast("int").alias("row"), F.when(steep, v).otherwise(u).cast("int").alias("col"))

    return F.transform(F.sequence(first, last), cell)
