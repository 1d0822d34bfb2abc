"""Rasters whose records have a fixed width: flat binary with a text header (BIL, BIP, BSQ) and USGS elevation models (DEM).

The driver reads the header, and of an elevation model the short head of each profile, which tells where the next begins. Tasks get byte
ranges of rows or profiles; filters on band, row and column leave out those they rule out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, InputPartition

from gridloom.functions.grid import RasterMeta
from gridloom.session import place, ship
from gridloom.sources.detect import Raster
from gridloom.sources.tiff import BATCH_CELLS, NAME, TASK_CELLS, Read, TiffReader, _opened, _value_type

FLAT_NAME = NAME.replace("tiff", "flat")
ENDINGS = (".bil", ".bip", ".bsq", ".dem")
# Fixed values of the USGS format: bytes of a block and of a profile's head, and elevations in a first and in a further block.
BLOCK, HEAD, FIRST, FURTHER = 1024, 144, 146, 170
#: Metres of a unit of length by its code, and arc seconds in degrees.
FEET, SECOND = 0.3048, 1 / 3600


@dataclass
class Rows:
    """Rows of all bands that follow each other in a file, or of one band: their place and bytes."""

    band: int
    row: int
    rows: int
    start: int
    size: int


@dataclass
class Flat:
    """What a text header tells. ``deep``: bands in a row's bytes; ``line``, ``apart``, ``cell``: bytes from a row, a band in it and a cell of a band to the next."""

    meta: RasterMeta
    dtype: str
    bands: int
    deep: int
    line: int
    apart: int
    cell: int
    skip: int
    gap: int

    def parts(self) -> Iterator[Rows]:
        rows = max(1, TASK_CELLS // max(1, self.meta.width * self.deep))
        for band in range(0, self.bands, self.deep):
            for row in range(0, self.meta.height, rows):
                many = min(rows, self.meta.height - row)
                start = self.skip + band * (self.meta.height * self.line + self.gap) + row * self.line
                # The last row may end without its padding.
                used = (self.meta.width - 1) * self.cell + np.dtype(self.dtype).itemsize
                yield Rows(band, row, many, start, (many - 1) * self.line + (self.deep - 1) * self.apart + used)

    def planes(self, part: Rows, raw: bytes) -> np.ndarray:
        """[band, row, column] of a part."""
        if len(raw) < part.size:
            raise ValueError(f"the file ends before row {part.row + part.rows}")
        kind = np.dtype(self.dtype)
        found = np.ndarray((self.deep, part.rows, self.meta.width), kind, raw, strides=(self.apart, self.line, self.cell))
        return found.astype(kind.newbyteorder("="))


def flat_layout(text: str, srid: int | None = None) -> Flat:
    """A header of lines of a keyword and a value, in any case; what is not told has the format's defaults."""
    told = {k.upper(): v for k, v in re.findall(r"^[ \t]*(\w+)[ \t]+(\S+)", text, re.M)}
    number = lambda key, default: int(told.get(key, default))
    real = lambda key, default: float(told.get(key, default))
    if "NROWS" not in told or "NCOLS" not in told:
        raise ValueError("the header tells no NROWS or NCOLS")
    height, width, bands, bits = number("NROWS", 0), number("NCOLS", 0), number("NBANDS", 1), number("NBITS", 8)
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"{bits} bits a cell are not supported")
    pixel, way = told.get("PIXELTYPE", "UNSIGNEDINT").upper(), told.get("LAYOUT", "BIL").upper()
    if way not in ("BIL", "BIP", "BSQ"):
        raise ValueError(f"unknown layout {way}")
    order = ">" if told.get("BYTEORDER", "I").upper()[:1] == "M" else "<"
    kind = np.dtype(order + ("f" if pixel.startswith("F") else "i" if pixel.startswith("S") else "u") + str(bits // 8))
    size, deep = kind.itemsize, 1 if way == "BSQ" else bands
    band_row = number("BANDROWBYTES", width * size)
    line = number("TOTALROWBYTES", {"BIL": band_row * bands, "BIP": width * size * bands, "BSQ": band_row}[way])
    step_x, step_y = real("XDIM", 1), real("YDIM", 1)
    x, y = real("ULXMAP", 0), real("ULYMAP", height - 1)  # of the first cell's centre
    meta = RasterMeta(height, width, step_x, 0.0, x - step_x / 2, 0.0, -step_y, y + step_y / 2, srid, kind.newbyteorder("=").name)
    return Flat(meta, kind.str, bands, deep, line, size if way == "BIP" else band_row, size * (bands if way == "BIP" else 1), number("SKIPBYTES", 0), number("BANDGAPBYTES", 0) if way == "BSQ" else 0)


@dataclass
class Profile:
    """A column of an elevation model: heights from south to north, the last in row ``top``."""

    col: int
    top: int
    rows: int
    start: int
    size: int
    base: float


@dataclass
class Model:
    meta: RasterMeta
    step: float
    profiles: list[Profile]


def _reals(data: bytes, width: int) -> list[float]:
    """Numbers of ``width`` bytes each, exponents written with D or E."""
    return [float(data[i : i + width].decode("ascii").replace("D", "E").replace("d", "e").strip() or 0) for i in range(0, len(data), width)]


def _whole(data: bytes, width: int = 6) -> list[int]:
    return [int(data[i : i + width].strip() or 0) for i in range(0, len(data), width)]


def dem_layout(read: Read) -> Model:
    """The header, and each profile's head: how many heights, where they begin, what they are above."""
    head = read(0, BLOCK)
    system, zone = _whole(head[156:168])
    (ground,) = _whole(head[528:534])
    step_x, step_y, step_z = _reals(head[816:852], 12)
    (count,) = _whole(head[858:864])
    scale = SECOND if ground == 3 else FEET if ground == 1 else 1.0
    found, at = [], BLOCK
    for col in range(count):
        own = read(at, HEAD)
        many, (x, y, base) = _whole(own[12:18])[0], _reals(own[24:96], 24)
        blocks = 1 + max(0, -(-(many - FIRST) // FURTHER))
        found.append((col, many, x * scale, y * scale, base, at, blocks * BLOCK))
        at += blocks * BLOCK
    if not found:
        raise ValueError("an elevation model without profiles")
    step_x, step_y = step_x * scale, step_y * scale
    left, top = found[0][2], max(y + (many - 1) * step_y for _, many, _, y, *_ in found)
    row_of = lambda y: round((top - y) / step_y)
    profiles = [Profile(round((x - left) / step_x), row_of(y + (many - 1) * step_y), many, start, size, base) for _, many, x, y, base, start, size in found]
    whole = step_z == round(step_z) and all(p.base == round(p.base) for p in profiles)
    srid = 4326 if system == 0 and ground == 3 else 32600 + zone if system == 1 and zone > 0 and ground == 2 else None
    height, width = max(p.top + p.rows for p in profiles), max(p.col for p in profiles) + 1
    return Model(RasterMeta(height, width, step_x, 0.0, left - step_x / 2, 0.0, -step_y, top + step_y / 2, srid, "int32" if whole else "float64"), step_z, profiles)


def heights(of: Model, profile: Profile, raw: bytes) -> np.ndarray:
    """A profile's heights from north to south."""
    data = raw[HEAD : HEAD + 6 * FIRST] + b"".join(raw[at : at + 6 * FURTHER] for at in range(BLOCK, len(raw), BLOCK))
    found = np.array(_whole(data[: 6 * profile.rows]), float)[::-1] * of.step + profile.base
    return found.astype(of.meta.dtype)


class FlatPart(InputPartition):
    def __init__(self, of: Flat | Model, parts: list) -> None:
        super().__init__(None)
        self.of, self.parts = of, parts


class FlatReader(TiffReader):
    """Cells of a file, with the same bounds from filters as for TIFF."""

    def _meets(self, name: str, first: int, n: int) -> bool:
        low, high = self.bounds.get(name, (-np.inf, np.inf))
        return low <= first + n - 1 and first <= high

    def partitions(self) -> list[FlatPart]:
        of = _layout(self.path)
        if isinstance(of, Flat):
            parts = [[p] for p in of.parts() if self._meets("row", p.row, p.rows) and self._meets("band", p.band, of.deep)]
            return [FlatPart(of, p) for p in parts or [[]]]
        kept, of.profiles = [p for p in of.profiles if self._meets("col", p.col, 1) and self._meets("row", p.top, p.rows)], []
        many = max(1, TASK_CELLS // max(1, of.meta.height))
        return [FlatPart(of, kept[i : i + many]) for i in range(0, max(1, len(kept)), many)]

    def _cut(self, name: str, first: int, n: int) -> slice:
        low, high = self.bounds.get(name, (first, first + n - 1))
        return slice(*(int(np.clip(v - first, 0, n)) for v in (low, high + 1)))

    def _batch(self, band: int, row: int, col: int, values: np.ndarray) -> pa.RecordBatch:
        r, c = (x.ravel().astype(np.int32) for x in np.indices(values.shape))
        columns = [np.full(values.size, band, np.int32), r + np.int32(row), c + np.int32(col)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(values.ravel()).cast(self.value)], ["band", "row", "col", "value"])

    def read(self, partition: FlatPart) -> Iterator[pa.RecordBatch]:
        of = partition.of
        if not partition.parts:
            return
        with _opened(self.path) as file:
            for p in partition.parts:
                if isinstance(of, Model):
                    values = heights(of, p, file.read_at(p.size, p.start))[:, None]
                    rows = self._cut("row", p.top, p.rows)
                    yield self._batch(0, p.top + rows.start, p.col, values[rows])
                    continue
                rows, cols = self._cut("row", p.row, p.rows), self._cut("col", 0, of.meta.width)
                for band, plane in enumerate(of.planes(p, file.read_at(p.size, p.start)), p.band):
                    plane = plane[rows, cols]
                    step = max(1, BATCH_CELLS // max(1, plane.shape[1]))
                    for at in range(0, plane.shape[0], step):
                        yield self._batch(band, p.row + rows.start + at, cols.start, plane[at : at + step])


class FlatSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FLAT_NAME

    def schema(self) -> str:
        return f"band int, row int, col int, value {self.options['value']}"

    def reader(self, schema) -> FlatReader:
        return FlatReader(self.options["path"], schema)


def _beside(path: str, ending: str) -> str | None:
    """A small text file beside another, None if there is none."""
    system, name = place(path)
    stem = name.rpartition(".")[0]
    for other in (stem + ending, stem + ending.upper()):
        if system.get_file_info(other).is_file:
            with system.open_input_file(other) as file:
                return file.read().decode("latin-1")
    return None


def _layout(path: str) -> Flat | Model:
    if path.lower().endswith(".dem"):
        with _opened(path) as file:
            return dem_layout(lambda at, n: file.read_at(n, at))
    text = _beside(path, ".hdr")
    if text is None:
        raise FileNotFoundError(f"{path} has no header (.hdr) beside it")
    if not re.search(r"^[ \t]*LAYOUT\b", text, re.M | re.I):
        text += f"\nLAYOUT {path.rpartition('.')[2]}"
    codes = re.findall(r'AUTHORITY\["EPSG",\s*"(\d+)"\]', _beside(path, ".prj") or "")
    return flat_layout(text, int(codes[-1]) if codes else None)


def read_flat(spark: SparkSession, path: str) -> Raster:
    """Cells (band, row, col, value) of a file; the driver reads headers only. Where an elevation model has no height there is no cell."""
    ship(spark)
    of = _layout(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FlatSource)
    return Raster(spark.read.format(FLAT_NAME).option("value", _value_type(of.meta.dtype)).load(path), of.meta, of.bands if isinstance(of, Flat) else 1)
