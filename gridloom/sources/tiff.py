"""GeoTIFF rasters, read by strips or tiles and written by tiles, in parallel.

The reader plans its tasks from the header alone: a task gets the byte ranges of some strips or tiles, and filters on band, row
and column leave out those that they rule out. The writer's tasks encode tiles into part files; the commit writes the
header and joins the parts by their offsets, as BigTIFF where 4 GB do not suffice. Pixels never pass the driver.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from gridloom.functions.grid import RasterMeta
from gridloom.session import place, ship
from gridloom.sources.detect import Raster

NAME = "gridloom_tiff"
#: Cells that a task decodes, cells of a batch, and the side of a tile as written (a multiple of 16).
TASK_CELLS, BATCH_CELLS, TILE = 1 << 22, 1 << 18, 256
#: Bytes from which on offsets need 64 bits.
CLASSIC_BYTES = (1 << 32) - (1 << 20)
# TIFF field types (format, bytes) and sample formats.
_TYPES = {
    1: ("B", 1),
    2: ("c", 1),
    3: ("H", 2),
    4: ("I", 4),
    5: ("2I", 8),
    12: ("d", 8),
    16: ("Q", 8),
    11: ("f", 4),
    6: ("b", 1),
    8: ("h", 2),
    9: ("i", 4),
}
_KINDS = {1: "u", 2: "i", 3: "f"}
#: Reads n bytes at an offset.
Read = Callable[[int, int], bytes]


def _fields(read: Read) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of a file's first image; of other bytes only the tags' values are read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    big = magic == 43
    offset, number, entry, room = ("Q", "Q", 20, 8) if big else ("I", "H", 12, 4)
    (at,) = struct.unpack_from(order + offset, head, 8 if big else 4)
    size = struct.calcsize(number)
    (count,) = struct.unpack_from(order + number, read(at, size), 0)
    table = read(at + size, entry * count)
    out = {}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HH" + offset, table, entry * i)
        form, width = _TYPES.get(kind, ("B", 1))
        place = entry * i + entry - room
        data = table[place : place + room]
        if n * width > room:
            data = read(struct.unpack(order + offset, data)[0], n * width)
        out[tag] = (bytes(data[:n]),) if kind == 2 else struct.unpack_from(order + form[-1] * (n * (2 if kind == 5 else 1)), data, 0)
    return order, out


@dataclass
class Block:
    """A strip or tile: its band (the first, if it holds all), place, cells to a row, rows, and bytes."""

    band: int
    row: int
    col: int
    rows: int
    cols: int
    start: int
    size: int


@dataclass
class Layout:
    """What the header tells."""

    meta: RasterMeta
    dtype: str
    bands: int
    deep: int
    packing: int
    predictor: int
    blocks: list[Block]

    def kept(self, bounds: dict[str, tuple[float, float]]) -> list[Block]:
        """Blocks with cells inside bounds of band, row and column, ends included."""
        meets = lambda name, first, n: bounds.get(name, (-np.inf, np.inf))[0] <= first + n - 1 and first <= bounds.get(name, (-np.inf, np.inf))[1]
        return [b for b in self.blocks if meets("row", b.row, b.rows) and meets("col", b.col, b.cols) and meets("band", b.band, self.deep)]


def layout(read: Read) -> Layout:
    order, tags = _fields(read)
    width, height = tags[256][0], tags[257][0]
    bands = tags.get(277, (1,))[0]
    dtype = np.dtype(order + _KINDS[tags.get(339, (1,))[0]] + str(tags.get(258, (8,))[0] // 8))
    packing, planar, predictor = tags.get(259, (1,))[0], tags.get(284, (1,))[0], tags.get(317, (1,))[0]
    if packing not in (1, 5, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"TIFF compression {packing} with predictor {predictor} is not supported")
    tiled = 322 in tags
    if tiled:
        tw, th, starts, sizes = tags[322][0], tags[323][0], tags[324], tags[325]
    else:
        tw, th, starts, sizes = width, min(tags.get(278, (height,))[0], height), tags[273], tags[279]
    across, down = -(-width // tw), -(-height // th)
    blocks = []
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        plane, rest = divmod(i, across * down)
        r = rest // across * th
        blocks.append(Block(plane, r, rest % across * tw, th if tiled else min(th, height - r), tw, start, size))
    if 34264 in tags:
        m = tags[34264]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    else:
        sx, sy = tags.get(33550, (1.0, 1.0, 0.0))[:2]
        i, j, _, x, y, _ = tags.get(33922, (0.0,) * 6)[:6]
        a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    keys = tags.get(34735, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    srid = codes.get(3072, codes.get(2048))
    meta = RasterMeta(height, width, a, b, c, d, e, f, srid, dtype.newbyteorder("=").name)
    return Layout(meta, dtype.str, bands, bands if planar == 1 else 1, packing, predictor, blocks)


def unpack_lzw(data: bytes) -> bytes:
    """LZW as in TIFF: codes of 9 to 12 bits, highest bit first, each width left one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        if last is not None:
            table.append(last + (table[code] if code < len(table) else last)[:1])
        last = table[code]
        out += last
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def unpacked(of: Layout, block: Block, raw: bytes) -> np.ndarray:
    """[band, row, column] of a block, without the padding at the raster's ends."""
    raw = unpack_lzw(raw) if of.packing == 5 else zlib.decompress(raw) if of.packing != 1 else raw
    values = np.frombuffer(raw, of.dtype, block.rows * block.cols * of.deep).reshape(block.rows, block.cols, of.deep)
    if of.predictor == 2:
        values = np.cumsum(values, axis=1, dtype=of.dtype)
    values = values[: of.meta.height - block.row, : of.meta.width - block.col].transpose(2, 0, 1)
    return values.astype(np.dtype(of.dtype).newbyteorder("="))


def decode(data: bytes) -> tuple[np.ndarray, RasterMeta]:
    """(bands, rows, columns) and the metadata of a TIFF file."""
    of = layout(lambda at, n: data[at : at + n])
    out = np.zeros((of.bands, of.meta.height, of.meta.width), of.meta.dtype)
    for b in of.blocks:
        part = unpacked(of, b, bytes(data[b.start : b.start + b.size]))
        out[b.band : b.band + of.deep, b.row : b.row + part.shape[1], b.col : b.col + part.shape[2]] = part
    return out, of.meta


def _directory(meta: RasterMeta, bands: int, more: list[tuple[int, str, list]], at: int, big: bool) -> bytes:
    """The directory of an image with deflated blocks, for the place ``at``, with the values it points to behind it."""
    kind = {"u": 1, "i": 2, "f": 3}[np.dtype(meta.dtype).kind]
    geo = [1, 1, 0, 1, 1024, 0, 1, 2 if meta.srid == 4326 else 1]
    if meta.srid:
        geo += [2048 if meta.srid == 4326 else 3072, 0, 1, meta.srid]
        geo[3] = 2
    entries = [
        (256, "I", [meta.width]),
        (257, "I", [meta.height]),
        (258, "H", [np.dtype(meta.dtype).itemsize * 8] * bands),
        (259, "H", [8]),
        (262, "H", [1]),
        (277, "H", [bands]),
        (284, "H", [2 if bands > 1 else 1]),
        (339, "H", [kind] * bands),
        (34264, "d", [meta.a, meta.b, 0, meta.c, meta.d, meta.e, 0, meta.f, 0, 0, 0, 0, 0, 0, 0, 1]),
        (34735, "H", geo),
        *more,
    ]
    entries.sort()
    codes = {"H": 3, "I": 4, "d": 12, "Q": 16}
    offset, number, room = ("Q", "Q", 8) if big else ("I", "H", 4)
    table, extra = b"", b""
    base = at + struct.calcsize(number) + (20 if big else 12) * len(entries) + struct.calcsize(offset)
    for tag, form, vals in entries:
        raw = struct.pack(f"<{len(vals)}{form}", *vals)
        table += struct.pack("<HH" + offset, tag, codes[form], len(vals))
        table += raw.ljust(room, b"\0") if len(raw) <= room else struct.pack("<" + offset, base + len(extra))
        if len(raw) > room:
            extra += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<" + number, len(entries)) + table + struct.pack("<" + offset, 0) + extra


def _head(at: int, big: bool) -> bytes:
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)


def encode(bands: np.ndarray, meta: RasterMeta) -> bytes:
    """A deflated TIFF of strips, planar if it has several bands."""
    values = bands[None] if bands.ndim == 2 else bands
    n, height, width = values.shape
    rows = max(1, (1 << 20) // max(1, width * values.itemsize))
    strips = [zlib.compress(np.ascontiguousarray(band[r : r + rows]).astype(values.dtype.newbyteorder("<")).tobytes()) for band in values for r in range(0, height, rows)]
    starts, at = [], 8
    for s in strips:
        starts.append(at)
        at += len(s) + len(s) % 2
    more = [(273, "I", starts), (278, "I", [rows]), (279, "I", [len(s) for s in strips])]
    own = RasterMeta(**asdict(meta) | {"height": height, "width": width, "dtype": values.dtype.name})
    return _head(at, False) + b"".join(s + b"\0" * (len(s) % 2) for s in strips) + _directory(own, n, more, at, False)


def _opened(path: str):
    system, name = place(path)
    return system.open_input_file(name)


class TiffPart(InputPartition):
    """What a task reads: blocks of a layout, and of these the cells within bounds."""

    def __init__(self, of: Layout, blocks: list[Block], bounds: dict[str, tuple[float, float]]) -> None:
        super().__init__(None)
        self.of, self.blocks, self.bounds = of, blocks, bounds

    def cut(self, name: str, first: int, n: int) -> slice:
        low, high = self.bounds.get(name, (first, first + n - 1))
        return slice(*(int(np.clip(v - first, 0, n)) for v in (low, high + 1)))


class TiffReader(DataSourceReader):
    """Cells of a file; ``bounds``: for band, row and column the least and largest value that filters leave."""

    def __init__(self, path: str, schema) -> None:
        self.path, self.bounds = path, {}
        self.value = pa.float64() if schema["value"].dataType.typeName() == "double" else pa.int64() if schema["value"].dataType.typeName() == "long" else pa.int32()

    def pushFilters(self, filters: list[Filter]) -> list[Filter]:
        """Notes bounds; all filters stay with Spark, which drops single cells."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[-1]
            if name not in ("band", "row", "col") or not isinstance(getattr(f, "value", None), int):
                continue
            low, high = self.bounds.get(name, (-np.inf, np.inf))
            if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                low = max(low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                high = min(high, f.value - isinstance(f, LessThan))
            self.bounds[name] = low, high
        return filters

    def partitions(self) -> list[TiffPart]:
        with _opened(self.path) as file:
            of = layout(lambda at, n: file.read_at(n, at))
        blocks, of.blocks = of.kept(self.bounds), []
        parts, held = [], 0
        for b in sorted(blocks, key=lambda b: b.start):
            if not parts or held + b.rows * b.cols * of.deep > TASK_CELLS:
                parts.append([])
                held = 0
            parts[-1].append(b)
            held += b.rows * b.cols * of.deep
        return [TiffPart(of, p, self.bounds) for p in parts or [[]]]

    def read(self, partition: TiffPart) -> Iterator[pa.RecordBatch]:
        names = ["band", "row", "col", "value"]
        if not partition.blocks:
            return
        with _opened(self.path) as file:
            for b in partition.blocks:
                found = unpacked(partition.of, b, file.read_at(b.size, b.start))
                rows, cols = partition.cut("row", b.row, found.shape[1]), partition.cut("col", b.col, found.shape[2])
                for band, plane in enumerate(found[:, rows, cols], b.band):
                    step = max(1, BATCH_CELLS // max(1, plane.shape[1]))
                    for at in range(0, plane.shape[0], step):
                        part = plane[at : at + step]
                        r, c = (x.ravel().astype(np.int32) for x in np.indices(part.shape))
                        columns = [np.full(part.size, band, np.int32), r + np.int32(b.row + rows.start + at), c + np.int32(b.col + cols.start)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(part.ravel()).cast(self.value)], names)


@dataclass
class Written(WriterCommitMessage):
    """A part file, and the place (band, tile row, tile column) and bytes of each tile in it, in order."""

    name: str
    tiles: list[tuple[int, int, int, int]]


class TiffWriter(DataSourceWriter):
    """Encoded tiles (band, tr, tc, data) to one file."""

    def __init__(self, options: dict) -> None:
        self.path, self.bands, self.tile = options["path"], int(options["bands"]), int(options["tile"])
        self.meta = json.loads(options["meta"])
        self.limit = int(options.get("classicbytes", CLASSIC_BYTES))
        self.parts = f"{self.path}.{uuid.uuid4().hex}.parts"

    def write(self, rows: Iterator) -> Written:
        system, folder = place(self.parts)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{uuid.uuid4().hex}"  # a name for each attempt: what failed ones leave goes with the folder
        tiles = []
        with system.open_output_stream(name) as file:
            for row in rows:
                file.write(row["data"])
                tiles.append((row["band"], row["tr"], row["tc"], len(row["data"])))
        return Written(name, tiles)

    def commit(self, messages: list[Written | None]) -> None:
        meta, parts = RasterMeta(**self.meta), [m for m in messages if m is not None]
        across, down = -(-meta.width // self.tile), -(-meta.height // self.tile)
        bare = encoded_tile(np.full((self.tile, self.tile), -1), meta.dtype)
        total = len(bare) + sum(t[3] for m in parts for t in m.tiles) + 16 * self.bands * across * down
        big = total > self.limit
        at = 16 if big else 8
        starts, sizes = np.full(self.bands * across * down, at), np.full(self.bands * across * down, len(bare))  # tiles without a cell share one
        at += len(bare)
        for m in parts:
            for band, tr, tc, size in m.tiles:
                starts[(band * down + tr) * across + tc], sizes[(band * down + tr) * across + tc] = at, size
                at += size
        even = at % 2
        form = "Q" if big else "I"
        more = [(322, "I", [self.tile]), (323, "I", [self.tile]), (324, form, starts.tolist()), (325, form, sizes.tolist())]
        system, name = place(self.path)
        with system.open_output_stream(name) as file:
            file.write(_head(at + even, big) + bare)
            for m in parts:
                with system.open_input_stream(m.name) as part:
                    while data := part.read(1 << 23):
                        file.write(data)
            file.write(b"\0" * even + _directory(meta, self.bands, more, at + even, big))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = place(self.parts)
        if system.get_file_info(folder).type.name == "Directory":
            system.delete_dir(folder)


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"band int, row int, col int, value {self.options['value']}"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(dict(self.options))


def read_raster(spark: SparkSession, path: str) -> Raster:
    """Cells (band, row, col, value) of a file; the driver reads its header only.

    Files that only Spark's own readers can open are decoded whole, each in one task.
    """
    ship(spark)
    try:
        file = _opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return _whole(spark, path)
    with file:
        of = layout(lambda at, n: file.read_at(n, at))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    return Raster(spark.read.format(NAME).option("value", _value_type(of.meta.dtype)).load(path), of.meta, of.bands)


def _value_type(dtype: str) -> str:
    found = np.dtype(dtype)
    return "double" if found.kind == "f" else "int" if np.can_cast(found, np.int32) else "long"


def _whole(spark: SparkSession, path: str) -> Raster:
    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.select(F.substring("content", 1, 1)).first()
    if head is None:
        raise FileNotFoundError(path)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                data = content.as_buffer()
                of = layout(lambda at, n: data[at : at + n].to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(asdict(of.meta) | {"bands": of.bands})])], ["head"])

    found = json.loads(files.mapInArrow(told, "head string").first()[0])
    bands = found.pop("bands")
    meta = RasterMeta(**found)
    kind = _value_type(meta.dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                for b, band in enumerate(decode(content.as_py())[0]):
                    step = max(1, BATCH_CELLS // max(1, band.shape[1]))
                    for at in range(0, band.shape[0], step):
                        part = band[at : at + step]
                        r, c = (x.ravel().astype(np.int32) for x in np.indices(part.shape))
                        value = pa.array(part.ravel()).cast({"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}[kind])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, b, np.int32)), pa.array(r + np.int32(at)), pa.array(c), value], ["band", "row", "col", "value"])

    return Raster(files.mapInArrow(run, f"band int, row int, col int, value {kind}"), meta, bands)


def encoded_tile(values: np.ndarray, dtype: str) -> bytes:
    kept = values.astype(np.float64 if np.dtype(dtype).kind == "f" else np.int64).astype(np.dtype(dtype).newbyteorder("<"))
    return zlib.compress(np.ascontiguousarray(kept).tobytes())


def write_raster(cells: DataFrame, meta: RasterMeta, path: str, tile: int = TILE, classic_bytes: int | None = None) -> None:
    """One deflated TIFF file of tiles, planar if there are several bands; cells that are missing are -1 in the raster's type.

    Tasks encode tiles; the driver copies their bytes into one file as they are. Files of more than ``classic_bytes`` are BigTIFF.
    """
    spark = cells.sparkSession
    ship(spark)
    bands = sorted(r[0] for r in cells.select("band").distinct().collect()) if "band" in cells.columns else [0]
    number = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band")) - 1 if "band" in cells.columns and bands else F.lit(0)
    inside = cells.where(F.col("row").between(0, meta.height - 1) & F.col("col").between(0, meta.width - 1))
    place = [number.cast("int").alias("band"), *(F.floor(F.col(c) / tile).cast("int").alias(name) for c, name in (("row", "tr"), ("col", "tc"))), "row", "col", "value"]
    dtype = meta.dtype

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.full((tile, tile), -1, np.float64 if np.dtype(dtype).kind == "f" else np.int64)
        values[pdf["row"] - key[1] * tile, pdf["col"] - key[2] * tile] = pdf["value"]
        return pd.DataFrame({"band": [key[0]], "tr": [key[1]], "tc": [key[2]], "data": [encoded_tile(values, dtype)]})

    packed = inside.select(*place).groupBy("band", "tr", "tc").applyInPandas(pack, "band int, tr int, tc int, data binary")
    spark.dataSource.register(TiffSource)
    options = {"path": path, "bands": max(1, len(bands)), "tile": tile, "meta": json.dumps(asdict(meta)), "value": "int"}
    if classic_bytes is not None:
        options["classicbytes"] = classic_bytes
    packed.write.format(NAME).mode("append").options(**options).save()
