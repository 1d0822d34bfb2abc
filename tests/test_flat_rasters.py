"""Rasters of fixed-width records: flat binary files and elevation models, written here and read by tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import flat
from gridloom.sources.detect import load


def flat_file(folder, values: np.ndarray, layout: str, order: str, pad: int = 0, skip: int = 0, ending: str = ".bil") -> str:
    """[band, row, column] as a file with padded rows and its header."""
    bands, height, width = values.shape
    kind = values.dtype.newbyteorder(">" if order == "M" else "<")
    lines = {"BIL": values.transpose(1, 0, 2), "BIP": values.transpose(1, 2, 0), "BSQ": values}[layout].astype(kind)
    if layout == "BIP":
        rows = [r.tobytes() + b"\7" * pad for r in lines]
        sizes = (width * kind.itemsize, width * bands * kind.itemsize + pad)
    else:
        rows = [r.tobytes() + b"\7" * pad for group in lines for r in group]
        sizes = (width * kind.itemsize + pad, (width * kind.itemsize + pad) * (bands if layout == "BIL" else 1))
    path = folder / f"heights{ending}"
    path.write_bytes(b"\1" * skip + b"".join(rows))
    pixel = {"u": "UNSIGNEDINT", "i": "SIGNEDINT", "f": "FLOAT"}[kind.kind]
    told = {"nrows": height, "NCOLS": width, "NBANDS": bands, "NBITS": kind.itemsize * 8, "PIXELTYPE": pixel, "BYTEORDER": order, "LAYOUT": layout}
    told |= {"SKIPBYTES": skip, "BANDROWBYTES": sizes[0], "TOTALROWBYTES": sizes[1], "ULXMAP": 100.5, "ULYMAP": 199.0, "XDIM": 1, "YDIM": 2}
    (folder / "heights.hdr").write_text("".join(f"{k:<14} {v}\r\n" for k, v in told.items()))
    return str(path)


@pytest.mark.parametrize(
    ("layout", "kind", "order", "pad", "skip"),
    [("BIL", "uint8", "I", 3, 0), ("BIL", "int16", "M", 0, 10), ("BIP", "uint16", "I", 4, 7), ("BSQ", "float32", "M", 0, 5), ("BSQ", "int32", "I", 4, 0), ("BIP", "float64", "M", 0, 0)],
)
def test_flat_layouts(spark, tmp_path, monkeypatch, layout, kind, order, pad, skip):
    monkeypatch.setattr(flat, "TASK_CELLS", 40)
    rng = np.random.default_rng(2)
    values = rng.integers(0, 100, (3, 11, 7)).astype(kind) - (50 if np.dtype(kind).kind != "u" else 0)
    found = load(spark, flat_file(tmp_path, values.astype(kind), layout, order, pad, skip))
    assert found.bands == 3 and (found.meta.height, found.meta.width, found.meta.dtype) == (11, 7, kind)
    assert found.meta.corner(0, 0) == (100.0, 200.0) and found.meta.corner(11, 7) == (107.0, 178.0)
    assert {(r.band, r.row, r.col): r.value for r in found.cells.collect()} == {k: v for k, v in np.ndenumerate(values)}
    window = found.cells.where((F.col("band") == 1) & (F.col("row") >= 8) & F.col("col").between(2, 4))
    assert {(r.band, r.row, r.col): r.value for r in window.collect()} == {(1, r, c): values[1, r, c] for r in range(8, 11) for c in range(2, 5)}


def test_flat_parts_meet_filters(tmp_path, monkeypatch):
    """Only rows and bands that bounds leave are planned."""
    monkeypatch.setattr(flat, "TASK_CELLS", 14)
    path = flat_file(tmp_path, np.zeros((2, 10, 7), "uint8"), "BSQ", "I")

    class Schema(dict):
        dataType = type("T", (), {"typeName": staticmethod(lambda: "int")})

    reader = flat.FlatReader(path, {"value": Schema})
    reader.bounds = {"band": (1, 1), "row": (3, 5)}
    assert [(p.band, p.row, p.rows) for part in reader.partitions() for p in part.parts] == [(1, 2, 2), (1, 4, 2)]
    reader.bounds = {"row": (20, 30)}
    assert [part.parts for part in reader.partitions()] == [[]]


def test_flat_faults(spark, tmp_path):
    path = flat_file(tmp_path, np.arange(12, dtype="uint8").reshape(1, 3, 4), "BIL", "I")
    (tmp_path / "heights.bil").write_bytes(bytes(8))
    with pytest.raises(Exception, match="ends before row 3"):
        load(spark, path).cells.collect()
    (tmp_path / "alone.bil").write_bytes(bytes(8))
    with pytest.raises(FileNotFoundError, match="header"):
        load(spark, str(tmp_path / "alone.bil"))
    with pytest.raises(ValueError, match="NROWS"):
        flat.flat_layout("NCOLS 5")
    with pytest.raises(ValueError, match="1 bits"):
        flat.flat_layout("NCOLS 5\nNROWS 5\nNBITS 1")
    (tmp_path / "heights.prj").write_text('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","25832"]]')
    flat_file(tmp_path, np.zeros((1, 3, 4), "uint8"), "BSQ", "I", ending=".bsq")
    assert load(spark, str(tmp_path / "heights.bsq")).meta.srid == 25832


def elevation_file(path, columns: dict[int, tuple[int, list[int]]], base: float = 0.0, step: float = 1.0) -> str:
    """Profiles by column: the lowest row from the south, and heights northwards; cells of 30 m from (500000, 4000000)."""
    real = lambda v, n: f"{v:>{n}.{n - 9}E}".replace("E", "D")
    head = bytearray(b" " * 1024)

    def put(at: int, text: str) -> None:
        head[at : at + len(text)] = text.encode()

    put(156, f"{1:6d}{32:6d}")
    put(528, f"{2:6d}{2:6d}")
    put(816, f"{30.0:12.6E}{30.0:12.6E}{step:12.6E}")
    put(852, f"{1:6d}{len(columns):6d}")
    data = bytes(head)
    for k, (col, (low, values)) in enumerate(sorted(columns.items()), 1):
        x, y = 500000 + 30 * col, 4000000 + 30 * low
        text = f"{1:6d}{k:6d}{len(values):6d}{1:6d}{real(x, 24)}{real(y, 24)}{real(base, 24)}{real(min(values), 24)}{real(max(values), 24)}"
        text += "".join(f"{v:6d}" for v in values[:146])
        data += text.ljust(1024).encode()
        for at in range(146, len(values), 170):
            data += "".join(f"{v:6d}" for v in values[at : at + 170]).ljust(1024).encode()
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize(("base", "step"), [(0.0, 1.0), (7.0, 1.0), (0.5, 0.25)])
def test_elevation_models(spark, tmp_path, base, step):
    """Profiles of unequal length and start, one of them over three blocks."""
    rng = np.random.default_rng(4)
    columns = {0: (3, rng.integers(-99, 4000, 5).tolist()), 1: (0, rng.integers(0, 4000, 400).tolist()), 2: (398, [5]), 3: (1, rng.integers(0, 9, 146).tolist())}
    found = load(spark, elevation_file(tmp_path / "a.dem", columns, base, step))
    assert (found.meta.height, found.meta.width, found.meta.srid) == (400, 4, 32632)
    assert found.meta.centre(399, 0) == (500000.0, 4000000.0) and found.meta.dtype == ("float64" if step < 1 else "int32")
    want = {(399 - low - i, col): v * step + base for col, (low, values) in columns.items() for i, v in enumerate(values)}
    assert {(r.row, r.col): r.value for r in found.cells.collect()} == want
    part = found.cells.where((F.col("col") == 1) & F.col("row").between(200, 260))
    assert {(r.row, r.col): r.value for r in part.collect()} == {k: v for k, v in want.items() if k[1] == 1 and 200 <= k[0] <= 260}
