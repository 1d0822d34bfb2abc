import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import FileLoadError, FormatError, InvalidSourceError, SystemMismatchError
from gridloom.functions import geometry as G
from gridloom.functions.grid import FORBIDDEN, RasterMeta
from gridloom.operators import blocks
from gridloom.operators import costs as C
from gridloom.operators import metrics as M
from gridloom.operators import raster as R
from gridloom.sources import costs as files
from gridloom.sources import tiff, vectors, wfs
from gridloom.sources.detect import array_cells, clipped, kind_of, load, meets, meets_any
from gridloom.sources.tiff import decode, encode, read_raster, write_raster

# Rules of every kind: all three given, the last two open, the last open, and the middle one open.
TUPLES = {("surface", "use", "owner"): {
    ("gravel", "track", "state"): 11.0,
    ("gravel", "", ""): 12.5,
    ("asphalt", "highway", ""): 90.0,
    ("asphalt", "", "private"): 33.0,
    ("asphalt", "lane", ""): 21.0,
    ("asphalt", "parking", ""): 17.0,
}}
NESTED = {("surface", "use"): {
    "gravel": {"track": 11.0, "quarry": 70.0, "": 12.5},
    "asphalt": {"highway": 90.0, "lane": 21.0},
    "meadow": {"hay": 3.0, "grazing": 4.0, "fallow": 2.25},
}}


def test_simple_costs_overwrite(spark):
    rows = spark.createDataFrame([("forest", 9.0), ("sea", 9.0), (None, 9.0)], "landuse string, cost double")
    got = C.apply_costs(rows, C.CostTable.from_dict(spark, {"landuse": {"forest": 1.0, "": 7.0}}))
    assert {r.landuse: r.cost for r in got.collect()} == {"forest": 1.0, "sea": None, None: 7.0}


def test_tuple_costs_with_wildcards(spark):
    expected = {
        ("gravel", "track", "state"): 11.0,
        ("gravel", "track", "private"): 12.5,
        ("gravel", "", None): 12.5,
        ("asphalt", "", "private"): 33.0,  # empty as in the rule
        ("asphalt", "highway", ""): 90.0,
        ("asphalt", "highway", "state"): 17.0,  # the last open rule of a surface stands for all
        ("asphalt", "square", "private"): 17.0,
        ("rails", "track", "state"): None,
    }
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(expected)], "i int, surface string, use string, owner string")
    got = C.apply_costs(rows, C.CostTable.from_dict(spark, TUPLES)).orderBy("i")
    assert [r.cost for r in got.collect()] == list(expected.values())


def test_nested_costs(spark):
    expected = {
        ("gravel", "quarry"): 70.0,
        ("gravel", "track"): 11.0,
        ("gravel", "dump"): 12.5,
        ("gravel", None): 12.5,
        ("asphalt", "lane"): 21.0,
        ("asphalt", "square"): None,
        ("meadow", "fallow"): 2.25,
        ("rails", "track"): None,
    }
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(expected)], "i int, surface string, use string")
    got = C.apply_costs(rows, C.CostTable.from_dict(spark, NESTED)).orderBy("i")
    assert [r.cost for r in got.collect()] == list(expected.values())
    with pytest.raises(FormatError):
        C.apply_costs(rows, C.CostTable(C.CostTable.from_dict(spark, NESTED).table, "surface", ("use", "surface"), "nested"))
    with pytest.raises(InvalidSourceError):
        C.CostTable.from_dict(spark, {})


@pytest.mark.parametrize("ending", ["csv", "json"])
@pytest.mark.parametrize("costs", [{"surface": {"gravel": 12.0, "asphalt": 5.5}}, TUPLES])
def test_cost_files_round_trip(spark, tmp_path, ending, costs):
    table, path = C.CostTable.from_dict(spark, costs), str(tmp_path / f"c.{ending}")
    files.save(table, path)
    assert files.load(spark, path).to_dict() == table.to_dict()


def test_cost_file_variants(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    files.save_csv(C.CostTable.from_dict(spark, {"nutzung": {"Wälder": 1.5, "See": 2.25}}), path, decimal=",")
    assert files.load(spark, path).to_dict() == {"nutzung": {"Wälder": 1.5, "See": 2.25}}
    (tmp_path / "empty.json").write_text("{}")
    for bad in ("empty.json", "none.csv"):
        with pytest.raises(FileLoadError):
            files.load(spark, str(tmp_path / bad))
    with pytest.raises(InvalidSourceError):
        files.load(spark, 3)
    with pytest.raises(TypeError):
        files.save(files.load(spark, path), "x.txt")


def test_detect_features(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, ["forest", "water", "urban"][i % 3], ["a", "b"][i % 2], str(i)) for i in range(60)],
        "id int, landuse string, kind string, name string",
    )
    main, sides = C.detect_features(rows)
    assert main == "landuse" and sides == ["kind"]
    files.save_template(rows, str(tmp_path / "t.csv"))
    assert files.load(spark, str(tmp_path / "t.csv")).table.count() == 6
    one = C.column_statistics(spark.createDataFrame([(x,) for x in ["f", "w", "u", "f", "w"]], "landuse string")).first()
    assert one.n_distinct == 3 and one.null_ratio == 0 and one.count_entropy == pytest.approx(1.521928, abs=1e-6)
    assert not C.relation(rows.withColumn("none", F.lit(None).cast("string")), "landuse", "none")


def test_to_numbers(spark):
    rows = spark.createDataFrame([("1,5", "2.5", "x"), ("2", "3", "1")], "a string, b string, c string")
    assert [f.dataType.typeName() for f in C.to_numbers(rows).schema.fields] == ["double", "double", "string"]


def square(x, y, d):
    return [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + d, y), (x + d, y + d), (x, y + d))]]


FEATURES = f"feature_id long, polygon {G.POLYGON}, cost double"


def test_rasterize_takes_the_highest(spark):
    rows = spark.createDataFrame([(0, square(0, 0, 6), 2.5), (1, square(4, 4, 4), 9.0), (2, square(0, 8, 2), None)], FEATURES)
    m = RasterMeta(10, 10, 1.0, 0.0, 0.0, 0.0, -1.0, 10.0)
    got = np.full((10, 10), -1)
    for r in R.rasterize(rows, m).collect():
        got[r.row, r.col] = r.value
    assert got[9, 0] == 2 and got[5, 5] == 9 and got[0, 0] == FORBIDDEN and got[4, 0] == 2 and got[3, 0] == FORBIDDEN
    buffered = R.rasterize(rows.where("feature_id = 1"), m, buffer=1.5)
    assert buffered.where("value = 9").count() > 16


def test_overlays_keep_forbidden_cells(spark):
    m = RasterMeta(4, 4, 1.0, 0.0, 0.0, 0.0, -1.0, 4.0)
    base = array_cells(spark, np.array([[1, 2, 3, FORBIDDEN]] * 4), m).cells.select("row", "col", "value")
    every = spark.createDataFrame([(0, square(0, 0, 4), 5.0), (1, square(0, 0, 2), 7.0)], FEATURES)
    values = lambda df: [r.value for r in df.orderBy("row", "col").collect()]
    assert values(R.overlay(base, every, m, 1, multiply=True)) == values(base)
    assert values(R.overlay(base, every, m, 30000, multiply=True))[:4] == [30000, 60000, 65535, 65535]
    assert values(R.overlay(base, every, m, 30000, multiply=True, wrap=True))[2] == 90000 % 65536
    assert values(R.overlay_costs(base, every, m))[8:12] == [7, 7, 5, FORBIDDEN]


def test_shrink_and_window(spark):
    frame = np.full((10, 10), FORBIDDEN)
    frame[2:8, 2:8] = 1
    m = RasterMeta(10, 10, 10.0, 0.0, 500000.0, 0.0, -10.0, 5600000.0)
    small, moved = R.shrink(array_cells(spark, frame, m).cells.select("row", "col", "value"), m)
    assert small.count() == 36 and (moved.height, moved.width, moved.c, moved.f) == (6, 6, 500020.0, 5599980.0)
    assert R.search_window(m, [(500050.0, 5599950.0)], 20.0) == (3, 7, 3, 7)


def test_buffer_sees_obstacles(spark):
    grid = np.ones((20, 20), int)
    grid[5:15, 10:12] = FORBIDDEN
    m = RasterMeta(20, 20, 10.0, 0.0, 500000.0, 0.0, -10.0, 5600000.0)
    c = array_cells(spark, grid, m).cells.select("row", "col", "value")
    a, b = [(500015.0, 5599905.0)], [(500185.0, 5599905.0)]
    assert R.buffer_statistics(c, m, a[0], b[0]).first().obstacle_ratio > 0
    assert R.estimate_buffer(c, m, a, b) >= 200 == R.estimate_buffer(c, m, a, a)


def test_vector_files(spark, tmp_path):
    geo = tmp_path / "a.geojson"
    geo.write_text('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:25832"}},"features":[{"type":"Feature","properties":{"k":"x","n":3},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"type":"Feature","properties":{"k":null,"n":4},"geometry":{"type":"Polygon","coordinates":[[[5,5],[7,5],[7,7],[5,5]]]}}]}')
    v = load(spark, str(geo))
    assert v.srid == 25832 and v.features.count() == 2 and v.features.select(F.sum(G.area(F.col("polygon")))).first()[0] == 4.0
    assert load(spark, str(geo), bbox=(4, 4, 9, 9)).features.count() == 1
    kml = tmp_path / "a.kml"
    kml.write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>p</name><Point><coordinates>9,51,0</coordinates></Point></Placemark></Document></kml>')
    row = load(spark, str(kml)).features.first()
    assert row.name == "p" and row.polygon[0][0].x == 9.0
    assert kind_of("a.TIF") == "raster" and kind_of("b.gpkg") == "vector" and kind_of({"url": "u"}) == "wfs"
    with pytest.raises(FileNotFoundError):
        kind_of("no/such/file.xyz")
    with pytest.raises(ValueError):
        load(spark, np.ones((2, 2)))


def test_geopackage_and_shapefile(spark, tmp_path):
    import sqlite3
    import struct

    ring = struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 2, 0, 2, 2, 0, 0)
    path = str(tmp_path / "a.gpkg")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INT); CREATE TABLE t (fid INTEGER PRIMARY KEY, geom BLOB, use TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom', 'POLYGON', 25832)")
    db.execute("INSERT INTO t VALUES (1, ?, 'wood')", (b"GP\0\1" + struct.pack("<i", 25832) + ring,))
    db.commit()
    db.close()
    v = load(spark, path)
    assert v.srid == 25832 and v.features.first().use == "wood" and v.features.select(G.area(F.col("polygon"))).first()[0] == 2.0
    body = struct.pack("<I4d", 5, 0, 0, 2, 2) + struct.pack("<2I", 1, 4) + struct.pack("<I", 0) + struct.pack("<8d", 0, 0, 2, 0, 2, 2, 0, 0)
    (tmp_path / "b.shp").write_bytes(b"\0" * 100 + struct.pack(">2I", 1, len(body) // 2) + body)
    field = b"use".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4]) + b"\0" * 15
    (tmp_path / "b.dbf").write_bytes(struct.pack("<BBBBIHH", 3, 0, 0, 0, 1, 65, 5) + b"\0" * 20 + field + b"\r" + b" wood")
    row = load(spark, str(tmp_path / "b.shp")).features.first()
    assert row.use == "wood" and len(row.polygon[0]) == 4


@pytest.mark.parametrize("dtype", ["uint16", "float32", "uint8"])
def test_tiff_round_trip(spark, tmp_path, dtype):
    m = RasterMeta(7, 5, 2.0, 0.0, 500000.0, 0.0, -2.0, 5600000.0, 25832, dtype)
    values = np.arange(70).reshape(2, 7, 5).astype(dtype)
    got, meta = decode(encode(values, m))
    assert (got == values).all() and meta == m
    (tmp_path / "a.tif").write_bytes(encode(values, m))
    r = read_raster(spark, str(tmp_path / "a.tif"))
    assert r.meta == m and r.bands == 2 and r.cells.count() == 70 and r.cells.where("band = 1 and row = 6 and col = 4").first().value == 69


def pack_lzw(data):
    """Codes of 9 to 12 bits, as the TIFF specification describes the compressor."""
    bits, n = 0, 0
    table = {}

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    def clear():
        nonlocal table
        table = {bytes([i]): i for i in range(256)} | {None: 256, (): 257}
        return 9

    width, held = 9, b""
    put(256, 9)
    width = clear()
    for byte in data:
        if held + bytes([byte]) in table:
            held += bytes([byte])
            continue
        put(table[held], width)
        table[held + bytes([byte])] = len(table)
        held = bytes([byte])
        if len(table) == 4095:
            put(table[held], width)
            put(256, width)
            width, held = clear(), b""
        elif len(table) in (512, 1024, 2048):
            width += 1
    if held:
        put(table[held], width)
    put(257, width)
    return (bits << (-n) % 8).to_bytes((n + 7) // 8, "big")


def test_lzw():
    rng = np.random.default_rng(1)
    for data in (b"a", b"ab" * 5000, bytes(rng.integers(0, 4, 40_000, np.uint8)), bytes(rng.integers(0, 256, 20_000, np.uint8)), bytes(30_000)):
        assert tiff.unpack_lzw(pack_lzw(data)) == data


def strips(values, predictor=False):
    """An LZW file of strips of two rows."""
    import struct

    rows = np.diff(values, axis=1, prepend=values.dtype.type(0)) if predictor else values
    packed = [pack_lzw(rows[r : r + 2].tobytes()) for r in range(0, len(rows), 2)]
    starts = np.cumsum([8] + [len(p) for p in packed])
    meta = RasterMeta(*values.shape, dtype=values.dtype.name)
    more = [(273, "I", starts[:-1].tolist()), (278, "I", [2]), (279, "I", [len(p) for p in packed]), (317, "H", [2 if predictor else 1])]
    directory = bytearray(tiff._directory(meta, 1, more, int(starts[-1]), False))
    place = directory.index(struct.pack("<HHI", 259, 3, 1)) + 8
    directory[place : place + 2] = struct.pack("<H", 5)
    return tiff._head(int(starts[-1]), False) + b"".join(packed) + bytes(directory)


@pytest.mark.parametrize("predictor", [False, True])
def test_tiff_strips_by_need(spark, tmp_path, monkeypatch, predictor):
    """Filters on rows and columns read only the strips they meet, and the header."""
    values = np.random.default_rng(2).integers(0, 500, (60, 40)).astype(np.uint16)
    path = str(tmp_path / "lzw.tif")
    data = strips(values, predictor)
    (tmp_path / "lzw.tif").write_bytes(data)
    cells = read_raster(spark, path).cells
    assert {(r.row, r.col): r.value for r in cells.collect()} == {(r, c): int(values[r, c]) for r in range(60) for c in range(40)}
    window = cells.where("row >= 10 and row < 13 and col = 7 and band = 0")
    assert {(r.row, r.col): r.value for r in window.collect()} == {(r, 7): int(values[r, 7]) for r in (10, 11, 12)}
    taken = []

    class Counted:
        def __init__(self, path):
            self.file = open(path, "rb")

        def __enter__(self):
            return self

        def __exit__(self, *why):
            self.file.close()

        def read_at(self, n, at):
            taken.append(n)
            self.file.seek(at)
            return self.file.read(n)

    monkeypatch.setattr(tiff, "_opened", Counted)
    reader = tiff.TiffReader(path, cells.schema)
    filters = [tiff.GreaterThanOrEqual(("row",), 10), tiff.LessThan(("row",), 13), tiff.EqualTo(("col",), 7)]
    assert reader.pushFilters(filters) == filters
    found = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in found) == 3
    assert sum(taken) < len(data) / 3


@pytest.mark.parametrize("dtype, classic", [("uint16", None), ("float32", 0), ("int32", 0)])
def test_tiff_sink(spark, tmp_path, dtype, classic):
    """Two bands with missing cells, by tiles; with ``classic`` 0 as BigTIFF."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 90, (2, 50, 70)).astype(dtype)
    m = RasterMeta(50, 70, 2.0, 0.0, 500000.0, 0.0, -2.0, 5600000.0, 25832, dtype)
    rows = [(b + 3, r, c, float(values[b, r, c])) for b in range(2) for r in range(50) for c in range(70) if (r, c) != (1, 1) and not (b == 1 and r < 16 and c < 16)]
    path = str(tmp_path / "out.tif")
    write_raster(spark.createDataFrame(rows, "band int, row int, col int, value double").repartition(5), m, path, tile=16, classic_bytes=classic)
    values[:, 1, 1] = values[1, :16, :16] = -1 if dtype != "uint16" else 65535
    data = (tmp_path / "out.tif").read_bytes()
    assert data[2] == (42 if classic is None else 43) and os.listdir(tmp_path) == ["out.tif"]
    got, meta = decode(data)
    assert meta == m and (got == values).all()
    again = read_raster(spark, path)
    assert again.meta == m and again.bands == 2
    assert {(r.band, r.row, r.col): r.value for r in again.cells.where("col > 60 and row = 20").collect()} == {(b, 20, c): values[b, 20, c] for b in range(2) for c in range(61, 70)}


def test_tiff_beyond_a_window(spark, tmp_path):
    """More cells than 2^26, few of them set; reading a window touches few tiles."""
    m = RasterMeta(20_000, 20_000, 1.0, 0.0, 0.0, 0.0, -1.0, 20_000.0, None, "uint16")
    rows = [(17 * i % 20_000, 31 * i % 20_000, i % 1000) for i in range(500)]
    path = str(tmp_path / "large.tif")
    write_raster(spark.createDataFrame(rows, "row int, col int, value int"), m, path)
    r, c, v = rows[123]
    window = read_raster(spark, path).cells.where(F.col("row").between(r - 2, r + 2) & F.col("col").between(c - 2, c + 2))
    got = {(x.row, x.col): x.value for x in window.collect()}
    near = {(x, y): 65535 for x in range(max(0, r - 2), r + 3) for y in range(max(0, c - 2), c + 3)}
    assert got == near | {(x, y): w for x, y, w in rows if (x, y) in near}


def test_tiff_that_only_spark_opens(spark, tmp_path, monkeypatch):
    values = np.arange(35).reshape(7, 5).astype("uint8")
    (tmp_path / "a.tif").write_bytes(encode(values, RasterMeta(7, 5, dtype="uint8")))

    def refuse(path):
        raise tiff.pa.ArrowInvalid("unknown scheme")

    monkeypatch.setattr(tiff, "_opened", refuse)
    found = read_raster(spark, str(tmp_path / "a.tif"))
    assert found.meta.height == 7 and {(r.row, r.col): r.value for r in found.cells.collect()} == {(r, c): int(values[r, c]) for r in range(7) for c in range(5)}


def test_masks_of_several_parts(spark):
    """Parts in any order; a feature that lies along a side's line, but beside the mask, does not meet it."""
    rows = spark.createDataFrame([(0, square(0, 0, 100), 1.0), (1, square(200, 0, 5), 1.0), (2, square(40, 300, 5), 1.0)], FEATURES)
    far, inside = [(500.0, 500.0), (510.0, 500.0), (510.0, 510.0), (500.0, 510.0)], [(40.0, 40.0), (50.0, 40.0), (50.0, 50.0), (40.0, 50.0)]
    for mask in ([far, inside], [inside, far]):
        assert [r.feature_id for r in meets(rows, mask).collect()] == [0]
        assert [r.feature_id for r in clipped(rows, mask).collect()] == [0]


def test_features_meet_tables_of_masks(spark):
    rng = np.random.default_rng(5)
    boxes = [(i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(zip(rng.uniform(0, 1000, 300), rng.uniform(0, 1000, 300), rng.choice([0.01, 1, 10, 300], 300)))]
    masks = [(float(x), float(y), float(s)) for x, y, s in zip(rng.uniform(0, 1000, 200), rng.uniform(0, 1000, 200), rng.choice([0.5, 5, 60], 200))]
    features = spark.createDataFrame([(i, square(x, y, s), 1.0) for i, x, y, s in boxes] + [(900, None, 1.0), (901, [], 1.0)], FEATURES)
    parts = [(square(x, y, s) + square(x + 2000, y, s),) for x, y, s in masks] + [(None,), ([],)]
    table = spark.createDataFrame(parts, f"polygon {G.POLYGON}")
    meet = lambda a, b: a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[2] and b[1] <= a[1] + a[2]
    want = sorted(i for i, x, y, s in boxes if any(meet((x, y, s), m) for m in masks))
    found = meets_any(features, table)
    assert 0 < len(want) < 300 and sorted(r.feature_id for r in found.collect()) == want and found.columns == features.columns
    assert meets_any(features, table.limit(0)).count() == 0 and meets_any(features.limit(0), table).count() == 0


class Twins:
    """Features with one geometry, with ids or without; some are repeated."""

    @staticmethod
    def answer(ids):
        def feature(i, name, at):
            return {"type": "Feature", "properties": {"v": name}, "geometry": {"type": "Point", "coordinates": at}} | ({"id": f"f.{i}"} if ids else {})

        return [feature(0, "a", (500001.0, 5600001.0)), feature(1, "b", (500001.0, 5600001.0)), feature(1, "b", (500001.0, 5600001.0)), feature(2, "c", (500005.0, 5600005.0))]


@pytest.mark.parametrize("ids", [True, False])
@pytest.mark.parametrize("at_once", [10_000, 1])
def test_features_of_a_service_once(spark, monkeypatch, ids, at_once):
    """Two features with one geometry stay two, however many features the service has."""
    monkeypatch.setattr(wfs, "AT_ONCE", at_once)
    monkeypatch.setattr(wfs, "DEEPEST", 2)
    monkeypatch.setattr(wfs, "capabilities", lambda url: None)
    monkeypatch.setattr(wfs, "layers", lambda root: ["x"])
    rows = vectors.parse_geojson(json.dumps({"features": Twins.answer(ids)}))
    monkeypatch.setattr(wfs, "count", lambda *a: len(rows))
    monkeypatch.setattr(wfs, "fetch", lambda *a: rows)
    if at_once == 1:
        halves = spark.createDataFrame(rows, wfs._ROWS).unionByName(spark.createDataFrame(rows[1:], wfs._ROWS))
        monkeypatch.setattr(wfs, "by_chunks", lambda *a, **b: wfs.once(halves))
    found = wfs.load(spark, "http://x", "x", bbox=(500000.0, 5600000.0, 500010.0, 5600010.0))
    assert sorted(r.v for r in found.features.collect()) == ["a", "b", "c"]


def test_masks(spark):
    rows = spark.createDataFrame([(0, square(0, 0, 2), 1.0), (1, square(9, 9, 2), 1.0), (2, square(-5, -5, 30), 1.0)], FEATURES)
    mask = [[(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0)]]
    assert sorted(r.feature_id for r in meets(rows, mask).collect()) == [0, 2]
    cut = clipped(rows, mask)
    assert {r.feature_id: r.a for r in cut.select("feature_id", G.area(F.col("polygon")).alias("a")).collect()} == {0: 1.0, 2: 9.0}


def test_services(spark):
    assert wfs.grid((0, 0, 10, 10), 2, 2) == [(0, 0, 5, 5), (0, 5, 5, 10), (5, 0, 10, 5), (5, 5, 10, 10)]
    assert wfs.expand((0, 0, 10, 10)) == (-1, -1, 11, 11)
    assert wfs.chunk_key((0, 0, 1, 1.5)) == "0.000000,0.000000,1.000000,1.500000"
    assert wfs.best_layer("landuse", ["water", "ns:LandUse"]) == "ns:LandUse"
    with pytest.raises(Exception, match="zzz"):
        wfs.best_layer("zzz", ["water"])
    assert vectors.parse_geojson("no json") is None and vectors.parse_geojson("") is None


def test_service_with_a_limit(spark):
    """A local service that cuts its answers off at 1000 features."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    points = [(500000 + i % 50 * 10 + 0.5, 5600000 + i // 50 * 10 + 0.5) for i in range(1800)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k.upper(): v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            if q["REQUEST"] == "GetCapabilities":
                data = b'<W xmlns:o="http://www.opengis.net/ows/1.1"><FeatureType><Name>ns:points</Name><o:WGS84BoundingBox><o:LowerCorner>8.9 50.4</o:LowerCorner><o:UpperCorner>9.1 50.7</o:UpperCorner></o:WGS84BoundingBox></FeatureType></W>'
            else:
                box = [float(v) for v in q["BBOX"].split(",")[:4]] if "BBOX" in q else [-1e9, -1e9, 1e9, 1e9]
                hits = [p for p in points if box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]][:1000]
                data = json.dumps({
                    "type": "FeatureCollection",
                    "features": [{
                        "type": "Feature",
                        "properties": {"v": str(p[0])},
                        "geometry": {"type": "Point", "coordinates": p},
                    } for p in hits],
                }).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        found = wfs.load(spark, f"http://127.0.0.1:{server.server_port}/wfs", "points")
        assert found.features.count() == 1800 and found.srid == 25832
    finally:
        server.shutdown()


class Service:
    """A local feature service over points; it notes what it is asked for."""

    def __init__(self, points, limit=None, tells=True):
        import json
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
        from urllib.parse import parse_qs, urlparse

        self.asked = asked = []

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k.upper(): v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                asked.append(q)
                if q["REQUEST"] == "GetCapabilities":
                    data = b'<W xmlns:o="http://www.opengis.net/ows/1.1"><FeatureType><Name>ns:points</Name><o:WGS84BoundingBox><o:LowerCorner>8.9 50.4</o:LowerCorner><o:UpperCorner>9.1 50.7</o:UpperCorner></o:WGS84BoundingBox></FeatureType></W>'
                else:
                    box = [float(v) for v in q["BBOX"].split(",")[:4]] if "BBOX" in q else [-1e9, -1e9, 1e9, 1e9]
                    hits = [p for p in points if box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]]
                    if q.get("RESULTTYPE") == "hits":
                        data = f'<c numberMatched="{len(hits)}"/>'.encode() if tells else b"unknown"
                    else:
                        data = json.dumps({
                            "type": "FeatureCollection",
                            "features": [{
                                "type": "Feature",
                                "properties": {"v": str(p[0])},
                                "geometry": {"type": "Point", "coordinates": p},
                            } for p in hits[:limit]],
                        }).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.source = {"url": f"http://127.0.0.1:{self.server.server_port}/wfs", "layer": "ns:points"}

    def __enter__(self):
        return self

    def __exit__(self, *why):
        self.server.shutdown()


SPOTS = [(500000 + i % 50 * 10 + 0.5, 5600000 + i // 50 * 10 + 0.5) for i in range(1800)]


@pytest.mark.parametrize("limit, tells", [(1000, False), (None, True)])
def test_service_with_a_mask(spark, limit, tells):
    mask = [[(500000.0, 5600000.0), (500100.0, 5600000.0), (500000.0, 5600360.0)]]
    with Service(SPOTS, limit, tells) as service:
        found = load(spark, service.source, mask=mask)
        got = {(r.polygon[0][0].x, r.polygon[0][0].y) for r in found.features.collect()}
        boxes = [q["BBOX"] for q in service.asked if "BBOX" in q]
    assert got == {p for p in SPOTS if G.point_in_rings(mask, *p)} and found.srid == 25832
    assert boxes and all(500000 <= float(b.split(",")[2]) <= 500100 for b in boxes)
    assert all(q.get("NAMESPACES", "").startswith("xmlns(ns=") for q in service.asked if q.get("VERSION") == "2.0.0")


def test_service_in_chunks_outside_a_mask(spark, monkeypatch):
    monkeypatch.setattr(wfs, "AT_ONCE", 50)
    mask = [[(500000.0, 5600000.0), (500500.0, 5600000.0), (500000.0, 5600400.0)]]
    with Service(SPOTS) as service:
        found = wfs.load(spark, **service.source, mask=mask)
        assert found.features.count() == sum(G.point_in_rings(mask, *p) for p in SPOTS)
        full = [tuple(map(float, q["BBOX"].split(",")[:4])) for q in service.asked if "BBOX" in q and "RESULTTYPE" not in q]
    assert len(full) > 3 and all(G.box_meets(b, mask) for b in full)
    far = [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]]
    assert wfs.by_chunks(spark, "http://127.0.0.1:9/none", "ns:points", (5.0, 5.0, 6.0, 6.0), mask=far).count() == 0


def test_boxes_and_masks_in_other_systems(spark, tmp_path):
    import json

    square = lambda x: [[[x, 0.0], [x + 2, 0.0], [x + 2, 2.0], [x, 2.0], [x, 0.0]]]
    doc = {
        "type": "FeatureCollection",
        "crs": {"type": "name", "properties": {"name": "EPSG:25832"}},
        "features": [{
            "type": "Feature",
            "properties": {"n": i},
            "geometry": {"type": "Polygon", "coordinates": square(3.0 * i)},
        } for i in range(4)],
    }
    path = f"{tmp_path}/a.geojson"
    with open(path, "w") as file:
        json.dump(doc, file)
    with pytest.raises(SystemMismatchError):
        load(spark, path, bbox=(0, 0, 1, 1), bbox_srid=4326)
    with pytest.raises(SystemMismatchError):
        load(spark, path, mask=[[(0, 0), (1, 0), (0, 1)]], mask_srid=4326)
    area = lambda v: sorted((r.n, round(r.a, 6)) for r in v.features.select("n", G.parts_area(F.col("polygon")).alias("a")).collect())
    # A file's features are read whole where they meet the box; with both, the mask cuts.
    assert area(load(spark, path, bbox=(1, 1, 4, 4), bbox_srid=25832)) == [(0, 4.0), (1, 4.0)]
    assert area(load(spark, path, bbox=(1, 1, 4, 4), mask=[[(0, 0), (1, 0), (1, 9), (0, 9)]])) == [(0, 2.0)]
    assert area(load(spark, load(spark, path), bbox=(1, 1, 4, 4))) == [(0, 1.0), (1, 1.0)]
    with pytest.raises(ValueError, match="GeoTIFF"):
        load(spark, "heights.jp2")


def test_clip_to_any_shape(spark):
    angle = [[(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5)]]  # with a hole
    point = lambda x, y: {"x": float(x), "y": float(y)}
    rows = [
        (1, "Polygon", [[point(1, 1), point(5, 1), point(5, 5), point(1, 5)]]),
        (2, "LineString", [[point(-1, 1), point(7, 1)]]),
        (3, "LineString", [[point(3, 3), point(5, 5)]]),
        (4, "Point", [[point(1, 5)]]),
        (5, "Point", [[point(1, 1)]]),
        (6, "Polygon", [[point(4, 4), point(5, 4), point(5, 5)]]),
    ]
    df = spark.createDataFrame(rows, "feature_id long, geometry_type string, polygon array<array<struct<x:double,y:double>>>")
    got = {r.feature_id: r.polygon for r in clipped(df, angle).collect()}
    size = lambda ring: abs(sum(a.x * b.y - a.y * b.x for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
    long = lambda ring: math.dist((ring[0].x, ring[0].y), (ring[1].x, ring[1].y))
    assert set(got) == {1, 2, 4}
    assert sum(map(size, got[1])) == pytest.approx(4 + 3 - 0.25) and sum(map(long, got[2])) == pytest.approx(5)


def test_cut_features_stay_whole(spark):
    """One row a feature, with the kind it has become; other columns, nulls and empty features."""
    frame = [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]]
    line = [{"x": -1.0, "y": 4.0}, {"x": 10.0, "y": 4.0}]
    rows = [
        (1, "Polygon", square(2, 2, 5), "a"),
        (2, "Polygon", [[{"x": x, "y": y} for x, y in ((2.0, 4.0), (7.0, 4.0), (7.0, 5.0), (2.0, 5.0))]], None),
        (3, "MultiPolygon", square(1, 1, 1) + square(20, 1, 1), "c"),
        (4, "LineString", [line], "d"),
        (5, "MultiPoint", [[{"x": 1.0, "y": 1.0}, {"x": 4.0, "y": 4.0}]], "e"),
        (6, None, square(1, 1, 1), "f"),
        (7, "Polygon", None, "g"),
        (8, "Polygon", [], "h"),
    ]
    df = spark.createDataFrame(rows, f"feature_id long, geometry_type string, polygon {G.POLYGON}, note string")
    cut = clipped(df, frame)
    assert cut.dtypes == df.dtypes
    got = {r.feature_id: (r.geometry_type, len(r.polygon), r.note) for r in cut.collect()}
    assert got == {1: ("Polygon", 2, "a"), 2: ("MultiPolygon", 2, None), 3: ("Polygon", 1, "c"), 4: ("MultiLineString", 2, "d"), 5: ("Point", 1, "e"), 6: (None, 1, "f")}
    assert {r.feature_id: r.a for r in cut.select("feature_id", G.oriented_area(F.col("polygon")).alias("a")).collect() if r.feature_id < 4} == {1: 16.0, 2: 2.0, 3: 1.0}
    assert clipped(df, []).count() == 0 == clipped(df.limit(0), frame).count()


def test_legend_and_screening(spark):
    cells = spark.range(40).select(
        F.col("id").cast("int").alias("row"),
        F.lit(0).alias("col"),
        (F.col("id") * 3).cast("int").alias("value"),
    )
    assert [r.rank - 1 for r in R.legend_sample(cells).orderBy("rank").collect()] == [0, 3, 7, 10, 14, 17, 21, 24, 28, 31, 35, 39]
    assert R.legend_sample(cells.limit(12)).count() == 12 == R.legend_sample(cells, 12).count()
    options = spark.createDataFrame(
        [("a", 1, 5.0, True), ("a", 2, 3.0, False), ("a", 3, 4.0, True), ("a", 4, 4.0, True), ("b", 5, 1.0, False), ("c", 6, None, True)],
        "g string, n int, cost double, ok boolean",
    )
    assert [(r.g, r.n) for r in M.cheapest_valid(options, F.col("ok"), "g", "cost", "n").collect()] == [("a", 3)]
    lengths = spark.createDataFrame(
        [(1, 10, 2.0), (1, 65535, 3.0), (1, 7, None), (2, 65535, 1.0)],
        "path_id long, category int, length double",
    )
    assert sorted((r.path_id, r.cost) for r in M.path_costs(lengths).collect()) == [(1, 20.0), (2, 0.0)]


def shapes(seed, n, size):
    """Stars with holes and odd corners on cell centres."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, y = rng.uniform(-5, size + 5, 2)
        r = rng.choice([0.4, 3, 9, size])
        ring = [(x + r * math.cos(t) * s, y + r * math.sin(t) * s) for t, s in zip(np.linspace(0, 2 * math.pi, 9)[:-1], rng.uniform(0.3, 1, 8))]
        hole = [(x + r * 0.2, y), (x, y + r * 0.2), (x - r * 0.2, y)]
        rings = [ring, hole] if i % 2 else [[(round(a) + 0.5, round(b) + 0.5) for a, b in ring]]
        out.append((i, [[{"x": float(a), "y": float(b)} for a, b in g] for g in rings], float(rng.choice([1.5, 2.5, 30.0, 70_000.0, 0.0]))))
    return out


def meta_of(size, flipped=False):
    return RasterMeta(size, size, -1.0 if flipped else 1.0, 0.0, float(size) if flipped else 0.0, 0.0, -1.0, float(size))


@pytest.mark.parametrize("side, flipped", [(7, False), (64, False), (16, True)])
def test_scan_lines_fill_as_cells_are_tested(spark, side, flipped):
    rows, m = shapes(1, 25, 40), meta_of(40, flipped)
    features = spark.createDataFrame(rows, FEATURES)
    got = {(r.row, r.col): r.value for r in blocks.rasterized(features, m, side=side).cells().collect()}
    painted = R.covered(features.withColumn("value", R.burn_value(F.col("cost"))), m, 0.0, ["value"]).groupBy("row", "col").agg(F.max("value").alias("value"))
    want = {(r.row, r.col): r.value for r in painted.collect()}
    assert len(got) == 1600 and got == {(r, c): want.get((r, c), FORBIDDEN) for r in range(40) for c in range(40)}


def test_overlays_in_one_pass(spark):
    """Each kind of overlay, in order, as cell by cell."""
    rng = np.random.default_rng(4)
    m = meta_of(40)
    cells = array_cells(spark, rng.integers(1, 60_000, (40, 40)), m).cells.where("row <> 3 or col <> 4").select("row", "col", "value")
    a, b = (spark.createDataFrame(shapes(s, 12, 40), FEATURES).withColumn("zone", F.when(F.col("feature_id") % 3 == 0, "z1").otherwise("z2")) for s in (2, 3))
    steps = [
        {"features": a, "value": 1.7, "multiply": True},
        {"features": b, "value": 1.7, "multiply": True, "wrap": True, "ignore": None},
        {"features": b},
        {"features": a, "value": 300, "zone_col": "zone", "forbidden_zone": "z1"},
        {"features": b, "value": 9, "ignore": 300},
    ]
    got = {(r.row, r.col): r.value for r in blocks.Blocks.of_cells(cells, m, 16).painted([one for s in steps for one in blocks.steps_of(**s)]).cells().collect()}
    plain = cells.withColumn("extra", F.lit(0))  # a further column keeps cells unpacked
    for s in steps:
        args = {k: v for k, v in s.items() if k != "features"}
        plain = (R.overlay_zones if "zone_col" in args else R.overlay if "value" in args else R.overlay_costs)(plain, s["features"], m, **args)
    assert got == {(r.row, r.col): r.value for r in plain.collect()} and len(got) == 1599
    whole = R.overlays(cells, m, steps)
    assert {(r.row, r.col): r.value for r in whole.collect()} == got and whole.columns == cells.columns
    assert R.overlays(cells, m, []).count() == 1599


def test_windows_and_masks_of_packed_tiles(spark):
    m = meta_of(40)
    packed = blocks.rasterized(spark.createDataFrame(shapes(6, 30, 40), FEATURES), m, side=16)
    for points in ([(5.0, 30.0), (30.0, 12.0)], [(20.5, 20.5)], [(5.0, 5.0), (30.0, 9.0), (12.0, 33.0)]):
        part = packed.crop(*R.search_window(m, points, 6.3)).masked(R.hull_of(points), 6.3)
        want, small = R.search_space(packed.cells(), m, points, 6.3)
        assert part.meta == small and sorted(map(tuple, part.cells().collect())) == sorted(map(tuple, want.select("row", "col", "value").collect()))
        again = part.painted([blocks.Step(spark.createDataFrame([(0, square(10, 10, 9), 1.0)], FEATURES), "set", 7)])
        hit = {(r.row, r.col) for r in again.cells().where("value = 7").collect()}
        assert hit == {(r.row, r.col) for r in R.covered(spark.createDataFrame([(0, square(10, 10, 9), 1.0)], FEATURES), small).collect()}


def test_cells_are_not_exchanged(spark):
    packed = blocks.rasterized(spark.createDataFrame(shapes(6, 30, 40), FEATURES), meta_of(40)).masked([(5.0, 5.0)], 9.0).crop(2, 30, 2, 30)
    plan = packed.cells()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(tr" in plan


def test_even_rasters_and_none(spark):
    m = meta_of(30)
    assert {r.value for r in blocks.Blocks.even(spark, m, 5, 16).cells().collect()} == {5}
    none = spark.createDataFrame([], FEATURES)
    assert blocks.rasterized(none, m).cells().where(F.col("value") != FORBIDDEN).count() == 0
    assert blocks.Blocks.of_cells(spark.createDataFrame([], "row int, col int, value int"), m).painted([blocks.Step(none, "set", 3)]).cells().count() == 0


def crowded(seed, n):
    """Nine in ten points in one spot, the others far and wide; some share a place."""
    rng = np.random.default_rng(seed)
    spot = rng.random(n) < 0.9
    xy = np.where(spot[:, None], 5_000 + rng.normal(0, 0.01, (n, 2)), rng.uniform(0, 100_000, (n, 2)))
    xy[:: n // 20] = (5_000.0, 5_000.0)
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_of_crowded_points(spark, k):
    points, others = crowded(1, 300), crowded(2, 3000)
    a, b = (spark.createDataFrame(rows, "id long, x double, y double") for rows in (points, others))
    found = R.nearest(a, b, k)
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append((r.rank, r.distance, r.other))
    for i, x, y in points:
        want = sorted((math.hypot(x - ox, y - oy), o) for o, ox, oy in others)[:k]
        assert [o for _, _, o in sorted(got[i])] == [o for _, o in want] and [d for _, d, _ in sorted(got[i])] == pytest.approx([d for d, _ in want])
    assert R._candidates(a, b, k).count() < 100 * k * len(points)


def test_nearest_odd_points(spark):
    rows = [(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0), (3, None, 2.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = sorted((r.id, r.rank, r.other) for r in R.nearest(df, df, 2).collect())
    assert got == [(i, n + 1, n) for i in range(3) for n in range(2)]
    assert [r.other for r in R.nearest(df.limit(1), df.limit(1), 5).collect()] == [0]
    assert R.nearest(df, df.limit(0), 2).count() == R.nearest(df.limit(0), df, 2).count() == 0
    assert R.nearest(df, df.limit(0), 2).columns == ["id", "other", "distance", "rank"]
