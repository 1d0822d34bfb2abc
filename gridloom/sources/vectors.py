"""Vector files: GeoJSON, GeoPackage, Shapefile, GML and KML -> features.

Rows: feature_id long, polygon (rings), geometry_type, and the attributes as strings. GeoJSON is
read by Spark; the binary formats are decoded in tasks, a file each.
"""

from __future__ import annotations

import os
import sqlite3
import struct
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.geometry import POLYGON
from gridloom.session import ship, store
from gridloom.sources.detect import Vector

Ring = list[dict[str, float]]
RAW = f"geometry_type string, polygon {POLYGON}, attributes map<string,string>, srid int"


def read(spark: SparkSession, path: str, layer: str | None = None, bbox: tuple[float, float, float, float] | None = None) -> Vector:
    """The features of a file (of a layer, where a file holds several); with ``bbox`` those whose box meets it.

    Tasks that decode a file leave out the others before anything is sent on.
    """
    ship(spark)
    name = path.lower()
    if name.endswith((".geojson", ".json")):
        found = geojson(spark, path)
        if bbox:
            from gridloom.sources.detect import within_box

            found.features = within_box(found.features, bbox)
        return found
    decode = {".gpkg": _gpkg, ".shp": _shp, ".gml": _gml, ".kml": _kml}[os.path.splitext(name)[1]]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if name.endswith(".shp"):
        dbf = spark.read.format("binaryFile").option("pathGlobFilter", "*.dbf").load(os.path.dirname(path)).where(F.lower("path").endswith(os.path.basename(path)[:-4].lower() + ".dbf")).select(F.col("content").alias("side"))
        files = files.join(F.broadcast(dbf), how="left")  # one file
    else:
        files = files.withColumn("side", F.lit(None).cast("binary"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, side in zip(pdf["content"], pdf["side"], strict=True):
                rows = []
                for row in decode(content, side, layer):
                    if bbox is None or _meets_box(row[1], bbox):
                        rows.append(row[:4])
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=["geometry_type", "polygon", "attributes", "srid"])
                        rows = []
                yield pd.DataFrame(rows, columns=["geometry_type", "polygon", "attributes", "srid"])

    return _features(files.mapInPandas(run, RAW))


def _meets_box(polygon: list[Ring], bbox: tuple[float, float, float, float]) -> bool:
    xs, ys = [p["x"] for r in polygon for p in r], [p["y"] for r in polygon for p in r]
    return bool(xs) and min(xs) <= bbox[2] and max(xs) >= bbox[0] and min(ys) <= bbox[3] and max(ys) >= bbox[1]


def _features(raw: DataFrame) -> Vector:
    """Attributes as columns; their names come from one pass over the features, whose ids are stored with them."""
    raw = store(raw.withColumn("feature_id", F.monotonically_increasing_id()), "features")
    names = raw.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attributes")))))).first()[0] or []
    srid = raw.agg(F.max("srid")).first()[0]
    columns = [F.col("attributes")[n].alias(n) for n in names if n not in ("feature_id", "polygon", "geometry_type")]
    return Vector(raw.select("feature_id", "geometry_type", "polygon", *columns), srid)


_RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))


def geojson(spark: SparkSession, path: str) -> Vector:
    """A FeatureCollection, by Spark's JSON reader; properties keep their types."""
    doc = spark.read.option("multiLine", "true").json(path)
    if "features" not in doc.columns:
        raise ValueError(f"{path} is not a FeatureCollection")
    rows = doc.select(F.posexplode("features").alias("feature_id", "f"))
    props = doc.schema["features"].dataType.elementType
    fields = [x.name for x in props["properties"].dataType.fields] if "properties" in props.names and isinstance(props["properties"].dataType, T.StructType) else []
    text = F.to_json("f.geometry.coordinates") if isinstance(props["geometry"].dataType["coordinates"].dataType, T.ArrayType) and not isinstance(
        props["geometry"].dataType["coordinates"].dataType.elementType,
        T.StringType,
    ) else None
    if text is None:  # mixed geometry types: Spark keeps parts of them as text
        c = F.col("f.geometry.coordinates")
        text = F.concat(F.lit("["), F.concat_ws(",", c), F.lit("]")) if isinstance(
            props["geometry"].dataType["coordinates"].dataType,
            T.ArrayType,
        ) else c
    kind = F.col("f.geometry.type")
    deep = F.when(kind == "MultiPolygon", F.flatten(F.from_json(text, T.ArrayType(_RINGS)))).when(kind.isin("Polygon", "MultiLineString"), F.from_json(text, _RINGS)).when(
        kind.isin("LineString", "MultiPoint"),
        F.array(F.from_json(text, _RINGS.elementType)),
    ).otherwise(F.array(F.array(F.from_json(text, T.ArrayType(T.DoubleType())))))
    polygon = F.transform(deep, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    srid = None
    if "crs" in doc.columns and "properties" in doc.schema["crs"].dataType.names:
        name = doc.select("crs.properties.name").first()[0] or ""
        srid = int(name.rpartition(":")[2]) if name.rpartition(":")[2].isdigit() else None
    return Vector(
        rows.select(
            F.col("feature_id").cast("long"),
            kind.alias("geometry_type"),
            polygon.alias("polygon"),
            *[F.col(f"f.properties.`{n}`").alias(n) for n in fields if n not in ("feature_id", "polygon", "geometry_type")],
        ),
        srid,
    )


def parse_geojson(text: str | None) -> list[dict] | None:
    """Features of a service's answer; None if it is empty or no GeoJSON."""
    import json

    try:
        doc = json.loads(text or "")
    except ValueError:
        return None
    found = doc.get("features") if isinstance(doc, dict) else None
    return [{
        "geometry_type": f["geometry"]["type"],
        "polygon": rings(f["geometry"]),
        "attributes": {k: None if v is None else str(v) for k, v in (f.get("properties") or {}).items()},
        "id": None if f.get("id") is None else str(f["id"]),
    } for f in found if f.get("geometry")] if found else None


def rings(geometry: dict) -> list[Ring]:
    at, kind = geometry["coordinates"], geometry["type"]
    if kind == "MultiPolygon":
        parts = [r for p in at for r in p]
    elif kind in ("Polygon", "MultiLineString"):
        parts = at
    elif kind in ("LineString", "MultiPoint"):
        parts = [at]
    else:
        parts = [[at]]
    return [[{"x": float(p[0]), "y": float(p[1])} for p in r] for r in parts]


_WKB = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}


def wkb(data: bytes, at: int = 0) -> tuple[str, list[Ring], int]:
    """(type, rings, end) of a well-known binary geometry; z and m are left out."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    dims = 2 + (bool(code & 0x80000000) + bool(code & 0x40000000) or {0: 0, 1: 1, 2: 1, 3: 2}[code % 0x20000000 // 1000])
    kind = _WKB[code % 0x20000000 % 1000]

    def points(n: int) -> Ring:
        nonlocal at
        values = struct.unpack_from(f"{order}{n * dims}d", data, at)
        at += 8 * n * dims
        return [{"x": values[i * dims], "y": values[i * dims + 1]} for i in range(n)]

    def number() -> int:
        nonlocal at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        return n

    if kind == "Point":
        return kind, [points(1)], at
    if kind == "LineString":
        return kind, [points(number())], at
    if kind == "Polygon":
        return kind, [points(number()) for _ in range(number())], at
    found: list[Ring] = []
    for _ in range(number()):
        _, part, at = wkb(data, at)
        found += part
    return kind, found, at


def _gpkg(content: bytes, _: bytes | None, layer: str | None) -> Iterator[tuple]:
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as file:  # SQLite needs a file; it goes with this call
        file.write(content)
        file.flush()
        db = sqlite3.connect(f"file:{file.name}?mode=ro", uri=True)
        tables = db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall()
        table, column, srid = next(t for t in tables if layer in (None, t[0]))
        cursor = db.execute('SELECT * FROM "{}"'.format(table.replace('"', '""')))
        names = [c[0] for c in cursor.description]
        for row in cursor:
            values = dict(zip(names, row, strict=True))
            blob = values.pop(column)
            if blob is None:
                continue
            envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
            kind, found, _ = wkb(blob, 8 + envelope)
            yield kind, found, {k: None if v is None else str(v) for k, v in values.items()}, srid if srid > 0 else None
        db.close()


_SHAPES = {1: "Point", 3: "MultiLineString", 5: "Polygon", 8: "MultiPoint"}


def _dbf(data: bytes) -> list[dict[str, str | None]]:
    count, start, size = struct.unpack_from("<IHH", data, 4)
    fields, at, offset = [], 32, 1
    while data[at] != 13:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), offset, data[at + 16]))
        offset += data[at + 16]
        at += 32
    rows = (data[start + i * size : start + (i + 1) * size] for i in range(count))
    return [{n: row[o : o + w].decode("utf-8", "replace").strip() or None for n, o, w in fields} for row in rows]


def _shp(content: bytes, side: bytes | None, _: str | None) -> Iterator[tuple]:
    table = _dbf(bytes(side)) if side is not None else []
    at, n = 100, 0
    while at + 12 <= len(content):
        (words,) = struct.unpack_from(">I", content, at + 4)
        body, at = content[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        (code,) = struct.unpack_from("<I", body, 0)
        base = code % 10
        attributes = table[n] if n < len(table) else {}
        n += 1
        if base == 1:
            x, y = struct.unpack_from("<2d", body, 4)
            yield "Point", [[{"x": x, "y": y}]], attributes, None
        elif base in (3, 5):
            parts, points = struct.unpack_from("<2I", body, 36)
            starts = [*struct.unpack_from(f"<{parts}I", body, 44), points]
            values = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
            yield _SHAPES[base], [[{"x": values[2 * i], "y": values[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)], attributes, None
        elif base == 8:
            (points,) = struct.unpack_from("<I", body, 36)
            values = struct.unpack_from(f"<{2 * points}d", body, 40)
            yield "MultiPoint", [[{"x": values[2 * i], "y": values[2 * i + 1]} for i in range(points)]], attributes, None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _gml(content: bytes, _: bytes | None, layer: str | None) -> Iterator[tuple]:
    for holder in ET.fromstring(content).iter():
        if _local(holder.tag) not in ("featureMember", "member", "featureMembers"):
            continue
        for feature in holder:
            if layer and _local(feature.tag) != layer:
                continue
            found: list[Ring] = []
            kind, srid = "Polygon", None
            for x in feature.iter():
                name = (x.get("srsName") or "").replace("/", ":").rpartition(":")[2].rpartition("#")[2]
                srid = int(name) if name.isdigit() else srid
                if _local(x.tag) in ("posList", "pos") and x.text:
                    v = [float(t) for t in x.text.split()]
                    found.append([{"x": a, "y": b} for a, b in zip(v[::2], v[1::2], strict=True)])
                    kind = "Point" if _local(x.tag) == "pos" and len(v) == 2 else kind
                elif _local(x.tag) == "coordinates" and x.text:
                    found.append([{"x": float(p.split(",")[0]), "y": float(p.split(",")[1])} for p in x.text.split()])
            named = next((v for k, v in feature.attrib.items() if _local(k) in ("id", "fid")), None)
            yield kind, found, {_local(x.tag): (x.text or "").strip() or None for x in feature if not len(x)}, srid, named


def _kml(content: bytes, _: bytes | None, layer: str | None) -> Iterator[tuple]:
    for mark in ET.fromstring(content).iter():
        if _local(mark.tag) != "Placemark":
            continue
        found: list[Ring] = []
        kinds = [_local(x.tag) for x in mark.iter() if _local(x.tag) in ("Point", "LineString", "Polygon")]
        for x in mark.iter():
            if _local(x.tag) == "coordinates" and x.text:
                found.append([{"x": float(p.split(",")[0]), "y": float(p.split(",")[1])} for p in x.text.split()])
        attributes = {_local(x.tag): (x.text or "").strip() or None for x in mark if not len(x)}
        attributes |= {x.get("name"): (next((y.text for y in x if _local(y.tag) == "value"), x.text) or "").strip() or None for x in mark.iter() if _local(x.tag) in ("Data", "SimpleData") and x.get("name")}
        yield (kinds or ["Point"])[0], found, attributes, 4326
