"""Web feature services: layers, extents, and features by chunks that tasks fetch.

The driver asks for the capabilities and, if the service can tell, for the number of features. A few are fetched
at once. If there are many, or the answer looks cut off, the extent is dealt into chunks that tasks fetch, and chunks
that hold many, fail or look cut off into four, level by level. Chunks outside a mask are left out.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import FeatureServiceError, LayerNotFoundError, ResponseParsingError, ServiceConnectionError
from gridloom.functions.geometry import POLYGON, Point, bounds_of, box_meets
from gridloom.session import ship, store
from gridloom.sources.detect import Vector
from gridloom.sources.vectors import _gml, parse_geojson

# Protocol versions in the order they are tried, sizes at which services cut off, and limits.
VERSIONS = ("2.0.0", "1.1.0", "1.0.0")
CUT_OFF = (1000, 5000, 10000, 50000, 100000)
SRID = 25832
TIMEOUT, CLOSE_ENOUGH, DEEPEST = 30, 0.3, 8
NAMESPACE_BASE = "https://www.adv-online.de/namespaces/adv/gid"
#: Features that are asked for at once, where a service can tell their number.
AT_ONCE = 10_000
Box = tuple[float, float, float, float]


def grid(bbox: Box, nx: int, ny: int) -> list[Box]:
    """A box in nx by ny equal parts, column by column."""
    w, h = (bbox[2] - bbox[0]) / nx, (bbox[3] - bbox[1]) / ny
    return [(bbox[0] + i * w, bbox[1] + j * h, bbox[0] + (i + 1) * w, bbox[1] + (j + 1) * h) for i in range(nx) for j in range(ny)]


def grid_columns(minx: Column, miny: Column, maxx: Column, maxy: Column, nx: int, ny: int) -> Column:
    """The same as an array of structs."""
    w, h = (maxx - minx) / nx, (maxy - miny) / ny
    cells = F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), lambda n: F.struct(F.floor(n / ny).alias("i"), (n % ny).alias("j")))
    return F.transform(
        cells,
        lambda c: F.struct(
            (minx + c["i"] * w).alias("minx"),
            (miny + c["j"] * h).alias("miny"),
            (minx + (c["i"] + 1) * w).alias("maxx"),
            (miny + (c["j"] + 1) * h).alias("maxy"),
        ),
    )


def chunk_key(bbox: Box) -> str:
    return ",".join(f"{v:.6f}" for v in bbox)


def expand(bbox: Box, share: float = 0.1) -> Box:
    w, h = (bbox[2] - bbox[0]) * share, (bbox[3] - bbox[1]) * share
    return bbox[0] - w, bbox[1] - h, bbox[2] + w, bbox[3] + h


def similarity(a: str, b: str) -> float:
    """Ratcliff and Obershelp's ratio, without regard to case."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def best_layer(name: str, layers: list[str]) -> str:
    """The layer of that name, else the most similar one if it is close enough."""
    if name in layers:
        return name
    top = max(layers, key=lambda x: similarity(name, x), default=None)
    if top is None or similarity(name, top) <= CLOSE_ENOUGH:
        raise LayerNotFoundError(name)
    return top


def union(frames: list[DataFrame], geometry: str = "polygon") -> DataFrame | None:
    """All rows, columns by name, each geometry once: the row of the first frame that has it."""
    if not frames:
        return None
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_at", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    names = [c for c in out.columns if c != "_at"]
    best = out.groupBy(F.col(geometry).alias("_g")).agg(F.min_by(F.struct(*names), "_at").alias("_row"))
    return best.select("_row.*")


def _get(url: str, params: Mapping[str, str]) -> bytes:
    try:
        with urllib.request.urlopen(
            url + ("&" if "?" in url else "?") + urllib.parse.urlencode(params),
            timeout=TIMEOUT,
        ) as answer:  # noqa: S310
            return answer.read()
    except OSError as cause:
        raise ServiceConnectionError(url) from cause


def capabilities(url: str) -> ET.Element:
    data = _get(url, {"SERVICE": "WFS", "REQUEST": "GetCapabilities"})
    try:
        return ET.fromstring(data)
    except ET.ParseError as cause:
        raise ResponseParsingError(url) from cause


def _parts(root: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in root.iter() if x.tag.rpartition("}")[2] == name)


def layers(root: ET.Element) -> list[str]:
    """Names of the feature types, in any namespace."""
    return [n.text.strip() for f in _parts(root, "FeatureType") for n in list(_parts(f, "Name"))[:1] if n.text]


def extent(root: ET.Element, layer: str) -> Box | None:
    """A layer's box in degrees."""
    for f in _parts(root, "FeatureType"):
        if not any(n.text and n.text.strip() == layer for n in list(_parts(f, "Name"))[:1]):
            continue
        corner = {k: next((x.text for x in _parts(f, k)), None) for k in ("LowerCorner", "UpperCorner")}
        if all(corner.values()):
            return (*map(float, corner["LowerCorner"].split()), *map(float, corner["UpperCorner"].split()))
        for b in _parts(f, "LatLongBoundingBox"):
            return tuple(float(b.get(k)) for k in ("minx", "miny", "maxx", "maxy"))
    return None


def _params(version: str, layer: str, bbox: Box | None, filters: Mapping[str, str] | None) -> dict[str, str]:
    """A request's parameters; a layer's prefix is explained where the protocol asks for it."""
    found = {
        "SERVICE": "WFS",
        "VERSION": version,
        "REQUEST": "GetFeature",
        "TYPENAMES" if version == "2.0.0" else "TYPENAME": layer,
        "SRSNAME": f"EPSG:{SRID}",
    }
    prefix = layer.partition(":")[0] if ":" in layer else ""
    if prefix and version == "2.0.0":
        found["NAMESPACES"] = f"xmlns({prefix}={NAMESPACE_BASE}/{prefix})"
    found |= filters or {}
    if bbox:
        found["BBOX"] = ",".join(map(str, bbox)) + f",EPSG:{SRID}"
    return found


def count(url: str, layer: str, bbox: Box | None = None, filters: Mapping[str, str] | None = None) -> int | None:
    """How many features a layer has in a box; None if the service does not tell."""
    for version in VERSIONS[:2]:
        try:
            root = ET.fromstring(_get(url, {**_params(version, layer, bbox, filters), "RESULTTYPE": "hits"}))
        except (ServiceConnectionError, ET.ParseError):
            continue
        told = root.get("numberMatched") or root.get("numberOfFeatures") or ""
        if told.isdigit():
            return int(told)
    return None


def fetch(url: str, layer: str, bbox: Box | None = None, filters: Mapping[str, str] | None = None) -> list[dict]:
    """Features of a layer in a box; GeoJSON, else GML, by the first version that answers."""
    why: Exception | None = None
    for version in VERSIONS:
        params = {"OUTPUTFORMAT": "application/json"} | _params(version, layer, bbox, filters)
        try:
            data = _get(url, params)
            text = data.decode("utf-8", "replace")
            if (found := parse_geojson(text)) is not None:
                return found
            if text.lstrip().startswith("{") and json.loads(text).get("features") == []:
                return []
            rows = [dict(zip(("geometry_type", "polygon", "attributes"), r[:3], strict=True)) | {"id": r[4]} for r in _gml(data, None, None)]
            if rows:
                return rows
        except (ServiceConnectionError, ET.ParseError, ValueError) as cause:
            why = cause
    if why:
        raise FeatureServiceError(f"{url}: {layer}") from why
    return []


_COLUMNS = ["geometry_type", "polygon", "attributes", "id"]
_ROWS = f"geometry_type string, polygon {POLYGON}, attributes map<string,string>, id string"


def once(rows: DataFrame) -> DataFrame:
    """Each feature once, as chunks that touch both return it: by the service's id, where there is none by geometry and all attributes."""
    told = F.to_json(F.struct("geometry_type", "polygon", F.array_sort(F.map_entries("attributes"))))
    key = F.coalesce(F.concat(F.lit("i"), F.col("id")), F.concat(F.lit("g"), F.sha2(told, 256)))
    return rows.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct("geometry_type", "polygon", "attributes"), F.sha2(told, 256)).alias("_row")).select("_row.*")


def load(
    spark: SparkSession,
    url: str,
    layer: str,
    bbox: Box | None = None,
    filter_params: Mapping[str, str] | None = None,
    auto_match: bool = True,
    mask: list[list[Point]] | None = None,
) -> Vector:
    """A layer's features, at once or by chunks of its extent; each of them once (see ``once``), whichever way they came.

    ``mask``: rings of a polygon. Without ``bbox`` its box is asked for, chunks that it does not meet are not, and features that it
    does not meet go.
    """
    from gridloom.sources.detect import meets

    ship(spark)
    root = capabilities(url)
    known = layers(root)
    name = best_layer(layer, known) if auto_match else layer
    if name not in known:
        raise LayerNotFoundError(layer)
    if mask and bbox is None:
        bbox = bounds_of(mask)
    rows = None
    many = (count(url, name, bbox, filter_params) or 0) > AT_ONCE
    if not many:
        try:
            rows = fetch(url, name, bbox, filter_params)
        except FeatureServiceError:
            pass
    if rows is not None and len(rows) not in CUT_OFF:
        found = _vector(once(spark.createDataFrame(rows, _ROWS)))
    else:
        area = bbox or _extent_metres(spark, root, name)
        if area is None and rows:
            xs, ys = zip(*[(p["x"], p["y"]) for r in rows for ring in r["polygon"] for p in ring], strict=True)
            area = expand((min(xs), min(ys), max(xs), max(ys)))
        if area is None:
            raise FeatureServiceError(f"{url} tells no extent of {name}")
        found = _vector(by_chunks(spark, url, name, area, filter_params, mask=mask))
    return Vector(meets(found.features, mask), found.srid) if mask else found


def _extent_metres(spark: SparkSession, root: ET.Element, layer: str) -> Box | None:
    from gridloom.functions.geometry import reproject

    box = extent(root, layer)
    if box is None:
        return None
    corners = spark.createDataFrame([(x, y) for x in (box[0], box[2]) for y in (box[1], box[3])], "x double, y double")
    moved = [(r[0], r[1]) for r in corners.select(*reproject(F.col("x"), F.col("y"), 4326, SRID)).collect()]
    return min(p[0] for p in moved), min(p[1] for p in moved), max(p[0] for p in moved), max(p[1] for p in moved)


def by_chunks(
    spark: SparkSession,
    url: str,
    layer: str,
    area: Box,
    filters: Mapping[str, str] | None = None,
    deepest: int = DEEPEST,
    mask: list[list[Point]] | None = None,
) -> DataFrame:
    """Chunks in parallel, those that fail or look cut off in four again; a chunk that still does at the last level is an error."""

    def run(batches: Iterator[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for box in pdf[["minx", "miny", "maxx", "maxy"]].itertuples(index=False):
                try:
                    # At the last level a chunk is fetched however many it holds.
                    cut = not last and (count(url, layer, tuple(box), filters) or 0) > AT_ONCE
                    found = [] if cut else fetch(url, layer, tuple(box), filters)
                    cut = cut or len(found) in CUT_OFF
                except FeatureServiceError:
                    found, cut = [], True
                rows = [] if cut else found
                out = pd.DataFrame(rows, columns=_COLUMNS)
                yield out.assign(minx=None, miny=None, maxx=None, maxy=None)
                if cut:
                    yield pd.DataFrame(
                        [(None, None, None, None, *box)],
                        columns=[*_COLUMNS, "minx", "miny", "maxx", "maxy"],
                    )

    inside = lambda boxes: [b for b in boxes if mask is None or box_meets(b, mask)]
    parts, chunks = [], inside(grid(area, 2, 2))
    if not chunks:
        return once(spark.createDataFrame([], _ROWS))
    for level in range(deepest):
        boxes = spark.createDataFrame(chunks, "minx double, miny double, maxx double, maxy double").repartition(len(chunks))
        got = store(
            boxes.mapInPandas(partial(run, last=level == deepest - 1), _ROWS + ", minx double, miny double, maxx double, maxy double"),
            "chunks",
        )
        parts.append(got.where("minx is null").select(*_COLUMNS))
        chunks = [q for r in got.where("minx is not null").select("minx", "miny", "maxx", "maxy").collect() for q in inside(grid(tuple(r), 2, 2))]
        if not chunks:
            return once(reduce(DataFrame.unionByName, parts))
    raise FeatureServiceError(f"{len(chunks)} chunks of {layer} fail or are cut off")


def _vector(raw: DataFrame) -> Vector:
    from gridloom.sources.vectors import _features

    return Vector(_features(raw.withColumn("srid", F.lit(SRID))).features, SRID)
