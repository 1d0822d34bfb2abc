"""What kind of dataset an input is, and datasets from any of them."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import SystemMismatchError
from gridloom.functions import clip
from gridloom.functions import geometry as G
from gridloom.functions.grid import RasterMeta
from gridloom.session import ship

# File name endings by kind.
VECTOR_FILES = (".shp", ".geojson", ".json", ".gpkg", ".gml", ".kml")
RASTER_FILES = (".tif", ".tiff", ".jp2", ".img", ".bil", ".bip", ".bsq", ".dem")
Box = tuple[float, float, float, float]
Rings = list[list[G.Point]]


@dataclass
class Vector:
    """Features: feature_id, polygon, attributes; srid or None."""

    features: DataFrame
    srid: int | None = None


@dataclass
class Raster:
    """Cells (band, row, col, value)."""

    cells: DataFrame
    meta: RasterMeta
    bands: int = 1


def kind_of(source: Any) -> str:
    """vector, raster, wfs, vector_frame, raster_array or raster_frame."""
    if isinstance(source, Vector):
        return "vector_frame"
    if isinstance(source, Raster):
        return "raster_frame"
    if isinstance(source, DataFrame):
        return "raster_frame" if {"row", "col", "value"} <= set(source.columns) else "vector_frame"
    if isinstance(source, np.ndarray):
        return "raster_array"
    if isinstance(source, Mapping):
        return "wfs"
    if isinstance(source, str | os.PathLike):
        name = os.fspath(source).lower()
        if name.endswith(VECTOR_FILES):
            return "vector"
        if name.endswith(RASTER_FILES):
            return "raster"
        if "://" not in name and not os.path.exists(source):
            raise FileNotFoundError(source)
    raise ValueError(f"not a dataset: {source!r}")


def array_cells(spark: SparkSession, values: np.ndarray, meta: RasterMeta | None) -> Raster:
    from gridloom.errors import RasterShapeError

    if meta is None:
        raise ValueError("an array needs its RasterMeta")
    if values.ndim not in (2, 3):
        raise RasterShapeError(f"a raster has two or three dimensions, not {values.ndim}")
    bands = values[None] if values.ndim == 2 else values
    b, r, c = (x.ravel() for x in np.indices(bands.shape))
    import pyarrow as pa

    table = pa.table({
        "band": pa.array(b, pa.int32()),
        "row": pa.array(r, pa.int32()),
        "col": pa.array(c, pa.int32()),
        "value": pa.array(bands.ravel().astype(np.int32)),
    })
    return Raster(spark.createDataFrame(table), meta, len(bands))


def _moved_rings(spark: SparkSession, rings: Rings, from_srid: int | None, to_srid: int | None) -> Rings:
    """Rings in another system."""
    if from_srid is None or to_srid is None or from_srid == to_srid:
        return rings
    points = spark.createDataFrame(
        [(i, j, float(x), float(y)) for i, ring in enumerate(rings) for j, (x, y) in enumerate(ring)],
        "i int, j int, x double, y double",
    )
    moved = {(r[0], r[1]): (r[2], r[3]) for r in points.select(
        "i",
        "j",
        *G.reproject(F.col("x"), F.col("y"), from_srid, to_srid),
    ).collect()}
    return [[moved[i, j] for j in range(len(ring))] for i, ring in enumerate(rings)]


def box_rings(bbox: Box) -> Rings:
    x0, y0, x1, y1 = bbox
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]


def load(
    spark: SparkSession,
    source: Any,
    srid: int | None = None,
    bbox: Box | None = None,
    mask: Rings | None = None,
    meta: RasterMeta | None = None,
    bbox_srid: int | None = None,
    mask_srid: int | None = None,
    **options: Any,
) -> Vector | Raster:
    """A dataset from a file, a service's mapping, an array or a DataFrame.

    ``srid``: the system to reproject features to. Features from memory and from services
    are cut to ``bbox`` and ``mask`` (rings of a polygon), which are reprojected if their systems are told and differ. From files, features
    that meet ``bbox`` are read whole, or without one those that meet ``mask``; with both, what was read is cut to
    ``mask``. There a box, or a mask alone, in another system is a SystemMismatchError, as it would find nothing. For rasters
    none of them counts.
    """
    from gridloom.sources import vectors, wfs
    from gridloom.sources.flat import ENDINGS, read_flat
    from gridloom.sources.tiff import read_raster

    what = kind_of(source)
    if what == "raster_array":
        return array_cells(spark, source, meta)
    if what == "raster":
        name = os.fspath(source)
        if name.lower().endswith(ENDINGS):
            return read_flat(spark, name)
        if not name.lower().endswith((".tif", ".tiff")):
            raise ValueError(f"{name}: of raster files GeoTIFF, BIL and USGS elevation models can be read; convert it to GeoTIFF first")
        return read_raster(spark, name)
    if what == "raster_frame":
        if isinstance(source, Raster):
            return source
        if meta is None:
            raise ValueError("cells need their RasterMeta")
        return Raster(source if "band" in source.columns else source.withColumn("band", F.lit(0)), meta)
    if what == "vector":
        near = bbox or (G.bounds_of(mask) if mask else None)
        found = vectors.read(spark, os.fspath(source), bbox=near, **options)
        if bbox and _differ(bbox_srid, found.srid):
            raise SystemMismatchError("box", bbox_srid, found.srid)
        if mask and not bbox and _differ(mask_srid, found.srid):
            raise SystemMismatchError("mask", mask_srid, found.srid)
        rows = found.features
        if bbox:
            rows = meets(rows, box_rings(bbox))
        if mask:
            rows = clipped(rows, _moved_rings(spark, mask, mask_srid, found.srid)) if bbox else meets(rows, mask)
        return _in_system(Vector(rows, found.srid), srid)
    if what == "wfs":
        missing = [k for k in ("url", "layer") if not source.get(k)]
        if missing:
            raise ValueError(f"a service needs {' and '.join(missing)}")
        asked = {k: source[k] for k in ("url", "layer", "filter_params", "auto_match") if k in source}
        there = lambda rings, known: _moved_rings(spark, rings, known, wfs.SRID)
        box = G.bounds_of(there(box_rings(bbox), bbox_srid or srid)) if bbox else None
        found = wfs.load(spark, **asked, bbox=box, mask=there(mask, mask_srid or srid) if mask else None)
    else:
        found = source if isinstance(source, Vector) else Vector(source)
    found = _in_system(found, srid)
    rows = found.features
    if bbox:
        rows = clipped(rows, _moved_rings(spark, box_rings(bbox), bbox_srid, found.srid))
    if mask:
        rows = clipped(rows, _moved_rings(spark, mask, mask_srid, found.srid))
    return Vector(rows, found.srid)


def _differ(a: int | None, b: int | None) -> bool:
    return a is not None and b is not None and a != b


def _in_system(found: Vector, srid: int | None) -> Vector:
    """Features in the wanted system; where theirs is not known it is taken to be that."""
    if _differ(srid, found.srid):
        return Vector(reprojected(found.features, found.srid, srid), srid)
    return Vector(found.features, found.srid if found.srid is not None else srid)


def reprojected(features: DataFrame, from_srid: int, to_srid: int) -> DataFrame:
    return features.withColumn("polygon", F.transform("polygon", lambda ring: F.transform(ring, lambda p: G.moved(p["x"], p["y"], from_srid, to_srid))))


def within_box(features: DataFrame, bbox: Box) -> DataFrame:
    """Features whose box meets a box."""
    b = G.bbox(F.col("polygon"))
    return features.where((b["minx"] <= bbox[2]) & (b["maxx"] >= bbox[0]) & (b["miny"] <= bbox[3]) & (b["maxy"] >= bbox[1]))


_SIDES = "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"


def _mask_row(spark: SparkSession, mask: Rings) -> DataFrame:
    """A mask as one row: its sides, and a corner of each ring. In a plan it stands as data, so its size doesn't grow the plan."""
    sides = [{"a": {"x": float(a[0]), "y": float(a[1])}, "b": {"x": float(b[0]), "y": float(b[1])}} for ring in mask for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    corners = [{"x": float(ring[0][0]), "y": float(ring[0][1])} for ring in mask if ring]
    return spark.createDataFrame([(sides, corners)], f"_sides {_SIDES}, _corners array<struct<x:double,y:double>>")


def _touch(own: Column, own_corners: Column, other: Column, other_corners: Column) -> Column:
    """Whether two areas meet, by their sides and corners: a corner of one in the other, or crossing sides.

    Of each ring one corner is enough, as a ring without crossing sides lies on one side of the other area.
    """
    side = lambda s, p: (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])
    beside = lambda s, t, v: F.greatest(s["a"][v], s["b"][v]) >= F.least(t["a"][v], t["b"][v])
    near = lambda s, t: beside(s, t, "x") & beside(t, s, "x") & beside(s, t, "y") & beside(t, s, "y")  # noqa: E731  (of sides on one line)
    crossing = F.exists(
        own,
        lambda s: F.exists(other, lambda t: near(s, t) & (side(s, t["a"]) * side(s, t["b"]) <= 0) & (side(t, s["a"]) * side(t, s["b"]) <= 0)),
    )
    within = lambda corners, sides: F.exists(corners, lambda p: G.inside(sides, p["x"], p["y"]))
    return within(own_corners, other) | within(other_corners, own) | crossing


def meets(features: DataFrame, mask: Rings) -> DataFrame:
    """Features that meet a polygon of any number of rings, in any order."""
    near = within_box(features, G.bounds_of(mask)).crossJoin(F.broadcast(_mask_row(features.sparkSession, mask)))  # one row, as large as the mask
    found = near.where(_touch(G.sides_of(F.col("polygon")), F.flatten("polygon"), F.col("_sides"), F.col("_corners")))
    return found.drop("_sides", "_corners")


def meets_any(features: DataFrame, masks: DataFrame, key: str = "feature_id") -> DataFrame:
    """Features that meet at least one of many masks (polygon): a semi-join, however many masks there are.

    Every box is filed in cells of a power-of-two side, at the level at which the side is no less than the box, so it touches at most four.
    Boxes of a level also look into the coarser levels in use above their own, so each pair of boxes that meet shares a cell, and
    large masks are not copied into many cells. Candidates are then compared exactly; features without corners or
    with a null polygon meet none. ``key`` tells features apart; rows that repeat stay.
    """
    ends = lambda name: G.bbox(F.col(name))
    mine = features.where(F.size("polygon") > 0).select(F.col(key).alias("_key"), F.col("polygon").alias("_own")).withColumn("_b", ends("_own"))
    theirs = masks.where(F.size("polygon") > 0).select(F.col("polygon").alias("_mask")).withColumn("_m", ends("_mask"))
    level = lambda b: F.ceil(F.log2(F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"], F.lit(2.0**-20)))).cast("int")
    theirs = theirs.withColumn("_level", level(F.col("_m")))
    mine = mine.withColumn("_level", level(F.col("_b")))
    used = lambda df: [r[0] for r in df.select("_level").distinct().collect()]  # noqa: E731  (at most a few dozen powers of two)
    levels = sorted({*used(theirs), *used(mine)})
    if not levels:
        return features.limit(0)
    known = F.array(*map(F.lit, levels))

    def filed(df: DataFrame, box: str, at: Column) -> DataFrame:
        """A row for each level in ``at`` and each cell there that a box touches; at its own level or above these are at most four."""
        df = df.withColumn("_at", F.explode(at))
        step = F.pow(F.lit(2.0), F.col("_at"))
        span = lambda low, high: F.sequence(F.floor(F.col(box)[low] / step), F.floor(F.col(box)[high] / step))
        return df.withColumn("_x", F.explode(span("minx", "maxx"))).withColumn("_y", F.explode(span("miny", "maxy")))

    coarser = lambda strict: F.filter(known, lambda v: v > F.col("_level") if strict else v >= F.col("_level"))
    own_level = F.array(F.col("_level"))
    # A pair meets at the coarser of its two levels: either the mask's, or the feature's if that is strictly coarser.
    at = ["_at", "_x", "_y"]
    boxes = lambda df: df.where(
        (F.col("_b.minx") <= F.col("_m.maxx")) & (F.col("_b.maxx") >= F.col("_m.minx")) & (F.col("_b.miny") <= F.col("_m.maxy")) & (F.col("_b.maxy") >= F.col("_m.miny"))
    )
    one = filed(mine, "_b", coarser(False)).drop("_level").join(filed(theirs, "_m", own_level).drop("_level"), at)
    two = filed(mine, "_b", own_level).drop("_level").join(filed(theirs, "_m", coarser(True)).drop("_level"), at)
    near = boxes(one.unionByName(two))
    hit = near.where(_touch(G.sides_of(F.col("_own")), F.flatten("_own"), G.sides_of(F.col("_mask")), F.flatten("_mask")))
    return features.join(hit.select(F.col("_key").alias(key)).distinct(), key, "left_semi")


def clipped(features: DataFrame, mask: Rings) -> DataFrame:
    """Features cut to a polygon of any shape, by the even-odd rule; those outside it go.

    A feature stays one row. An area is then its outer rings (counter-clockwise), each followed by
    its holes (clockwise); a line keeps each stretch inside or along a side as one; points
    stay if they are inside. A feature wholly inside stays as it is, and what only touches the polygon goes.
    ``geometry_type``, if there, tells which is which and becomes the one of many parts or of one;
    without it features are areas. Other columns pass unchanged.
    """
    ship(features.sparkSession)
    sides = clip.sides_of([np.array(ring, float) for ring in mask if len(ring)])
    if not len(sides):
        return features.limit(0)
    near = within_box(features, G.bounds_of(mask))
    return near.mapInArrow(_cut(sides), near.schema)


def _cut(mask: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch["geometry_type"].to_pylist() if "geometry_type" in batch.schema.names else [None] * batch.num_rows
            rows, polygons, names = [], [], []
            for row, (kind, rings) in enumerate(zip(kinds, _point_arrays(batch["polygon"]), strict=True)):
                plain = (kind or "Polygon").removeprefix("Multi")
                if plain == "Point":
                    found = clip.points_in(rings, mask)
                    parts = sum(map(len, found))
                else:
                    found = (clip.line_in if plain == "LineString" else clip.area_in)(rings, mask)
                    parts = len(found or ()) if plain == "LineString" else sum(clip.twice_area(r) > 0 for r in found or ())
                if found is None or found:
                    rows.append(row)
                    polygons.append(rings if found is None else found)
                    names.append(kind if found is None or kind is None else ("Multi" if parts > 1 else "") + plain)
            if rows:
                kept = batch.take(pa.array(rows))
                new = {"polygon": _point_lists(polygons, batch.schema.field("polygon").type), "geometry_type": pa.array(names, pa.string())}
                yield pa.RecordBatch.from_arrays([new.get(n, kept[n]) for n in kept.schema.names], kept.schema.names)

    return run


def _point_arrays(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The rings of each row, [point, (x, y)]; the column holds no nulls."""
    rings = column.flatten()
    points = rings.flatten()
    xy = np.stack([points.field(n).to_numpy(zero_copy_only=False) for n in ("x", "y")], 1)
    ends = np.cumsum(np.concatenate([[0], rings.value_lengths().to_numpy(zero_copy_only=False)]))
    at = 0
    for many in column.value_lengths().to_pylist():
        yield [xy[a:b] for a, b in zip(ends[at : at + many], ends[at + 1 : at + many + 1], strict=True)]
        at += many


def _point_lists(polygons: list[list[np.ndarray]], kind: pa.DataType) -> pa.Array:
    rings = [ring for polygon in polygons for ring in polygon]
    xy = np.concatenate(rings)
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(ends(map(len, polygons)), pa.ListArray.from_arrays(ends(map(len, rings)), points)).cast(kind)
