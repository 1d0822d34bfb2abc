"""Path records to files: GeoJSON and CSV text by Spark's sinks, or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_geojson(records: DataFrame) -> DataFrame:
    """(value): a GeoJSON feature for each path."""
    line = F.transform("coords", lambda p: F.array(p["x"], p["y"]))
    rest = [c for c in records.columns if c not in ("coords", "geometry")]
    geometry = F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))
    return records.select(F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        geometry.alias("geometry"),
        F.struct(*rest).alias("properties"),
    )).alias("value"))


def save(records: DataFrame, path: str | None) -> None:
    """Write by ending: .geojson (a feature in each line), .csv, or Parquet; nothing without a path."""
    if not path:
        return
    if path.lower().endswith((".geojson", ".json")):
        as_geojson(records).write.mode("overwrite").text(path)
    elif path.lower().endswith(".csv"):
        flat = records.select(*[F.to_json(c).alias(c) if not isinstance(records.schema[c].dataType.typeName(), str) or records.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in records.columns])
        flat.write.mode("overwrite").option("header", "true").csv(path)
    else:
        records.write.mode("overwrite").parquet(path)
