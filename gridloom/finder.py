"""The whole way from a dataset and route ends to paths."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import NoPathFoundError
from gridloom.functions.neighborhood import Step
from gridloom.operators import blocks
from gridloom.operators import costs as C
from gridloom.operators import metrics as M
from gridloom.operators import raster as R
from gridloom.operators import route
from gridloom.operators.search import Heuristic
from gridloom.sources import costs as cost_files
from gridloom.sources import export
from gridloom.sources.detect import Raster, Vector, load
from gridloom.sources.tiff import write_raster

Point = tuple[float, float]


def points(value: Any) -> Point | list[Point]:
    """Route ends in any shape: one as a tuple, several as a list of tuples; one in a list counts as one."""
    if isinstance(value, DataFrame):
        value = [tuple(r) for r in value.select("x", "y").collect()]
    if hasattr(value, "geoms"):
        value = [(p.x, p.y) for p in value.geoms]
    elif hasattr(value, "x") and hasattr(value, "y") and np.isscalar(value.x):
        value = (value.x, value.y)
    elif hasattr(value, "geometry"):
        value = [(p.x, p.y) for p in value.geometry]
    try:
        array = np.asarray(value, float)
    except (TypeError, ValueError) as cause:
        raise ValueError(f"not coordinates: {value!r}") from cause
    if array.shape == (2,):
        return float(array[0]), float(array[1])
    if array.ndim == 2 and array.shape[1] == 2 and len(array):
        found = [(float(x), float(y)) for x, y in array]
        return found[0] if len(found) == 1 else found
    raise ValueError(f"not coordinates: {value!r}")


def _list(p: Point | list[Point]) -> list[Point]:
    return [p] if isinstance(p, tuple) else p


class PathFinder:
    """Paths of least cost over a raster, or over features with costs.

    ``overlays`` change the raster in order; ``buffer`` bounds the search space around the ends
    (None: estimated). Metrics are in cells of band 0, routes in ``band``.
    """

    def __init__(
        self,
        spark: SparkSession,
        dataset: Any,
        sources: Any,
        targets: Any,
        costs: Any = None,
        overlays: Sequence[dict] = (),
        neighborhood: int | str | Sequence[Step] = 2,
        buffer: float | None = None,
        pixel_area: float = 1.0,
        band: int = 0,
        ignore_max: bool = True,
        **options: Any,
    ) -> None:
        self.spark, self.steps, self.ignore_max = spark, neighborhood, ignore_max
        self.sources, self.targets = points(sources), points(targets)
        self.runtimes: dict[str, float] = {}
        self._held: list[DataFrame] = []
        self.packed: blocks.Blocks | None = None
        data = self._timed("loading", lambda: load(spark, dataset, **options))
        if isinstance(data, Vector):
            began = time.perf_counter()
            if costs is None and "cost" not in data.features.columns:
                raise ValueError("features need costs")
            rows = C.apply_costs(data.features, cost_files.load(spark, costs)) if costs is not None else data.features
            b = R.total_bounds(rows).first()
            meta = R.output_meta(tuple(b), pixel_area, data.srid)
            packed = blocks.rasterized(rows, meta)
            data = Raster(packed.cells().withColumn("band", F.lit(0)), meta)
            if not any(step.get("buffer") for step in overlays):
                self.packed = packed.painted([one for step in overlays for one in blocks.steps_of(**step)]) if overlays else packed
            self.runtimes["rasterizing"] = time.perf_counter() - began
        self.raster = data
        plain = data.cells.where(F.col("band") == band).select("row", "col", "value")
        self.cells = self.packed.cells() if self.packed else R.overlays(plain, data.meta, overlays)
        ends = _list(self.sources) + _list(self.targets)
        self.buffer = buffer if buffer is not None else R.estimate_buffer(self.cells, data.meta, _list(self.sources), _list(self.targets))
        if self.packed:  # the window's tiles, masked where they lie
            part = self.packed.crop(*R.search_window(data.meta, ends, self.buffer)).masked(R.hull_of(ends), self.buffer)
            self.window, self.meta = part.cells(), part.meta
        else:
            self.window, self.meta = R.search_space(self.cells, data.meta, ends, self.buffer)
        self.window = self._hold(self.window)
        self._timed("search_space", self.window.count)
        self.paths: DataFrame | None = None

    def _timed(self, name: str, what: Callable[[], Any]) -> Any:
        start = time.perf_counter()
        out = what()
        self.runtimes[name] = time.perf_counter() - start
        return out

    def find(
        self,
        sources: Any = None,
        targets: Any = None,
        algorithm: str = "dijkstra",
        pairwise: bool = False,
        heuristic_weight: float = 1.0,
        metrics: bool = True,
        heuristic: Heuristic | None = None,
        heuristic_radius: int | None = None,
    ) -> DataFrame:
        """Path records; pairs without a path are left out, but a single one raises NoPathFoundError."""
        a = points(sources) if sources is not None else self.sources
        b = points(targets) if targets is not None else self.targets
        wanted = route.requests(self.spark, [self.meta.node(*p) for p in _list(a)], [self.meta.node(*p) for p in _list(b)], pairwise)
        found = route.solve(
            self.window,
            self.meta.height,
            self.meta.width,
            wanted,
            self.steps,
            algorithm,
            self.ignore_max,
            heuristic_weight,
            heuristic,
            heuristic_radius,
        )
        found = self._hold(found)
        self._timed("shortest_path", found.count)
        hits = route.reached(found).select(
            F.col("ord").alias("path_id"),
            F.lit(getattr(algorithm, "__name__", algorithm)).alias("algorithm"),
            "source",
            "target",
            "cost",
            "node_ids",
        )
        if isinstance(a, tuple) and isinstance(b, tuple) and hits.isEmpty():
            raise NoPathFoundError(a, b)
        if metrics:
            hits = self._timed(
                "metrics",
                lambda: self._hold(M.records(hits, M.length_by_category(hits, self.window, self.meta.width), self.meta)),
            )
        self.runtimes["total"] = sum(v for k, v in self.runtimes.items() if k != "total")
        self.paths = hits.withColumn("runtimes", F.create_map(*[F.lit(x) for kv in self.runtimes.items() for x in kv]))
        return self.paths

    def get(self, path_id: int | None = None, source: Point | None = None, target: Point | None = None) -> DataFrame:
        """A path by its id, or the first one between two points."""
        if self.paths is None:
            raise ValueError("no paths yet")
        if path_id is not None:
            return self.paths.where(F.col("path_id") == path_id)
        return self.paths.where((F.col("source") == self.meta.node(*source)) & (F.col("target") == self.meta.node(*target))).orderBy("path_id").limit(1)

    def save_paths(self, path: str | None) -> None:
        if self.paths is not None:
            export.save(self.paths, path)

    def save_raster(self, path: str = "raster.tif", window: bool = False) -> None:
        """The raster with its overlays, or the masked search window."""
        write_raster(self.window if window else self.cells, self.meta if window else self.raster.meta, path)

    def _hold(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist())
        return df

    def close(self) -> None:
        """Release the window and the results of every ``find``."""
        while self._held:
            self._held.pop().unpersist()


def add_paths(collection: DataFrame, new: DataFrame, replace: bool = True) -> DataFrame:
    """A collection with more paths; those of known ids replace the old ones, or get new ids."""
    if replace:
        return collection.join(new.select("path_id"), "path_id", "left_anti").unionByName(new)
    top = (collection.agg(F.max("path_id")).first()[0] or 0) + 1
    return collection.unionByName(new.withColumn("path_id", F.col("path_id") + top))


def contains_paths(collection: DataFrame, other: DataFrame) -> bool:
    """Whether every path of ``other`` (source, target, node_ids) is in a collection."""
    names = ["source", "target", "node_ids"]
    return other.select(*names).exceptAll(collection.select(*names)).isEmpty()


def straight(a: Point, b: Point) -> float:
    return math.dist(a, b)
