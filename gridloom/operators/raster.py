"""Rasters as cells (row, col, value): painting features, overlays, windows, masks, buffers.

Features are (feature_id, polygon, cost, ...). Cells meet features through tiles: a
feature goes to the tiles its box touches, a tile's cells are tested there, so no join compares
all cells with all features.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions.grid import FORBIDDEN, RasterMeta, line_cells, x_of, y_of
from gridloom.operators import blocks
from gridloom.operators.costs import CostTable, apply_costs
from gridloom.session import store

#: The side of a tile in cells.
TILE = 64


def synthetic(spark: SparkSession, height: int, width: int, pattern: str = "gradient", band: int = 0) -> DataFrame:
    """(band, row, col, value): gradient, checkerboard, or seeded random integers of 1 to 9."""
    r, c = F.floor(F.col("id") / width).cast("int"), F.pmod("id", F.lit(width)).cast("int")
    if pattern == "gradient":
        value = F.floor((c + r) / F.lit(float(width + height)) * 100 + 10 * band)
    elif pattern == "checkerboard":
        value = F.pmod(r + c + band, F.lit(2)) * 50 + 25
    elif pattern == "random":
        value = F.pmod(F.xxhash64("id", F.lit(1234 + band)), F.lit(9)) + 1
    else:
        raise ValueError(f"no such pattern: {pattern}")
    return spark.range(height * width).select(F.lit(band).alias("band"), r.alias("row"), c.alias("col"), value.cast("int").alias("value"))


def all_cells(spark: SparkSession, meta: RasterMeta) -> DataFrame:
    n = F.col("id")
    return spark.range(meta.height * meta.width).select(
        F.floor(n / meta.width).cast("int").alias("row"),
        F.pmod(n, F.lit(meta.width)).cast("int").alias("col"),
    )


def output_meta(bounds: tuple[float, float, float, float], pixel_area: float, srid: int | None = None) -> RasterMeta:
    """Shape and transform for bounds, with pixels of about ``pixel_area``.

    Rows and columns are cut to whole numbers; one more goes to the longer axis if they hold
    fewer pixels than the area asks for. Pixels then share the bounds, so they may not be square.
    """
    minx, miny, maxx, maxy = bounds
    edge = math.sqrt(pixel_area)
    rows, cols = max(1, int((maxy - miny) / edge)), max(1, int((maxx - minx) / edge))
    if rows * cols < int((maxx - minx) * (maxy - miny) / pixel_area):
        rows, cols = (rows + 1, cols) if maxy - miny >= maxx - minx else (rows, cols + 1)
    return RasterMeta(rows, cols, (maxx - minx) / cols, 0.0, minx, 0.0, -(maxy - miny) / rows, maxy, srid)


def total_bounds(features: DataFrame) -> DataFrame:
    """One row: minx, miny, maxx, maxy of all polygons."""
    b = features.select(G.bbox(F.col("polygon")).alias("b"))
    return b.agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))


def covered(features: DataFrame, meta: RasterMeta, buffer: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """(row, col, keep...): a row for each cell whose centre lies in a feature, or within ``buffer`` of it.

    A feature is cut into the tiles of its box, and only the cells of these are made and
    tested.
    """
    box = features.select(*keep, G.sides_of(F.col("polygon")).alias("sides"), G.bbox(F.col("polygon")).alias("b"))
    rows = [(F.col(y) - meta.f) / meta.e for y in ("b.miny", "b.maxy")]
    cols = [(F.col(x) - meta.c) / meta.a for x in ("b.minx", "b.maxx")]
    pad_r, pad_c = abs(buffer / meta.e), abs(buffer / meta.a)
    low = lambda p, pad: F.greatest(F.lit(0), F.floor(F.least(*p) - pad - 1)).cast("int")
    high = lambda p, pad, n: F.least(F.lit(n - 1), F.ceil(F.greatest(*p) + pad)).cast("int")
    box = box.select(
        *keep,
        "sides",
        low(rows, pad_r).alias("r0"),
        high(rows, pad_r, meta.height).alias("r1"),
        low(cols, pad_c).alias("c0"),
        high(cols, pad_c, meta.width).alias("c1"),
    )
    box = box.where("r0 <= r1 and c0 <= c1")
    tile = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE), F.floor(F.col(b) / TILE)))
    cut = box.withColumn("tr", tile("r0", "r1")).withColumn("tc", tile("c0", "c1"))
    span = lambda lo, hi, t: F.explode(F.sequence(
        F.greatest(F.col(lo), F.col(t) * TILE).cast("int"),
        F.least(F.col(hi), F.col(t) * TILE + (TILE - 1)).cast("int"),
    ))
    cells = cut.withColumn("row", span("r0", "r1", "tr")).withColumn("col", span("c0", "c1", "tc"))
    x, y = x_of(F.col("row"), F.col("col"), meta, centre=True), y_of(F.col("row"), F.col("col"), meta, centre=True)
    test = G.inside(F.col("sides"), x, y) if buffer <= 0 else G.polygon_distance(F.col("sides"), x, y) <= buffer
    return cells.where(test).select("row", "col", *keep)


def burn_value(cost: Column, fill: int = FORBIDDEN) -> Column:
    """A cost as a cell value: missing becomes ``fill``, halves go to the even number."""
    return F.bround(F.coalesce(cost, F.lit(float(fill))), 0).cast("int")


def rasterize(features: DataFrame, meta: RasterMeta, fill: int = FORBIDDEN, buffer: float = 0.0) -> DataFrame:
    """(row, col, value) for every cell: the highest cost of the features over it, else ``fill``.

    Cells are painted in packed tiles; only features travel. Buffers and rasters that don't follow the axes are tested cell by cell.
    """
    if not buffer and blocks.paintable(meta):
        return blocks.rasterized(features, meta, fill).cells()
    painted = covered(features.withColumn("value", burn_value(F.col("cost"), fill)), meta, buffer, ["value"])
    top = painted.groupBy("row", "col").agg(F.max("value").alias("value"))
    return all_cells(features.sparkSession, meta).join(top, ["row", "col"], "left").select(
        "row",
        "col",
        F.coalesce("value", F.lit(fill)).alias("value"),
    )


def _packable(cells: DataFrame, meta: RasterMeta) -> bool:
    """Whether cells can be packed into tiles: one band of whole numbers, along the axes."""
    return blocks.paintable(meta) and set(cells.columns) == {"row", "col", "value"} and dict(cells.dtypes)["value"] in ("tinyint", "smallint", "int")


def _painted(cells: DataFrame, meta: RasterMeta, steps: list[blocks.Step]) -> DataFrame:
    return blocks.Blocks.of_cells(cells, meta).painted(steps).cells().select(*cells.columns)


def overlay(
    cells: DataFrame,
    features: DataFrame,
    meta: RasterMeta,
    value: float,
    multiply: bool = False,
    ignore: int | None = FORBIDDEN,
    wrap: bool = False,
    buffer: float = 0.0,
) -> DataFrame:
    """Set the cells inside features to a value, or multiply them; those that hold ``ignore`` stay.

    Products are cut to whole numbers and to 65535, or wrap around it as 16-bit numbers do.
    """
    if not buffer and _packable(cells, meta):
        return _painted(cells, meta, blocks.steps_of(features, ignore=ignore, value=value, multiply=multiply, wrap=wrap))
    inside = covered(features, meta, buffer).distinct().withColumn("hit", F.lit(True))
    new = F.floor(F.col("value") * F.lit(float(value))) if multiply else F.lit(int(value))
    new = (F.pmod(new, F.lit(65536)) if wrap else F.least(new, F.lit(FORBIDDEN))).cast("int")
    hit = F.col("hit") & ((F.col("value") != ignore) if ignore is not None else F.lit(True))
    return cells.join(inside, ["row", "col"], "left").withColumn("value", F.when(hit, new).otherwise(F.col("value"))).drop("hit").select(*cells.columns)


def overlay_costs(
    cells: DataFrame,
    features: DataFrame,
    meta: RasterMeta,
    costs: CostTable | None = None,
    ignore: int | None = FORBIDDEN,
    ordinal: str = "feature_id",
    buffer: float = 0.0,
) -> DataFrame:
    """Paint features by their costs: each distinct cost in the order of its first feature, the last one wins.

    A cell that holds ``ignore``, from before or painted so, is painted no more. Features
    without a cost, and costs of 0, paint nothing.
    """
    if not buffer and _packable(cells, meta):
        return _painted(cells, meta, blocks.steps_of(features, ordinal, costs, ignore))
    priced = (apply_costs(features, costs) if costs else features).where("cost is not null and not isnan(cost) and cost <> 0")
    order = priced.groupBy("cost").agg(F.min(ordinal).alias("ord"))
    painted = covered(priced.join(order, "cost"), meta, buffer, ["ord", "cost"])
    # One struct for each cost; there are as many as distinct costs over a cell.
    stack = painted.groupBy("row", "col").agg(F.array_sort(F.collect_set(F.struct("ord", "cost"))).alias("stack"))
    old = F.col("value")

    def paint(now: Column, s: Column) -> Column:
        new = F.least(F.floor(s["cost"]), F.lit(FORBIDDEN)).cast("int")
        return new if ignore is None else F.when(now == ignore, now).otherwise(new)

    out = cells.join(stack, ["row", "col"], "left")
    return out.withColumn("value", F.when(F.col("stack").isNull(), old).otherwise(F.aggregate("stack", old, paint))).select(*cells.columns)


def overlay_zones(
    cells: DataFrame,
    features: DataFrame,
    meta: RasterMeta,
    value: float,
    multiply: bool = False,
    zone_col: str | None = None,
    forbidden_zone: str | None = None,
    forbidden_value: int = FORBIDDEN,
    ignore: int | None = FORBIDDEN,
) -> DataFrame:
    """One value for all zones; with a zone column, first the other zones, then the forbidden one."""
    if zone_col is None or forbidden_zone is None:
        return overlay(cells, features, meta, value, multiply, ignore)
    zone = F.col(f"`{zone_col}`")
    first = overlay(cells, features.where(zone != forbidden_zone), meta, value, multiply, ignore)
    return overlay(first, features.where(zone == forbidden_zone), meta, forbidden_value, False, ignore)


def overlays(cells: DataFrame, meta: RasterMeta, steps: Sequence[dict]) -> DataFrame:
    """Overlays in order; each a mapping with ``features`` and the arguments of one of the three above.

    Without buffers, all of them are painted in one pass over packed tiles.
    """
    if steps and _packable(cells, meta) and not any(s.get("buffer") for s in steps):
        return _painted(cells, meta, [one for s in steps for one in blocks.steps_of(**s)])
    for step in steps:
        args = {k: v for k, v in step.items() if k != "features"}
        how = overlay_zones if "zone_col" in args else overlay if "value" in args else overlay_costs
        cells = how(cells, step["features"], meta, **args)
    return cells


def shrink_bounds(cells: DataFrame, value: int = FORBIDDEN) -> DataFrame:
    """row0, row1, col0, col1 of the cells of another value, ends included (null if there is none)."""
    other = cells.where(F.col("value") != value)
    return other.agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def shrink(cells: DataFrame, meta: RasterMeta, value: int = FORBIDDEN) -> tuple[DataFrame, RasterMeta]:
    """Cut off the border of ``value``; a raster of nothing else stays as it is."""
    b = shrink_bounds(cells, value).first()
    if b["row0"] is None:
        return cells, meta
    return crop(cells, meta, b["row0"], b["row1"] + 1, b["col0"], b["col1"] + 1)


def crop(cells: DataFrame, meta: RasterMeta, row0: int, row1: int, col0: int, col1: int) -> tuple[DataFrame, RasterMeta]:
    """The window of half-open ranges, renumbered from 0; the ranges reach the scan as filters."""
    inside = cells.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))
    return inside.withColumn("row", F.col("row") - row0).withColumn("col", F.col("col") - col0), meta.window(row0, col0, row1 - row0, col1 - col0)


def hull_of(points: Sequence[G.Point]) -> list[G.Point]:
    """What the search space surrounds: a point, a segment, or the convex hull."""
    return G.convex_hull(points)


def near_hull(hull: Sequence[G.Point], buffer: float, x: Column, y: Column) -> Column:
    """Whether a point is within ``buffer`` of a hull."""
    if len(hull) == 1:
        return F.hypot(x - hull[0][0], y - hull[0][1]) <= buffer
    if len(hull) == 2:
        return G.segment_distance(x, y, *[F.lit(float(v)) for p in hull for v in p]) <= buffer
    return G.polygon_distance(G.sides_of(G.literal_polygon([hull])), x, y) <= buffer


def search_window(meta: RasterMeta, points: Sequence[G.Point], buffer: float) -> tuple[int, int, int, int]:
    """row0, row1, col0, col1 (half open) of the buffered hull, inside the raster."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    a, b = meta.index(min(xs) - buffer, max(ys) + buffer), meta.index(max(xs) + buffer, min(ys) - buffer)
    (r0, r1), (c0, c1) = sorted((a[0], b[0])), sorted((a[1], b[1]))
    clamp = lambda v, n: min(max(v, 0), n)
    return clamp(r0, meta.height), clamp(r1, meta.height), clamp(c0, meta.width), clamp(c1, meta.width)


def search_space(
    cells: DataFrame,
    meta: RasterMeta,
    points: Sequence[G.Point],
    buffer: float,
    outside: int = FORBIDDEN,
) -> tuple[DataFrame, RasterMeta]:
    """The window around points; its cells outside the buffered hull become ``outside``."""
    part, small = crop(cells, meta, *search_window(meta, points, buffer))
    return mask(part, small, hull_of(points), buffer, outside), small


def mask(
    cells: DataFrame,
    meta: RasterMeta,
    hull: Sequence[G.Point],
    buffer: float,
    outside: int = FORBIDDEN,
    bands: Sequence[int] | None = None,
) -> DataFrame:
    """Cells whose centre is not within ``buffer`` of the hull become ``outside``, in all or some bands."""
    x, y = x_of(F.col("row"), F.col("col"), meta, centre=True), y_of(F.col("row"), F.col("col"), meta, centre=True)
    out = ~near_hull(hull, buffer, x, y)
    if bands is not None:
        out = out & F.col("band").isin(list(bands))
    return cells.withColumn("value", F.when(out, F.lit(outside)).otherwise(F.col("value")))


def farthest_pair(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: sx, sy, tx, ty, distance of the source and target farthest apart.

    Both are corners of their tables' convex hulls. Tasks reduce their points to hulls, and one
    task compares the corners of what is left.
    """
    from collections.abc import Iterator

    import pandas as pd

    from gridloom.session import ship

    ship(sources.sparkSession)
    both = sources.select(F.lit(0).alias("side"), "x", "y").unionAll(targets.select(F.lit(1), "x", "y"))

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {0: [], 1: []}
        for pdf in batches:
            for side in held:
                own = pdf[pdf["side"] == side]
                held[side] = G.convex_hull([*held[side], *zip(own["x"], own["y"], strict=True)])
        yield pd.DataFrame([(side, *p) for side, hull in held.items() for p in hull], columns=["side", "x", "y"])

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(corners(batches)))
        a, b = ([tuple(p) for p in rows.loc[rows["side"] == s, ["x", "y"]].to_numpy()] for s in (0, 1))
        if a and b:
            p, q = max(((p, q) for p in a for q in b), key=lambda pq: math.dist(*pq))
            yield pd.DataFrame([(*p, *q, math.dist(p, q))], columns=["sx", "sy", "tx", "ty", "distance"])

    return both.mapInPandas(corners, "side int, x double, y double").repartition(1).mapInPandas(
        farthest,
        "sx double, sy double, tx double, ty double, distance double",
    )


#: Points of a leaf of the quadtree, its levels (of 16 children each), and bits of an axis.
LEAF, LEVELS, BITS = 16, 13, 26


def _spread(c: Column) -> Column:
    """The bits of a number, a gap between each two."""
    for shift, kept in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(kept))
    return c


def _quadtree(others: DataFrame, low: tuple[float, float], span: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: level, prefix, parent, n, box, split; others with level and prefix of their leaf).

    A node is split if it holds more than LEAF others, so dense spots have small leaves. Of others at one place only the k smallest ids can matter.
    """
    from pyspark.sql.window import Window

    at_once = Window.partitionBy("x", "y").orderBy("id")
    rows = others.select("id", "x", "y").withColumn("_n", F.row_number().over(at_once)).where(F.col("_n") <= k).drop("_n")
    step = lambda c, zero: F.least(F.floor((F.col(c) - zero) / span * float(1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
    code = _spread(step("x", low[0])).bitwiseOR(F.shiftleft(_spread(step("y", low[1])), 1))
    prefix = lambda level: F.expr(f"shiftright(code, 4 * ({LEVELS} - {level}))")
    levels = F.array(*[F.struct(F.lit(i).alias("level"), prefix(i).alias("prefix")) for i in range(LEVELS + 1)])
    filed = rows.withColumn("code", code).withColumn("at", F.explode(levels)).select("id", "x", "y", "at.level", "at.prefix")
    found = filed.groupBy("level", "prefix").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    found = store(found.withColumn("split", (F.col("n") > LEAF) & (F.col("level") < LEVELS)), "quadtree")
    parents = found.where("split").select((F.col("level") + 1).alias("level"), F.col("prefix").alias("parent"))
    nodes = found.withColumn("parent", F.shiftright("prefix", 4)).join(parents, ["level", "parent"], "left_semi")
    nodes = store(nodes.unionByName(found.where("level = 0").withColumn("parent", F.lit(-1).cast("long"))), "nodes")
    leaves = nodes.where("not split").select("level", "prefix")
    held = filed.withColumnsRenamed({"id": "other", "x": "ox", "y": "oy"}).join(leaves, ["level", "prefix"], "left_semi")
    return nodes, held


def _candidates(points: DataFrame, others: DataFrame, k: int) -> DataFrame | None:
    """(id, other, distance): for each point the others of those leaves that may hold one of its k nearest.

    From the root on, a point keeps the nodes whose box is no farther than the farthest corner of boxes that hold k others
    together; kept nodes give way to their children until all are leaves, two levels of the tree at a time.
    """
    from pyspark.sql.window import Window

    box = lambda df: df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    b = box(others)
    if b[0] is None:
        return None
    nodes, held = _quadtree(others, (b[0], b[2]), max(b[1] - b[0], b[3] - b[2]) or 1.0, k)
    outside = lambda low, high, v: F.greatest(F.col(low) - F.col(v), F.col(v) - F.col(high), F.lit(0.0))
    across = lambda low, high, v: F.greatest(F.abs(F.col(low) - F.col(v)), F.abs(F.col(high) - F.col(v)))
    columns = ["id", "x", "y", "level", "prefix", "n", "split", "least", "most"]

    def measured(df: DataFrame) -> DataFrame:
        near, far = (F.hypot(f("x0", "x1", "x"), f("y0", "y1", "y")) for f in (outside, across))
        return df.withColumn("least", near).withColumn("most", far).select(*columns)

    root = nodes.where("level = 0").drop("parent")
    now = measured(points.select("id", "x", "y").crossJoin(F.broadcast(root)))  # one row
    for _ in range(LEVELS):
        children = nodes.select((F.col("level") - 1).alias("level"), F.col("parent").alias("prefix"), F.col("prefix").alias("_own"), "n", "split", "x0", "x1", "y0", "y1")
        below = now.where("split").select("id", "x", "y", "level", "prefix").join(children, ["level", "prefix"])
        below = measured(below.withColumn("level", F.col("level") + 1).withColumn("prefix", F.col("_own")))
        both = now.where("not split").unionByName(below)
        by_far = Window.partitionBy("id").orderBy("most", "level", "prefix").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_sum", F.sum("n").over(by_far))
        reach = F.min(F.when(F.col("_sum") >= k, F.col("most"))).over(Window.partitionBy("id"))
        both = both.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("least") <= F.col("_reach")))
        now = store(both.select(*columns), "frontier")
        if now.where("split").isEmpty():
            break
    met = now.select("id", "x", "y", "level", "prefix").join(held, ["level", "prefix"])
    return met.select("id", "other", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")).alias("distance"))


def nearest(points: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(id, other, distance, rank): the k nearest others of each point, the smaller id first at equal distances.

    Points and others are (id, x, y); ids of points tell them apart. A quadtree over the others follows their density, so a
    point is compared with few of them wherever it lies, dense spots and far outliers included. Rows without coordinates
    have no neighbours and are none.
    """
    from pyspark.sql.window import Window

    known = lambda df: df.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    found = _candidates(known(points), known(others), k)
    if found is None:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("other", "long"), ("distance", "double"), ("rank", "int"))]
        return points.select("id", *none).limit(0)
    first = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def buffer_width(distance: float, obstacle_ratio: float, variation: float) -> int:
    """The search buffer for a distance, the share of obstacles on the line, and the costs' variation."""
    base = 200 + min(1.0, distance / 10_000) * 3800 * 0.5
    wide = base * (1 + 0.5 * min(1.0, 2 * variation) + min(1.0, 5 * obstacle_ratio))
    return int(min(4000.0, max(200.0, wide)))


def buffer_statistics(
    cells: DataFrame,
    meta: RasterMeta,
    source: G.Point,
    target: G.Point,
    samples: int = 1000,
    box: int = 50,
) -> DataFrame:
    """One row: obstacle_ratio on the line between two points, and the costs' variation around it.

    Up to ``samples`` cells of the line are looked at. The variation is the mean over these of
    standard deviation by mean of the free cells in boxes of ``box`` cells to each side.
    """
    a, b = meta.index(*source), meta.index(*target)
    spark = cells.sparkSession
    line = spark.range(1).select(F.posexplode(line_cells(*map(F.lit, (*a, *b)))).alias("i", "p"))
    n = max(abs(a[0] - b[0]), abs(a[1] - b[1])) + 1
    every = -(-n // samples)
    line = line.where(F.col("i") % every == 0).select(F.col("i").alias("at"), F.col("p.row").alias("r"), F.col("p.col").alias("c"))
    on = cells.join(F.broadcast(line), (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")))  # at most ``samples`` rows
    ratio = on.agg(F.avg((F.col("value") == FORBIDDEN).cast("double")).alias("obstacle_ratio"))
    rows = line.select("at", "c", F.explode(F.sequence(F.col("r") - box, F.col("r") + box)).alias("row"))
    # Sums over a row's range of columns, by prefix sums, instead of all pairs of samples and cells.
    from pyspark.sql.window import Window

    w = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = cells.join(F.broadcast(rows.select("row").distinct()), "row").withColumn(
        "v",
        F.when(F.col("value") != FORBIDDEN, F.col("value").cast("double")),
    )
    sums = free.select(
        "row",
        "col",
        F.count("v").over(w).alias("n"),
        F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.col("v") * F.col("v")).over(w), F.lit(0.0)).alias("q"),
    )
    ends = rows.select("at", "row", F.least(F.col("c") + box, F.lit(meta.width - 1)).alias("hi"), (F.col("c") - box - 1).alias("lo"))
    high = ends.join(sums, (ends["row"] == sums["row"]) & (F.col("hi") == F.col("col"))).select("at", "n", "s", "q")
    low = ends.join(sums, (ends["row"] == sums["row"]) & (F.col("lo") == F.col("col"))).select(
        "at",
        (-F.col("n")).alias("n"),
        (-F.col("s")).alias("s"),
        (-F.col("q")).alias("q"),
    )
    boxes = high.unionByName(low).groupBy("at").agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
    ).where("n > 0 and s > 0")
    mean = F.col("s") / F.col("n")
    cv = boxes.agg(F.coalesce(
        F.avg(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))) / mean),
        F.lit(0.0),
    ).alias("variation"))
    return ratio.crossJoin(F.broadcast(cv))  # one row each


def estimate_buffer(cells: DataFrame, meta: RasterMeta, points: Sequence[G.Point], targets: Sequence[G.Point]) -> int:
    """The buffer for the farthest pair of route ends; 200 if they coincide."""
    # Both ends of the farthest pair are corners of hulls.
    a, b = max(((s, t) for s in G.convex_hull(points) for t in G.convex_hull(targets)), key=lambda p: math.dist(*p))
    if math.dist(a, b) < 1:
        return 200
    got = buffer_statistics(cells, meta, a, b).first()
    return buffer_width(math.dist(a, b), got["obstacle_ratio"] or 0.0, got["variation"] or 0.0)


def distinct_values(cells: DataFrame) -> DataFrame:
    return cells.select("value").distinct()


def value_ranks(cells: DataFrame) -> DataFrame:
    """(value, rank): grey levels for a picture; ranks over the distinct values only."""
    from pyspark.sql.window import Window

    return distinct_values(cells).select("value", F.dense_rank().over(Window.orderBy("value")).alias("rank"))  # at most 65,536 values


def legend_sample(cells: DataFrame, most: int = 12) -> DataFrame:
    """(value, rank) of at most ``most`` distinct values, evenly spaced by rank, the lowest and the highest included."""
    ranks = value_ranks(cells)  # at most 65,536 rows
    n = ranks.count()
    if n <= most:
        return ranks
    places = sorted({int(i * ((n - 1) / (most - 1))) if i < most - 1 else n - 1 for i in range(most)})
    return ranks.where((F.col("rank") - 1).isin(places))
