"""What a path costs, and where it runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.grid import FORBIDDEN, RasterMeta, node_col, node_row, segment_length, x_of, y_of
from gridloom.functions.neighborhood import LARGEST, between


def _passed(dr: Column, dc: Column) -> Column:
    """The cells between the ends of a segment, as offsets (r, c)."""
    far = F.greatest(F.abs(dr), F.abs(dc))
    cell = lambda r, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"))
    inner = F.flatten(F.transform(
        F.sequence(F.lit(1), F.greatest(far - 1, F.lit(1))),
        lambda i: F.array(cell(F.floor(i * dr / far), F.floor(i * dc / far)), cell(F.ceil(i * dr / far), F.ceil(i * dc / far))),
    ))
    none = F.array().cast("array<struct<r:int,c:int>>")
    return F.when(F.abs(dr) + F.abs(dc) <= 1, none).when(far == 1, F.array(cell(dr, F.lit(0)), cell(F.lit(0), dc))).otherwise(inner)


def segments(paths: DataFrame, width: int) -> DataFrame:
    """(path_id, row, col, dr, dc): the steps of paths (path_id, node_ids)."""
    n = F.size("node_ids")
    pairs = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.struct(F.element_at("node_ids", i).alias("a"), F.element_at("node_ids", i + 1).alias("b")),
        ),
    )
    steps = paths.select("path_id", F.explode(pairs).alias("s"))
    r, c = node_row(F.col("s.a"), width), node_col(F.col("s.a"), width)
    return steps.select(
        "path_id",
        r.alias("row"),
        c.alias("col"),
        (node_row(F.col("s.b"), width) - r).alias("dr"),
        (node_col(F.col("s.b"), width) - c).alias("dc"),
    )


def length_by_category(paths: DataFrame, cells: DataFrame, width: int, all_categories: bool = True) -> DataFrame:
    """(path_id, category, length): a step's length, in cells, is shared by the cells it touches.

    With ``all_categories`` the raster's other values come with 0.
    """
    steps = segments(paths, width).withColumn("passed", _passed(F.col("dr"), F.col("dc")))
    zero = F.struct(F.lit(0).alias("r"), F.lit(0).alias("c"))
    end = F.struct(F.col("dr").cast("int").alias("r"), F.col("dc").cast("int").alias("c"))
    touched = steps.withColumn("cells", F.concat(F.array(zero, end), F.col("passed")))
    share = segment_length(F.col("dr"), F.col("dc")) / F.size("cells")
    long = touched.select("path_id", "row", "col", share.alias("share"), F.explode("cells").alias("o")).select(
        "path_id",
        (F.col("row") + F.col("o.r")).alias("row"),
        (F.col("col") + F.col("o.c")).alias("col"),
        "share",
    )
    # Paths are short beside the raster: their cells are summed first and only these are looked up.
    parts = long.groupBy("path_id", "row", "col").agg(F.sum("share").alias("share"))
    sums = parts.join(
        cells.select("row", "col", F.col("value").alias("category")),
        ["row", "col"],
    ).groupBy("path_id", "category").agg(F.sum("share").alias("length"))
    if not all_categories:
        return sums
    every = paths.select("path_id").distinct().crossJoin(F.broadcast(cells.select(F.col("value").alias("category")).distinct()))  # at most 65,536 values
    return every.join(sums, ["path_id", "category"], "left").select("path_id", "category", F.coalesce("length", F.lit(0.0)).alias("length"))


def totals(by_category: DataFrame) -> DataFrame:
    """(path_id, total_length, total_cost): the cost is the sum of category times length, the weight of the path's edges."""
    return by_category.groupBy("path_id").agg(
        F.sum("length").alias("total_length"),
        F.sum(F.col("length") * F.col("category")).alias("total_cost"),
    )


def path_costs(by_category: DataFrame, ignore: Sequence[int] = (FORBIDDEN,)) -> DataFrame:
    """(path_id, cost): the sum of length times category, without some categories and without missing lengths."""
    counts = ~F.col("category").isin(list(ignore)) if ignore else F.lit(True)
    part = F.when(counts & F.col("length").isNotNull(), F.col("length") * F.col("category")).otherwise(F.lit(0.0))
    return by_category.groupBy("path_id").agg(F.sum(part).alias("cost"))


def cheapest_valid(options: DataFrame, valid: Column, group: str, cost: str, tie: str) -> DataFrame:
    """Of each group's options that are valid the cheapest one, of equally cheap ones that with the smallest ``tie``.

    Groups without a valid option are left out; so are options without a cost.
    """
    rows = options.where(valid & F.col(cost).isNotNull())
    best = rows.groupBy(F.col(group).alias("_group")).agg(F.min_by(F.struct(*options.columns), F.struct(cost, tie)).alias("_best"))
    return best.select("_best.*")


def shares(by_category: DataFrame) -> DataFrame:
    """(path_id, category, length, percent); 0 percent on a path without length."""
    total = by_category.groupBy("path_id").agg(F.sum("length").alias("total"))
    percent = F.when(F.col("total") > 0, F.col("length") / F.col("total") * 100).otherwise(F.lit(0.0))
    return by_category.join(total, "path_id").select("path_id", "category", "length", percent.alias("percent"))


def coordinates(nodes: Column, meta: RasterMeta) -> Column:
    """A path's points: the upper left corners of its cells."""
    row, col = (lambda n: F.floor(n / F.lit(meta.width))), (lambda n: F.pmod(n, F.lit(meta.width)))
    return F.transform(nodes, lambda n: F.struct(x_of(row(n), col(n), meta).alias("x"), y_of(row(n), col(n), meta).alias("y")))


def end_distance(coords: Column) -> Column:
    """The straight distance between a path's ends."""
    a, b = F.element_at(coords, 1), F.element_at(coords, -1)
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def end_distance_legacy(coords: Column) -> Column:
    """An older formula that mixes the ends' coordinates; only for comparison with old results."""
    a, b = F.element_at(coords, 1), F.element_at(coords, -1)
    return F.hypot(a["x"] - a["y"], b["x"] - b["y"])


def length_in_metres(coords: Column) -> Column:
    n = F.size(coords)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.hypot(
            F.element_at(coords, i)["x"] - F.element_at(coords, F.least(i + 1, n))["x"],
            F.element_at(coords, i)["y"] - F.element_at(coords, F.least(i + 1, n))["y"],
        ),
    )
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def records(paths: DataFrame, by_category: DataFrame, meta: RasterMeta) -> DataFrame:
    """A row for each path with its points, line, lengths, cost, and maps of length and percent by category."""
    parts = shares(by_category).groupBy("path_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "length")))).alias("length_by_category"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "percent")))).alias("percent_by_category"),
    )
    out = paths.join(totals(by_category), "path_id", "left").join(parts, "path_id", "left").withColumn("coords", coordinates(F.col("node_ids"), meta))
    from gridloom.functions.geometry import wkt_line

    return out.withColumn("geometry", wkt_line(F.col("coords"))).withColumn("euclidean_distance", end_distance(F.col("coords"))).withColumn("length_m", length_in_metres(F.col("coords")))


def wide(rows: DataFrame, categories: list[int]) -> DataFrame:
    """Columns length_cost_<category> and percent_cost_<category> instead of the maps."""
    picks = [F.col(f"{m}_by_category")[c].alias(f"{p}_{c}") for m, p in (("length", "length_cost"), ("percent", "percent_cost")) for c in categories]
    return rows.select(*[c for c in rows.columns if not c.endswith("_by_category")], *picks)


def bag_size(dr: int, dc: int) -> int:
    if max(abs(dr), abs(dc)) > LARGEST:
        raise ValueError("a step is too long")
    return len(between(dr, dc))
