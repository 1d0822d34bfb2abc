"""Further queries: data written and read back, tables of masks, packed rasters, collections, routes by overlay and goal."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import finder
from gridloom.functions import geometry as G
from gridloom.functions import grid as X
from gridloom.functions import neighborhood as N
from gridloom.operators import blocks
from gridloom.operators import costs as C
from gridloom.operators import edges as E
from gridloom.operators import metrics as M
from gridloom.operators import raster as R
from gridloom.operators import route
from gridloom.plans.registry import (
    _BASE_SQL,
    _HEIGHT_SQL,
    _PATH_SQL,
    _RECORDS_SQL,
    FIELD,
    GRID_SQL,
    WIDTH,
    _free,
    _lengths,
    _several_sql,
    box_sql,
    corners_sql,
    edges_sql,
    field,
    long_cells,
    part_cells,
    part_height,
    query,
    r6,
    rectangles,
    staircases,
    table,
)
from gridloom.session import new_path, place
from gridloom.sources import costs as cost_files
from gridloom.sources import export
from gridloom.sources.detect import Raster, clipped, load, meets_any
from gridloom.sources.tiff import write_raster

# Files.


def _file(spark, label: str, ending: str) -> str:
    """A new file's path in the shared folder; the folder is there."""
    path = new_path(spark, label)
    system, name = place(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    return path + ending


_FULL_SQL = f"{GRID_SQL}, {_HEIGHT_SQL}, q AS (SELECT r, c FROM hh, LATERAL (SELECT unnest(range(n)) AS r), range(50) b(c))"


@query(
    "tiff_window",
    f"""WITH {_FULL_SQL}, b AS (SELECT q.r, q.c, unnest([0, 1]) AS band, v FROM q LEFT JOIN g USING (r, c))
SELECT band::BIGINT AS band, r AS "row", c AS col, CASE WHEN v IS NULL THEN 65535 ELSE v - CASE WHEN band = 1 THEN v // 2 ELSE 0 END END::BIGINT AS value
FROM b WHERE band = 1 AND r >= 10 AND c BETWEEN 5 AND 30""",
)
def tiff_window(spark, sf):
    """Two bands written as tiles, and a window of one read back through filters that reach the file."""
    cells = part_cells(spark, sf)
    half = (F.col("value") - F.floor(F.col("value") / 2)).cast("int")
    both = cells.withColumn("band", F.lit(0)).unionByName(cells.withColumns({"band": F.lit(1), "value": half}))
    path = _file(spark, "raster", ".tif")
    write_raster(both, field(spark, sf), path, tile=64)
    found = load(spark, path)
    window = found.cells.where((F.col("band") == 1) & (F.col("row") >= 10) & F.col("col").between(5, 30))
    return long_cells(window).withColumn("band", F.lit(1).cast("long"))


def _cost_round_trip(spark, sf, ending: str):
    """Mean sizes by type and brand as a cost file, applied to all parts."""
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    rows = parts.groupBy("p_type", "p_brand").agg(F.max("p_size").cast("double").alias("cost")).orderBy("p_type", "p_brand").collect()  # one row for each cost
    costs = C.CostTable.from_rows(spark, "p_type", ["p_brand"], [tuple(r) for r in rows], "tuple")
    path = _file(spark, "costs", ending)
    cost_files.save(costs, path)
    return C.apply_costs(parts, cost_files.load(spark, path)).select("p_partkey", "cost")


_COST_SQL = "SELECT p_partkey, max(p_size) OVER (PARTITION BY p_type, p_brand)::DOUBLE AS cost FROM part"


@query("cost_file_csv", _COST_SQL)
def cost_file_csv(spark, sf):
    return _cost_round_trip(spark, sf, ".csv")


@query("cost_file_json", _COST_SQL)
def cost_file_json(spark, sf):
    return _cost_round_trip(spark, sf, ".json")


@query("export_geojson", f"SELECT path_id, length_m, euclidean_distance, 30::BIGINT AS points FROM ({_PATH_SQL + _RECORDS_SQL})")
def export_geojson(spark, sf):
    path = _file(spark, "paths", ".geojson")
    export.save(M.records(staircases(spark, sf), _lengths(spark, sf), FIELD), path)
    found = spark.read.json(path)
    return found.select(
        F.col("properties.path_id").alias("path_id"),
        r6("properties.length_m").alias("length_m"),
        r6("properties.euclidean_distance").alias("euclidean_distance"),
        F.size("geometry.coordinates").cast("long").alias("points"),
    )


# Masks and packed rasters.


@query(
    "meets_masks",
    f"""WITH {_HEIGHT_SQL}, a AS (SELECT c_custkey AS id, {corners_sql("c_custkey")} FROM customer, hh),
b AS (SELECT {corners_sql("s_suppkey")} FROM supplier, hh WHERE s_suppkey % 3 = 0)
SELECT id AS feature_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)""",
)
def meets_masks(spark, sf):
    masks = rectangles(spark, sf).where(F.col("feature_id") % 3 == 0)
    return meets_any(rectangles(spark, sf, "customer"), masks).select("feature_id")


@query("overlay_chain", f"""WITH {box_sql()}, {_BASE_SQL}, z AS (SELECT DISTINCT r, c FROM h WHERE kind = 'z1'),
m AS (SELECT b.r, b.c, CASE WHEN d.r IS NOT NULL AND v <> 65535 THEN floor(v * 1.3) ELSE v END AS v FROM b LEFT JOIN d USING (r, c))
SELECT m.r AS "row", m.c AS col, CASE WHEN z.r IS NOT NULL AND m.v <> 65535 THEN 500 ELSE m.v END::BIGINT AS value FROM m LEFT JOIN z USING (r, c)""")
def overlay_chain(spark, sf):
    """Two overlays in one pass."""
    features = rectangles(spark, sf)
    steps = [{"features": features, "value": 1.3, "multiply": True}, {"features": features.where("kind = 'z1'"), "value": 500}]
    return long_cells(R.overlays(part_cells(spark, sf), field(spark, sf), steps))


@query("packed_window", f"""WITH {box_sql()}, p AS (SELECT q.r, q.c, q.x, q.y, coalesce(max(round_even(cost, 0)), 65535) AS v FROM q LEFT JOIN h ON q.r = h.r AND q.c = h.c GROUP BY ALL)
SELECT r - (n - 36) AS "row", c - 4 AS col, CASE WHEN sqrt((x - 20) * (x - 20) + (y - 20) * (y - 20)) <= 15.5 THEN v ELSE 65535 END::BIGINT AS value FROM p, hh WHERE y < 36 AND y > 4 AND c >= 4 AND c < 36""")
def packed_window(spark, sf):
    """Features to a packed raster, of which a masked window is unfolded."""
    meta = field(spark, sf)
    packed = blocks.rasterized(rectangles(spark, sf), meta, side=64).masked([(20.0, 20.0)], 15.5)
    return long_cells(packed.crop(meta.height - 36, meta.height - 4, 4, 36).cells())


# Graphs, steps and distances.


@query("node_list", f"WITH {GRID_SQL}, {edges_sql(1)} SELECT u AS node FROM e UNION SELECT w FROM e")
def node_list(spark, sf):
    return E.nodes(E.edges(part_cells(spark, sf), WIDTH, 1))


@query("distance_to_point", f"WITH {GRID_SQL} SELECT r * 50 + c AS node, round(sqrt(((r - 7) * (r - 7) + (c - 11) * (c - 11) + (v - 3) * (v - 3))::DOUBLE), 6) AS distance FROM g")
def distance_to_point(spark, sf):
    cells = part_cells(spark, sf)
    at = F.array(*[F.col(c).cast("double") for c in ("row", "col", "value")])
    return cells.select(X.node_id(F.col("row"), F.col("col"), WIDTH).alias("node"), r6(X.distance(at, F.array(*[F.lit(float(v)) for v in (7, 11, 3)]))).alias("distance"))


_STEPS_SQL = "s AS (SELECT r AS dr, c AS dc FROM range(-3, 4) a(r), range(-3, 4) b(c) WHERE gcd(r, c) = 1)"


@query("step_regions", f"WITH {GRID_SQL}, {_HEIGHT_SQL}, {_STEPS_SQL} SELECT dr, dc, count(*) AS starts, sum(v)::BIGINT AS cost FROM g, hh, s WHERE r + dr >= 0 AND r + dr < n AND c + dc >= 0 AND c + dc < 50 GROUP BY ALL")
def step_regions(spark, sf):
    """Cells from which each step of R_3 stays on the raster, and their costs."""
    height = part_height(spark, sf)
    inside = [(dr, dc, N.region_bounds(dr, dc, height, WIDTH)[0]) for dr, dc in N.steps(3)]
    within = lambda b: F.col("row").between(b.row0, b.row1 - 1) & F.col("col").between(b.col0, b.col1 - 1)
    taken = F.array(*[F.when(within(b), F.struct(F.lit(dr).cast("long").alias("dr"), F.lit(dc).cast("long").alias("dc"))) for dr, dc, b in inside])
    steps = part_cells(spark, sf).select("value", F.explode(taken).alias("s")).where("s is not null")
    return steps.groupBy(F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc")).agg(F.count(F.lit(1)).alias("starts"), F.sum("value").alias("cost"))


# Collections of paths.


def _halves(spark, sf):
    """Paths of ids up to 60 of 100, and those from 40 on with their first cell left out."""
    paths = staircases(spark, sf).select("path_id", F.element_at("node_ids", 1).alias("source"), F.element_at("node_ids", -1).alias("target"), "node_ids")
    late = paths.where(F.col("path_id") % 100 >= 40).withColumn("node_ids", F.slice("node_ids", 2, 100)).withColumn("source", F.element_at("node_ids", 1))
    return paths.where(F.col("path_id") % 100 < 60), late


@query("collection_replace", "SELECT s_suppkey AS path_id, CASE WHEN s_suppkey % 100 >= 40 THEN 29 ELSE 30 END::BIGINT AS points FROM supplier")
def collection_replace(spark, sf):
    early, late = _halves(spark, sf)
    return finder.add_paths(early, late).select("path_id", F.size("node_ids").cast("long").alias("points"))


@query("collection_append", """WITH t AS (SELECT max(s_suppkey) FILTER (s_suppkey % 100 < 60) + 1 AS top FROM supplier)
SELECT s_suppkey AS path_id, 30::BIGINT AS points FROM supplier WHERE s_suppkey % 100 < 60 UNION ALL SELECT s_suppkey + top, 29 FROM supplier, t WHERE s_suppkey % 100 >= 40""")
def collection_append(spark, sf):
    early, late = _halves(spark, sf)
    return finder.add_paths(early, late, replace=False).select("path_id", F.size("node_ids").cast("long").alias("points"))


# Routes.


_MANY = [(i, j) for i in range(3) for j in range(3, 6)]


@query("route_overlay", _several_sql(_MANY))
def route_overlay(spark, sf):
    """All pairs through costs between the borders of small tiles."""
    a = _free(spark, sf, 6)
    wanted = route.requests(spark, a[:3], a[3:])
    found = route.solve(part_cells(spark, sf), part_height(spark, sf), WIDTH, wanted, 1, side=128, overlay_sources=1)
    return found.select("ord", "source", "target", F.when(F.col("node_ids")[0].isNotNull(), r6("cost")).alias("cost"))


@query("route_goal", _several_sql([(0, 3)]))
def route_goal(spark, sf):
    """A* over tiles, bounded by least costs of rows and columns of tiles."""
    a = _free(spark, sf, 4)
    wanted = route.requests(spark, a[0], a[3])
    found = route.solve(part_cells(spark, sf), part_height(spark, sf), WIDTH, wanted, 1, "astar", side=128)
    return found.select("ord", "source", "target", F.when(F.col("node_ids")[0].isNotNull(), r6("cost")).alias("cost"))


@query("finder_routes", _several_sql([(0, 2), (0, 3), (1, 2), (1, 3)]))
def finder_routes(spark, sf):
    """From coordinates to path records; the search space holds the whole raster."""
    meta = field(spark, sf)
    ends = [meta.centre(n // WIDTH, n % WIDTH) for n in _free(spark, sf, 4)]
    data = Raster(part_cells(spark, sf).withColumn("band", F.lit(0)), meta)
    found = finder.PathFinder(spark, data, ends[:2], ends[2:], neighborhood=1, buffer=1e6)
    rows = found.find().select(F.col("path_id").alias("ord"), "source", "target", r6("total_cost").alias("cost"))
    return rows


# Coordinate systems.


@query("reproject_systems", "SELECT p_partkey, s AS srid, 7.0 + (p_partkey % 700) / 100.0 AS lon, 46.0 + (p_partkey % 800) / 100.0 AS lat FROM part, (VALUES (2154), (3035), (31467)) t(s)")
def reproject_systems(spark, sf):
    """Conic, equal-area and Gauss-Kruger coordinates, and back, to a tenth of a metre."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", (7.0 + (k % 700) / 100.0).alias("lon"), (46.0 + (k % 800) / 100.0).alias("lat"))
    out = None
    for srid in (2154, 3035, 31467):
        there = p.select("p_partkey", G.moved(F.col("lon"), F.col("lat"), 4326, srid).alias("at"))
        again = there.select("p_partkey", G.moved(F.col("at.x"), F.col("at.y"), srid, 4326).alias("at"))
        back = again.select("p_partkey", F.lit(srid).alias("srid"), F.round("at.x", 6).alias("lon"), F.round("at.y", 6).alias("lat"))
        out = back if out is None else out.unionByName(back)
    return out


# Clipping.

#: A base with a hole, and two prongs on it, a gap of 2 between them; the boxes it is made of (areas less the hole) are in the SQL.
COMB = [[(3.0, 2.0), (43.0, 2.0), (43.0, 8.0), (40.0, 8.0), (40.0, 30.0), (20.0, 30.0), (20.0, 8.0), (18.0, 8.0), (18.0, 30.0), (5.0, 30.0), (5.0, 8.0), (3.0, 8.0)],
        [(20.0, 4.0), (21.0, 4.0), (21.0, 5.0), (20.0, 5.0)]]


def _common(x0: float, y0: float, x1: float, y1: float) -> str:
    return f"greatest(0, least(x1, {x1}) - greatest(x0, {x0})) * greatest(0, least(y1, {y1}) - greatest(y0, {y0}))"


@query(
    "clip_parts",
    f"""WITH {box_sql("customer")}, c AS (SELECT k, x0, x1, y0, y1, {_common(3, 2, 43, 8)} AS base, {_common(5, 8, 18, 30)} AS one, {_common(20, 8, 40, 30)} AS two,
  {_common(20, 4, 21, 5)} AS hole FROM f)
SELECT k AS feature_id, (base + one + two - hole)::DOUBLE AS area, CASE WHEN base > 0 OR one = 0 OR two = 0 THEN 1 ELSE 2 END::BIGINT AS parts,
  (CASE WHEN base > 0 OR one = 0 OR two = 0 THEN 1 ELSE 2 END + CASE WHEN x0 < 20 AND x1 > 21 AND y0 < 4 AND y1 > 5 THEN 1 ELSE 0 END)::BIGINT AS rings
FROM c WHERE base + one + two - hole > 0""",
)
def clip_parts(spark, sf):
    """Features cut to a polygon with inner corners and a hole: each stays one, of as many parts and holes as it has."""
    polygon = F.col("polygon")
    cut = clipped(rectangles(spark, sf, "customer"), COMB)
    return cut.select(
        "feature_id",
        r6(G.oriented_area(polygon)).alias("area"),
        G.outer_rings(polygon).cast("long").alias("parts"),
        F.size(polygon).cast("long").alias("rings"),
    )
