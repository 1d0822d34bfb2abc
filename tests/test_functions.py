import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import clip
from gridloom.functions import geometry as G
from gridloom.functions import projections as P
from gridloom.functions import neighborhood as N
from gridloom.functions.grid import RasterMeta, line_cells


# Known sizes, cells and distances that the functions must give.


def test_sizes_of_neighborhoods():
    assert [len(N.steps(k)) for k in range(6)] == [4, 8, 16, 32, 48, 80]
    assert [len(N.steps(k, False)) for k in range(6)] == [2, 4, 8, 16, 24, 40]
    assert N.steps("k=1") == N.steps("radius-1") == N.steps("neighborhood1") == N.steps(1)


@pytest.mark.parametrize("bad", [-1, 128, "none"])
def test_bad_neighborhoods(bad):
    with pytest.raises(ValueError):
        N.steps(bad)


def test_cells_between():
    assert N.between(1, 0) == []
    assert sorted(N.between(1, 1)) == [(0, 1), (1, 0)]
    assert sorted(N.between(2, 1)) == [(1, 0), (1, 1)]
    assert sorted(N.between(3, 1)) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert sorted(N.between(3, 2)) == [(1, 0), (1, 1), (2, 1), (2, 2)]
    assert N.factor(1, 0) == 0.5 and N.factor(3, 4, 2) == 5 / 4


def test_region_bounds():
    a, b = N.region_bounds(1, 1, 5, 5)
    assert a == N.Bounds(0, 4, 0, 4) and b == N.Bounds(1, 5, 1, 5)


@pytest.mark.parametrize(
    "k, expected",
    [(0, (1.414214, 0.5)), (1, (1.082392, 0.207107)), (2, (1.027486, 0.118034)), (3, (1.013081, 0.081139)), (4, (1.007549, 0.061553))],
)
def test_lattice_errors(k, expected):
    assert N.largest_errors(k) == pytest.approx(expected, abs=1e-6)


def test_adjacent_directions_wrap():
    angles = [0.0, math.pi / 2, math.pi, 3 * math.pi / 2]
    assert N.adjacent(0.1, angles) == pytest.approx((0, math.pi / 2))
    assert N.adjacent(0.0, angles) == pytest.approx((-math.pi / 2, math.pi / 2))
    assert N.adjacent(6.0, angles) == pytest.approx((3 * math.pi / 2, 2 * math.pi))
    with pytest.raises(ValueError):
        N.elongation(0.1, 0.0, math.pi)


@given(st.integers(-20, 20), st.integers(-20, 20))
def test_index_inverts_corner(row, col):
    m = RasterMeta(100, 100, 2.0, 0.0, 500000.0, 0.0, -2.0, 5600000.0)
    x, y = m.centre(row, col)
    assert m.index(x, y) == (row, col)


def test_node_outside_raises():
    with pytest.raises(ValueError):
        RasterMeta(3, 3).node(5.0, 5.0)


def test_convex_hull_and_clip():
    hull = G.convex_hull([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)])
    assert hull == [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert sorted(G.clip_ring([(-1, -1), (2, -1), (2, 2), (-1, 2)], hull)) == [(0, 0), (0, 2), (2, 0), (2, 2)]


def test_polygons(spark):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6)]
    p = G.literal_polygon([ring, hole])
    sides = G.sides_of(p)
    row = spark.range(1).select(
        G.area(p).alias("area"),
        G.inside(sides, F.lit(1.0), F.lit(1.0)).alias("a"),
        G.inside(sides, F.lit(5.0), F.lit(5.0)).alias("b"),
        G.inside(sides, F.lit(11.0), F.lit(5.0)).alias("c"),
        G.polygon_distance(sides, F.lit(13.0), F.lit(14.0)).alias("d"),
    ).first()
    assert (row.area, row.a, row.b, row.c, row.d) == (96.0, True, False, False, 5.0)


def test_reproject_known_points(spark):
    # The meridian of a zone lies at 500 km; a degree of latitude there is about 110.6 to 111.7 km.
    x, y = G.reproject(F.lit(9.0), F.lit(0.0), 4326, 25832)
    a = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (a.x, a.y) == pytest.approx((500000.0, 0.0), abs=1e-6)
    x, y = G.reproject(F.lit(10.5), F.lit(51.0), 4326, 32632)
    lon, lat = G.reproject(x, y, 32632, 4326)
    b = spark.range(1).select(lon.alias("lon"), lat.alias("lat"), x.alias("x")).first()
    assert (b.lon, b.lat) == pytest.approx((10.5, 51.0), abs=1e-9) and 600000 < b.x < 610000
    with pytest.raises(ValueError):
        G.reproject(F.lit(1.0), F.lit(1.0), 4326, 27700)


@settings(max_examples=8, deadline=None)
@given(st.tuples(*[st.integers(0, 12)] * 4))
def test_lines_are_the_same_from_both_ends(spark, p):
    a, b = (spark.range(1).select(line_cells(*map(F.lit, q)).alias("l")).first().l for q in (p, (p[2], p[3], p[0], p[1])))
    assert sorted(a) == sorted(b) and len(a) == max(abs(p[0] - p[2]), abs(p[1] - p[3])) + 1
    assert {(p[0], p[1]), (p[2], p[3])} <= {tuple(c) for c in a}


def degrees(d, m=0, s=0.0):
    return d + m / 60 + s / 3600


def test_published_points_of_projections(spark):
    """Points from the public guidance note on coordinate conversions, and one of Lambert-93."""
    row = spark.range(1)

    def at(pair):
        return tuple(row.select(pair[0].alias("a"), pair[1].alias("b")).first())

    east, north = at(G.reproject(F.lit(5.0), F.lit(50.0), 4326, 3035))
    assert (east, north) == pytest.approx((3962799.45, 2999718.85), abs=0.1)
    foot = 1200 / 3937
    texas = P.Conic((6378206.4, 1 / 294.9786982), (degrees(28, 23), degrees(30, 17)), (-99.0, degrees(27, 50)), (2_000_000 * foot, 0.0))
    assert at(texas.forward(F.lit(-96.0), F.lit(28.5))) == pytest.approx((2963503.91 * foot, 254759.80 * foot), abs=0.1)
    assert at(texas.inverse(F.lit(2963503.91 * foot), F.lit(254759.80 * foot))) == pytest.approx((-96.0, 28.5), abs=1e-6)
    assert at(G.reproject(F.lit(3.0), F.lit(46.5), 4326, 2154)) == pytest.approx((700_000.0, 6_600_000.0), abs=0.001)
    x, y, z = P.helmert(tuple(map(F.lit, (3657660.66, 255768.55, 5201382.11))), (0.0, 0.0, 4.5, 0.0, 0.0, 0.554, 0.219))
    assert tuple(row.select(x.alias("x"), y.alias("y"), z.alias("z")).first()) == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)


@pytest.mark.parametrize("srid, lon, lat", [(3035, 9.0, 48.0), (3035, 10.0, 52.0), (2154, 2.3, 48.8), (31466, 6.9, 51.2), (31467, 9.2, 48.8), (31468, 11.6, 48.1), (31469, 14.5, 51.1), (25832, 9.2, 48.8)])
def test_projections_there_and_back(spark, srid, lon, lat):
    x, y = G.reproject(F.lit(lon), F.lit(lat), 4326, srid)
    there = spark.range(1).select(x.alias("x"), y.alias("y"))
    back = there.select("x", "y", *[c.alias(n) for c, n in zip(G.reproject(F.col("x"), F.col("y"), srid, 4326), ("lon", "lat"))]).first()
    assert (back.lon, back.lat) == pytest.approx((lon, lat), abs=2e-8)
    if srid in P.GAUSS_KRUGER:
        assert int(back.x // 1_000_000) == srid - 31464
        zone = spark.range(1).select(*G.reproject(F.lit(lon), F.lit(lat), 4326, 25832)).first()
        assert 50 < abs(back.y - zone[1]) < 20_000  # another datum, scale and meridian


@pytest.mark.parametrize("srid", [2154, 3035, 31467])
def test_stages_are_worked_out_once(spark, srid):
    """Each stage stands once in the plan, there and back; a pair of columns would repeat the way for each of the two."""
    there = spark.range(3).select(F.col("id"), G.moved(9.0 + F.col("id"), 48.0 - F.col("id"), 4326, srid).alias("at"))
    back = there.select("id", G.moved(F.col("at.x"), F.col("at.y"), srid, 4326).alias("at"))
    stages = len(G._from_degrees(srid)) + len(G._to_degrees(srid))
    assert back._jdf.queryExecution().optimizedPlan().toString().count("lambdafunction(") == stages
    x, y = G.reproject(F.lit(9.0), F.lit(48.0), 4326, srid)
    plan = spark.range(1).select(x.alias("x"), y.alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("lambdafunction(") == 2 * len(G._from_degrees(srid))
    for r in back.select("id", "at.x", "at.y").collect():
        assert (r.x, r.y) == pytest.approx((9.0 + r.id, 48.0 - r.id), abs=2e-8)


@pytest.mark.parametrize(("step", "away"), [(None, 0.0), (None, 5.6e6), (1.0, 0.0), (0.5, 5.6e6)])
def test_clipped_areas_by_points(step, away):
    """Stars of one or two rings, on a grid or not: a point is in the cut area if it is in both."""
    rng = np.random.default_rng(11)

    def star() -> np.ndarray:
        angles = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 14)))
        far = rng.uniform(0.3, 1, len(angles)) * rng.uniform(1, 6)
        points = rng.uniform(-3, 3, 2) + np.stack([far * np.cos(angles), far * np.sin(angles)], 1) + away
        return points if step is None else np.round(points / step) * step

    within = lambda rings, p: G.point_in_rings([r.tolist() for r in rings], *p)
    for _ in range(60):
        subject, mask = [[star() for _ in range(rng.integers(1, 3))] for _ in range(2)]
        found = clip.area_in(subject, clip.sides_of(mask))
        found = subject if found is None else found
        for p in rng.uniform(-8, 8, (60, 2)) + away + 0.0012345:
            assert within(found, p) == (within(subject, p) and within(mask, p))


def test_clipped_rings_and_lines():
    box = lambda x, y, s: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)
    mask = clip.sides_of([box(0, 0, 10), box(4, 4, 2)])
    size = lambda rings: [clip.twice_area(r) / 2 for r in rings]
    assert size(clip.area_in([box(3, 3, 4)], mask)) == [16, -4]  # an outer ring and its hole
    assert size(clip.area_in([box(3, 3, 3)], mask)) == [9 - 4]  # a hole on the edge is a notch
    assert clip.area_in([box(1, 1, 2)], mask) is None and clip.area_in([box(4.5, 4.5, 1)], mask) == []
    assert clip.area_in([box(10, 0, 3)], mask) == [] == clip.area_in([box(4, 4, 2)], mask) and clip.area_in([], mask) == []
    assert sorted(size(clip.area_in([box(0, 0, 10), box(4, 4, 2)], mask))) == [-4, 100]  # equal areas
    assert size(clip.area_in([box(0, 0, 2), box(2, 2, 2)], clip.sides_of([box(0, 0, 9)]))) == [4, 4]  # parts that touch in a corner
    assert size(clip.area_in([box(-1, -1, 2), box(8, 8, 5)], mask)) == [1, 4]
    line = lambda *p: [np.array(p, float)]
    got = clip.line_in(line((-1, 5), (11, 5), (11, 10), (-2, 10)), mask)
    assert [r.tolist() for r in got] == [[[0, 5], [4, 5]], [[6, 5], [10, 5]], [[10, 10], [0, 10]]]  # across the hole, and along a side
    assert clip.line_in(line((1, 1), (2, 2), (3, 1)), mask) is None and clip.line_in(line((20, 1), (21, 1)), mask) == []
    got = clip.line_in(line((1, 1), (2, 1), (2, -3), (3, -3), (3, 1)), mask)
    assert [r.tolist() for r in got] == [[[1, 1], [2, 1], [2, 0]], [[3, 0], [3, 1]]]  # a stretch keeps its corners
