"""Planar geometry: Catalyst expressions over rings, and a few exact helpers for the driver.

A polygon is ``array<array<struct<x double, y double>>>``: rings, closed or not, filled by
the even-odd rule, so holes are further rings.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import projections as P

POLYGON = "array<array<struct<x: double, y: double>>>"
Point = tuple[float, float]


def edges_of(ring: Column) -> Column:
    """(a, b) of each side of a ring, its end joined to its start."""
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i % n + 1).alias("b")),
    )


def sides_of(polygon: Column) -> Column:
    return F.flatten(F.transform(F.filter(polygon, lambda r: F.size(r) > 0), edges_of))


def inside(sides: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point; sides own their lower end, so shared sides are owned once."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.aggregate(sides, F.lit(0), lambda n, s: n + F.when(crosses(s), 1).otherwise(0)) % 2 == 1


def ring_area(ring: Column) -> Column:
    doubled = F.aggregate(edges_of(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(doubled) / 2)


def area(polygon: Column) -> Column:
    """The first ring's area less that of the others (holes)."""
    areas = F.transform(polygon, ring_area)
    return F.when(F.size(polygon) == 0, F.lit(0.0)).otherwise(F.aggregate(areas, F.lit(0.0), lambda t, a: t - a) + 2 * F.element_at(areas, 1))


def parts_area(rings: Column) -> Column:
    """The sum of all rings' areas, for features of several parts without holes."""
    return F.aggregate(F.transform(rings, ring_area), F.lit(0.0), lambda t, a: t + a)


def oriented_area(rings: Column) -> Column:
    """The area of rings that turn left around areas and right around holes, as clipping gives them; a single ring may turn either way."""
    twice = lambda ring: F.aggregate(edges_of(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.abs(F.aggregate(rings, F.lit(0.0), lambda t, ring: t + twice(ring))) / 2


def outer_rings(rings: Column) -> Column:
    """How many of the rings turn left, or all if there is just one."""
    left = lambda ring: F.aggregate(edges_of(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) > 0
    return F.when(F.size(rings) == 1, 1).otherwise(F.size(F.filter(rings, left)))


def bbox(polygon: Column) -> Column:
    points = F.flatten(polygon)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("minx"),
        F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"),
        F.array_max(ys).alias("maxy"),
    )


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - ax) * dx + (y - ay) * dy) / length)))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def polygon_distance(sides: Column, x: Column, y: Column) -> Column:
    """The distance of a point from a polygon: 0 inside it."""
    far = F.lit(float("inf"))
    near = F.aggregate(sides, far, lambda d, s: F.least(d, segment_distance(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))
    return F.when(inside(sides, x, y), F.lit(0.0)).otherwise(near)


def literal_polygon(rings: Sequence[Sequence[Point]]) -> Column:
    point = lambda p: F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y"))
    return F.array(*[F.array(*[point(p) for p in ring]) for ring in rings])


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))


def wkt_line(coords: Column) -> Column:
    """LINESTRING of an array of (x, y)."""
    return F.concat(
        F.lit("LINESTRING ("),
        F.concat_ws(", ", F.transform(coords, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))),
        F.lit(")"),
    )


def convex_hull(points: Iterable[Point]) -> list[Point]:
    """Monotone chain, counter-clockwise, without points on the sides."""
    unique = sorted(set(points))
    if len(unique) < 3:
        return unique

    def half(ordered: Iterable[Point]) -> list[Point]:
        out: list[Point] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(unique) + half(reversed(unique))


def clip_ring(ring: Sequence[Point], convex: Sequence[Point]) -> list[Point]:
    """Sutherland and Hodgman's clip of a ring by a convex counter-clockwise one."""
    out = list(ring)
    for (ax, ay), (bx, by) in zip(convex, [*convex[1:], convex[0]], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        old, out = out, []
        for p, q in zip([*old[-1:], *old[:-1]], old, strict=True):
            sp, sq = side(p), side(q)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if sq >= 0:
                out.append(q)
    return out


def bounds_of(rings: Iterable[Sequence[Point]]) -> tuple[float, float, float, float]:
    """The box of all points of some rings."""
    points = [p for ring in rings for p in ring]
    if not points:
        raise ValueError("no points")
    return min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)


def point_in_rings(rings: Iterable[Sequence[Point]], x: float, y: float) -> bool:
    """Whether a point is inside by the even-odd rule."""
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def box_meets(box: tuple[float, float, float, float], rings: Sequence[Sequence[Point]]) -> bool:
    """Whether a box and a polygon have a point in common."""
    x0, y0, x1, y1 = box
    if any(x0 <= x <= x1 and y0 <= y <= y1 for ring in rings for x, y in ring) or point_in_rings(rings, x0, y0):
        return True
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
            # The part of the side, from 0 to 1, that lies in both strips of the box.
            low, high = 0.0, 1.0
            for start, move, least, most in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
                if move == 0:
                    low, high = (low, high) if least <= start <= most else (1.0, 0.0)
                else:
                    t = sorted(((least - start) / move, (most - start) / move))
                    low, high = max(low, t[0]), min(high, t[1])
            if low <= high:
                return True
    return False


# WGS 84 / GRS 80 ellipsoids and the transverse Mercator scale.
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)
SCALE, FALSE_EASTING = 0.9996, 500000.0
WEB_RADIUS = 6378137.0


def _krueger(flattening: float) -> tuple[float, list[float], list[float]]:
    """Kruger's series to the fourth order in n: rectifying radius factor, forward and inverse terms."""
    n = flattening / (2 - flattening)
    radius = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    inverse = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, inverse


def _mercator(srid: int) -> tuple[float, tuple[float, float], float, float, float] | None:
    """Transverse Mercator systems: central meridian, ellipsoid, scale, false easting, false northing."""
    utm = lambda zone, ellipsoid, north: (float(zone * 6 - 183), ellipsoid, SCALE, FALSE_EASTING, north)
    if 25828 <= srid <= 25838:
        return utm(srid - 25800, GRS80, 0.0)
    if 32601 <= srid <= 32660:
        return utm(srid - 32600, WGS84, 0.0)
    if 32701 <= srid <= 32760:
        return utm(srid - 32700, WGS84, 10_000_000.0)
    if srid in P.GAUSS_KRUGER:
        zone = srid - 31464
        return 3.0 * zone, P.BESSEL, 1.0, zone * 1_000_000.0 + 500_000.0, 0.0
    return None


def _to_degrees(srid: int) -> list[P.Stage]:
    if srid == 4326:
        return []
    if srid == 3857:
        return [lambda p: {"x": F.degrees(p["x"] / WEB_RADIUS), "y": F.degrees(2 * F.atan(F.exp(p["y"] / WEB_RADIUS)) - math.pi / 2)}]
    if srid in P.SYSTEMS:
        return P.SYSTEMS[srid].inverse_stages()
    meridian, (a, f), scale, east, north = _mercator(srid) or _refuse(srid)
    radius, _, inverse = _krueger(f)

    def scaled(p):
        return {"xi": (p["y"] - north) / (scale * a * radius), "eta": (p["x"] - east) / (scale * a * radius)}

    def summed(p):
        xi, eta = p["xi"], p["eta"]
        xi2, eta2 = xi, eta
        for j, term in enumerate(inverse, 1):
            xi2 = xi2 - term * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta2 = eta2 - term * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return {"xi": xi2, "eta": eta2}

    def conformal(p):
        return {"chi": F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])), "rel": F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))}

    def degrees(p):
        return {"x": F.lit(meridian) + F.degrees(p["rel"]), "y": F.degrees(P.latitude(p["chi"], f))}

    found = [scaled, summed, conformal, degrees]
    return [*found, *P.shift_stages(P.DHDN_SHIFT, P.BESSEL, P.WGS84)] if srid in P.GAUSS_KRUGER else found


def _from_degrees(srid: int) -> list[P.Stage]:
    if srid == 4326:
        return []
    if srid == 3857:
        return [lambda p: {"x": F.radians(p["x"]) * WEB_RADIUS, "y": F.log(F.tan(F.radians(p["y"]) / 2 + math.pi / 4)) * WEB_RADIUS}]
    if srid in P.SYSTEMS:
        return P.SYSTEMS[srid].forward_stages()
    meridian, (a, f), scale, east, north = _mercator(srid) or _refuse(srid)
    radius, forward, _ = _krueger(f)
    e = math.sqrt(f * (2 - f))

    def sine(p):
        return {"sin_lat": F.sin(F.radians(p["y"])), "rel": F.radians(p["x"] - meridian)}

    def conformal(p):
        return {"t": F.sinh(F.atanh(p["sin_lat"]) - e * F.atanh(e * p["sin_lat"])), "rel": p["rel"]}

    def turned(p):
        t, rel = p["t"], p["rel"]
        return {"xi": F.atan2(t, F.cos(rel)), "eta": F.atanh(F.sin(rel) / F.sqrt(1 + t * t))}

    def summed(p):
        xi, eta = p["xi"], p["eta"]
        xi2, eta2 = xi, eta
        for j, term in enumerate(forward, 1):
            xi2 = xi2 + term * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta2 = eta2 + term * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return {"x": east + scale * a * radius * eta2, "y": north + scale * a * radius * xi2}

    found = [sine, conformal, turned, summed]
    return [*P.shift_stages(P.DHDN_SHIFT, P.WGS84, P.BESSEL, back=True), *found] if srid in P.GAUSS_KRUGER else found


def _refuse(srid: int):
    raise ValueError(f"EPSG:{srid} is not supported; known are 4326, 3857, 3035, 2154, 31466 to 31469 and UTM zones")


def reproject(x: Column, y: Column, from_srid: int | None, to_srid: int | None) -> tuple[Column, Column]:
    """Coordinates (east, north) in another system; unchanged if either is unknown or both agree."""
    if from_srid is None or to_srid is None or from_srid == to_srid:
        return x, y
    stages = [*_to_degrees(from_srid), *_from_degrees(to_srid)]
    if any(srid in P.SYSTEMS or srid in P.GAUSS_KRUGER for srid in (from_srid, to_srid)):
        at = P.bound(x, y, stages)
        return at["x"], at["y"]
    return P.plain(x, y, stages)


def moved(x: Column, y: Column, from_srid: int, to_srid: int) -> Column:
    """The same as one struct (x, y): its way is gone once, where ``reproject`` goes it for each of the two."""
    return P.bound(x, y, [] if from_srid == to_srid else [*_to_degrees(from_srid), *_from_degrees(to_srid)])
