"""Further map projections and a datum shift as column expressions: conic, equal-area and Gauss-Kruger systems.

All go by way of longitude and latitude, in stages from named values to named values. ``bound`` works out each stage once a row, so
expressions don't multiply from stage to stage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids (semi-major axis, flattening), the systems' parameters, and the shift from the German datum to WGS 84:
# metres, seconds of arc (position vector) and parts per million.
GRS80 = (6378137.0, 1 / 298.257222101)
WGS84 = (6378137.0, 1 / 298.257223563)
BESSEL = (6377397.155, 1 / 299.1528128)
DHDN_SHIFT = (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)

Pair = tuple[Column, Column]
#: Values by name (a dict, or a struct with such fields) -> values by name; the first and the last are x and y, or longitude and latitude.
Stage = Callable[[dict[str, Column] | Column], dict[str, Column]]


def bound(x: Column, y: Column, stages: Sequence[Stage]) -> Column:
    """A struct (x, y) after all stages, each of which is worked out once."""

    def made(values: dict[str, Column]) -> Column:
        return F.struct(*[c.cast("double").alias(n) for n, c in values.items()])

    held = F.array(made({"x": x, "y": y}))
    for stage in stages:
        held = F.transform(held, lambda p: made(stage(p)))  # noqa: B023  (called at once)
    return F.element_at(held, 1)


def plain(x: Column, y: Column, stages: Sequence[Stage]) -> Pair:
    """The same as expressions that repeat what they need."""
    values = {"x": x, "y": y}
    for stage in stages:
        values = stage(values)
    return values["x"], values["y"]


@dataclass(frozen=True)
class Conic:
    """Lambert's conformal conic with two standard parallels."""

    ellipsoid: tuple[float, float]
    parallels: tuple[float, float]
    origin: tuple[float, float]  # longitude, latitude
    false: tuple[float, float]

    def _constants(self) -> tuple[float, float, float, float]:
        e = math.sqrt(self.ellipsoid[1] * (2 - self.ellipsoid[1]))
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        p1, p2, p0 = (math.radians(v) for v in (*self.parallels, self.origin[1]))
        n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        scale = self.ellipsoid[0] * m(p1) / (n * t(p1) ** n)
        return e, n, scale, scale * t(p0) ** n

    def forward_stages(self) -> list[Stage]:
        e, n, scale, start = self._constants()

        def sine(p):
            return {"x": p["x"], "s": F.sin(F.radians(p["y"]))}

        def polar(p):
            t = F.exp(-(F.atanh(p["s"]) - e * F.atanh(e * p["s"])))
            return {"radius": scale * F.pow(t, F.lit(n)), "angle": F.radians(p["x"] - self.origin[0]) * n}

        def flat(p):
            return {"x": self.false[0] + p["radius"] * F.sin(p["angle"]), "y": self.false[1] + start - p["radius"] * F.cos(p["angle"])}

        return [sine, polar, flat]

    def inverse_stages(self) -> list[Stage]:
        _, n, scale, start = self._constants()
        sign = math.copysign(1.0, n)

        def polar(p):
            east, north = p["x"] - self.false[0], start - (p["y"] - self.false[1])
            return {"t": F.pow(F.hypot(east, north) / abs(scale), F.lit(1 / n)), "angle": F.atan2(sign * east, sign * north)}

        def conformal(p):
            return {"angle": p["angle"], "chi": math.pi / 2 - 2 * F.atan(p["t"])}

        def degrees(p):
            return {"x": self.origin[0] + F.degrees(p["angle"]) / n, "y": F.degrees(latitude(p["chi"], self.ellipsoid[1]))}

        return [polar, conformal, degrees]

    def forward(self, lon: Column, lat: Column) -> Pair:
        return plain(lon, lat, self.forward_stages())

    def inverse(self, x: Column, y: Column) -> Pair:
        return plain(x, y, self.inverse_stages())


def latitude(conformal: Column, flattening: float) -> Column:
    """Latitude from conformal latitude, to the fourth order."""
    n = flattening / (2 - flattening)
    terms = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    out = conformal
    for j, term in enumerate(terms, 1):
        out = out + term * F.sin(2 * j * conformal)
    return out


@dataclass(frozen=True)
class EqualArea:
    """Lambert's azimuthal equal-area projection, oblique."""

    ellipsoid: tuple[float, float]
    origin: tuple[float, float]
    false: tuple[float, float]

    def _constants(self) -> tuple[float, float, float, float, float]:
        a, f = self.ellipsoid
        e = math.sqrt(f * (2 - f))
        q = lambda s: (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e)
        s0 = math.sin(math.radians(self.origin[1]))
        most = q(1.0)
        beta, radius = math.asin(q(s0) / most), a * math.sqrt(most / 2)
        stretch = a * math.cos(math.radians(self.origin[1])) / math.sqrt(1 - (e * s0) ** 2) / (radius * math.cos(beta))
        return e, most, beta, radius, stretch

    def forward_stages(self) -> list[Stage]:
        e, most, beta0, radius, stretch = self._constants()

        def sine(p):
            return {"rel": F.radians(p["x"] - self.origin[0]), "s": F.sin(F.radians(p["y"]))}

        def authalic(p):
            s = p["s"]
            return {"rel": p["rel"], "sin_beta": (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e) / most}

        def turned(p):
            return {"rel": p["rel"], "sin_beta": p["sin_beta"], "cos_beta": F.sqrt(1 - p["sin_beta"] * p["sin_beta"]), "cos_rel": F.cos(p["rel"])}

        def flat(p):
            sin_beta, cos_beta, cos_rel = p["sin_beta"], p["cos_beta"], p["cos_rel"]
            b = radius * F.sqrt(2 / (1 + math.sin(beta0) * sin_beta + math.cos(beta0) * cos_beta * cos_rel))
            north = math.cos(beta0) * sin_beta - math.sin(beta0) * cos_beta * cos_rel
            return {"x": self.false[0] + b * stretch * cos_beta * F.sin(p["rel"]), "y": self.false[1] + b / stretch * north}

        return [sine, authalic, turned, flat]

    def inverse_stages(self) -> list[Stage]:
        e, _, beta0, radius, stretch = self._constants()
        e2, e4, e6 = e**2, e**4, e**6

        def centred(p):
            return {"east": (p["x"] - self.false[0]) / stretch, "north": (p["y"] - self.false[1]) * stretch}

        def away(p):
            return {"east": p["east"], "north": p["north"], "rho": F.hypot(p["east"], p["north"])}

        def angle(p):
            return {"east": p["east"], "north": p["north"], "rho": p["rho"], "c": 2 * F.asin(p["rho"] / (2 * radius))}

        def authalic(p):
            east, north, rho, c = p["east"], p["north"], p["rho"], p["c"]
            beta = F.when(rho == 0, F.lit(beta0)).otherwise(F.asin(F.cos(c) * math.sin(beta0) + north * F.sin(c) * math.cos(beta0) / rho))
            return {"beta": beta, "rel": F.atan2(east * F.sin(c), rho * math.cos(beta0) * F.cos(c) - north * math.sin(beta0) * F.sin(c))}

        def degrees(p):
            beta = p["beta"]
            lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
            return {"x": self.origin[0] + F.degrees(p["rel"]), "y": F.degrees(lat)}

        return [centred, away, angle, authalic, degrees]

    def forward(self, lon: Column, lat: Column) -> Pair:
        return plain(lon, lat, self.forward_stages())

    def inverse(self, x: Column, y: Column) -> Pair:
        return plain(x, y, self.inverse_stages())


SYSTEMS = {
    3035: EqualArea(GRS80, (10.0, 52.0), (4_321_000.0, 3_210_000.0)),
    2154: Conic(GRS80, (49.0, 44.0), (3.0, 46.5), (700_000.0, 6_600_000.0)),
}
#: Gauss-Kruger zones on the German datum.
GAUSS_KRUGER = range(31466, 31470)


def helmert(xyz: tuple[Column, Column, Column], shift: tuple[float, ...], back: bool = False) -> tuple[Column, Column, Column]:
    """Seven-parameter shift of geocentric coordinates, in the position vector convention."""
    dx, dy, dz, *turns, ppm = shift
    rx, ry, rz = (math.radians(s / 3600) for s in turns)
    x, y, z = xyz
    scale = 1 + ppm * 1e-6
    if back:
        x, y, z, scale = x - dx, y - dy, z - dz, 1 / scale
        rx, ry, rz, dx, dy, dz = -rx, -ry, -rz, 0.0, 0.0, 0.0
    return dx + scale * (x - rz * y + ry * z), dy + scale * (rz * x + y - rx * z), dz + scale * (-ry * x + rx * y + z)


def shift_stages(shift: tuple[float, ...], before: tuple[float, float], after: tuple[float, float], back: bool = False) -> list[Stage]:
    """Longitude and latitude on another datum, for points on the ellipsoid."""
    a, f = before
    e2 = f * (2 - f)
    a2, f2 = after
    b, to2 = a2 * (1 - f2), f2 * (2 - f2)

    def across(p):
        phi, lam = F.radians(p["y"]), F.radians(p["x"])
        return {"sin_phi": F.sin(phi), "cos_phi": F.cos(phi), "lam": lam}

    def normal(p):
        return {"sin_phi": p["sin_phi"], "cos_phi": p["cos_phi"], "lam": p["lam"], "nu": a / F.sqrt(1 - e2 * p["sin_phi"] * p["sin_phi"])}

    def geocentric(p):
        nu, lam = p["nu"], p["lam"]
        return {"x": nu * p["cos_phi"] * F.cos(lam), "y": nu * p["cos_phi"] * F.sin(lam), "z": nu * (1 - e2) * p["sin_phi"]}

    def move(p):
        return dict(zip("xyz", helmert((p["x"], p["y"], p["z"]), shift, back), strict=True))

    def flat(p):
        return {"x": p["x"], "y": p["y"], "z": p["z"], "flat": F.hypot(p["x"], p["y"])}

    def turned(p):
        return {"lam": F.atan2(p["y"], p["x"]), "z": p["z"], "flat": p["flat"], "theta": F.atan2(p["z"] * a2, p["flat"] * b)}

    def land(p):
        phi = F.atan2(p["z"] + to2 / (1 - to2) * b * F.pow(F.sin(p["theta"]), F.lit(3.0)), p["flat"] - to2 * a2 * F.pow(F.cos(p["theta"]), F.lit(3.0)))
        return {"x": F.degrees(p["lam"]), "y": F.degrees(phi)}

    return [across, normal, geocentric, move, flat, turned, land]
