"""Neighbourhoods R_k: steps, the cells between, and the errors of their lattices."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

Step = tuple[int, int]
LARGEST = 127


def radius(k: int | str) -> int:
    """k from a number or from the first digits of a text."""
    if isinstance(k, str):
        digits = re.match(r"\D*(\d+)", k)
        if not digits:
            raise ValueError(f"no number in {k!r}")
        k = int(digits[1])
    if not 0 <= k <= LARGEST:
        raise ValueError(f"the neighbourhood must lie between 0 and {LARGEST}, not {k}")
    return k


@lru_cache(maxsize=64)
def _directed(k: int) -> tuple[Step, ...]:
    if k == 0:
        return ((-1, 0), (0, -1), (0, 1), (1, 0))
    span = range(-k, k + 1)
    # The square's lattice points that no shorter step in the same direction reaches.
    return tuple((r, c) for r in span for c in span if math.gcd(r, c) == 1)


def steps(k: int | str, directed: bool = True) -> list[Step]:
    """Steps of R_k; if not directed one of each step and its reverse: down, or level to the right."""
    found = _directed(radius(k))
    return list(found) if directed else [(r, c) for r, c in found if r > 0 or r == 0 and c > 0]


def between(dr: int, dc: int) -> list[Step]:
    """Cells that a step passes over, as offsets from its start; a bag, so some may repeat."""
    far = max(abs(dr), abs(dc))
    if abs(dr) + abs(dc) <= 1:
        return []
    if far == 1:
        return [(dr, 0), (0, dc)]
    return [(side(i * dr / far), side(i * dc / far)) for i in range(1, far) for side in (math.floor, math.ceil)]


def factor(dr: int, dc: int, cells_between: int | None = None) -> float:
    """A step's length over the number of its cells."""
    n = len(between(dr, dc)) if cells_between is None else cells_between
    return math.sqrt(dr * dr + dc * dc) / (2 + n)


@dataclass(frozen=True)
class Bounds:
    """Half-open ranges of rows and columns."""

    row0: int
    row1: int
    col0: int
    col1: int


def region_bounds(dr: int, dc: int, height: int, width: int) -> tuple[Bounds, Bounds]:
    """Where a step can start, and where it then ends."""
    start = Bounds(max(0, -dr), height - max(0, dr), max(0, -dc), width - max(0, dc))
    return start, Bounds(start.row0 + dr, start.row1 + dr, start.col0 + dc, start.col1 + dc)


def most_edges(height: int, width: int, of: list[Step]) -> int:
    return sum(max(0, height - abs(r)) * max(0, width - abs(c)) for r, c in of)


def normal_angle(angle: float) -> float:
    return angle % (2 * math.pi)


def directions(of: list[Step]) -> list[float]:
    """The sorted distinct angles of steps."""
    return sorted({round(normal_angle(math.atan2(c, r)), 12) for r, c in of})


def adjacent(angle: float, sorted_angles: list[float]) -> tuple[float, float]:
    """The directions on both sides of an angle; of a direction itself, those before and after it."""
    phi, n = round(normal_angle(angle), 12), len(sorted_angles)
    below = sum(a < phi for a in sorted_angles)
    above = below + (below < n and sorted_angles[below] == phi)
    low = sorted_angles[below - 1] - (2 * math.pi if below == 0 else 0)
    high = sorted_angles[above % n] + (2 * math.pi if above == n else 0)
    return low, high


def elongation(phi: float, low: float, high: float) -> float:
    """How much longer than straight a way at angle phi is that goes along two directions only."""
    between_ = math.sin(high - low)
    if abs(between_) < 1e-10:
        raise ValueError("the directions are parallel")
    return (math.sin(high - phi) + math.sin(phi - low)) / between_


def deviation(phi: float, low: float, high: float) -> float:
    """How far from the straight line such a way gets, as a share of its length."""
    between_ = math.sin(high - low)
    if abs(between_) < 1e-10:
        raise ValueError("the directions are parallel")
    return abs(math.sin(high - phi) * math.sin(phi - low) / between_)


def largest_errors(k: int | str) -> tuple[float, float]:
    """The largest elongation and deviation of R_k, met half way between two directions."""
    found = directions(steps(k))
    worst = [0.0, 0.0]
    for low, high in zip(found, [*found[1:], found[0] + 2 * math.pi], strict=True):
        mid = (low + high) / 2
        worst = [max(worst[0], elongation(mid, low, high)), max(worst[1], deviation(mid, low, high))]
    return worst[0], worst[1]
