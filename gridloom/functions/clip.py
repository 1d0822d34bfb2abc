"""Areas and lines cut to an area by its sides, a feature staying one feature.

All sides are split where they meet, and each piece is told which of its sides lie inside both areas,
by the even-odd rule. The pieces with one such side bound the common area; walked with it on the left they
close to outer rings (counter-clockwise) and holes (clockwise). Which sides come near each
other is found by sorting, so work grows with the sides that share a height or breadth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points nearer than this part of the extent are one point; pairs of sides looked at together.
NEAR, CHUNK = 2.0**-43, 1 << 20
Rings = list[np.ndarray]


def sides_of(rings: Rings) -> np.ndarray:
    """[side, (ax, ay, bx, by)] of rings of points; sides without length are left out."""
    sides = [np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings if len(r)]
    found = np.concatenate(sides) if sides else np.empty((0, 4))
    return found[(found[:, 0] != found[:, 2]) | (found[:, 1] != found[:, 3])]


def _span(sides: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(sides[:, axis], sides[:, axis + 2]), np.maximum(sides[:, axis], sides[:, axis + 2])


def _starting(low: np.ndarray, high: np.ndarray, at: np.ndarray, side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): at[j] lies in the span i, in chunks; ``side`` tells whether a span holds its lower end ("left") or not."""
    order = np.argsort(at, kind="stable")
    first, last = np.searchsorted(at[order], low, side), np.searchsorted(at[order], high, "right")
    many = np.maximum(last - first, 0)
    ends = np.concatenate([[0], np.cumsum(many)])
    for chunk in range(0, int(ends[-1]), CHUNK):
        flat = np.arange(chunk, min(chunk + CHUNK, int(ends[-1])))
        i = np.searchsorted(ends, flat, "right") - 1
        yield i, order[first[i] + flat - ends[i]]


def _meeting(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the sides of ``a`` and ``b`` whose boxes meet."""
    (alow, ahigh), (blow, bhigh) = _span(a, 1), _span(b, 1)
    (aleft, aright), (bleft, bright) = _span(a, 0), _span(b, 0)
    for i, j in (*_starting(alow, ahigh, blow, "left"), *((i, j) for j, i in _starting(blow, bhigh, alow, "right"))):
        near = (aleft[i] <= bright[j]) & (bleft[j] <= aright[i])
        yield i[near], j[near]


def _cuts(a: np.ndarray, b: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """(side of a, point): where sides of ``b`` meet those of ``a``, ends of either taken as they stand."""
    who, where = [np.empty(0, np.int64)], [np.empty((0, 2))]
    for i, j in _meeting(a, b):
        p, d, q, e = a[i, :2], a[i, 2:] - a[i, :2], b[j, :2], b[j, 2:] - b[j, :2]
        cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
        length, other = np.hypot(*d.T), np.hypot(*e.T)
        turn = cross(d, e)
        along = np.abs(turn) <= 1e-14 * length * other
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(q - p, e) / turn, cross(q - p, d) / turn
            slack, room = near / length, near / other
            met = ~along & (t >= -slack) & (t <= 1 + slack) & (u >= -room) & (u <= 1 + room)
            point = p + t[:, None] * d
            for at_end, end in ((u <= room, q), (u >= 1 - room, q + e)):
                point = np.where(at_end[:, None], end, point)
        who.append(i[met])
        where.append(point[met])
        for end in (q, q + e):  # sides on one line split each other at their ends
            reach = ((end - p) * d).sum(1) / length
            on = along & (np.abs(cross(d, end - p)) <= near * length) & (reach > 0) & (reach < length)
            who.append(i[on])
            where.append(end[on])
    return np.concatenate(who), np.concatenate(where)


def _left_of(at: np.ndarray, sides: np.ndarray, axis: int, own: np.ndarray | None = None) -> np.ndarray:
    """For each point how many sides pass it on its left (axis 1) or below it (axis 0), modulo 2; ``own``: its own side, not counted."""
    low, high = _span(sides, axis)
    count = np.zeros(len(at), np.int64)
    for j, i in _starting(low, high, at[:, axis], "left"):
        a, b = sides[j, :2], sides[j, 2:]
        y = at[i, axis]
        spans = (low[j] <= y) & (y < high[j])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[:, 1 - axis] + (y - a[:, axis]) / (b[:, axis] - a[:, axis]) * (b[:, 1 - axis] - a[:, 1 - axis])
        counts = spans & (x < at[i, 1 - axis])
        if own is not None:
            counts &= own[i] != j
        count += np.bincount(i[counts], minlength=len(at))
    return count % 2


def _near_box(rings: Rings, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sides of a mask share a breadth or height with rings, and which their box; the box."""
    points = np.concatenate(rings)
    low, high = points.min(0), points.max(0)
    (left, right), (down, up) = _span(mask, 0), _span(mask, 1)
    wide, tall = (left <= high[0]) & (right >= low[0]), (down <= high[1]) & (up >= low[1])
    return wide | tall, wide & tall, np.array([low, high])


def area_in(rings: Rings, mask: np.ndarray) -> Rings | None:
    """The part of an area inside a mask, given by its sides: each outer ring and its holes in turn. None: all of it, unchanged."""
    rings = [r for r in rings if len(r)]
    if not rings or not len(mask):
        return []
    facing, touching, box = _near_box(rings, mask)
    if not touching.any():
        return None if _left_of(rings[0][:1], mask, 1)[0] else []
    own = sides_of(rings)
    sides = np.concatenate([own, mask[facing]])
    belongs = np.repeat([1, 2], [len(own), int(facing.sum())])
    meet = np.concatenate([np.ones(len(own), bool), touching[facing]])
    base = np.minimum(box[0], 0)
    near = NEAR * max(np.abs(box).max(), (box[1] - box[0]).max())
    if near == 0:
        return []
    # Nodes: ends and crossings; ends come first, so a node keeps their coordinates.
    busy = np.flatnonzero(meet)
    cut, where = _cuts(sides[busy], sides[busy], near)
    points = np.concatenate([sides[:, :2], sides[:, 2:], where])
    _, first, node = np.unique(np.round((points - base) / (16 * near)) + 0.0, axis=0, return_index=True, return_inverse=True)
    node, spot = node.reshape(-1), points[first]
    side = np.concatenate([np.arange(len(sides)), np.arange(len(sides)), busy[cut]])
    start = sides[side, :2]
    along = ((points - start) * (sides[side, 2:] - start)).sum(1)
    order = np.lexsort((along, side))
    side, node = side[order], node[order]
    same = (side[1:] == side[:-1]) & (node[1:] != node[:-1])
    u, v, of = node[:-1][same], node[1:][same], belongs[side[1:][same]]
    # Pieces go up, level ones to the right; a piece that an area has an even number of times bounds nothing of it.
    down = (spot[u, 1] > spot[v, 1]) | ((spot[u, 1] == spot[v, 1]) & (spot[u, 0] > spot[v, 0]))
    u, v = np.where(down, v, u), np.where(down, u, v)
    ends, at = np.unique(np.stack([u, v], 1), axis=0, return_inverse=True)
    held = [np.bincount(at.reshape(-1)[of == k], minlength=len(ends)) % 2 for k in (1, 2)]
    pieces = np.hstack([spot[ends[:, 0]], spot[ends[:, 1]]])
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    level = pieces[:, 1] == pieces[:, 3]
    left, right = np.ones(len(ends), bool), np.ones(len(ends), bool)
    for odd in held:
        bounds = np.flatnonzero(odd)
        place = np.full(len(ends), -1)
        place[bounds] = np.arange(len(bounds))
        before = np.empty(len(ends), np.int64)
        for axis, some in ((1, ~level), (0, level)):
            before[some] = _left_of(middle[some], pieces[bounds], axis, place[some])
        left &= before == 1
        right &= (before ^ odd) == 1
    kept = np.flatnonzero(left != right)
    ahead = np.where(level, right, left)[kept]  # below a level piece counts as before it, and above it is its left
    a, b = ends[kept].T
    return _ordered(_walked(np.where(ahead, a, b), np.where(ahead, b, a), spot), (16 * near) ** 2)


def _walked(start: np.ndarray, end: np.ndarray, spot: np.ndarray) -> Rings:
    """Rings of directed pieces, turning left as far as may be; a ring that comes back to a node is two."""
    leaving: dict[int, list[int]] = {}
    for piece, node in enumerate(start.tolist()):
        leaving.setdefault(node, []).append(piece)
    heading = spot[end] - spot[start]
    angle = np.arctan2(heading[:, 1], heading[:, 0])
    used, out = np.zeros(len(start), bool), []
    for piece in range(len(start)):
        path: list[int] = []
        seen: dict[int, int] = {}
        now: int | None = piece
        while now is not None and not used[now]:
            used[now] = True
            seen[int(start[now])] = len(path)
            path.append(now)
            node = int(end[now])
            if node in seen:
                loop = path[seen[node] :]
                del path[seen[node] :]
                for gone in loop:
                    seen.pop(int(start[gone]), None)
                out.append(spot[start[loop]])
            free = [p for p in leaving.get(node, ()) if not used[p]]
            now = max(free, key=lambda p: (angle[p] - angle[now] + np.pi) % (2 * np.pi)) if free else None  # noqa: B023
    return out


def twice_area(ring: np.ndarray) -> float:
    """Twice the area, negative for clockwise rings."""
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def _ordered(rings: Rings, least: float) -> Rings:
    """Rings without points on their sides and without slivers; each outer ring, leftmost first, and after it the holes in it."""
    plain = []
    for ring in rings:
        back, on = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        bends = np.abs(back[:, 0] * on[:, 1] - back[:, 1] * on[:, 0]) > 1e-12 * np.hypot(*back.T) * np.hypot(*on.T)
        if bends.sum() > 2:
            plain.append(ring[bends])
    sized = [(r, twice_area(r)) for r in plain]
    outer = sorted(((r, s) for r, s in sized if s > least), key=lambda x: x[0].min(0).tolist())
    holes: list[list[np.ndarray]] = [[] for _ in outer]
    for ring, size in sized:
        if size < -least:
            inside = ((ring[:1] + ring[1:2]) / 2, (ring[1:2] + ring[2:3]) / 2)  # middles of sides: a corner may touch the outer ring
            around = [k for k, (r, s) in enumerate(outer) if s > -size and all(_left_of(p, sides_of([r]), 1)[0] for p in inside)]
            if around:
                holes[min(around, key=lambda k: outer[k][1])].append(ring)
    return [r for (ring, _), inner in zip(outer, holes, strict=True) for r in (ring, *inner)]


def line_in(lines: Rings, mask: np.ndarray) -> Rings | None:
    """The parts of lines inside a mask or along its sides, each as long as it runs on. None: all, unchanged."""
    lines = [r for r in lines if len(r) > 1]
    if not lines or not len(mask):
        return []
    _, touching, box = _near_box(lines, mask)
    if not touching.any():
        return None if _left_of(lines[0][:1], mask, 1)[0] else []
    near, close = NEAR * max(np.abs(box).max(), (box[1] - box[0]).max()), mask[touching]
    out: Rings = []
    for line in lines:
        sides = np.hstack([line[:-1], line[1:]])
        sides = sides[(sides[:, :2] != sides[:, 2:]).any(1)]
        cut, where = _cuts(sides, close, near)
        points = np.concatenate([sides[:, :2], sides[:, 2:], where])
        side = np.concatenate([np.arange(len(sides)), np.arange(len(sides)), cut])
        along = ((points - sides[side, :2]) * (sides[side, 2:] - sides[side, :2])).sum(1)
        order = np.lexsort((along, side))
        points, side = points[order], side[order]
        real = (side[1:] == side[:-1]) & (np.hypot(*(points[1:] - points[:-1]).T) > 16 * near)
        a, b, side = points[:-1][real], points[1:][real], side[1:][real]
        middle = (a + b) / 2
        inside = _left_of(middle, mask, 1) == 1
        for i, j in _meeting(np.hstack([middle, middle]), close):
            d, back = close[j, 2:] - close[j, :2], middle[i] - close[j, :2]
            inside[i[np.abs(d[:, 0] * back[:, 1] - d[:, 1] * back[:, 0]) <= 16 * near * np.hypot(*d.T)]] = True
        run: list[np.ndarray] = []
        last = -1
        for k in np.flatnonzero(inside).tolist():
            if run and (a[k] == run[-1]).all():
                if side[k] == last:
                    run.pop()  # a cut within a side that goes on
                run.append(b[k])
            else:
                if run:
                    out.append(np.array(run))
                run = [a[k], b[k]]
            last = side[k]
        if run:
            out.append(np.array(run))
    return out


def points_in(groups: Rings, mask: np.ndarray) -> Rings:
    inside = [r[_left_of(r, mask, 1) == 1] for r in groups if len(r)]
    return [r for r in inside if len(r)]
