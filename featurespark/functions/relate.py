"""Spatial relations of two planar geometries, for all type combinations.

A geometry is ``(gtype, zm, [(ptype, [ring (n, d) array ...]) ...])`` as
``wkb.parse_one`` returns it. Coordinates are compared exactly, without a tolerance.

*Closed* means with the boundary. ``covers(a, b)``: no point of b lies outside closed a. ``contains``:
covers, and some point of b lies in the interior of a, so a point on an edge is covered
but not contained. A line's boundary is its two ends, a closed line has none.
"""

from __future__ import annotations

import numpy as np

_NONE = np.zeros((0, 4))


class Shape:
    """Points, segments and polygons of a geometry as arrays."""

    def __init__(self, g):
        parts = [(t, [np.asarray(r)[:, :2] for r in rings if len(r)]) for t, rings in g[2]]
        self.points = np.array([r[0] for t, rings in parts if t == 1 for r in rings]).reshape(-1, 2)
        self.lines = [r for t, rings in parts if t == 2 for r in rings]
        self.polygons = [rings for t, rings in parts if t == 3 and rings]
        rings = [r for p in self.polygons for r in p]
        self.line_segments = _segments(self.lines)
        self.edges = _segments(rings)
        self.segments = np.concatenate([self.line_segments, self.edges])
        every = [self.points, *self.lines, *rings]
        self.positions = np.concatenate(every) if every else np.zeros((0, 2))
        ends = [tuple(e) for line in self.lines for e in (line[0], line[-1])]
        self.ends = {e for e in ends if ends.count(e) % 2}

    @property
    def box(self):
        p = self.positions
        return None if not len(p) else (p[:, 0].min(), p[:, 1].min(), p[:, 0].max(), p[:, 1].max())


def _segments(rings) -> np.ndarray:
    pairs = [np.concatenate([r[:-1], r[1:]], axis=1) for r in rings if len(r) > 1]
    return np.concatenate(pairs) if pairs else _NONE


def _on(segments: np.ndarray, x, y) -> bool:
    """Whether a point lies on any of the segments."""
    ax, ay, bx, by = segments.T
    return bool(np.any(((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (np.minimum(ax, bx) <= x)
                       & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))))


def _in_rings(rings, x, y) -> bool:
    """Even-odd rule over all rings of a polygon, for a point that is not on them."""
    ax, ay, bx, by = _segments(rings).T
    with np.errstate(divide="ignore", invalid="ignore"):
        right = x < (bx - ax) * (y - ay) / (by - ay) + ax
    return bool(np.count_nonzero(((ay > y) != (by > y)) & right) % 2)


def _place(a: Shape, x, y) -> int:
    """2 in the interior of ``a``, 1 on its boundary, 0 outside."""
    on_edge = False
    for rings in a.polygons:
        if _on(_segments(rings), x, y):
            on_edge = True
        elif _in_rings(rings, x, y):
            return 2
    if len(a.line_segments) and _on(a.line_segments, x, y):
        return 2 if (x, y) not in a.ends else 1
    if len(a.points) and bool(np.any((a.points[:, 0] == x) & (a.points[:, 1] == y))):
        return 2
    return int(on_edge)


def _pieces(segment: np.ndarray, others: np.ndarray):
    """``(x, y, along)`` in the middle of each piece into which ``others`` cut a segment.

    ``along`` tells that the piece runs along one of them.
    """
    px, py, qx, qy = segment
    dx, dy = qx - px, qy - py
    if dx == 0 and dy == 0:
        return [(px, py, len(others) > 0 and _on(others, px, py))]
    ax, ay, bx, by = others.T if len(others) else _NONE.T
    ex, ey = bx - ax, by - ay
    cross = dx * ey - dy * ex
    cuts, along = [0.0, 1.0], []
    flat = (cross == 0) & (dx * (ay - py) == dy * (ax - px))
    for i in np.flatnonzero(flat):
        t = sorted(((x - px) * dx + (y - py) * dy) / (dx * dx + dy * dy) for x, y in ((ax[i], ay[i]), (bx[i], by[i])))
        lo, hi = max(t[0], 0.0), min(t[1], 1.0)
        if lo < hi:
            along.append((lo, hi))
            cuts += [lo, hi]
    some = np.flatnonzero(cross != 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((ax - px) * ey - (ay - py) * ex)[some] / cross[some]
        u = ((ax - px) * dy - (ay - py) * dx)[some] / cross[some]
    cuts += t[(t > 0) & (t < 1) & (u >= 0) & (u <= 1)].tolist()
    cuts = sorted(set(cuts))
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        m = (lo + hi) / 2
        out.append((px + m * dx, py + m * dy, any(s <= lo and hi <= e for s, e in along)))
    return out


def _cross(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any segment of ``a`` meets any of ``b``."""
    if not len(a) or not len(b):
        return False

    def side(p, x, y):
        return np.sign((p[:, 2] - p[:, 0])[:, None] * (y[None] - p[:, 1][:, None])
                       - (p[:, 3] - p[:, 1])[:, None] * (x[None] - p[:, 0][:, None]))

    a1, a2 = side(b, a[:, 0], a[:, 1]).T, side(b, a[:, 2], a[:, 3]).T
    b1, b2 = side(a, b[:, 0], b[:, 1]), side(a, b[:, 2], b[:, 3])
    boxes = np.ones((len(a), len(b)), bool)
    for k in (0, 1):
        lo_a, hi_a = np.minimum(a[:, k], a[:, k + 2]), np.maximum(a[:, k], a[:, k + 2])
        lo_b, hi_b = np.minimum(b[:, k], b[:, k + 2]), np.maximum(b[:, k], b[:, k + 2])
        boxes &= (lo_a[:, None] <= hi_b[None]) & (lo_b[None] <= hi_a[:, None])
    return bool(np.any(boxes & (a1 * a2 <= 0) & (b1 * b2 <= 0)))


def intersects(g, h) -> bool:
    a, b = Shape(g), Shape(h)
    if a.box is None or b.box is None:
        return False
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.box, b.box
    if ax0 > bx1 or bx0 > ax1 or ay0 > by1 or by0 > ay1:
        return False
    if _cross(a.segments, b.segments):
        return True
    # without a crossing, a part of one lies in the other whole or not at all
    return any(_place(p, *q) for p, s in ((a, b), (b, a)) for q in _anchors(s))


def _anchors(s: Shape):
    """Every point, and one position of every line and polygon ring."""
    yield from (tuple(p) for p in s.points)
    yield from (tuple(r[0]) for r in (*s.lines, *(r for p in s.polygons for r in p)))


def _covering(a: Shape, b: Shape) -> int:
    """0: some of b lies outside a; 1: b is covered; 2: and meets the interior of a."""
    if a.box is None or b.box is None:
        return 0
    met = False
    for x, y in b.points:
        place = _place(a, x, y)
        if not place:
            return 0
        met |= place == 2
    for s in b.segments:
        for x, y, along in _pieces(s, a.segments):
            inside = any(_in_rings(r, x, y) and not _on(_segments(r), x, y) for r in a.polygons)
            if not (along or inside):
                return 0
            met |= inside or along and len(a.line_segments) > 0 and _along(a.line_segments, s)
    for rings in b.polygons:
        # no edge of a may run through b's inside unless a goes on behind it, and a must have an area there
        for s in a.edges:
            for x, y, along in _pieces(s, b.edges):
                if not along and _in_rings(rings, x, y) and not _both_sides(a, s, x, y):
                    return 0
        x, y = _inner_point(rings)
        if not any(_in_rings(r, x, y) for r in a.polygons):
            return 0
        met = True
    return 2 if met else 1


def _along(segments: np.ndarray, s: np.ndarray) -> bool:
    return any(along for _, _, along in _pieces(s, segments))


def _both_sides(a: Shape, s: np.ndarray, x, y) -> bool:
    """Whether polygons of ``a`` lie on either side of one of its edges, next to ``(x, y)``."""
    dx, dy = s[2] - s[0], s[3] - s[1]
    step = 1e-9
    return all(any(_in_rings(r, x - k * dy * step, y + k * dx * step) for r in a.polygons) for k in (1, -1))


def _inner_point(rings) -> tuple[float, float]:
    """A point inside a polygon: the middle of the widest stretch of a line across it."""
    ys = np.unique(np.concatenate([r[:, 1] for r in rings]))
    y = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2 if len(ys) > 1 else ys[0]
    ax, ay, bx, by = _segments(rings).T
    hit = (ay > y) != (by > y)
    xs = np.sort(ax[hit] + (bx - ax)[hit] * (y - ay[hit]) / (by - ay)[hit])
    if len(xs) < 2:
        return float(rings[0][0, 0]), float(rings[0][0, 1])
    k = int(np.argmax(xs[1::2] - xs[:len(xs) // 2 * 2:2])) * 2
    return float(xs[k] + xs[k + 1]) / 2, float(y)


def covers(g, h) -> bool:
    return _covering(Shape(g), Shape(h)) > 0


def contains(g, h) -> bool:
    return _covering(Shape(g), Shape(h)) == 2


def distance(g, h) -> float:
    """Smallest distance of two geometries; NaN if one is empty."""
    a, b = Shape(g), Shape(h)
    if a.box is None or b.box is None:
        return float("nan")
    if intersects(g, h):
        return 0.0
    d = np.hypot(a.positions[:, None, 0] - b.positions[None, :, 0], a.positions[:, None, 1] - b.positions[None, :, 1])
    return float(min(d.min(), _to_segments(a.positions, b.segments), _to_segments(b.positions, a.segments)))


def _to_segments(points: np.ndarray, segments: np.ndarray) -> float:
    return float(_gaps(points, segments).min()) if len(segments) else np.inf


def _gaps(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """The distance of each point and segment."""
    ax, ay, bx, by = segments.T
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = ((points[:, :1] - ax) * dx + (points[:, 1:2] - ay) * dy) / np.where(long == 0, 1, long)
    t = np.clip(t, 0, 1)
    return np.hypot(points[:, :1] - (ax + t * dx), points[:, 1:2] - (ay + t * dy))


# -- a batch against one geometry -----------------------------------------------------
_PAIRS = 1 << 20          # comparisons of a step


class Batch:
    """The geometries of a batch (``wkb.Flat``) as flat arrays of segments and anchors, each with its row."""

    def __init__(self, flat):
        self.n = len(flat.valid)
        part = np.repeat(np.arange(len(flat.part_row)), flat.part_rings)
        kind = flat.part_type[part]
        size = flat.ring_n * flat.ring_dims
        first = np.cumsum(size) - size
        own = (kind != 1) & (flat.ring_n > 1)
        n = (flat.ring_n - 1)[own]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a = np.repeat(first[own], n) + step * np.repeat(flat.ring_dims[own], n)
        b = a + np.repeat(flat.ring_dims[own], n)
        c = flat.coords
        self.segments = np.stack([c[a], c[a + 1], c[b], c[b + 1]], axis=1)
        self.row, self.part = np.repeat(flat.ring_row[own], n), np.repeat(part[own], n)
        self.of_polygon = np.repeat(kind[own] == 3, n)
        some = np.flatnonzero(flat.ring_n > 0)
        self.anchor_row, self.anchors = flat.ring_row[some], np.stack([c[first[some]], c[first[some] + 1]], axis=1)
        self.point_row = self.anchor_row[kind[some] == 1]
        self.points = self.anchors[kind[some] == 1]
        self.position_row, x, y = flat.positions()
        self.positions = np.stack([x, y], axis=1)
        self.box = [flat.bounds(k).to_numpy(zero_copy_only=False) for k in range(4)]
        self.some = ~flat.bounds(0).is_null().to_numpy(zero_copy_only=False)

    def _any(self, rows, hit) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[rows[hit]] = True
        return out

    def at_point(self, x, y) -> np.ndarray:
        """Rows that the point lies in or on, as ``_place`` tells."""
        ax, ay, bx, by = self.segments.T
        on = ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) \
            & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
        with np.errstate(divide="ignore", invalid="ignore"):
            right = x < (bx - ax) * (y - ay) / (by - ay) + ax
        cut = self.of_polygon & ((ay > y) != (by > y)) & right
        odd = np.flatnonzero(np.bincount(self.part[cut]) % 2) if cut.any() else np.zeros(0, np.int64)
        out = self._any(self.row, on | np.isin(self.part, odd) & self.of_polygon)
        return out | self._any(self.point_row, (self.points[:, 0] == x) & (self.points[:, 1] == y))

    def intersects(self, other: Shape) -> np.ndarray:
        """``relate.intersects`` of every row and a geometry."""
        if other.box is None:
            return np.zeros(self.n, bool)
        x0, y0, x1, y1 = self.box
        bx0, by0, bx1, by1 = other.box
        near = self.some & ~((x0 > bx1) | (bx0 > x1) | (y0 > by1) | (by0 > y1))
        met = np.zeros(self.n, bool)
        own = near[self.row]
        p, row = self.segments[own], self.row[own]
        ax, ay, bx, by = p.T
        for qx, qy, rx, ry in other.segments:
            b1 = np.sign((bx - ax) * (qy - ay) - (by - ay) * (qx - ax))
            b2 = np.sign((bx - ax) * (ry - ay) - (by - ay) * (rx - ax))
            a1 = np.sign((rx - qx) * (ay - qy) - (ry - qy) * (ax - qx))
            a2 = np.sign((rx - qx) * (by - qy) - (ry - qy) * (bx - qx))
            boxes = (np.minimum(ax, bx) <= max(qx, rx)) & (min(qx, rx) <= np.maximum(ax, bx)) \
                & (np.minimum(ay, by) <= max(qy, ry)) & (min(qy, ry) <= np.maximum(ay, by))
            met[row[boxes & (a1 * a2 <= 0) & (b1 * b2 <= 0)]] = True
        for x, y in _anchors(other):
            met |= near & self.at_point(x, y)
        left = near & ~met
        own = np.flatnonzero(left[self.anchor_row])
        met[self.anchor_row[own[_within(other, self.anchors[own])]]] = True
        return met

    def distance(self, other: Shape) -> np.ndarray:
        """``relate.distance`` of every row and a geometry; NaN for empty ones."""
        out = np.full(self.n, np.inf)
        if other.box is None:
            return np.full(self.n, np.nan)
        step = max(1, _PAIRS // max(1, len(other.positions), len(other.segments)))
        for lo in range(0, len(self.positions), step):
            p, row = self.positions[lo:lo + step], self.position_row[lo:lo + step]
            d = np.hypot(p[:, None, 0] - other.positions[None, :, 0], p[:, None, 1] - other.positions[None, :, 1]).min(axis=1)
            if len(other.segments):
                d = np.minimum(d, _gaps(p, other.segments).min(axis=1))
            np.minimum.at(out, row, d)
        step = max(1, _PAIRS // max(1, len(other.positions)))
        for lo in range(0, len(self.segments), step):
            np.minimum.at(out, self.row[lo:lo + step], _gaps(other.positions, self.segments[lo:lo + step]).min(axis=0))
        out[self.intersects(other)] = 0.0
        return np.where(self.some, out, np.nan)


def _within(s: Shape, points: np.ndarray) -> np.ndarray:
    """Whether each point lies in or on a geometry, as ``_place`` tells."""
    out = np.zeros(len(points), bool)
    step = max(1, _PAIRS // max(1, len(s.segments), len(s.points)))
    for lo in range(0, len(points), step):
        x, y = points[lo:lo + step, :1], points[lo:lo + step, 1:]
        got = out[lo:lo + step]
        for rings in [_segments(r) for r in s.polygons] + [s.line_segments]:
            ax, ay, bx, by = rings.T
            got |= np.any(((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx))
                          & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by)), axis=1)
            if rings is not s.line_segments:
                with np.errstate(divide="ignore", invalid="ignore"):
                    right = x < (bx - ax) * (y - ay) / (by - ay) + ax
                got |= np.count_nonzero(((ay > y) != (by > y)) & right, axis=1) % 2 == 1
        got |= np.any((s.points[None, :, 0] == x) & (s.points[None, :, 1] == y), axis=1)
    return out
