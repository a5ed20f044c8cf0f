"""``ST_*`` SQL functions for use inside a guarded ``where`` predicate.

Predicates arrive as SQL text and geometry columns hold WKB, so these are
registered on the query session as Arrow UDFs over WKB. Relations between two geometries
are in ``functions.relate``; a geometry that repeats from row to row, such as a constant, is parsed
once. The DataFrame API has native equivalents for points and measures in
``functions.geometry``, with the same boundary rule: a point on an edge is not contained
(``ST_Contains``/``ST_Within``) but covered, and does intersect.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

from featurespark.functions import relate
from featurespark.functions.wkb import TYPE_NAMES, Flat, encode_one, parse_one


@lru_cache(maxsize=64)
def _parsed(v: bytes | None):
    return parse_one(v)


def _ring_area(r: np.ndarray) -> float:
    if len(r) < 3:
        return 0.0
    x = r[:, 0] - r[0, 0]
    y = r[:, 1] - r[0, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2.0)


def _area(g) -> float:
    return sum(abs(_ring_area(rs[0])) - sum(abs(_ring_area(h)) for h in rs[1:])
               for t, rs in g[2] if t == 3 and rs)


def _line_len(r: np.ndarray) -> float:
    return float(np.hypot(np.diff(r[:, 0]), np.diff(r[:, 1])).sum()) if len(r) > 1 else 0.0


def _length(g) -> float:
    return sum(_line_len(rs[0]) for t, rs in g[2] if t == 2 and rs)


def _perimeter(g) -> float:
    return sum(_line_len(r) for t, rs in g[2] if t == 3 for r in rs)


def _positions(g) -> np.ndarray:
    rings = [r[:, :2] for _, rs in g[2] for r in rs if len(r)]
    return np.concatenate(rings) if rings else np.zeros((0, 2))


def _bbox(g):
    p = _positions(g)
    return None if not len(p) else (p[:, 0].min(), p[:, 1].min(), p[:, 0].max(), p[:, 1].max())


def _centroid(g):
    a_tot = mx = my = 0.0
    for t, rs in g[2]:
        if t != 3:
            continue
        for k, r in enumerate(rs):
            if len(r) < 3:
                continue
            x0, y0 = r[0, 0], r[0, 1]
            x, y = r[:, 0] - x0, r[:, 1] - y0
            cr = x[:-1] * y[1:] - x[1:] * y[:-1]
            a = cr.sum() / 2.0
            cx = ((x[:-1] + x[1:]) * cr).sum() / 6.0 + a * x0
            cy = ((y[:-1] + y[1:]) * cr).sum() / 6.0 + a * y0
            sign = 1.0 if (k == 0) == (a >= 0) else -1.0
            a_tot += sign * a
            mx += sign * cx
            my += sign * cy
    if a_tot:
        return mx / a_tot, my / a_tot
    p = _positions(g)
    return (float(p[:, 0].mean()), float(p[:, 1].mean())) if len(p) else None


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums by group, added in the order of the values."""
    return np.bincount(groups, values, n)


def _rings(flat: Flat):
    """Of the rings of a batch: part, type, place in the part; and of the segments: ring, and their ends."""
    part = np.repeat(np.arange(len(flat.part_row)), flat.part_rings)
    nth = np.arange(len(part)) - np.repeat(np.cumsum(flat.part_rings) - flat.part_rings, flat.part_rings)
    size = flat.ring_n * flat.ring_dims
    first = np.cumsum(size) - size
    n = np.maximum(flat.ring_n - 1, 0)
    ring = np.repeat(np.arange(len(n)), n)
    a = first[ring] + (np.arange(len(ring)) - np.repeat(np.cumsum(n) - n, n)) * flat.ring_dims[ring]
    return part, flat.part_type[part], nth, first, ring, a, a + flat.ring_dims[ring]


def _shoelace(flat: Flat, first, ring, a, b):
    """Cross product of each segment's ends from the ring's first position, those ends, and the ring's signed area."""
    c = flat.coords
    x0, y0 = c[first[ring]], c[first[ring] + 1]
    xa, ya, xb, yb = c[a] - x0, c[a + 1] - y0, c[b] - x0, c[b + 1] - y0
    cross = xa * yb - xb * ya
    area = _sums(cross, ring, len(flat.ring_n)) / 2.0
    return cross, xa, ya, xb, yb, np.where(flat.ring_n < 3, 0.0, area)


def _areas(flat: Flat) -> pa.Array:
    part, kind, nth, first, ring, a, b = _rings(flat)
    *_, area = _shoelace(flat, first, ring, a, b)
    sign = np.where(nth == 0, 1.0, -1.0) * (kind == 3)
    of_part = _sums(np.abs(area) * sign, part, len(flat.part_row))
    return pa.array(_sums(of_part, flat.part_row, len(flat.valid)), mask=~flat.valid)


def _lengths(ptype: int):
    def run(flat: Flat) -> pa.Array:
        part, kind, _, _, ring, a, b = _rings(flat)
        c = flat.coords
        long = _sums(np.hypot(c[b] - c[a], c[b + 1] - c[a + 1]), ring, len(flat.ring_n))
        return pa.array(_sums(np.where(kind == ptype, long, 0.0), flat.ring_row, len(flat.valid)), mask=~flat.valid)
    return run


def _centroids(flat: Flat) -> pa.Array:
    """Points: of the area of polygons, else the mean of the positions; null for empty geometries."""
    n = len(flat.valid)
    part, kind, nth, first, ring, a, b = _rings(flat)
    cross, xa, ya, xb, yb, area = _shoelace(flat, first, ring, a, b)
    own = (kind == 3) & (flat.ring_n >= 3)
    sign = np.where((nth == 0) == (area >= 0), 1.0, -1.0) * own
    whole = _sums(sign * area, flat.ring_row, n)
    row, *xy = flat.positions()
    count = flat.counts()
    out = []
    for axis, ends in ((0, xa + xb), (1, ya + yb)):
        origin = np.zeros(len(own))
        origin[own] = flat.coords[first[own] + axis]
        moment = _sums(ends * cross, ring, len(flat.ring_n)) / 6.0 + area * origin
        total = _sums(np.where(own, sign * moment, 0.0), flat.ring_row, n)
        with np.errstate(divide="ignore", invalid="ignore"):
            out.append(np.where(whole != 0, total / whole, _sums(xy[axis], row, n) / count))
    made = np.zeros((n, 21), np.uint8)
    made[:, :2] = 1
    made[:, 5:] = np.stack(out, axis=1).astype("<f8").view(np.uint8).reshape(n, 16)
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * 21)
    points = pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(made.tobytes())])
    return pc.if_else(pa.array(flat.valid & (count > 0)), points, pa.scalar(None, pa.binary()))


def _point_wkb(x, y):
    return encode_one({"gtype": 1, "zm": 0, "parts": [{"ptype": 1, "rings": [[[x, y]]]}]})


def _envelope_wkb(x0, y0, x1, y1):
    ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    return encode_one({"gtype": 3, "zm": 0, "parts": [{"ptype": 3, "rings": [ring]}]})


_GEOJSON_TYPES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4,
                  "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}


def _from_geojson(text):
    if text is None:
        return None
    o = json.loads(text)

    def parts_of(obj):
        t = _GEOJSON_TYPES[obj["type"]]
        if t < 7 and not isinstance(obj.get("coordinates"), list):
            raise ValueError(f"GeoJSON {obj['type']} without coordinates")
        c = obj.get("coordinates")
        if t == 1:
            return [{"ptype": 1, "rings": [[c]]}] if c else []
        if t == 2:
            return [{"ptype": 2, "rings": [c]}]
        if t == 3:
            return [{"ptype": 3, "rings": c}] if c else []
        if t == 4:
            return [{"ptype": 1, "rings": [[p]]} for p in c]
        if t == 5:
            return [{"ptype": 2, "rings": [ln]} for ln in c]
        if t == 6:
            return [{"ptype": 3, "rings": pg} for pg in c]
        return [p for g in obj["geometries"] for p in parts_of(g)]

    parts = parts_of(o)
    zm = 1 if any(len(pos) > 2 for p in parts for r in p["rings"] for pos in r) else 0
    return encode_one({"gtype": _GEOJSON_TYPES[o["type"]], "zm": zm, "parts": parts})


def _from_wkt(text):
    """Minimal WKT reader (2D/3D, all seven types) into WKB."""
    import re

    if text is None:
        return None
    tokens = re.findall(r"[A-Za-z]+|\(|\)|,|[-+0-9.eE]+", text)
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else None

    def take():
        nonlocal pos
        pos += 1
        return tokens[pos - 1]

    def coords_list():
        take()  # (
        out = [[]]
        while peek() != ")":
            t = take()
            if t == ",":
                out.append([])
            else:
                out[-1].append(float(t))
        take()
        return out

    def nested(depth):
        if depth == 0:
            return coords_list()
        take()
        out = [nested(depth - 1)]
        while peek() == ",":
            take()
            out.append(nested(depth - 1))
        take()
        return out

    def geometry():
        name = take().upper()
        while peek() and peek().upper() in ("Z", "M", "ZM"):
            take()
        if peek() and peek().upper() == "EMPTY":
            take()
            return name, []
        if name == "POINT":
            return name, [{"ptype": 1, "rings": [coords_list()]}]
        if name == "LINESTRING":
            return name, [{"ptype": 2, "rings": [coords_list()]}]
        if name == "POLYGON":
            return name, [{"ptype": 3, "rings": nested(1)}]
        if name == "MULTIPOINT":
            if tokens[pos + 1] == "(":
                return name, [{"ptype": 1, "rings": [c]} for c in nested(1)]
            return name, [{"ptype": 1, "rings": [[p]]} for p in coords_list()]
        if name == "MULTILINESTRING":
            return name, [{"ptype": 2, "rings": [r]} for r in nested(1)]
        if name == "MULTIPOLYGON":
            return name, [{"ptype": 3, "rings": p} for p in nested(2)]
        take()
        parts = []
        while True:
            parts += geometry()[1]
            if take() == ")":
                break
        return name, parts

    name, parts = geometry()
    codes = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5,
             "MULTIPOLYGON": 6, "GEOMETRYCOLLECTION": 7}
    zm = 1 if any(len(p) > 2 for part in parts for r in part["rings"] for p in r) else 0
    return encode_one({"gtype": codes[name], "zm": zm, "parts": parts})


def constant_box(function: str, text) -> tuple | None:
    """Extent of a geometry that a constructor makes of a constant text."""
    raw = {"st_geomfromtext": _from_wkt, "st_geomfromgeojson": _from_geojson}[function](text)
    box = None if raw is None else _bbox(parse_one(raw))
    return None if box is None else tuple(float(v) for v in box)


def _number_text(v: float) -> str:
    return repr(float(v)) if v != int(v) or abs(v) >= 1e15 else str(int(v))


def _coordinates(ptype: int, rings, dims: int):
    lists = [[[float(v) for v in pos[:dims]] for pos in r] for r in rings]
    return lists[0][0] if ptype == 1 else lists[0] if ptype == 2 else lists


def _as_geojson(g) -> str:
    """The same text as the native ``geometry.geojson``."""
    gtype, zm, parts = g
    dims = 3 if zm % 2 else 2
    coords = [_coordinates(t, rings, dims) for t, rings in parts]
    if gtype == 7:
        members = [{"type": TYPE_NAMES[t], "coordinates": c} for (t, _), c in zip(parts, coords)]
        out = {"type": "GeometryCollection", "geometries": members}
    else:
        out = {"type": TYPE_NAMES[gtype], "coordinates": coords if gtype > 3 else coords[0] if coords else []}
    return json.dumps(out, separators=(",", ":"))


def _as_text(g) -> str:
    """Well-known text, with as many ordinates as the geometry has."""
    gtype, zm, parts = g
    tag = ("", " Z", " M", " ZM")[zm]

    def run(r):
        return "(" + ", ".join(" ".join(_number_text(v) for v in pos) for pos in r) + ")"

    def body(t, rings):
        return run(rings[0]) if t < 3 else "(" + ", ".join(run(r) for r in rings) + ")"

    name = TYPE_NAMES[gtype].upper()
    if not parts:
        return f"{name}{tag} EMPTY"
    if gtype <= 3:
        return f"{name}{tag} {body(*parts[0])}"
    members = [body(t, r) if gtype < 7 else f"{TYPE_NAMES[t].upper()}{tag} {body(t, r)}" for t, r in parts]
    return f"{name}{tag} ({', '.join(members)})"


def _unary(fn, out_type):
    def run(arr: pa.Array) -> pa.Array:
        res = []
        for v in arr.to_pylist():
            g = _parsed(v)
            res.append(None if g is None else fn(g))
        return pa.array(res, type=out_type)
    return run


def _binary(fn, out_type):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        res = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            gx, gy = _parsed(x), _parsed(y)
            res.append(None if gx is None or gy is None else fn(gx, gy))
        return pa.array(res, type=out_type)
    return run


def _constant(a: pa.Array) -> bool:
    return len(a) > 0 and a.null_count == 0 and len(pc.unique(a)) == 1


@lru_cache(maxsize=64)
def _at_most(v):
    """The greatest double that is no more than a decimal or whole number."""
    return None if v is None else float(v) if float(v) <= v else float(np.nextafter(float(v), -np.inf))


def _against_one(fn, of_batch, out_type):
    """A symmetric relation of two columns, of a whole batch at once where one of them is a single geometry."""
    slow = _binary(fn, out_type)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        if _constant(a) and not _constant(b):
            a, b = b, a
        if not _constant(b):
            return slow(a, b)
        flat = Flat(a)
        return pa.array(of_batch(relate.Batch(flat), relate.Shape(_parsed(b[0].as_py()))), out_type, mask=~flat.valid)
    return run


def _values(fn, out_type, n):
    def run(*arrs: pa.Array) -> pa.Array:
        make = lru_cache(maxsize=64)(fn)
        if all(_constant(a) for a in arrs):
            one = pa.array([make(*[a[0].as_py() for a in arrs])], type=out_type)
            return one.take(pa.array(np.zeros(len(arrs[0]), np.int64)))
        cols = [a.to_pylist() for a in arrs]
        return pa.array([None if any(v is None for v in row) else make(*row) for row in zip(*cols)],
                        type=out_type)
    return run


def _columnar(fn):
    """A function of a batch's geometries decoded together."""
    def run(arr: pa.Array) -> pa.Array:
        return fn(Flat(arr))
    return run


def _counted(fn, out_type):
    return lambda flat: pa.array(fn(flat.counts()), out_type, mask=~flat.valid)


def register(session) -> None:
    from pyspark.sql.functions import arrow_udf

    D, B, Bin, I, S = T.DoubleType(), T.BooleanType(), T.BinaryType(), T.IntegerType(), T.StringType()
    d, b, y, i = pa.float64(), pa.bool_(), pa.binary(), pa.int32()
    unary = {
        "st_geometrytype": (lambda g: ["POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING",
                                       "MULTIPOLYGON", "GEOMETRYCOLLECTION"][g[0] - 1], S, pa.string()),
        "st_geomfromwkb": (lambda g: encode_one({"gtype": g[0], "zm": g[1], "parts": [
            {"ptype": t, "rings": [r.tolist() for r in rs]} for t, rs in g[2]]}), Bin, y),
        "st_asgeojson": (_as_geojson, S, pa.string()), "st_astext": (_as_text, S, pa.string()),
    }
    for name, (fn, st, at) in unary.items():
        session.udf.register(name, arrow_udf(_unary(fn, at), st))
    columnar = {
        "st_area": (_areas, D), "st_length": (_lengths(2), D), "st_perimeter": (_lengths(3), D), "st_centroid": (_centroids, Bin),
        "st_x": (lambda f: f.point(0), D), "st_y": (lambda f: f.point(1), D),
        "st_xmin": (lambda f: f.bounds(0), D), "st_ymin": (lambda f: f.bounds(1), D),
        "st_xmax": (lambda f: f.bounds(2), D), "st_ymax": (lambda f: f.bounds(3), D),
        "st_numpoints": (_counted(lambda n: n.astype(np.int32), i), I), "st_npoints": (_counted(lambda n: n.astype(np.int32), i), I),
        "st_isempty": (_counted(lambda n: n == 0, b), B),
    }
    for name, (fn, st) in columnar.items():
        session.udf.register(name, arrow_udf(_columnar(fn), st))
    binary = {
        "st_contains": (relate.contains, B, b), "st_within": (lambda a, c: relate.contains(c, a), B, b),
        "st_covers": (relate.covers, B, b), "st_coveredby": (lambda a, c: relate.covers(c, a), B, b),
    }
    for name, (fn, st, at) in binary.items():
        session.udf.register(name, arrow_udf(_binary(fn, at), st))
    symmetric = {
        "st_intersects": (relate.intersects, relate.Batch.intersects, B, b),
        "st_disjoint": (lambda a, c: not relate.intersects(a, c), lambda batch, s: ~batch.intersects(s), B, b),
        "st_distance": (relate.distance, relate.Batch.distance, D, d),
    }
    for name, (fn, of_batch, st, at) in symmetric.items():
        session.udf.register(name, arrow_udf(_against_one(fn, of_batch, at), st))
    session.udf.register("st_point", arrow_udf(_values(_point_wkb, y, 2), Bin))
    session.udf.register("st_makeenvelope", arrow_udf(_values(_envelope_wkb, y, 4), Bin))
    session.udf.register("st_geomfromgeojson", arrow_udf(_values(_from_geojson, y, 1), Bin))
    session.udf.register("st_geomfromtext", arrow_udf(_values(_from_wkt, y, 1), Bin))

    gap = _against_one(relate.distance, relate.Batch.distance, d)

    def dwithin(a: pa.Array, c: pa.Array, r: pa.Array) -> pa.Array:
        # no distance of empty geometries is within any
        most = r.cast(d) if pa.types.is_floating(r.type) else pa.array([_at_most(v) for v in r.to_pylist()], d)
        return pc.less_equal(gap(a, c), most)

    session.udf.register("st_dwithin", arrow_udf(dwithin, B))
