"""WKB codec: the two Arrow UDFs of the engine (H7 and its inverse).

Geometry is stored as WKB bytes (BinaryType). Everything after decoding —
GeoJSON text, extents, areas, lengths, containment — is done with native
Spark higher-order functions over the decoded struct::

    struct<gtype int,               -- 1..7 = Point .. GeometryCollection
           zm int,                  -- 0 XY, 1 XYZ, 2 XYM, 3 XYZM
           parts array<struct<ptype int,          -- 1 point, 2 line, 3 polygon
                              rings array<array<array<double>>>>>>

A point part holds one ring with one position, a line part one ring, a polygon
part its rings (shell first). Multi geometries and collections list their
members as parts (members of nested collections are flattened).

The Arrow UDFs receive whole record batches. Decoding works on the batch's one buffer: the headers of
all rows are read with NumPy at offsets computed for all of them together, member by member and ring by
ring, which gives a table of rings (where it starts, how many positions, of how many ordinates, in which byte order);
the coordinates are gathered from that, and the nested result is
assembled from flat buffers and offsets. Rows with more members or rings than most, nested collections and what is
left of a batch are walked one by one into the same table.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITIONS = T.ArrayType(T.ArrayType(T.DoubleType()))
PART = T.StructType([
    T.StructField("ptype", T.IntegerType()),
    T.StructField("rings", T.ArrayType(POSITIONS)),
])
GEOM = T.StructType([
    T.StructField("gtype", T.IntegerType()),
    T.StructField("zm", T.IntegerType()),
    T.StructField("parts", T.ArrayType(PART)),
])

# --- fixed values: OGC geometry type codes and names ---
TYPE_NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint",
              5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
EWKB_Z, EWKB_M, EWKB_SRID = 0x80000000, 0x40000000, 0x20000000
# --------------------------------------------------------

_A_POS = pa.list_(pa.float64())
_A_RING = pa.list_(_A_POS)
_A_RINGS = pa.list_(_A_RING)
_A_PART = pa.struct([("ptype", pa.int32()), ("rings", _A_RINGS)])
_A_GEOM = pa.struct([("gtype", pa.int32()), ("zm", pa.int32()), ("parts", pa.list_(_A_PART))])


class WKBError(ValueError):
    pass


FEW = 32          # with fewer rows left to walk together, each is walked by itself


def _dims(zm):
    return 2 + (zm & 1) + ((zm >> 1) & 1)


class _Table:
    """Parts and rings in the order they are found; rows of one batch may be interleaved."""

    def __init__(self):
        self.rings: list[tuple] = []        # row, first byte, positions, ordinates, byte order
        self.parts: list[tuple] = []        # row, type, rings

    def columns(self, found: list[tuple], n: int) -> list[np.ndarray]:
        cols = [np.concatenate([np.atleast_1d(np.asarray(f[k], np.int64)) for f in found]) if found else np.zeros(0, np.int64)
                for k in range(n)]
        order = np.argsort(cols[0], kind="stable")
        return [c[order] for c in cols]


def _check(order, base) -> None:
    if not np.all((order == 0) | (order == 1)):
        raise WKBError("bad byte order")
    if not np.all((base >= 1) & (base <= 7)):
        raise WKBError("unknown geometry type")


class _Bytes:
    """The values of a binary array as one buffer, read at many places together."""

    def __init__(self, buf: np.ndarray):
        self.buf = np.concatenate([buf, np.zeros(16, np.uint8)])

    def ints(self, at, order, end):
        """Unsigned 32-bit numbers at ``at``, each in its own byte order."""
        if np.any(at + 4 > end):
            raise WKBError("truncated geometry")
        b = [self.buf[at + k].astype(np.int64) for k in range(4)]
        little = b[0] | b[1] << 8 | b[2] << 16 | b[3] << 24
        big = b[3] | b[2] << 8 | b[1] << 16 | b[0] << 24
        return np.where(order == 1, little, big)

    def headers(self, at, end):
        """Byte order, type, dimension flag and first byte after the header."""
        if np.any(at + 5 > end):
            raise WKBError("truncated geometry")
        order = self.buf[at].astype(np.int64)
        code = self.ints(at + 1, order, end)
        at = at + np.where(code & EWKB_SRID, 9, 5)
        plain = code & 0x0FFFFFFF
        base, iso = plain % 1000, plain // 1000
        z = (code & EWKB_Z != 0) | (iso == 1) | (iso == 3)
        m = (code & EWKB_M != 0) | (iso == 2) | (iso == 3)
        _check(order, base)
        return order, base, z.astype(np.int64) + 2 * m, at

    def doubles(self, at, counts, order):
        """``counts[i]`` doubles from byte ``at[i]`` on, for all ``i`` one after the other."""
        total = int(counts.sum())
        out = np.empty(total, np.float64)
        goes = np.cumsum(counts) - counts
        for shift in range(8):
            for swap, kind in ((1, "<f8"), (0, ">f8")):
                own = (at % 8 == shift) & (order == swap) & (counts > 0)
                if not own.any():
                    continue
                size = (len(self.buf) - shift) // 8
                view = np.frombuffer(self.buf, kind, size, shift)
                n = counts[own]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(goes[own], n) + step] = view[np.repeat(at[own] // 8, n) + step]
        return out


def _walk_together(data: _Bytes, rows, at, end, table: _Table) -> np.ndarray:
    """Read the rows member by member; returns those that are left to be walked one by one."""
    order, base, _, after = data.headers(at, end)
    many = base > 3
    left = np.where(many, 0, 1)
    at = at.copy()
    if many.any():
        left[many] = data.ints(after[many], order[many], end[many])
        at[many] = after[many] + 4
    alone = [rows[base == 7]]
    go = (base != 7) & (left > 0)
    rows, at, end, left = rows[go], at[go], end[go], left[go]
    while len(rows):
        if len(rows) < FEW:
            alone.append(rows)
            break
        order, base, zm, at = data.headers(at, end)
        odd = base > 3                                   # a member that has members
        if odd.any():
            alone.append(rows[odd])
            rows, at, end, left, order, base, zm = [x[~odd] for x in (rows, at, end, left, order, base, zm)]
        dims = _dims(zm)
        n = np.ones(len(rows), np.int64)
        counted = base > 1
        n[counted] = data.ints(at[counted], order[counted], end[counted])
        at = at + np.where(counted, 4, 0)
        k = np.flatnonzero(base <= 2)
        if len(k):
            size = 8 * n[k] * dims[k]
            if np.any(at[k] + size > end[k]):
                raise WKBError("truncated geometry")
            full = n[k] > 0
            p = np.flatnonzero(base[k] == 1)
            if len(p):                                   # a point without any coordinate is empty
                values = data.doubles(at[k][p], dims[k][p], order[k][p])
                full[p] = ~np.logical_and.reduceat(np.isnan(values), np.cumsum(dims[k][p]) - dims[k][p])
            f = k[full]
            table.rings.append((rows[f], at[f], n[f], dims[f], order[f]))
            table.parts.append((rows[f], base[f], np.ones(len(f))))
            at[k] += size
        k = np.flatnonzero((base == 3) & (n > 0))
        table.parts.append((rows[k], base[k], n[k]))
        ring = 0
        while len(k):
            if len(k) < FEW and ring:                    # a few rows with very many rings
                for j in k:
                    for _ in range(ring, int(n[j])):
                        at[j] = _ring(data, rows[j], at[j], end[j], dims[j], order[j], table)
                break
            size = data.ints(at[k], order[k], end[k])
            at[k] += 4
            if np.any(at[k] + 8 * size * dims[k] > end[k]):
                raise WKBError("truncated geometry")
            table.rings.append((rows[k], at[k], size, dims[k], order[k]))
            at[k] += 8 * size * dims[k]
            ring += 1
            k = k[n[k] > ring]
        left = left - 1
        go = left > 0
        rows, at, end, left = rows[go], at[go], end[go], left[go]
    return np.concatenate(alone)


def _ring(data: _Bytes, row, at, end, dims, order, table: _Table) -> int:
    (n,) = struct.unpack_from("<I" if order == 1 else ">I", data.buf, at)
    if at + 4 + 8 * n * dims > end:
        raise WKBError("truncated geometry")
    table.rings.append((row, at + 4, n, dims, order))
    return at + 4 + 8 * n * dims


def _walk_one(data: _Bytes, row: int, at: int, end: int, table: _Table) -> int:
    """Read the geometry at ``at``, with all its members; returns the first byte after it."""
    if at + 9 > end:
        raise WKBError("truncated geometry")
    order = int(data.buf[at])
    kind = "<I" if order == 1 else ">I"
    (code,) = struct.unpack_from(kind, data.buf, at + 1)
    at += 9 if code & EWKB_SRID else 5
    iso, base = divmod(code & 0x0FFFFFFF, 1000)
    _check(order, base)
    dims = 2 + bool(code & EWKB_Z or iso in (1, 3)) + bool(code & EWKB_M or iso in (2, 3))
    if base == 1:
        after = at + 8 * dims
        if after > end:
            raise WKBError("truncated geometry")
        if not np.isnan(np.frombuffer(data.buf, "<f8" if order == 1 else ">f8", dims, at)).all():
            table.rings.append((row, at, 1, dims, order))
            table.parts.append((row, 1, 1))
        return after
    if at + 4 > end:
        raise WKBError("truncated geometry")
    (n,) = struct.unpack_from(kind, data.buf, at)
    if base == 2:
        if n:
            table.parts.append((row, 2, 1))
            return _ring(data, row, at, end, dims, order, table)
        return at + 4
    at += 4
    if base == 3:
        if n:
            table.parts.append((row, 3, n))
        for _ in range(n):
            at = _ring(data, row, at, end, dims, order, table)
        return at
    for _ in range(n):
        at = _walk_one(data, row, at, end, table)
    return at


class Flat:
    """A batch of decoded geometries as flat arrays: coordinates, rings, parts, rows."""

    def __init__(self, arr: pa.Array):
        own = arr.cast(pa.large_binary())
        n = len(own)
        self.valid = ~own.is_null().to_numpy(zero_copy_only=False)
        _, offsets, data = own.buffers()
        ends = np.frombuffer(offsets, np.int64)[own.offset:own.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        bytes_ = _Bytes(raw[ends[0]:ends[-1]])
        start, end = ends[:-1] - ends[0], ends[1:] - ends[0]
        rows = np.flatnonzero(self.valid)
        self.gtype, self.zm = np.zeros(n, np.int64), np.zeros(n, np.int64)
        table = _Table()
        if len(rows):
            _, self.gtype[rows], self.zm[rows], _ = bytes_.headers(start[rows], end[rows])
            alone = _walk_together(bytes_, rows, start[rows], end[rows], table)
            if len(alone):                                # what was found of them so far is found again
                for found in (table.rings, table.parts):
                    for i, f in enumerate(found):
                        keep = ~np.isin(f[0], alone)
                        found[i] = tuple(np.atleast_1d(c)[np.atleast_1d(keep)] for c in f)
                for r in np.sort(alone).tolist():
                    _walk_one(bytes_, r, int(start[r]), int(end[r]), table)
        self.part_row, self.part_type, self.part_rings = table.columns(table.parts, 3)
        self.ring_row, at, self.ring_n, self.ring_dims, order = table.columns(table.rings, 5)
        self.coords = bytes_.doubles(at, self.ring_n * self.ring_dims, order)

    def positions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, x and y of every position."""
        start = np.cumsum(self.ring_n * self.ring_dims) - self.ring_n * self.ring_dims
        n = self.ring_n
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(start, n) + step * np.repeat(self.ring_dims, n)
        return np.repeat(self.ring_row, n), self.coords[at], self.coords[at + 1]

    def counts(self) -> np.ndarray:
        """Positions of every row."""
        return np.bincount(np.repeat(self.ring_row, self.ring_n), minlength=len(self.valid))

    def bounds(self, side: int) -> pa.Array:
        """Least x, least y, greatest x or greatest y of every row; null where it has no position."""
        row, *xy = self.positions()
        out, some = np.zeros(len(self.valid)), np.zeros(len(self.valid), bool)
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = (np.minimum, np.maximum)[side // 2].reduceat(xy[side % 2], first)
            some[row[first]] = True
        return pa.array(out, mask=~some)

    def point(self, axis: int) -> pa.Array:
        """The coordinate of points; null for other types and empty points."""
        bound, single = self.bounds(axis), self.valid & (self.gtype == 1)
        return pa.array(bound.to_numpy(zero_copy_only=False), mask=~single | bound.is_null().to_numpy(zero_copy_only=False))

    def extents(self) -> pa.Array:
        """The four bounds of every row as a struct, as ``geometry.extent`` has them: a NaN is greater than any number."""
        row, x, y = self.positions()
        n = len(self.valid)
        some = np.zeros(n, bool)
        sides = [np.zeros(n) for _ in range(4)]
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            some[row[first]] = True
            for out, of, value in zip(sides, (np.fmin, np.fmin, np.maximum, np.maximum), (x, y, x, y)):
                out[row[first]] = of.reduceat(value, first)
        return pa.StructArray.from_arrays([pa.array(v) for v in sides], names=["xmin", "ymin", "xmax", "ymax"], mask=pa.array(~some))

    def to_arrow(self) -> pa.Array:
        def offsets(counts):
            return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))

        n = len(self.valid)
        positions = pa.ListArray.from_arrays(offsets(np.repeat(self.ring_dims, self.ring_n)), pa.array(self.coords))
        rings = pa.ListArray.from_arrays(offsets(self.ring_n), positions)
        parts = pa.StructArray.from_arrays([pa.array(self.part_type.astype(np.int32)), pa.ListArray.from_arrays(
            offsets(self.part_rings), rings)], fields=list(_A_PART))
        own = pa.ListArray.from_arrays(offsets(np.bincount(self.part_row, minlength=n)), parts)
        return pa.StructArray.from_arrays([pa.array(self.gtype.astype(np.int32)), pa.array(self.zm.astype(np.int32)), own],
                                          fields=list(_A_GEOM), mask=pa.array(~self.valid))


def decode_array(arr: pa.Array) -> pa.Array:
    return Flat(arr).to_arrow()


# -- edges of polygons, and points against them -----------------------------------------
EDGE = 5          # doubles of an edge: from x, y to x, y, and the number of its part


def edge_array(arr: pa.Array) -> pa.Array:
    """The edges of each geometry's polygon parts, packed as doubles (rings of fewer than four positions have no inside)."""
    flat = Flat(arr)
    parts = np.arange(len(flat.part_row))
    first = np.searchsorted(flat.part_row, np.arange(len(flat.valid)))
    part = np.repeat(parts, flat.part_rings)
    own = (flat.part_type[part] == 3) & (flat.ring_n >= 4)
    at = (np.cumsum(flat.ring_n * flat.ring_dims) - flat.ring_n * flat.ring_dims)[own]
    n, dims, part, row = (flat.ring_n - 1)[own], flat.ring_dims[own], part[own], flat.ring_row[own]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    a = np.repeat(at, n) + step * np.repeat(dims, n)
    b = a + np.repeat(dims, n)
    edges = np.stack([flat.coords[a], flat.coords[a + 1], flat.coords[b], flat.coords[b + 1],
                      np.repeat(part - first[row], n).astype(np.float64)], axis=1)
    size = np.bincount(np.repeat(row, n), minlength=len(flat.valid)) * EDGE * 8
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    mask = pa.array(flat.valid).buffers()[1] if len(flat.valid) else None
    packed = pa.Array.from_buffers(pa.large_binary(), len(flat.valid), [mask, pa.py_buffer(ends), pa.py_buffer(edges.tobytes())])
    return packed.cast(pa.binary())


def inside_array(xs: pa.Array, ys: pa.Array, packed: pa.Array, edges_at_once: int = 1 << 20) -> pa.Array:
    """Whether each point is strictly inside a part: within its rings by the even-odd rule, and on none of them.

    The comparisons are those of ``geometry.contains_point``; a null on either side is outside.
    """
    n = len(packed)
    inside = np.zeros(n, bool)
    if not n:
        return pa.array(inside)
    x, y = (v.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for v in (xs, ys))
    own = packed.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = own.buffers()
    ends = np.frombuffer(offsets, np.int64)[own.offset:own.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + edges_at_once * EDGE * 8, side="right")) - 1)
        edges = np.frombuffer(raw[ends[lo]:ends[hi]].tobytes(), "<f8").reshape(-1, EDGE)
        row = np.repeat(np.arange(lo, hi), np.diff(ends[lo:hi + 1]) // (EDGE * 8))
        if len(row):
            inside[_even_odd(x[row], y[row], *edges.T, row)] = True
        lo = hi
    return pa.array(inside)


def _even_odd(px, py, ax, ay, bx, by, part, row) -> np.ndarray:
    """The rows whose point is inside a part, from a point and an edge each."""
    on = ((bx - ax) * (py - ay) == (by - ay) * (px - ax)) & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) \
        & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
    rise = np.where(by != ay, by - ay, 1.0)
    hit = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / rise + ax)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(new)
    good = (np.add.reduceat(hit.astype(np.int64), at) % 2 == 1) & ~np.logical_or.reduceat(on, at)
    return row[at][good]


def pairs_inside(batch: pa.RecordBatch, rank: np.ndarray | None = None, pairs_at_once: int = 1 << 19, edges_at_once: int = 1 << 20):
    """Indices ``(point, polygon)`` of the pairs inside, of blocks that belong together.

    A row has points in the lists ``__x`` and ``__y``, and polygons in ``__edges``, with their extents in ``__b0`` to ``__b3``; all of
    one are tested against all of the other. Indices are those of the flattened lists. A polygon's edges are there once for all
    points of its row. With a ``rank`` of every polygon only a point's hit of the least one in its row is given, and those after it
    are not tested.
    """
    m, k = (batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__x", "__edges"))
    x, y, *box = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("__x", "__y", "__b0", "__b1", "__b2", "__b3"))
    own = batch.column("__edges").flatten().cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = own.buffers()
    ends = np.frombuffer(offsets, np.int64)[own.offset:own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    edges = np.ascontiguousarray(np.frombuffer(raw.tobytes(), "<f8").reshape(-1, EDGE).T)
    first, count = (ends[:-1] - ends[0]) // (EDGE * 8), np.diff(ends) // (EDGE * 8)
    order = np.arange(len(own)) if rank is None else np.lexsort((rank, np.repeat(np.arange(len(k)), k)))
    first, count, *box = (c[order] for c in (first, count, *box))

    def hit(px, py, polygon) -> np.ndarray:
        size, inside, a = count[polygon], np.zeros(len(polygon), bool), 0
        stop = np.cumsum(size)
        while a < len(polygon):
            b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + edges_at_once, side="right")))
            row = np.repeat(np.arange(a, b), size[a:b])
            if len(row):
                at = np.arange(len(row)) + np.repeat(first[polygon[a:b]] - (stop[a:b] - size[a:b] - (stop[a] - size[a])), size[a:b])
                inside[_even_odd(px[row], py[row], *[c[at] for c in edges], row)] = True
            a = b
        return inside

    # each point with the polygons of its row, which lie together
    low, each = np.repeat(np.cumsum(k) - k, m), np.repeat(k, m)
    until, lo = np.cumsum(each), 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(until, (until[lo - 1] if lo else 0) + pairs_at_once, side="right")))
        n = each[lo:hi]
        point = np.repeat(np.arange(lo, hi), n)
        polygon = np.arange(len(point)) - np.repeat(np.cumsum(n) - n - low[lo:hi], n)
        px, py = np.repeat(x[lo:hi], n), np.repeat(y[lo:hi], n)
        near = (px > box[0][polygon]) & (px < box[2][polygon])
        near &= (py > box[1][polygon]) & (py < box[3][polygon])
        near, lo = np.flatnonzero(near), hi
        point, polygon, px, py = point[near], polygon[near], px[near], py[near]
        if rank is None:
            inside = hit(px, py, polygon)
            yield point[inside], order[polygon[inside]]
            continue
        # the next of every point that has not got one
        new = np.ones(len(point), bool)
        new[1:] = point[1:] != point[:-1]
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(point))
        while len(at):
            inside = hit(px[at], py[at], polygon[at])
            yield point[at[inside]], order[polygon[at[inside]]]
            at, end = at[~inside] + 1, end[~inside]
            at, end = at[at < end], end[at < end]


def topmost_array(xs: pa.Array, ys: pa.Array, packed: pa.Array, point: pa.Array, below: pa.Array, feature: pa.Array) -> pa.Array:
    """Of a batch of candidates, the hits that come first of their point: by ``below``, then by ``feature``, nulls before others."""
    hits = pa.table({"row": np.flatnonzero(inside_array(xs, ys, packed).to_numpy(zero_copy_only=False))})
    first = np.zeros(len(packed), bool)
    if hits.num_rows:
        rows = hits["row"]
        hits = pa.table({"row": rows, "point": point.take(rows), "below": below.take(rows), "feature": feature.take(rows)})
        order = pc.sort_indices(hits, [(c, "ascending") for c in ("point", "below", "feature")], null_placement="at_start")
        own = hits["point"].take(order).to_numpy()
        first[rows.take(order).to_numpy()[np.r_[True, own[1:] != own[:-1]]]] = True
    return pa.array(first)


# -- encoding -------------------------------------------------------------------
def _code(base: int, zm: int) -> int:
    return base + (1000 if zm == 1 else 2000 if zm == 2 else 3000 if zm == 3 else 0)


def _encode_part(ptype, rings, zm) -> bytes:
    d = _dims(zm)
    head = struct.pack("<BI", 1, _code(ptype, zm))
    if ptype == 1:
        return head + np.asarray(rings[0][0], dtype="<f8")[:d].tobytes()
    if ptype == 2:
        ring = rings[0] if rings else []
        return head + struct.pack("<I", len(ring)) + _coords(ring, d)
    out = [head, struct.pack("<I", len(rings))]
    for ring in rings:
        out.append(struct.pack("<I", len(ring)))
        out.append(_coords(ring, d))
    return b"".join(out)


def _coords(ring, d) -> bytes:
    if not ring:
        return b""
    return np.asarray(ring, dtype="<f8").reshape(len(ring), -1)[:, :d].tobytes()


def encode_one(g: dict) -> bytes | None:
    if g is None:
        return None
    gtype, zm, parts = g["gtype"], g["zm"] or 0, g["parts"] or []
    if gtype <= 3:
        if not parts:   # empty
            if gtype == 1:
                return struct.pack("<BI", 1, _code(1, zm)) + np.full(_dims(zm), np.nan, "<f8").tobytes()
            return struct.pack("<BII", 1, _code(gtype, zm), 0)
        p = parts[0]
        return _encode_part(p["ptype"], p["rings"], zm)
    body = b"".join(_encode_part(p["ptype"], p["rings"], zm) for p in parts)
    return struct.pack("<BII", 1, _code(gtype, zm), len(parts)) + body


def _int32(a: pa.Array) -> np.ndarray:
    """The numbers of an integer array, with -1 for nulls."""
    return a.cast(pa.int32()).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _offsets(a: pa.ListArray) -> np.ndarray:
    return a.offsets.to_numpy(zero_copy_only=False).astype(np.int64)


def _encode_single(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Points, lines and polygons of a batch without any nulls below the rows, from its flat arrays.

    Which rows those are, their bytes one after the other and the number of bytes of each; None if there are none.
    """
    n = len(arr)
    gtype, zm, parts = _int32(arr.field("gtype")), arr.field("zm"), arr.field("parts")
    zm = np.where(zm.is_null().to_numpy(zero_copy_only=False), 0, _int32(zm))
    at = _offsets(parts)
    good = arr.is_valid().to_numpy(zero_copy_only=False) & (gtype >= 1) & (gtype <= 3) & (zm >= 0) & (zm <= 3) & (np.diff(at) == 1)
    if not good.any():
        return None
    part = parts.values                                   # not sliced: the offsets count from its start
    rings = part.field("rings")
    ring_at, ring = _offsets(rings), rings.values
    pos_at, pos = _offsets(ring), ring.values
    num_at, numbers = _offsets(pos), pos.values
    if part.null_count or rings.null_count or ring.null_count or pos.null_count or numbers.null_count:
        return None
    first = np.where(good, at[:-1], 0)
    r0, r1 = ring_at[first], ring_at[first + 1]
    good &= (_int32(part.field("ptype"))[first] == gtype) & (r1 > r0) & ((gtype == 3) | (r1 == r0 + 1))
    dims = _dims(zm)
    rows = np.flatnonzero(good)
    p0, p1 = pos_at[r0[rows]], pos_at[r1[rows]]
    # every position of a row has as many numbers as its dimension says
    odd = np.concatenate([[0], np.cumsum(np.diff(num_at) != 2)])
    plain = (num_at[p1] - num_at[p0] == (p1 - p0) * dims[rows]) & (p1 > p0) & ((gtype[rows] != 1) | (p1 == p0 + 1))
    plain &= ((dims[rows] == 2) & (odd[p1] == odd[p0])) | ((dims[rows] > 2) & (p1 == p0 + 1))
    good[rows[~plain]] = False
    rows = rows[plain]
    if not len(rows):
        return None
    p0, p1, kind, dims, n_rings = p0[plain], p1[plain], gtype[rows], dims[rows], (r1 - r0)[rows]
    size = 5 + 8 * (p1 - p0) * dims + np.where(kind == 1, 0, 4) + np.where(kind == 3, 4 * n_rings, 0)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)

    def put(where, value):
        for k in range(4):
            out[where + k] = (value >> 8 * k) & 255

    out[start] = 1
    put(start + 1, kind + np.array([0, 1000, 2000, 3000])[zm[rows]])
    line, poly = kind == 2, kind == 3
    put(start[line] + 5, (p1 - p0)[line])
    put(start[poly] + 5, n_rings[poly])
    # the first byte of the coordinates of each ring: the rings of a polygon have counts before them
    own = np.repeat(np.arange(len(rows)), n_rings)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(n_rings) - n_rings, n_rings)
    one = r0[rows][own] + nth
    length = pos_at[one + 1] - pos_at[one]
    before = 8 * (pos_at[one] - p0[own]) * dims[own]
    to = start[own] + np.where(kind == 1, 5, 9)[own] + before + np.where(poly[own], 4 * (nth + 1), 0)
    put((to - 4)[poly[own]], length[poly[own]])
    count = length * dims[own]
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    values = numbers.to_numpy(zero_copy_only=False)[np.repeat(num_at[pos_at[one]], count) + step].astype("<f8")
    out[(np.repeat(to, count) + 8 * step)[:, None] + np.arange(8)] = values.view(np.uint8).reshape(-1, 8)
    return good, out, size


def encode_array(arr: pa.Array) -> pa.Array:
    found = _encode_single(arr) if len(arr) else None
    if found is None:
        return pa.array([encode_one(g) for g in arr.to_pylist()], type=pa.binary())
    good, out, size = found
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
    many = pa.Array.from_buffers(pa.binary(), len(size), [None, offsets.buffers()[1], pa.py_buffer(out)])
    if good.all():
        return many
    # the others are encoded one by one and put in between
    rest = pa.array([encode_one(g) for g in arr.filter(pa.array(~good)).to_pylist()], type=pa.binary())
    place = np.where(good, np.cumsum(good) - 1, len(many) + np.cumsum(~good) - 1)
    return pa.concat_arrays([many, rest]).take(pa.array(place))


# -- Spark functions ---------------------------------------------------------------
def _arrow_udf(fn, rtype):
    from pyspark.sql.functions import arrow_udf

    return arrow_udf(fn, rtype)


wkb_decode_udf = _arrow_udf(decode_array, GEOM)
wkb_encode_udf = _arrow_udf(encode_array, T.BinaryType())


def point_array(arr: pa.Array) -> pa.Array:
    flat = Flat(arr)
    return pa.StructArray.from_arrays([flat.point(0), flat.point(1)], names=["x", "y"])


BOX = T.StructType([T.StructField(side, T.DoubleType()) for side in ("xmin", "ymin", "xmax", "ymax")])
wkb_extent_udf = _arrow_udf(lambda a: Flat(a).extents(), BOX)
wkb_point_udf = _arrow_udf(point_array, T.StructType([T.StructField(axis, T.DoubleType()) for axis in ("x", "y")]))
# Spark would evaluate it a second time, by workers of its own, for the filter that it derives from a join's keys
wkb_point_once_udf = _arrow_udf(point_array, T.StructType([T.StructField(axis, T.DoubleType()) for axis in ("x", "y")])) \
    .asNondeterministic()
polygon_edges_udf = _arrow_udf(edge_array, T.BinaryType())
point_topmost_udf = _arrow_udf(topmost_array, T.BooleanType())
point_inside_udf = _arrow_udf(lambda x, y, edges: inside_array(x, y, edges), T.BooleanType())


def polygon_edges(c: Column) -> Column:
    """WKB bytes -> packed edges, prepared once for many ``point_inside``."""
    return polygon_edges_udf(c)


def point_inside(x: Column, y: Column, edges: Column) -> Column:
    return point_inside_udf(x, y, edges)


def point_topmost(x: Column, y: Column, edges: Column, point: Column, below: Column, feature: Column) -> Column:
    """Whether a candidate is a hit that no other of the same point in its batch comes before."""
    return point_topmost_udf(x, y, edges, point, below, feature)


def wkb_decode(c: Column | str) -> Column:
    """H7: WKB bytes -> decoded geometry struct (NULL stays NULL)."""
    return wkb_decode_udf(F.col(c) if isinstance(c, str) else c)


def wkb_extent(c: Column) -> Column:
    """WKB bytes -> ``struct(xmin, ymin, xmax, ymax)`` as ``geometry.extent`` of the decoded geometry, without its nested lists."""
    return wkb_extent_udf(c)


def wkb_point(c: Column) -> Column:
    """WKB bytes -> ``struct(x, y)`` of a point; nulls in it for other types."""
    return wkb_point_udf(c)


def wkb_point_once(c: Column) -> Column:
    """``wkb_point`` that no filter above it makes Spark evaluate again."""
    return wkb_point_once_udf(c)


def wkb_encode(c: Column | str) -> Column:
    """Decoded geometry struct -> little-endian ISO WKB bytes."""
    return wkb_encode_udf(F.col(c) if isinstance(c, str) else c)


# -- per-row parse (small helper for the SQL functions usable inside ``where``) ----
def parse_one(v: bytes):
    """WKB -> ``(gtype, zm, [(ptype, [ring (n, d) ndarray ...]) ...])``; None for NULL."""
    if v is None:
        return None
    data, table = _Bytes(np.frombuffer(v, np.uint8)), _Table()
    at = np.zeros(1, np.int64)
    _, gtype, zm, _ = data.headers(at, at + len(v))
    _walk_one(data, 0, 0, len(v), table)
    rings = iter([np.frombuffer(data.buf, "<f8" if order == 1 else ">f8", n * dims, start).astype(np.float64).reshape(-1, dims)
                  for _, start, n, dims, order in table.rings])
    return int(gtype[0]), int(zm[0]), [(int(t), [next(rings) for _ in range(n)]) for _, t, n in table.parts]
