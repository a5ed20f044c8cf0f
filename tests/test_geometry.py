"""WKB codec, native geometry expressions, ST_* SQL functions, reprojection."""

import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featurespark.functions import geometry as G
from featurespark.functions import crs, relate
from featurespark.functions.wkb import GEOM, WKBError, decode_array, encode_array, parse_one

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [2.0, 1.0], [1.0, 1.0]]


def geom(gtype, parts, zm=0):
    return {"gtype": gtype, "zm": zm, "parts": [{"ptype": t, "rings": r} for t, r in parts]}


CASES = [
    geom(1, [(1, [[[1.5, 2.5]]])]),
    geom(2, [(2, [[[0.0, 0.0], [3.0, 4.0], [3.0, 0.0]]])]),
    geom(3, [(3, [SQUARE, HOLE])]),
    geom(4, [(1, [[[1.0, 2.0]]]), (1, [[[3.0, 4.0]]])]),
    geom(5, [(2, [[[0.0, 0.0], [1.0, 1.0]]]), (2, [[[2.0, 2.0], [3.0, 3.0]]])]),
    geom(6, [(3, [SQUARE]), (3, [[[10.0, 10.0], [11.0, 10.0], [11.0, 11.0], [10.0, 10.0]]])]),
    geom(7, [(1, [[[1.0, 2.0]]]), (2, [[[0.0, 0.0], [1.0, 1.0]]])]),
    geom(1, [(1, [[[1.0, 2.0, 3.0]]])], zm=1),
    geom(2, [(2, [[[1.0, 2.0, 7.0], [2.0, 3.0, 8.0]]])], zm=2),
    geom(3, [(3, [[[0.0, 0.0, 1.0, 2.0], [1.0, 0.0, 1.0, 2.0], [0.0, 1.0, 1.0, 2.0], [0.0, 0.0, 1.0, 2.0]]])], zm=3),
    geom(3, []),          # POLYGON EMPTY
    None,
]


def test_encode_decode_roundtrip():
    arr = pa.array(CASES, type=pa.struct([("gtype", pa.int32()), ("zm", pa.int32()), ("parts", pa.list_(
        pa.struct([("ptype", pa.int32()), ("rings", pa.list_(pa.list_(pa.list_(pa.float64()))))])))]))
    wkb = encode_array(arr)
    back = decode_array(wkb).to_pylist()
    assert back == CASES
    assert encode_array(decode_array(wkb)).to_pylist() == wkb.to_pylist()


def test_big_endian_and_ewkb():
    be = struct.pack(">BI", 0, 1) + struct.pack(">dd", 1.25, -2.5)
    assert decode_array(pa.array([be], pa.binary())).to_pylist()[0]["parts"][0]["rings"] == [[[1.25, -2.5]]]
    ewkb = struct.pack("<BII", 1, 0x80000001 | 0x20000000, 4326) + struct.pack("<ddd", 1.0, 2.0, 3.0)
    g = decode_array(pa.array([ewkb], pa.binary())).to_pylist()[0]
    assert g["zm"] == 1 and g["parts"][0]["rings"] == [[[1.0, 2.0, 3.0]]]


def test_random_polygons_roundtrip():
    rnd = random.Random(7)
    gs = []
    for _ in range(200):
        n = rnd.randint(3, 30)
        ring = [[rnd.uniform(-180, 180), rnd.uniform(-90, 90)] for _ in range(n)]
        ring.append(ring[0])
        gs.append(geom(3, [(3, [ring])]))
    arr = pa.array(gs, type=decode_array(encode_array(pa.array(CASES[:3]))).type)
    assert decode_array(encode_array(arr)).to_pylist() == gs


def random_wkb(rnd, depth=0, base=None):
    """WKB of any type, nesting, byte order, dimension and header form, with what it decodes to: parts of (type, rings)."""
    end = rnd.choice("<>")
    base = base or rnd.choice([1, 2, 3, 3, 4, 5, 6, 7] if depth < 2 else [1, 2, 3])
    zm = rnd.choice([0, 0, 0, 1, 2, 3])
    dims = 2 + (zm & 1) + (zm >> 1)
    code, srid = base + 1000 * zm, b""
    if rnd.random() < 0.3:
        code = base | (0x80000000 if zm & 1 else 0) | (0x40000000 if zm & 2 else 0)
        if rnd.random() < 0.5:
            code, srid = code | 0x20000000, struct.pack(end + "I", 4326)
    out = struct.pack(end + "BI", int(end == "<"), code) + srid

    def positions(n):
        ring = [[rnd.uniform(-9, 9) for _ in range(dims)] for _ in range(n)]
        return struct.pack(end + f"{n * dims}d", *[v for p in ring for v in p]), ring

    parts = []
    if base == 1:
        body, ring = positions(1)
        if rnd.random() < 0.1:
            body = struct.pack(end + f"{dims}d", *[math.nan] * dims)
        else:
            parts = [(1, [ring])]
        return out + body, base, zm, parts
    n = rnd.choice([0, 2, 9] if base == 2 else [0, 1, 1, 2, 40] if base == 3 else [0, 1, 3, 40] if depth == 0 else [0, 1, 2])
    out += struct.pack(end + "I", n)
    if base == 2:
        body, ring = positions(n)
        return out + body, base, zm, [(2, [ring])] if n else []
    if base == 3:
        rings = []
        for _ in range(n):
            k = rnd.choice([0, 4, 5, 7])
            body, ring = positions(k)
            out += struct.pack(end + "I", k) + body
            rings.append(ring)
        return out, base, zm, [(3, rings)] if n else []
    for _ in range(n):
        body, _, _, more = random_wkb(rnd, depth + 1, None if base == 7 or rnd.random() < 0.02 else base - 3)
        out += body
        parts += more
    return out, base, zm, parts


def test_batches_decode_like_single_values():
    rnd = random.Random(11)
    for size in (1, 7, 400, 400):
        rows = [None if rnd.random() < 0.1 else random_wkb(rnd) for _ in range(size)]
        want = [r and geom(r[1], r[3], r[2]) for r in rows]
        arr = pa.concat_arrays([pa.array([b"not wkb"]), pa.array([r and r[0] for r in rows], pa.binary())]).slice(1)
        got = decode_array(arr)
        got.validate(full=True)
        assert got.to_pylist() == want
        for r in rows[:40]:
            if r:
                gtype, zm, parts = parse_one(r[0])
                assert (gtype, zm, [(t, [x.tolist() for x in rs]) for t, rs in parts]) == (r[1], r[2], r[3])
                for cut in (3, len(r[0]) - 1):
                    for many in (1, 50):
                        with pytest.raises(WKBError):
                            decode_array(pa.array([r[0][:cut]] * many, pa.binary()))
    assert decode_array(pa.array([], pa.binary())).to_pylist() == []
    with pytest.raises(WKBError, match="byte order"):
        decode_array(pa.array([b"\x02" + struct.pack("<I", 1) + bytes(16)]))
    with pytest.raises(WKBError, match="type"):
        decode_array(pa.array([struct.pack("<BI", 1, 17) + bytes(16)] * 40))


def test_measures_of_a_batch():
    from featurespark.functions.wkb import Flat

    rnd = random.Random(12)
    rows = [None if rnd.random() < 0.1 else random_wkb(rnd) for _ in range(500)]
    flat = Flat(pa.array([r and r[0] for r in rows], pa.binary()))
    for r, n, x, y, *box in zip(rows, flat.counts(), flat.point(0).to_pylist(), flat.point(1).to_pylist(),
                                *[flat.bounds(k).to_pylist() for k in range(4)]):
        at = [p for _, rings in r[3] for ring in rings for p in ring] if r else []
        assert n == len(at)
        assert box == ([f(p[k] for p in at) for f in (min, max) for k in (0, 1)] if at else [None] * 4)
        assert (x, y) == (tuple(at[0][:2]) if r and r[1] == 1 and at else (None, None))
    none = Flat(pa.array([], pa.binary()))
    assert none.bounds(0).to_pylist() == none.point(1).to_pylist() == [] and not len(none.counts())


def test_packed_edges_agree_with_the_native_test(spark):
    from featurespark.functions.stsql import _from_wkt
    from featurespark.functions.wkb import edge_array, inside_array, wkb_decode

    texts = [BOX, U, HOLED, TWO, "POLYGON((0 0, 6 0, 6 6, 0 0))", "POLYGON((1 0, 5 2, 3 7, 0 3, 1 0))", "POINT(1 1)", "POLYGON EMPTY",
             "GEOMETRYCOLLECTION(POINT(1 1), POLYGON((0 0, 4 0, 4 4, 0 4, 0 0)), LINESTRING(0 0, 5 5))", None]
    wkbs = [t and _from_wkt(t) for t in texts]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(wkbs)], "i int, w binary").withColumn("g", wkb_decode("w"))
    pts = spark.createDataFrame([(x / 2, y / 2) for x in range(-1, 20) for y in range(-1, 20)], "x double, y double")
    rows = df.crossJoin(pts).select("i", "x", "y", G.contains_point("g", F.col("x"), F.col("y")).alias("inside")).collect()
    edges = edge_array(pa.array(wkbs, pa.binary())).to_pylist()
    xs, ys = pa.array([r["x"] for r in rows]), pa.array([r["y"] for r in rows])
    packed = pa.array([edges[r["i"]] for r in rows], pa.binary())
    for at_once in (1 << 20, 7, 1):
        got = inside_array(xs, ys, packed, at_once).to_pylist()
        assert got == [bool(r["inside"]) for r in rows]
    assert inside_array(pa.array([None, 1.0], pa.float64()), pa.array([1.0, None], pa.float64()), packed[:2]).to_pylist() == [False, False]
    assert inside_array(xs[:0], ys[:0], packed[:0]).to_pylist() == []


def test_stored_and_derived_layers_join_alike(layers, tmp_path):
    from featurespark import Layers
    from featurespark.operators import spatial as SP

    for n in ("sites", "parcels", "zones", "nested", "lattice"):
        layers.read(n).repartition(3).write.parquet(str(tmp_path / f"{n}.parquet"))
    own = Layers(layers.base, str(tmp_path))
    for a, b, ids in (("sites", "parcels", ["site_id", "parcel_id"]), ("sites", "zones", ["site_id", "zone_id"]),
                      ("lattice", "nested", ["site_id", "square_id"])):
        derived = SP.points_in_polygons(layers.read(a), layers.read(b), ids[:1], ids[1:])
        stored = SP.points_in_polygons(own.read(a), own.read(b), ids[:1], ids[1:])
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, derived.collect())) != []
    # geometry is read in one scan, whose rows are not dealt into cells
    join = SP.points_in_polygons(own.read("sites"), own.read("parcels"), ["site_id"], ["parcel_id"])
    lines = join._jdf.queryExecution().executedPlan().toString().splitlines()
    reading = [i for i, line in enumerate(lines) if "FileScan" in line and "geometry" in line]
    assert len(reading) == 1 and "edge_array" in "".join(lines[reading[0] - 3:reading[0]])
    which = [("zones", "zone_id"), ("parcels", "parcel_id")]
    one = SP.identify(layers.read("sites"), [(n, layers.read(n), i) for n, i in which], ["site_id"])
    two = SP.identify(own.read("sites"), [(n, own.read(n), i) for n, i in which], ["site_id"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) != []
    assert "Window" not in two._jdf.queryExecution().executedPlan().toString()


def _frame(spark, gs):
    from featurespark.functions.wkb import wkb_decode, wkb_encode
    df = spark.createDataFrame([(i, g) for i, g in enumerate(gs)], f"id int, g {GEOM.simpleString()}")
    return df.select("id", wkb_decode(wkb_encode("g")).alias("g"))


def test_native_measures(spark):
    rows = _frame(spark, CASES[:7]).select(
        "id", G.area("g").alias("area"), G.length("g").alias("len"), G.extent("g").alias("e"),
        G.num_points("g").alias("n"), G.geojson("g").alias("js"),
        G.contains_point("g", F.lit(3.0), F.lit(3.0)).alias("in33"),
        G.contains_point("g", F.lit(1.5), F.lit(1.5)).alias("in_hole"),
        G.centroid("g").alias("c")).orderBy("id").collect()
    assert rows[2]["area"] == pytest.approx(15.0)
    assert rows[5]["area"] == pytest.approx(16.5)
    assert rows[1]["len"] == pytest.approx(5.0 + 4.0)
    assert rows[2]["in33"] and not rows[2]["in_hole"]
    assert rows[0]["js"] == '{"type":"Point","coordinates":[1.5,2.5]}'
    assert rows[6]["js"].startswith('{"type":"GeometryCollection","geometries":[{"type":"Point"')
    assert tuple(rows[2]["e"]) == (0.0, 0.0, 4.0, 4.0)
    assert rows[2]["c"]["x"] == pytest.approx(30.5 / 15) and rows[2]["c"]["y"] == pytest.approx(30.5 / 15)


def test_sql_functions_match_native(layers):
    df = layers.filter("parcels", "ST_Area(geometry) > 0 AND ST_NumPoints(geometry) = 5 "
                                  "AND ST_Contains(geometry, ST_Centroid(geometry)) "
                                  "AND ST_Intersects(geometry, ST_GeomFromText('POLYGON((143 -39, 146 -39, 146 -37, 143 -37, 143 -39))'))")
    assert df.count() == layers.read("parcels").count()
    pts = layers.filter("sites", "ST_DWithin(geometry, ST_Point(144.5, -38.0), 0.1) AND ST_X(geometry) > 144")
    n = pts.count()
    assert 0 < n < layers.read("sites").count()


def forward_tm(lon, lat, zone, south, flattening):
    """Krueger series to n^4, in plain floating point."""
    n = flattening / (2 - flattening)
    big_a = 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    alpha = [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180,
             13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440,
             61 * n ** 3 / 240 - 103 * n ** 4 / 140, 49561 * n ** 4 / 161280]
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
    return 500000 + 0.9996 * big_a * x, (1e7 if south else 0) + 0.9996 * big_a * y


def forward_lambert(lon, lat, lat0, lon0, lat1, lat2, fe, fn):
    e = math.sqrt(crs.GRS80_F * (2 - crs.GRS80_F))

    def m(p):
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p):
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    p, p0, p1, p2 = (math.radians(v) for v in (lat, lat0, lat1, lat2))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    f = m(p1) / (n * t(p1) ** n)
    r, r0, th = 6378137 * f * t(p) ** n, 6378137 * f * t(p0) ** n, n * math.radians(lon - lon0)
    return fe + r * math.sin(th), fn + r0 - r * math.cos(th)


def test_reprojection(spark):
    places = [(144.9631, -37.8136), (145.5, -38.2), (147.1, -36.0), (148.9, -31.5)]
    made = []
    for lon, lat in places:
        made.append((7855, lon, lat, *forward_tm(lon, lat, 55, True, crs.GRS80_F)))
        made.append((32755, lon, lat, *forward_tm(lon, lat, 55, True, crs.WGS84_F)))
        made.append((3857, lon, lat, math.radians(lon) * 6378137, math.asinh(math.tan(math.radians(lat))) * 6378137))
        for epsg in (7899, 3112, 8058):
            made.append((epsg, lon, lat, *forward_lambert(lon, lat, *crs.LAMBERT[epsg])))
    made.append((2154, 2.35, 48.85, *forward_lambert(2.35, 48.85, *crs.LAMBERT[2154])))
    df = spark.createDataFrame(made, "epsg int, lon double, lat double, x double, y double")
    for epsg in sorted({m[0] for m in made}):
        g = crs.to_4326(G.make_point(F.col("x"), F.col("y")), epsg)
        for r in df.where(F.col("epsg") == epsg).select("lon", "lat", g["parts"][0]["rings"][0][0].alias("p")).collect():
            assert r["p"][0] == pytest.approx(r["lon"], abs=1e-9) and r["p"][1] == pytest.approx(r["lat"], abs=1e-9)
    # published: Melbourne lies at about E 320 700, N 5 812 800 in zone 55, at the origin's false values on Vicgrid
    e, n = forward_tm(144.9631, -37.8136, 55, True, crs.GRS80_F)
    assert 320_000 < e < 321_500 and 5_812_000 < n < 5_813_500
    assert forward_lambert(145, -37, *crs.LAMBERT[7899]) == pytest.approx((2.5e6, 2.5e6), abs=1e-3)


# -- relations -----------------------------------------------------------------------
def wkt(text):
    from featurespark.functions.stsql import _from_wkt
    return parse_one(_from_wkt(text))


BOX = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
U = "POLYGON((0 0, 9 0, 9 9, 6 9, 6 3, 3 3, 3 9, 0 9, 0 0))"
HOLED = "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 3 6, 6 6, 6 3, 3 3))"
TWO = "MULTIPOLYGON(((0 0, 2 0, 2 4, 0 4, 0 0)), ((2 0, 4 0, 4 4, 2 4, 2 0)))"


@pytest.mark.parametrize("a,b,inter,cover,contain", [
    (BOX, BOX, True, True, True),                                     # everything contains itself
    (U, "POLYGON((1 7, 8 7, 8 8, 1 8, 1 7))", True, False, False),     # a box across the gap of a U
    (U, "POLYGON((1 1, 8 1, 8 2, 1 2, 1 1))", True, True, True),
    (U, "POLYGON((4 4, 5 4, 5 5, 4 5, 4 4))", False, False, False),    # inside the gap
    (HOLED, "POLYGON((2 2, 7 2, 7 7, 2 7, 2 2))", True, False, False),  # around the hole
    (HOLED, "POLYGON((4 4, 5 4, 5 5, 4 5, 4 4))", False, False, False),  # inside the hole
    (HOLED, "POLYGON((3 3, 6 3, 6 6, 3 6, 3 3))", True, False, False),  # fills the hole
    (HOLED, "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", True, True, True),
    (BOX, "POINT(2 2)", True, True, True),
    (BOX, "POINT(4 2)", True, True, False),                           # on an edge
    ("POLYGON((0 0, 2 0, 2 2, 0 0))", "POINT(1 1)", True, True, False),  # on the slanted edge
    (BOX, "POINT(5 2)", False, False, False),
    (BOX, "MULTIPOINT(2 2, 4 4)", True, True, True),
    (BOX, "LINESTRING(0 0, 4 0)", True, True, False),                 # along an edge
    (BOX, "LINESTRING(0 0, 4 4)", True, True, True),                  # a diagonal
    (BOX, "LINESTRING(1 1, 5 1)", True, False, False),
    (BOX, "LINESTRING(4 4, 5 5)", True, False, False),                # touches a corner
    ("LINESTRING(0 0, 4 4)", "POINT(2 2)", True, True, True),          # a point on a line
    ("LINESTRING(0 0, 4 4)", "POINT(4 4)", True, True, False),         # its end
    ("LINESTRING(0 0, 4 4)", "POINT(2 3)", False, False, False),
    ("LINESTRING(0 0, 4 0)", "LINESTRING(5 0, 7 0)", False, False, False),   # collinear, apart
    ("LINESTRING(0 0, 4 0)", "LINESTRING(1 0, 3 0)", True, True, True),
    ("LINESTRING(0 0, 4 0)", "LINESTRING(3 0, 7 0)", True, False, False),
    ("LINESTRING(0 0, 4 4)", "LINESTRING(0 4, 4 0)", True, False, False),
    ("POINT(1 1)", "POINT(1 1)", True, True, True),
    ("POINT(1 1)", "POINT(1 2)", False, False, False),
    (TWO, "POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))", True, True, True),     # across the shared edge
    (TWO, "POLYGON((1 1, 5 1, 5 3, 1 3, 1 1))", True, False, False),
    (BOX, "GEOMETRYCOLLECTION(POINT(1 1), LINESTRING(1 1, 2 2))", True, True, True),
    (BOX, "POLYGON EMPTY", False, False, False),
    (BOX, "POLYGON((10 0, 14 0, 14 4, 10 4, 10 0))", False, False, False),
    (BOX, "POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))", True, False, False),   # shares an edge
    (BOX, "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", True, True, True),
])
def test_relations(a, b, inter, cover, contain):
    g, h = wkt(a), wkt(b)
    assert relate.intersects(g, h) is inter and relate.intersects(h, g) is inter
    assert relate.covers(g, h) is cover and relate.contains(g, h) is contain


def test_relations_match_sampled_boxes():
    rnd = random.Random(3)

    def box():
        x, y = rnd.randint(0, 8), rnd.randint(0, 8)
        return x, y, x + rnd.randint(1, 5), y + rnd.randint(1, 5)

    for _ in range(400):
        (ax, ay, bx, by), (cx, cy, dx, dy) = box(), box()
        g, h = (wkt(f"POLYGON(({p} {q}, {r} {q}, {r} {s}, {p} {s}, {p} {q}))")
                for p, q, r, s in ((ax, ay, bx, by), (cx, cy, dx, dy)))
        assert relate.intersects(g, h) == (ax <= dx and cx <= bx and ay <= dy and cy <= by)
        assert relate.contains(g, h) == relate.covers(g, h) == (ax <= cx and dx <= bx and ay <= cy and dy <= by)
        gap = math.hypot(max(cx - bx, ax - dx, 0), max(cy - by, ay - dy, 0))
        assert relate.distance(g, h) == pytest.approx(gap)


def test_native_and_sql_points_agree(spark):
    """One boundary rule in both implementations: every point of a grid against shapes with holes and slants."""
    from featurespark.functions.stsql import _from_wkt
    from featurespark.functions.wkb import wkb_decode

    texts = [BOX, U, HOLED, TWO, "POLYGON((0 0, 6 0, 6 6, 0 0))", "POLYGON((1 0, 5 2, 3 7, 0 3, 1 0))"]
    df = spark.createDataFrame([(i, _from_wkt(t)) for i, t in enumerate(texts)], "i int, w binary")
    pts = spark.createDataFrame([(x / 2, y / 2) for x in range(-1, 20) for y in range(-1, 20)], "x double, y double")
    got = df.withColumn("g", wkb_decode("w")).crossJoin(pts).select(
        "i", "x", "y", G.contains_point("g", F.col("x"), F.col("y")).alias("inside")).collect()
    shapes = [wkt(t) for t in texts]
    for r in got:
        want = relate.contains(shapes[r["i"]], wkt(f"POINT({r['x']} {r['y']})"))
        # a multipolygon's shared edge is inside neither part
        assert r["inside"] == want, tuple(r)


def test_geojson_and_text_functions(spark):
    from featurespark.functions.stsql import _as_geojson, _as_text, _from_wkt
    from featurespark.functions.wkb import wkb_decode

    texts = ["POINT (1 2.5)", "LINESTRING (0 0, 3 4)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
             "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
             "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
             "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POLYGON EMPTY", "POINT Z (1 2 3)"]
    df = spark.createDataFrame([(i, _from_wkt(t)) for i, t in enumerate(texts)], "i int, w binary")
    native = {r["i"]: r["j"] for r in df.select("i", wkb_decode("w").alias("g")).select("i", G.geojson("g").alias("j")).collect()}
    for i, t in enumerate(texts):
        g = parse_one(_from_wkt(t))
        assert _as_geojson(g) == native[i]
        assert parse_one(_from_wkt(_as_text(g)))[0] == g[0]
    assert _as_text(wkt("POINT(7 3)")) == "POINT (7 3)" and _as_text(wkt("MULTIPOINT(1 2, 3 4)")) == "MULTIPOINT ((1 2), (3 4))"


def test_json_values(spark):
    from featurespark.functions.jsonfmt import json_columns
    df = spark.sql("SELECT timestamp'2024-05-06 07:08:09.120+02:00' AS t, timestamp_ntz'2024-05-06 07:08:09' AS n, "
                   "date'2024-05-06' AS d, cast(1.50 AS decimal(5,2)) AS m, x'00ff' AS b, interval '2' day AS i")
    r = df.select(*json_columns(df.schema, df.columns)).first()
    assert r["t"] == "2024-05-06T05:08:09.120000+00:00" and r["n"] == "2024-05-06T07:08:09" and r["d"] == "2024-05-06"
    assert r["m"] == 1.5 and r["b"] is None and "2" in r["i"]


def test_numeric_text():
    from featurespark.operators.predicates import _number
    assert [_number(t) for t in ("12", " -3.5 ", "1e3", ".5", "+7", "3.")] == [12, -3.5, 1000.0, 0.5, 7, 3.0]
    assert [_number(t) for t in ("", "1_000", "inf", "nan", "0x10", "1,5", "--1", "e3")] == [None] * 8


def test_batches_encode_like_single_values():
    from featurespark.functions.wkb import _A_GEOM, _encode_single, encode_one

    rnd = random.Random(13)

    def some():
        r = random_wkb(rnd)
        return None if rnd.random() < 0.1 else geom(r[1], r[3], rnd.choice([r[2], r[2], None]) if r[2] == 0 else r[2])

    for size in (0, 1, 60, 60):
        rows = [some() for _ in range(size)]
        for cut in (0, 2):
            arr = pa.array(rows, _A_GEOM).slice(min(cut, size))
            got = encode_array(arr)
            got.validate(full=True)
            assert got.to_pylist() == [encode_one(g) for g in arr.to_pylist()]
    good, out, _ = _encode_single(pa.array(CASES[:3], _A_GEOM))          # as flat arrays, not row by row
    assert good.all() and out.tobytes() == b"".join(map(encode_one, CASES[:3]))


def test_batches_measure_and_relate_like_single_values():
    from featurespark.functions import stsql as S
    from featurespark.functions.wkb import Flat

    rnd = random.Random(14)
    texts = [BOX, U, HOLED, TWO, "POINT(1 1)", "POINT(4 2)", "MULTIPOINT(2 2, 4 4)", "LINESTRING(0 0, 4 4)", "POLYGON EMPTY",
             "POLYGON((4 4, 5 4, 5 5, 4 5, 4 4))", "GEOMETRYCOLLECTION(POINT(1 1), LINESTRING(1 1, 2 2))", "LINESTRING(0 4, 4 0)", None]
    batches = [[t and S._from_wkt(t) for t in texts]]
    batches += [[random_wkb(rnd)[0] for _ in range(n)] for n in (1, 50)]
    for rows in batches:
        arr, single = pa.array(rows, pa.binary()), [r and parse_one(r) for r in rows]
        flat = Flat(arr)
        for many, one in ((S._areas, S._area), (S._lengths(2), S._length), (S._lengths(3), S._perimeter)):
            assert many(flat).to_pylist() == [None if g is None else pytest.approx(one(g)) for g in single]
        for w, g in zip(S._centroids(flat).to_pylist(), single):
            want = g and S._centroid(g)
            assert (w is None) == (want is None)
            if w is not None and not any(map(math.isnan, want)):
                assert parse_one(w)[2][0][1][0][0].tolist() == pytest.approx(list(want))
        batch = relate.Batch(flat)
        for h in [*batches[0][:-1], rows[0]]:
            own = relate.Shape(parse_one(h))
            meet, gap = batch.intersects(own).tolist(), batch.distance(own).tolist()
            for g, m, d in zip(single, meet, gap):
                if g is not None:
                    assert m == relate.intersects(g, parse_one(h))
                    assert repr(float(d)) == repr(relate.distance(g, parse_one(h)))


def test_a_constant_is_related_to_batches(spark, monkeypatch):
    """A constant geometry goes against a batch, not against its rows one by one."""
    from featurespark.functions import stsql as S

    def never(*_):
        raise AssertionError("row by row")

    monkeypatch.setattr(S, "_binary", lambda *_: never)
    rows = pa.array([S._from_wkt("POINT(1 1)"), None, S._from_wkt("POINT(7 1)")], pa.binary())
    one = pa.array([S._from_wkt(BOX)] * 3, pa.binary())
    near = S._against_one(relate.intersects, relate.Batch.intersects, pa.bool_())
    assert near(rows, one).to_pylist() == near(one, rows).to_pylist() == [True, None, False]
    assert S._at_most(__import__("decimal").Decimal("0.05")) < 0.05 <= S._at_most(0.05)


def test_extents_and_points_of_a_batch(spark):
    from featurespark.functions.wkb import wkb_decode, wkb_extent, wkb_point

    rnd = random.Random(15)
    df = spark.createDataFrame([(i, r and r[0]) for i, r in enumerate([None, *[random_wkb(rnd) for _ in range(80)]])], "i int, w binary")
    nan = struct.pack("<BIIdddd", 1, 2, 2, math.nan, 1.0, 2.0, math.nan)
    rows = df.union(spark.createDataFrame([(-1, nan)], df.schema)).withColumn("g", wkb_decode("w")).select(
        wkb_extent(F.col("w")).alias("box"), G.extent("g").alias("want"), wkb_point(F.col("w")).alias("p"),
        F.when(F.size("g.parts") > 0, F.struct(G.point_x("g"), G.point_y("g"))).alias("at")).collect()
    assert [repr(r["box"]) for r in rows] == [repr(r["want"]) for r in rows]
    assert all(tuple(r["p"]) == (tuple(r["at"]) if r["at"] else (None, None)) for r in rows if r["p"])


def test_candidates_are_tested_where_they_are_found(layers, spark, tmp_path):
    """Features that lie on each other make many candidates: these are not shuffled, and identify keeps few of a batch."""
    from featurespark import Layers
    from featurespark.functions.wkb import edge_array, topmost_array
    from featurespark.functions.stsql import _from_wkt
    from featurespark.operators import spatial as SP

    for n in ("sites", "parcels"):
        layers.read(n).write.parquet(str(tmp_path / f"{n}.parquet"))
    own = Layers(layers.base, str(tmp_path))
    join = SP.points_in_polygons(own.read("sites"), own.read("parcels"), ["site_id"], ["parcel_id"])
    top = SP.identify(own.read("sites"), [("parcels", own.read("parcels"), "parcel_id")], ["site_id"])
    assert [d._jdf.queryExecution().optimizedPlan().toString().count("Join") for d in (join, top)] == [1, 1]
    e = edge_array(pa.array([_from_wkt(BOX)]))[0].as_py()
    got = topmost_array(pa.array([1.0] * 7), pa.array([1.0] * 6 + [9.0]), pa.array([e] * 7), pa.array([1, 1, 2, 1, 2, 1, 3]),
                        pa.array([0, -1, 0, -1, 0, -1, 0]), pa.array(["a", "c", None, "b", "a", "b", "a"]))
    assert got.to_pylist() == [False, False, True, True, False, False, False]
