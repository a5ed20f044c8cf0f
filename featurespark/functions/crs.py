"""Reprojection to EPSG:4326 (H16), natively over decoded geometries.

Supported sources: EPSG:4326 and GDA2020 geographic (7844), both identity;
Web Mercator (3857, inverse spherical Mercator); the GDA2020 / MGA grid zones
(7846..7859) and WGS 84 / UTM zones (326zz north, 327zz south) by the inverse
transverse Mercator Krüger series (sub-millimetre inside a zone); and the national and
state grids on a Lambert conformal conic with two standard parallels.

Intermediate values are bound to lambda variables (``_let``), so each is computed once a vertex.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from featurespark.errors import LayerQueryError
from featurespark.functions.geometry import _let

# --- fixed values: ellipsoids and projection constants (published) ---
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GRS80_F = 1 / 298.257222101
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0
MGA_EPSG_ZONE_OFFSET = 7800      # EPSG:78zz = GDA2020 / MGA zone zz (46..59)
IDENTITY_EPSG = (4326, 7844, 4283, 4269, 4258)
# Lambert conformal conic grids on GRS80: latitude and longitude of the origin, the two
# standard parallels (degrees), false easting and northing (metres)
LAMBERT = {
    3111: (-37.0, 145.0, -36.0, -38.0, 2500000.0, 2500000.0),
    7899: (-37.0, 145.0, -36.0, -38.0, 2500000.0, 2500000.0),
    3112: (0.0, 134.0, -18.0, -36.0, 0.0, 0.0),
    7845: (0.0, 134.0, -18.0, -36.0, 0.0, 0.0),
    3308: (-33.25, 147.0, -30.75, -35.75, 9300000.0, 4500000.0),
    8058: (-33.25, 147.0, -30.75, -35.75, 9300000.0, 4500000.0),
    2154: (46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0),
}
# -------------------------------------------------------------------------


def _tm_params(epsg: int):
    if MGA_EPSG_ZONE_OFFSET + 46 <= epsg <= MGA_EPSG_ZONE_OFFSET + 59:
        return epsg - MGA_EPSG_ZONE_OFFSET, True, GRS80_F
    if 32601 <= epsg <= 32660:
        return epsg - 32600, False, WGS84_F
    if 32701 <= epsg <= 32760:
        return epsg - 32700, True, WGS84_F
    return None


def inverse_tm(e: Column, n: Column, zone: int, south: bool, flattening: float) -> Column:
    """(easting, northing) -> array(lon, lat) in degrees, Krüger series to n^4."""
    nn = flattening / (2 - flattening)
    big_a = WGS84_A / (1 + nn) * (1 + nn ** 2 / 4 + nn ** 4 / 64)
    beta = [nn / 2 - 2 * nn ** 2 / 3 + 37 * nn ** 3 / 96 - nn ** 4 / 360,
            nn ** 2 / 48 + nn ** 3 / 15 - 437 * nn ** 4 / 1440,
            17 * nn ** 3 / 480 - 37 * nn ** 4 / 840, 4397 * nn ** 4 / 161280]
    delta = [2 * nn - 2 * nn ** 2 / 3 - 2 * nn ** 3 + 116 * nn ** 4 / 45,
             7 * nn ** 2 / 3 - 8 * nn ** 3 / 5 - 227 * nn ** 4 / 45,
             56 * nn ** 3 / 15 - 136 * nn ** 4 / 35, 4279 * nn ** 4 / 630]
    fn = UTM_FALSE_NORTHING_SOUTH if south else 0.0
    raw = F.struct(((n - F.lit(fn)) / F.lit(UTM_K0 * big_a)).alias("xi"),
                   ((e - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM_K0 * big_a)).alias("eta"))

    def rectify(r):
        xi, eta = r["xi"], r["eta"]
        for j, b in enumerate(beta, start=1):
            xi = xi - F.lit(b) * F.sin(2 * j * r["xi"]) * F.cosh(2 * j * r["eta"])
            eta = eta - F.lit(b) * F.cos(2 * j * r["xi"]) * F.sinh(2 * j * r["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def position(p):
        lam = F.lit(math.radians(zone * 6 - 183)) + F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))
        return _let(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])), lambda chi: F.array(F.degrees(lam), F.degrees(
            chi + sum((F.lit(d) * F.sin(2 * j * chi) for j, d in enumerate(delta, start=1)), F.lit(0.0)))))

    return _let(raw, lambda r: _let(rectify(r), position))


def inverse_lambert(x: Column, y: Column, lat0, lon0, lat1, lat2, fe, fn) -> Column:
    """(easting, northing) -> array(lon, lat) in degrees, conformal conic with two standard parallels."""
    ecc = math.sqrt(GRS80_F * (2 - GRS80_F))

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - (ecc * math.sin(phi)) ** 2)

    def t(phi):
        return math.tan(math.pi / 4 - phi / 2) / ((1 - ecc * math.sin(phi)) / (1 + ecc * math.sin(phi))) ** (ecc / 2)

    p0, p1, p2 = (math.radians(v) for v in (lat0, lat1, lat2))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big_f = m(p1) / (n * t(p1) ** n)
    r0 = WGS84_A * big_f * t(p0) ** n
    sign = math.copysign(1.0, n)
    dx, dy = x - F.lit(fe), F.lit(r0) - (y - F.lit(fn))
    raw = F.struct((F.lit(sign) * F.hypot(dx, dy)).alias("r"),
                   F.atan2(F.lit(sign) * dx, F.lit(sign) * dy).alias("theta"))

    def latitude(tt):
        start = F.lit(math.pi / 2) - 2 * F.atan(tt)
        # the fixed point is reached to the last digit in well under eight rounds
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda phi, _: F.lit(math.pi / 2) - 2 * F.atan(
            tt * F.pow((1 - ecc * F.sin(phi)) / (1 + ecc * F.sin(phi)), F.lit(ecc / 2))))

    return _let(raw, lambda p: F.array(
        F.degrees(p["theta"] / F.lit(n) + F.lit(math.radians(lon0))),
        F.degrees(_let(F.pow(p["r"] / F.lit(WGS84_A * big_f), F.lit(1 / n)), latitude))))


def inverse_mercator(x: Column, y: Column) -> Column:
    return F.array(F.degrees(x / F.lit(WGS84_A)),
                   F.degrees(2 * F.atan(F.exp(y / F.lit(WGS84_A))) - F.lit(math.pi / 2)))


def position_to_4326(epsg: int):
    """Function ``array<double> -> array<double>`` (extra ordinates kept); None for identity."""
    if epsg in IDENTITY_EPSG:
        return None
    tm = _tm_params(epsg)
    if epsg == 3857:
        conv = inverse_mercator
    elif epsg in LAMBERT:
        def conv(x, y):
            return inverse_lambert(x, y, *LAMBERT[epsg])
    elif tm is not None:
        def conv(x, y):
            return inverse_tm(x, y, *tm)
    else:
        raise LayerQueryError(f"unsupported source CRS: EPSG:{epsg}")
    return lambda c: F.concat(conv(c[0], c[1]), F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(0))))


def to_4326(g: Column, epsg: int) -> Column:
    """Reproject a decoded geometry struct (see ``wkb.GEOM``) to EPSG:4326."""
    fn = position_to_4326(epsg)
    if fn is None:
        return g
    parts = F.transform(g["parts"], lambda p: F.struct(
        p["ptype"].alias("ptype"),
        F.transform(p["rings"], lambda r: F.transform(r, fn)).alias("rings")))
    return F.when(g.isNull(), g).otherwise(
        F.struct(g["gtype"].alias("gtype"), g["zm"].alias("zm"), parts.alias("parts")))
