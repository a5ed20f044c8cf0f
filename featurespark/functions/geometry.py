"""Native geometry expressions over the decoded struct (see ``wkb.GEOM``).

All functions return Spark Columns built from higher-order functions
(``transform``, ``aggregate``, ``filter``, ``flatten``), so they run in the JVM
with no Python in the loop (Spark interprets lambdas; it does not generate code
for them). SQL snippets use only
single-quoted literals, so they parse the same with or without ANSI
double-quoted identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from featurespark.functions.wkb import TYPE_NAMES

_NAMES = "array(" + ", ".join(f"'{TYPE_NAMES[i]}'" for i in range(1, 8)) + ")"


def _g(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a one-element transform).

    Expression trees repeat a sub-expression each time it is referenced; this
    binds it to a lambda variable instead, keeping generated code small.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def geojson(g: Column | str) -> Column:
    """H8: decoded geometry -> GeoJSON geometry text (XY, or XYZ when Z present)."""
    g = _g(g)
    d = F.when((g["zm"] % 2) == 1, F.lit(3)).otherwise(F.lit(2))
    name = F.element_at(F.expr(_NAMES), g["gtype"])
    part_json = F.transform(g["parts"], lambda p: _part_json(p, d))
    single = F.when(F.size(g["parts"]) == 0, F.lit("[]")).otherwise(F.element_at(part_json, 1))
    multi = F.concat(F.lit("["), F.array_join(part_json, ","), F.lit("]"))
    member = F.transform(g["parts"], lambda p: F.concat(
        F.lit('{"type":"'), F.element_at(F.expr(_NAMES), p["ptype"]),
        F.lit('","coordinates":'), _part_json(p, d), F.lit("}")))
    collection = F.concat(F.lit('{"type":"GeometryCollection","geometries":['),
                          F.array_join(member, ","), F.lit("]}"))
    coords = F.when(g["gtype"] <= 3, single).otherwise(multi)
    text = F.when(g["gtype"] == 7, collection).otherwise(
        F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), coords, F.lit("}")))
    return F.when(g.isNull(), F.lit(None).cast("string")).otherwise(text)


def _part_json(p: Column, d: Column) -> Column:
    pt = F.to_json(F.slice(p["rings"][0][0], F.lit(1), d))
    line = F.to_json(F.transform(p["rings"][0], lambda c: F.slice(c, F.lit(1), d)))
    poly = F.to_json(F.transform(p["rings"], lambda r: F.transform(r, lambda c: F.slice(c, F.lit(1), d))))
    return F.when(p["ptype"] == 1, pt).when(p["ptype"] == 2, line).otherwise(poly)


def positions(g: Column | str) -> Column:
    """Every position of the geometry, any nesting (array<array<double>>)."""
    g = _g(g)
    return F.flatten(F.transform(g["parts"], lambda p: F.flatten(p["rings"])))


def extent(g: Column | str) -> Column:
    """D5 per row: ``struct(xmin, ymin, xmax, ymax)``; NULL for NULL/empty."""
    def box(pos):
        xs = F.transform(pos, lambda c: c[0])
        ys = F.transform(pos, lambda c: c[1])
        b = F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                     F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
        return F.when(F.size(pos) > 0, b)

    return _let(positions(g), box)


def _ring_area2(r: Column) -> Column:
    """Twice the signed shoelace area, translated to the first vertex."""
    x0, y0 = r[0][0], r[0][1]
    idx = F.sequence(F.lit(1), F.size(r) - 1)
    return F.when(F.size(r) < 3, F.lit(0.0)).otherwise(F.aggregate(
        idx, F.lit(0.0),
        lambda acc, i: acc + (r[i - 1][0] - x0) * (r[i][1] - y0) - (r[i][0] - x0) * (r[i - 1][1] - y0)))


def area(g: Column | str) -> Column:
    """Planar area: shells minus holes, summed over polygon parts."""
    g = _g(g)

    def part_area(p):
        ring_areas = F.transform(p["rings"], lambda r, i: F.when(i == 0, F.abs(_ring_area2(r)))
                                 .otherwise(-F.abs(_ring_area2(r))) / 2.0)
        return F.when(p["ptype"] == 3, F.aggregate(ring_areas, F.lit(0.0), lambda a, b: a + b)) \
                .otherwise(F.lit(0.0))

    return F.aggregate(F.transform(g["parts"], part_area), F.lit(0.0), lambda a, b: a + b)


def _ring_length(r: Column) -> Column:
    idx = F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1)))
    return F.when(F.size(r) < 2, F.lit(0.0)).otherwise(F.aggregate(
        idx, F.lit(0.0), lambda acc, i: acc + F.hypot(r[i][0] - r[i - 1][0], r[i][1] - r[i - 1][1])))


def length(g: Column | str) -> Column:
    """Planar length of line parts (polygons have length 0, like ST_Length)."""
    g = _g(g)
    return F.aggregate(F.transform(g["parts"], lambda p: F.when(
        p["ptype"] == 2, _ring_length(p["rings"][0])).otherwise(F.lit(0.0))),
        F.lit(0.0), lambda a, b: a + b)


def perimeter(g: Column | str) -> Column:
    g = _g(g)
    return F.aggregate(F.transform(g["parts"], lambda p: F.when(
        p["ptype"] == 3, F.aggregate(F.transform(p["rings"], _ring_length), F.lit(0.0),
                                     lambda a, b: a + b)).otherwise(F.lit(0.0))),
        F.lit(0.0), lambda a, b: a + b)


def num_points(g: Column | str) -> Column:
    return F.size(positions(g))


def point_x(g: Column | str) -> Column:
    g = _g(g)
    return F.when(g["gtype"] == 1, g["parts"][0]["rings"][0][0][0])


def point_y(g: Column | str) -> Column:
    g = _g(g)
    return F.when(g["gtype"] == 1, g["parts"][0]["rings"][0][0][1])


def _ring_side(r: Column, px: Column, py: Column) -> Column:
    """Edges that a ray to the right crosses, or -1 when the point is on the ring.

    The same exact comparisons as ``relate._on`` and ``relate._in_rings``.
    """
    idx = F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1)))

    def step(acc, i):
        ax, ay, bx, by = r[i - 1][0], r[i - 1][1], r[i][0], r[i][1]
        on = ((bx - ax) * (py - ay) == (by - ay) * (px - ax)) & px.between(F.least(ax, bx), F.greatest(ax, bx)) \
            & py.between(F.least(ay, by), F.greatest(ay, by))
        hit = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.when(by != ay, by - ay) + ax)
        return F.when((acc < 0) | on, F.lit(-1)).otherwise(acc + F.coalesce(hit, F.lit(False)).cast("int"))

    return F.when(F.size(r) < 4, F.lit(0)).otherwise(F.aggregate(idx, F.lit(0), step))


def contains_point(g: Column | str, px: Column, py: Column) -> Column:
    """True when (px, py) lies strictly inside a polygon part: within the shell, outside the holes, on no ring."""
    g = _g(g)

    def part_in(p):
        total = F.aggregate(F.transform(p["rings"], lambda r: _ring_side(r, px, py)), F.lit(0),
                            lambda a, c: F.when((a < 0) | (c < 0), F.lit(-1)).otherwise(a + c))
        return (p["ptype"] == 3) & (F.pmod(F.greatest(total, F.lit(0)), F.lit(2)) == 1)

    return F.exists(g["parts"], part_in)


def centroid(g: Column | str) -> Column:
    """Area-weighted centroid of polygon parts; mean of positions otherwise."""
    g = _g(g)

    def ring_terms(r):
        x0, y0 = r[0][0], r[0][1]
        idx = F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1)))
        init = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

        def step(acc, i):
            xa, ya = r[i - 1][0] - x0, r[i - 1][1] - y0
            xb, yb = r[i][0] - x0, r[i][1] - y0
            cr = xa * yb - xb * ya
            return F.struct((acc["a"] + cr).alias("a"), (acc["cx"] + (xa + xb) * cr).alias("cx"),
                            (acc["cy"] + (ya + yb) * cr).alias("cy"))

        t = F.aggregate(idx, init, step)
        # signed area of this ring and its first moments, shifted back to x0/y0
        a = t["a"] / 2.0
        return F.struct(a.alias("a"), (t["cx"] / 6.0 + a * x0).alias("mx"),
                        (t["cy"] / 6.0 + a * y0).alias("my"))

    def oriented(p):
        # shell counts positive, holes negative, regardless of ring orientation:
        # multiply each ring's terms by sign(+1 shell / -1 hole) * sign(area)
        raw = F.transform(p["rings"], ring_terms)
        return F.transform(raw, lambda t, i: F.struct(
            (F.abs(t["a"]) * F.when(i == 0, 1.0).otherwise(-1.0)).alias("a"),
            (t["mx"] * F.when((i == 0) == (t["a"] >= 0), 1.0).otherwise(-1.0)).alias("mx"),
            (t["my"] * F.when((i == 0) == (t["a"] >= 0), 1.0).otherwise(-1.0)).alias("my")))

    terms = F.flatten(F.transform(F.filter(g["parts"], lambda p: p["ptype"] == 3), oriented))
    tot = F.aggregate(terms, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")),
                      lambda acc, t: F.struct((acc["a"] + t["a"]).alias("a"), (acc["mx"] + t["mx"]).alias("mx"),
                                              (acc["my"] + t["my"]).alias("my")))
    def finish(t, pos):
        n = F.size(pos)
        mean = F.struct((F.aggregate(pos, F.lit(0.0), lambda a, c: a + c[0]) / n).alias("x"),
                        (F.aggregate(pos, F.lit(0.0), lambda a, c: a + c[1]) / n).alias("y"))
        poly = F.struct((t["mx"] / t["a"]).alias("x"), (t["my"] / t["a"]).alias("y"))
        return F.when(t["a"] != 0, poly).when(n > 0, mean)

    return _let(tot, lambda t: _let(positions(g), lambda pos: finish(t, pos)))


def distance_point_point(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)


def make_point(x: Column, y: Column) -> Column:
    """ST_Point as a decoded struct."""
    return F.struct(F.lit(1).alias("gtype"), F.lit(0).alias("zm"), F.array(F.struct(
        F.lit(1).alias("ptype"), F.array(F.array(F.array(x.cast("double"), y.cast("double")))).alias("rings")
    )).alias("parts"))


def make_polygon(ring: Column) -> Column:
    """One-ring polygon from an ``array<array<double>>`` ring."""
    return F.struct(F.lit(3).alias("gtype"), F.lit(0).alias("zm"), F.array(F.struct(
        F.lit(3).alias("ptype"), F.array(ring).alias("rings"))).alias("parts"))
