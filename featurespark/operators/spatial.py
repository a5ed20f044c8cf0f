"""Spatial operators: extents (D5), identify (B11), point-in-feature join.

Point-in-feature join, distributed and exact
--------------------------------------------
A multi-level grid turns the spatial predicate into an equi-join:

* cells of level ``k`` are ``2^k`` wide; each polygon is assigned to the level
  whose cells are at least as wide as its extent, so it covers at most 2 x 2 cells
  there (no polygon explodes into thousands of rows, however large it is);
* one aggregate over the polygons' extents tells which levels are in use, and each
  point emits one cell key for each of those;
* ``(level, cx, cy)`` is an ordinary equi-join key, so Spark shuffles both
  sides by it and AQE's skew-join splits hot cells;
* candidates are pairs that pass the extent test. A (point, polygon) pair can meet
  in one cell only, so no de-duplication is needed;
* a polygon's geometry is read once and goes along into its cells, as packed edges, so candidates, which may be very many where features
  lie on each other, are tested where the join finds them and are never shuffled or sorted;
* each task gathers the points, and the polygons, of a cell in *blocks*, rows that hold lists. Blocks are what is shuffled and joined, so
  that where n points meet m polygons a block goes to Python once, not n * m rows; blocks are bounded and AQE splits hot cells between them;
* the box test and the exact even-odd test run over all pairs of two blocks at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.functions.wkb import pairs_inside, polygon_edges, wkb_extent, wkb_point_once

_BOUNDS = ("xmin", "ymin", "xmax", "ymax")
_KEYS = ["__lvl", "__cx", "__cy"]
_GATHERED, _BYTES = 1 << 18, 1 << 26    # rows, and bytes of them, that a task makes blocks of
_POINTS, _POLYGONS = 1 << 11, 1 << 8    # of a block
_EDGES = 1 << 18                        # bytes of the edges of a block, if it has more than one polygon


def extent_column(schema: T.StructType) -> str | None:
    """The stored extent of the geometry: a struct of the four bounds, marked as covering or called ``bbox``."""
    boxes = [f for f in schema.fields if isinstance(f.dataType, T.StructType) and set(f.dataType.names) == set(_BOUNDS)]
    marked = [f.name for f in boxes if "covering" in f.metadata]
    return (marked or [f.name for f in boxes if f.name == "bbox"] or [None])[0]


def bbox_of(df: DataFrame, geom_col: str = "geometry", name: str = "__bbox") -> DataFrame:
    """Adds the extent under ``name``: the stored covering column, else decoded."""
    stored = extent_column(df.schema)
    if stored:
        return df.withColumn(name, F.col(f"`{stored}`"))
    return df.withColumn(name, wkb_extent(F.col(f"`{geom_col}`")))


def extent(df: DataFrame, geom_col: str = "geometry") -> DataFrame:
    """One row ``(xmin, ymin, xmax, ymax)`` over all non-NULL geometries.

    Uses the stored covering column when present: a pure column aggregate with
    partial min/max per task, no geometry decode.
    """
    b = bbox_of(df, geom_col)
    return b.agg(F.min("__bbox.xmin").alias("xmin"), F.min("__bbox.ymin").alias("ymin"),
                 F.max("__bbox.xmax").alias("xmax"), F.max("__bbox.ymax").alias("ymax"))


def geometry_extents(df: DataFrame, geom_col: str = "geometry") -> DataFrame:
    """Per-row extent from every decoded position (any nesting)."""
    return df.withColumn("extent", wkb_extent(F.col(f"`{geom_col}`")))


def point_xy(df: DataFrame, geom_col: str = "geometry") -> DataFrame:
    """Add ``__x``/``__y`` of point features.

    With a stored covering column the coordinates are read from it (a point's
    extent is the point itself; rows whose extent is not degenerate are not
    points and get NULL) — no geometry decode at all. Otherwise the WKB is
    decoded once.
    """
    stored = extent_column(df.schema)
    if stored:
        b = F.col(f"`{stored}`")
        is_pt = (b["xmin"] == b["xmax"]) & (b["ymin"] == b["ymax"])
        return df.withColumn("__x", F.when(is_pt, b["xmin"])).withColumn("__y", F.when(is_pt, b["ymin"]))
    dec = df.withColumn("__pt", wkb_point_once(F.col(f"`{geom_col}`")))
    return dec.withColumn("__x", F.col("__pt.x")).withColumn("__y", F.col("__pt.y")).drop("__pt")


def _level(box: Column) -> Column:
    """Exponent of the smallest power of two that is no less than the extent; null for empty extents."""
    size = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    up = F.ceil(F.log2(F.when(size > 0, size))).cast("int")
    # a logarithm may be rounded below the exponent that the size needs
    return F.when(F.pow(F.lit(2.0), up) < size, up + 1).otherwise(up)


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level))


def _blocked(df: DataFrame, most: int, heavy: str | None = None) -> DataFrame:
    """``_KEYS`` and lists of the other columns: a task's rows of a cell together, ``most`` at most, of ``heavy`` (bytes) ``_EDGES`` about."""
    others = [f for f in df.schema if f.name not in _KEYS]

    def run(batches):
        held: list = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= _GATHERED or sum(h.nbytes for h in held) >= _BYTES:
                yield made(held)
                held = []
        if sum(h.num_rows for h in held):
            yield made(held)

    def made(held):
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in _KEYS]))
        new = np.zeros(len(rows), bool)
        new[0] = True
        for c in _KEYS:
            own = rows[c].to_numpy()
            new[1:] |= own[1:] != own[:-1]
        first = np.flatnonzero(new)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        new |= place % most == 0
        if heavy:
            size = np.cumsum(pc.binary_length(rows[heavy]).fill_null(0).to_numpy().astype(np.int64)) // _EDGES
            new[1:] |= size[1:] != size[:-1]
        first = np.flatnonzero(new)
        ends = pa.array(np.append(first, len(rows)).astype(np.int32))
        keys = [rows[c].take(pa.array(first)).combine_chunks() for c in _KEYS]
        lists = [pa.ListArray.from_arrays(ends, rows[f.name].combine_chunks()) for f in others]
        return pa.RecordBatch.from_arrays([*keys, *lists], names=[*_KEYS, *[f.name for f in others]])

    schema = [df.schema[c] for c in _KEYS] + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in others]
    return df.mapInArrow(run, T.StructType(schema))


def _blocks(points: DataFrame, polygons: DataFrame, point_cols: list[str], polygon_cols: list[str], point_geom: str,
            polygon_geom: str) -> DataFrame:
    """Blocks of points and polygons that meet in a cell: ``__p0``, ... and ``__q0``, ... hold ``point_cols`` and ``polygon_cols``."""
    polys = bbox_of(polygons, polygon_geom).withColumn("__lvl", _level(F.col("__bbox"))).where("__lvl is not null")
    levels = sorted(polys.agg(F.collect_set("__lvl")).first()[0])
    poly = polys.select("*", polygon_edges(F.col(f"`{polygon_geom}`")).alias("__edges")).select(
        *[F.col(f"`{c}`").alias(f"__q{i}") for i, c in enumerate(polygon_cols)], "__edges", "__lvl", F.col("__bbox").alias("__bb"),
        F.explode(F.sequence(_cell(F.col("__bbox.xmin"), F.col("__lvl")),
                             _cell(F.col("__bbox.xmax"), F.col("__lvl")))).alias("__cx"))
    poly = poly.select("*", F.explode(F.sequence(_cell(F.col("__bb.ymin"), F.col("__lvl")),
                                                 _cell(F.col("__bb.ymax"), F.col("__lvl")))).alias("__cy"))
    poly = poly.select("*", *[F.col(f"__bb.{side}").alias(f"__b{i}") for i, side in enumerate(_BOUNDS)]).drop("__bb")

    at = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")
    # NULL coordinates would drop out at the equi-join (NULL keys never match)
    pts = point_xy(points, point_geom).where("__x is not null and __y is not null")
    pts = pts.select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(point_cols)], "__x", "__y", F.explode(at).alias("__lvl"))
    pts = pts.select("*", _cell(F.col("__x"), F.col("__lvl")).alias("__cx"),
                     _cell(F.col("__y"), F.col("__lvl")).alias("__cy"))
    return _blocked(pts, _POINTS).join(_blocked(poly, _POLYGONS, "__edges"), _KEYS, "inner")


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_cols: list[str],
                       polygon_cols: list[str], point_geom: str = "geometry",
                       polygon_geom: str = "geometry") -> DataFrame:
    """Every (point, polygon) pair with the point strictly inside the polygon.

    Returns ``point_cols + polygon_cols`` (names must not clash). Building the frame runs one
    aggregate over the polygons' extents, whose result is the list of levels.
    """
    pts = _kept(points, point_cols, point_geom)
    names = point_cols + polygon_cols

    def run(batches):
        for b in batches:
            left = [b.column(f"__p{i}").flatten() for i in range(len(point_cols))]
            right = [b.column(f"__q{i}").flatten() for i in range(len(polygon_cols))]
            for point, polygon in pairs_inside(b):
                i, j = pa.array(point), pa.array(polygon)
                yield pa.RecordBatch.from_arrays([*[c.take(i) for c in left], *[c.take(j) for c in right]], names=names)

    schema = T.StructType([points.schema[c] for c in point_cols] + [polygons.schema[c] for c in polygon_cols])
    return _blocks(pts, polygons, point_cols, polygon_cols, POINT, polygon_geom).mapInArrow(run, schema)


POINT = "__point"


def _kept(points: DataFrame, point_cols: list[str], point_geom: str) -> DataFrame:
    """``point_cols`` with the coordinates' column: the stored extent if there is one, else the geometry as ``POINT``."""
    stored = extent_column(points.schema)
    where = F.col(f"`{stored}`").alias("__point", metadata={"covering": point_geom}) if stored else F.col(f"`{point_geom}`").alias(POINT)
    return points.select(*[F.col(f"`{c}`") for c in point_cols], where)


def identify(points: DataFrame, layers: list[tuple[str, DataFrame, str]], point_cols: list[str],
             point_geom: str = "geometry", polygon_geom: str = "geometry") -> DataFrame:
    """B11 for many clicks: per point, the feature of the topmost layer under it.

    ``layers`` is ``[(layer_name, frame, id_column)]`` in registry (drawing)
    order; the last drawn layer is on top, as on the map. All layers go through one
    join, so the points are read and dealt once; the topmost hit (ties: smallest id) is a mergeable minimum,
    taken of each point's pairs as they are tested, then in each task and after its shuffle.
    """
    every = None
    for order, (name, frame, id_col) in enumerate(layers):
        one = bbox_of(frame, polygon_geom, "bbox").select(
            F.lit(name).alias("layer"), F.lit(-order).alias("__below"),
            F.col(f"`{id_col}`").cast("string").alias("feature_id"), "bbox", F.col(f"`{polygon_geom}`").alias("geometry"))
        every = one if every is None else every.unionByName(one)
    cols = [F.col(f"`{c}`") for c in point_cols]
    found = ["__below", "feature_id", "layer"]

    def run(batches):
        for b in batches:
            left = [b.column(f"__p{i}").flatten() for i in range(len(point_cols))]
            right = [b.column(f"__q{i}").flatten() for i in range(len(found))]
            order = pc.sort_indices(pa.table(right[:2], names=found[:2]), [(c, "ascending") for c in found[:2]], null_placement="at_start")
            order = order.to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            for point, polygon in pairs_inside(b, rank):
                i, j = pa.array(point), pa.array(polygon)
                yield pa.RecordBatch.from_arrays([*[c.take(i) for c in left], *[c.take(j) for c in right]], names=[*point_cols, *found])

    pts = _kept(points, point_cols, point_geom)
    schema = T.StructType([points.schema[c] for c in point_cols] + [every.schema[c] for c in found])
    hits = _blocks(pts, every, point_cols, found, POINT, "geometry").mapInArrow(run, schema) \
        .select(*cols, F.struct(*found).alias("__hit"))
    return hits.groupBy(*cols).agg(F.min("__hit").alias("__top")).select(*cols, "__top.layer", "__top.feature_id")
