"""Tile pyramid as a Spark job (A12, re-aimed from an external tiler).

Web-Mercator tile arithmetic in native functions, for zoom ``z`` and
``n = 2^z``::

    x = floor((lon + 180) / 360 * n)
    y = floor((1 - asinh(tan(lat)) / pi) / 2 * n)        clamped to [0, n-1]

* ``assign_tiles``: every tile a feature's extent touches, for a zoom range.
  The explosion is split in two narrow steps with a hash repartition on
  ``(feature, z, column)`` in between, so a continent-sized polygon at a high
  zoom spreads its millions of tile rows over many tasks instead of one.
* ``tile_density``: features per tile (partial counts, one shuffle).
* ``guess_max_zoom``: the smallest zoom at which the median number of features
  per occupied tile (by feature centre) is at most ``target`` (default
  ``cap / 4``), bounded by 14.
* ``thin_tiles``: keep at most ``cap`` features per tile, dropping features
  in the densest sub-cells (zoom + 4 grid) first, ties by feature id. Each
  task keeps a tile's ``cap`` best before the shuffle, so a tile that holds
  the whole layer is ranked from few rows.
* ``refine_tiles``: from a zoom on, a quadtree: only tiles that hold more than ``cap`` features are
  divided, and only the features in them go on. A tile with fewer is complete and
  has no children; whatever lies in a few crowded tiles, the others stay as they are.
* *blocks*: while zooms are divided, neighbouring tiles that hold the very same features are one block, a rectangle of tiles
  ``x..x2`` by ``y..y2``. A row is a feature in a block, so a feature that covers thousands of tiles of a deep zoom, alone or with others, is
  a few rows; a block is cut only where a feature begins or ends in it, down to single tiles. Rows a tile
  are counted out last of all, and never stored or dealt.
* ``build_tiles``: zoom guess, extension while a tile still drops features, either of
  those tiles alone (``refine``) or of the whole zoom, assignment, thinning. Every feature is somewhere in the
  pyramid in a tile that drops nothing. ``write_tiles`` stores the same rows zoom by zoom.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurespark.errors import LayerQueryError
from featurespark.functions import geometry as G
from featurespark.functions.crs import IDENTITY_EPSG, to_4326
from featurespark.functions.wkb import wkb_decode, wkb_extent

# --- fixed values: Web-Mercator limits and pyramid defaults ---
MAX_LAT = 85.0511287798066
ZOOM_LIMIT = 14
DEFAULT_CAP = 2000
SUBCELL_BITS = 4
LAST_ZOOM = 24           # tiles of this zoom are a few metres wide: extension ends here
# ----------------------------------------------------------------

ZOOMS_AT_ONCE = 3        # zooms of a layer whose rows are written together
TEXTS = 8 << 20          # bytes of the dictionary of a stored row group
WIDE = 4                 # tiles of a feature and zoom from which on zooms are thinned in blocks
TASK_TILES = 1 << 22     # tiles that a task counts out of its blocks, if they are even


def tile_x(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    x = F.floor((lon + F.lit(180.0)) / F.lit(360.0) * n)
    return F.least(F.greatest(x, F.lit(0)), (n - 1).cast("long"))


def tile_y(lat: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    la = F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT))
    y = F.floor((F.lit(1.0) - F.asinh(F.tan(F.radians(la))) / F.lit(math.pi)) / F.lit(2.0) * n)
    return F.least(F.greatest(y, F.lit(0)), (n - 1).cast("long"))


def with_bbox_4326(df: DataFrame, epsg: int, geom_col: str = "geometry") -> DataFrame:
    """``__bb`` = extent in EPSG:4326 (the stored bbox when already geographic)."""
    from featurespark.operators.spatial import extent_column

    stored = extent_column(df.schema)
    if epsg in IDENTITY_EPSG and stored:
        return df.withColumn("__bb", F.col(f"`{stored}`"))
    if epsg in IDENTITY_EPSG:
        return df.withColumn("__bb", wkb_extent(F.col(f"`{geom_col}`")))
    dec = df.withColumn("__g", wkb_decode(F.col(f"`{geom_col}`")))
    return dec.withColumn("__bb", G.extent(to_4326(F.col("__g"), epsg))).drop("__g")


def assign_tiles(df: DataFrame, id_cols: list[str], zmin: int, zmax: int,
                 bbox_col: str = "__bb", spread: bool = True) -> DataFrame:
    """``(id..., z, x, y)`` for every tile the extent touches, zooms ``zmin..zmax``."""
    b = F.col(bbox_col)
    ids = [F.col(f"`{c}`") for c in id_cols]
    z = df.where(b.isNotNull()).select(*ids, bbox_col, F.explode(F.sequence(F.lit(zmin), F.lit(zmax))).alias("z"))
    zc = F.col("z")
    xs = z.select(*ids, "z", F.explode(F.sequence(tile_x(b["xmin"], zc), tile_x(b["xmax"], zc))).alias("x"),
                  tile_y(b["ymax"], zc).alias("y0"), tile_y(b["ymin"], zc).alias("y1"),
                  ((b["xmin"] + b["xmax"]) / 2).alias("cx"), ((b["ymin"] + b["ymax"]) / 2).alias("cy"))
    if spread:
        xs = xs.repartition(*id_cols, "z", "x")
    return xs.select(*ids, "z", "x", F.explode(F.sequence("y0", "y1")).alias("y"), "cx", "cy")


def tile_density(tiles: DataFrame) -> DataFrame:
    """Features per tile ``(z, x, y, n)``."""
    return tiles.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def center_tiles(df: DataFrame, zmin: int, zmax: int, bbox_col: str = "__bb") -> DataFrame:
    """One tile per feature and zoom: the tile of the extent centre."""
    b = F.col(bbox_col)
    cx = (b["xmin"] + b["xmax"]) / 2
    cy = (b["ymin"] + b["ymax"]) / 2
    z = df.where(b.isNotNull()).select(cx.alias("cx"), cy.alias("cy"),
                                       F.explode(F.sequence(F.lit(zmin), F.lit(zmax))).alias("z"))
    return z.select("z", tile_x(F.col("cx"), F.col("z")).alias("x"), tile_y(F.col("cy"), F.col("z")).alias("y"))


def zoom_stats(df: DataFrame, zmin: int = 0, zmax: int = ZOOM_LIMIT, bbox_col: str = "__bb") -> DataFrame:
    """Per zoom: median and max features per occupied tile (by centre)."""
    per_tile = tile_density(center_tiles(df, zmin, zmax, bbox_col))
    return per_tile.groupBy("z").agg(F.median("n").alias("median_n"), F.max("n").alias("max_n"))


def guess_max_zoom(df: DataFrame, cap: int = DEFAULT_CAP, target: float | None = None,
                   zmin: int = 0, bbox_col: str = "__bb") -> DataFrame:
    """One row ``(zoom)``: smallest z whose median per-tile count <= target."""
    target = cap / 4 if target is None else target
    st = zoom_stats(df, zmin, ZOOM_LIMIT, bbox_col)
    ok = st.where(F.col("median_n") <= F.lit(float(target))).agg(F.min("z").alias("z"))
    return ok.select(F.coalesce(F.col("z"), F.lit(ZOOM_LIMIT)).cast("int").alias("zoom"))


def thin_tiles(tiles: DataFrame, id_col: str, cap: int = DEFAULT_CAP, stored: str | None = None) -> DataFrame:
    """Keep <= ``cap`` features per tile, sparsest sub-cells first, ties by id.

    The ranks are limits, so Spark applies them in each task before the shuffle as well
    (the query session lifts the optimizer's threshold for that above ``cap``). With ``stored`` the densities, a row
    a sub-cell, are written there first, so that Spark knows their size and need not deal the tiles to join them. Rows may be
    blocks (with ``x2``, ``y2``): their features are ranked once for all of its tiles.
    """
    # density of the feature's centre sub-cell at zoom z + SUBCELL_BITS
    # (``tiles`` carries the centre ``cx``/``cy`` from ``assign_tiles``, or that sub-cell itself)
    t = tiles.withColumnRenamed(id_col, "__id")
    if "sx" not in t.columns:
        zs = F.col("z") + F.lit(SUBCELL_BITS)
        t = t.withColumn("sx", tile_x(F.col("cx"), zs)).withColumn("sy", tile_y(F.col("cy"), zs))
    block = [c for c in ("x2", "y2") if c in t.columns]
    dens = t.groupBy("z", "sx", "sy").agg((F.sum(_tiles_of()) if block else F.count(F.lit(1))).alias("dens"))
    if stored:
        dens.write.mode("overwrite").parquet(stored)
        dens = t.sparkSession.read.schema(dens.schema).parquet(stored)
    return _ranked(t.join(dens, ["z", "sx", "sy"]), cap).select(F.col("__id").alias(id_col), "z", "x", "y", *block, "dens")


def _ranked(t: DataFrame, cap: int) -> DataFrame:
    w = Window.partitionBy("z", "x", "y").orderBy(F.col("dens").asc(), F.col("__id").asc())
    return t.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= cap)


def _tiles_of() -> Column:
    """How many tiles a block has."""
    return (F.col("x2") - F.col("x") + 1) * (F.col("y2") - F.col("y") + 1)


def _top_zoom(bb: DataFrame, id_col: str, zmax: int, cap: int) -> int:
    """The first zoom from ``zmax`` on where no tile holds more than ``cap`` features.

    The tile of a feature's upper left corner is one of its tiles, so zooms where a tile holds more corners than ``cap`` are passed over
    after a single count of a row a feature and zoom; only the others are counted in all tiles.
    """
    b = F.col("__bb")
    corners = bb.where(b.isNotNull()).select(b.alias("__bb"), F.explode(F.sequence(F.lit(zmax), F.lit(LAST_ZOOM))).alias("z")) \
        .select("z", tile_x(b["xmin"], F.col("z")).alias("x"), tile_y(b["ymax"], F.col("z")).alias("y"))
    crowded = {r["z"] for r in tile_density(corners).where(F.col("n") > cap).select("z").distinct().collect()}
    while zmax < LAST_ZOOM:
        if zmax in crowded:
            zmax += 1
            continue
        most = tile_density(assign_tiles(bb, [id_col], zmax, zmax)).agg(F.max("n")).first()[0]
        if (most or 0) <= cap:
            break
        zmax += 1
    return zmax


def _unfolded(tiles: DataFrame) -> DataFrame:
    """A row a tile of every block."""
    out = tiles.withColumn("x", F.explode(F.sequence("x", "x2"))).drop("x2")
    return out.withColumn("y", F.explode(F.sequence("y", "y2"))).drop("y2")


def _dealt(blocks: DataFrame, id_cols: list[str], n_tiles: int) -> DataFrame:
    """Blocks in so many parts that none is counted out to very many rows: their own bytes tell nothing of that."""
    return blocks.repartition(max(1, math.ceil(n_tiles / TASK_TILES)), *id_cols)


_RANGES = ["__x0", "__x1", "__y0", "__y1", "__sx", "__sy"]
_BLOCK = ["x", "x2", "y", "y2"]


def _ranged(bb: DataFrame, id_cols: list[str], bbox_col: str) -> DataFrame:
    """Extents as ranges of tiles at ``LAST_ZOOM``, which shifted are those of any other zoom, and the sub-cells of their centres."""
    b, last, fine = F.col(bbox_col), F.lit(LAST_ZOOM), F.lit(LAST_ZOOM + SUBCELL_BITS)
    at = [tile_x(b["xmin"], last), tile_x(b["xmax"], last), tile_y(b["ymax"], last), tile_y(b["ymin"], last),
          tile_x((b["xmin"] + b["xmax"]) / 2, fine), tile_y((b["ymin"] + b["ymax"]) / 2, fine)]
    return bb.where(b.isNotNull()).select(*[F.col(f"`{c}`") for c in id_cols], *[c.alias(name) for c, name in zip(at, _RANGES)])


def _at(z: int | Column) -> list[Column]:
    """A feature's range of tiles at a zoom, as ``_BLOCK``."""
    up = F.lit(LAST_ZOOM) - z
    return [F.call_function("shiftright", F.col(c), up).alias(name) for c, name in zip(_RANGES, _BLOCK)]


def _divided(spans: DataFrame, z: int, end: int, cap: int, folder: str) -> Iterator[tuple[int, DataFrame, DataFrame | None, int]]:
    """Levels from zoom ``z`` on, while tiles are crowded and up to ``end``, as ``(zoom, rows, crowded blocks, tiles at most)``.

    Rows are a feature in a block. The blocks of a level are written, those of ``end`` are not looked at: there the blocks are None, as they
    are at the level without a crowded one.
    """
    spark, keep = spans.sparkSession, spans.columns
    # the first blocks are single tiles
    first = spans.select("*", F.explode(F.sequence(*_at(z)[:2])).alias("x"), *_at(z)[2:]).withColumn("x2", F.col("x"))
    frontier = first.withColumn("y", F.explode(F.sequence("y", "y2"))).withColumn("y2", F.col("y")).select(*keep, *_BLOCK)
    most = 0
    while z < end:
        path = f"{folder}/z{z}"
        # a block's rows lie together, so that they are counted before the shuffle; Spark splits the parts that are too large
        frontier.hint("rebalance", F.col("x"), F.col("y")).write.mode("overwrite").parquet(path)
        frontier = spark.read.schema(frontier.schema).parquet(path).withColumn("__tile", F.shiftleft("x", 32).bitwiseOR(F.col("y")))
        # which of its features don't reach the first or last column or row of a block's children: there it is cut
        cuts, below = [], dict(zip(_BLOCK, _at(z + 1)))
        for c in "xy":
            low, high = below[c] > F.col(c) * 2, below[f"{c}2"] < F.col(f"{c}2") * 2 + 1
            wide = F.col(f"{c}2") > F.col(c)
            cuts += [F.max(low | (high & ~wide)).alias(f"__{c}low"), F.max(high & wide).alias(f"__{c}high")]
        full = frontier.groupBy("__tile").agg(F.count(F.lit(1)).alias("n"), F.max(_tiles_of()).alias("__tiles"), *cuts).where(F.col("n") > cap)
        full.write.mode("overwrite").parquet(f"{path}/_crowded")
        full = spark.read.schema(full.schema).parquet(f"{path}/_crowded")
        most = full.agg(F.sum(F.col("n") * F.col("__tiles"))).first()[0]
        if most is None:
            yield z, frontier.drop("__tile"), None, 0
            return
        yield z, frontier, full, most
        z, most = z + 1, most * 4
        frontier = frontier.join(full, "__tile")
        for c in "xy":
            # up to three parts: the first column, those between and the last one, as far as they are told apart
            start, last = F.col(c) * 2, F.col(f"{c}2") * 2 + 1
            low, high = F.col(f"__{c}low"), F.col(f"__{c}high")
            before = F.when(high, last - 1).otherwise(last)
            part = F.col("__part")
            frontier = frontier.withColumn("__part", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))) \
                .where((part == 0) | ((part == 1) & low) | ((part == 2) & high)) \
                .withColumns({"__from": F.when(part == 0, start).when(part == 1, start + 1).otherwise(last),
                              "__to": F.when(part == 2, last).when((part == 0) & low, start).otherwise(before)}) \
                .where((below[c] <= F.col("__from")) & (below[f"{c}2"] >= F.col("__to"))) \
                .withColumns({c: F.col("__from"), f"{c}2": F.col("__to")})
        frontier = frontier.select(*keep, *_BLOCK)
    yield z, frontier, None, most


def _refined(bb: DataFrame, id_cols: list[str], z: int, cap: int, folder: str, bbox_col: str = "__bb") -> Iterator[tuple[int, Callable[[], DataFrame]]]:
    """``refine_tiles`` zoom by zoom, in blocks, as ``(zoom, what makes its frame)``."""
    for z, frontier, full, most in _divided(_ranged(bb, id_cols, bbox_col), z, LAST_ZOOM, cap, folder):
        if full is None:
            end = frontier.select(*[F.col(f"`{c}`") for c in id_cols], F.lit(z).alias("z"), *_BLOCK)
            yield z, lambda: _dealt(end, id_cols, most) if most else end
        else:
            yield z, partial(_level, frontier, full, id_cols, z, cap, f"{folder}/z{z}")


def _level(frontier: DataFrame, full: DataFrame, id_cols: list[str], z: int, cap: int, path: str) -> DataFrame:
    """The blocks of a zoom that are complete, and the crowded ones thinned."""
    ids, tile = [F.col(f"`{c}`") for c in id_cols], [F.lit(z).alias("z"), *_BLOCK]
    cell = [F.shiftright(c, LAST_ZOOM - z).alias(c[2:]) for c in ("__sx", "__sy")]
    one, back = (ids[0], F.col("__one").alias(id_cols[0])) if len(ids) == 1 else (F.struct(*ids), "__one.*")
    crowded = frontier.join(full.select("__tile"), "__tile")
    thinned = thin_tiles(crowded.select(one.alias("__one"), *tile, *cell), "__one", cap, f"{path}/_density").select(back, "z", *_BLOCK)
    return frontier.join(full, "__tile", "left_anti").select(*ids, *tile).unionByName(thinned)


def _wide(bb: DataFrame, id_col: str, zmin: int, zmax: int) -> bool:
    """Whether the features touch so many tiles of these zooms that blocks are worth their jobs."""
    each = _ranged(bb, [id_col], "__bb").select(F.explode(F.sequence(F.lit(zmin), F.lit(zmax))).alias("z"), *_RANGES).select(*_at(F.col("z")))
    return (each.agg(F.avg(_tiles_of())).first()[0] or 0) > WIDE


def _thinned(bb: DataFrame, id_col: str, zmin: int, zmax: int, cap: int, folder: str) -> DataFrame:
    """``thin_tiles`` of zooms ``zmin..zmax``, in blocks.

    Below a tile that isn't crowded none is, so the features of a block go on only while it is; the tiles that they touch from there to
    ``zmax`` are cut out of their own ranges. Densities are those of all features, which their ranges tell.
    """
    spark, spans, cell = bb.sparkSession, _ranged(bb, [id_col], "__bb"), dict(zip(("sx", "sy"), _RANGES[4:]))
    own = dict(zip(_BLOCK, _at(F.col("z")))) | {
        s: F.call_function("shiftright", F.col(c), F.lit(LAST_ZOOM) - F.col("z")) for s, c in cell.items()}
    each = spans.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax)))).select("z", *[c.alias(name) for name, c in own.items()])
    dens = each.groupBy("z", "sx", "sy").agg(F.sum(_tiles_of()).alias("dens"))
    dens.write.mode("overwrite").parquet(f"{folder}/density")
    dens = spark.read.schema(dens.schema).parquet(f"{folder}/density")
    levels = []
    for z, frontier, full, _ in _divided(spans, zmin, zmax + 1, cap, folder):
        if z > zmax:
            break
        levels.append((z, frontier.withColumn("__tile", F.shiftleft("x", 32).bitwiseOR(F.col("y"))), full))

    # all zooms together, or each would be a few small jobs
    every = reduce(DataFrame.unionByName, [rows.withColumn("z", F.lit(z)) for z, rows, _ in levels])
    full = [found.select(F.lit(z).alias("z"), "__tile") for z, _, found in levels if found is not None]
    full = reduce(DataFrame.unionByName, full) if full else every.select("z", "__tile").limit(0)
    rest = every.join(full, ["z", "__tile"], "left_anti").withColumnRenamed("z", "__from")
    deeper = rest.withColumn("z", F.explode(F.sequence("__from", F.lit(zmax))))
    lift = lambda c: F.call_function("shiftleft", c, F.col("z") - F.col("__from"))
    cut = [F.least(own[c], lift(F.col(c) + 1) - 1) if c.endswith("2") else F.greatest(own[c], lift(F.col(c))) for c in _BLOCK]
    deeper = deeper.select(f"`{id_col}`", "z", *[x.alias(c) for c, x in zip(_BLOCK, cut)])
    crowded = every.join(full, ["z", "__tile"]).select(F.col(f"`{id_col}`").alias("__id"), "z", *_BLOCK, *[own[s].alias(s) for s in cell])
    return deeper.unionByName(_ranked(crowded.join(dens, ["z", "sx", "sy"]), cap).select(F.col("__id").alias(id_col), "z", *_BLOCK))


def refine_tiles(bb: DataFrame, id_cols: list[str], z: int, cap: int, folder: str, bbox_col: str = "__bb") -> DataFrame:
    """``(id..., z, x, y)`` of the quadtree below zoom ``z``.

    At every level the tiles of the frontier with more than ``cap`` features are thinned and divided (at ``LAST_ZOOM``
    kept whole); the rest of the frontier is complete. A feature goes on only into those of the four children that its extent touches,
    so a row becomes four at most, however large the feature. Each level that may be divided is written below ``folder``,
    so lost tasks repeat one level and nothing is decoded twice; the rows of ``LAST_ZOOM``, the most of all, are not. Levels are
    stored in blocks and counted out to tiles as the frame is read.
    """
    return reduce(DataFrame.unionByName, [_unfolded(made()) for _, made in _refined(bb, id_cols, z, cap, folder, bbox_col)])


def _file_ids(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the place of a row in the layer's files as one number, which orders rows as file and row do."""
    from featurespark.operators.query import FILE, ROW

    df = df.withColumns({"__file": F.col(FILE), "__row": F.col(ROW)})
    files = df.select("__file").distinct().withColumn("__no", F.row_number().over(Window.orderBy("__file")).cast("long"))
    return df.join(F.broadcast(files), "__file").withColumn(name, F.shiftleft("__no", 40).bitwiseOR(F.col("__row"))) \
        .drop("__file", "__row", "__no")


def _pyramid(df: DataFrame, epsg: int, id_col: str | None, zmin: int, zmax: int | None, cap: int, extend: bool,
             geom_col: str, refine: bool, folder: str | None, telling: dict[str, Column] | None = None,
             ) -> Iterator[tuple[int | None, Callable[[], DataFrame]]]:
    """``build_tiles`` in parts, as ``(zoom, what makes its frame)``; no zoom where the frame holds several."""
    from featurespark.functions.jsonfmt import json_object
    from featurespark.operators.query import has_file_order
    from featurespark.operators.spatial import extent_column
    from featurespark.session import checkpoint_dir

    schema, attrs = df.schema, [c for c in df.columns if c not in (geom_col, extent_column(df.schema))]
    if id_col is None:
        if not has_file_order(df):
            raise LayerQueryError("tiles of a derived layer need an id column")
        id_col = "__fid"
        df = _file_ids(df, id_col)
    spark = df.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/tiles-{uuid.uuid4().hex}"
    with_bbox_4326(df, epsg, geom_col).select(F.col(f"`{id_col}`"), "__bb").write.mode("overwrite").parquet(f"{folder}/extents")
    bb = spark.read.parquet(f"{folder}/extents")
    dec = df.withColumn("__g", wkb_decode(F.col(f"`{geom_col}`")))
    feats = dec.select(F.col(f"`{id_col}`"), json_object(schema, attrs).alias("feature"),
                       G.geojson(to_4326(F.col("__g"), epsg)).alias("geometry"))
    telling = telling or {c: F.col(c) for c in ("feature", "geometry")}
    feats = feats.select(F.col(f"`{id_col}`"), *[c.alias(f"__told_{name}") for name, c in telling.items()])
    if extend:               # every zoom takes its features from there
        feats.write.mode("overwrite").parquet(f"{folder}/features")
        feats = spark.read.parquet(f"{folder}/features")

    def told(tiles: DataFrame) -> DataFrame:
        # blocks are counted out after the join, which is of a row a block and feature
        rows = tiles.join(feats, id_col)
        rows = _unfolded(rows) if "x2" in tiles.columns else rows
        return rows.select("z", "x", "y", *[F.col(f"__told_{name}").alias(name) for name in telling])

    if zmax is None:
        zmax = guess_max_zoom(bb, cap, zmin=zmin).first()["zoom"]
    zmax = max(zmax, zmin)
    if extend and not refine:
        zmax = _top_zoom(bb, id_col, zmax, cap)
    thinned = zmax - 1 if extend else zmax
    if thinned >= zmin and extend and not refine and zmax <= LAST_ZOOM and _wide(bb, id_col, zmin, thinned):
        yield None, lambda: told(_thinned(bb, id_col, zmin, thinned, cap, folder))
    elif thinned >= zmin:
        yield None, lambda: told(thin_tiles(assign_tiles(bb, [id_col], zmin, thinned), id_col, cap))
    if extend and refine:
        for z, made in _refined(bb, [id_col], zmax, cap, folder):
            yield z, lambda made=made: told(made())
    elif extend and zmax <= LAST_ZOOM:
        top = _ranged(bb, [id_col], "__bb").select(f"`{id_col}`", F.lit(zmax).alias("z"), *_at(zmax))
        n_tiles = top.agg(F.sum(_tiles_of())).first()[0] or 0
        yield zmax, lambda: told(_dealt(top, [id_col], n_tiles))
    elif extend:
        yield zmax, lambda: told(assign_tiles(bb, [id_col], zmax, zmax))


def build_tiles(df: DataFrame, epsg: int, id_col: str | None = None, zmin: int = 0,
                zmax: int | None = None, cap: int = DEFAULT_CAP, extend: bool = True,
                geom_col: str = "geometry", refine: bool = False, folder: str | None = None,
                telling: dict[str, Column] | None = None) -> DataFrame:
    """``(z, x, y, feature, geometry)`` tile table of a layer.

    ``feature`` is the feature's JSON properties; ``geometry`` its GeoJSON in
    EPSG:4326. Features are told apart by ``id_col`` or else by their place in the layer's
    files. With ``extend`` the top zoom holds every feature; without, it is thinned as well. With ``refine`` only the
    tiles of the top zoom that drop features are extended. Extents are decoded once, into ``folder``, where
    levels are written too; the caller removes it when the frame has been used (default: a folder of its own in the
    checkpoint folder). ``telling`` names other columns than ``feature`` and ``geometry`` and says how they follow from these: they are
    computed for each feature, not for each of its tiles.
    """
    parts = _pyramid(df, epsg, id_col, zmin, zmax, cap, extend, geom_col, refine, folder, telling)
    return reduce(DataFrame.unionByName, [made() for _, made in parts])


def write_tiles(df: DataFrame, epsg: int, target: str, id_col: str | None = None, zmin: int = 0, zmax: int | None = None,
                cap: int = DEFAULT_CAP, extend: bool = True, geom_col: str = "geometry", refine: bool = False,
                folder: str | None = None) -> None:
    """The rows of ``build_tiles`` as ``<target>/z=<zoom>``, a job a zoom: rows with their texts are never sorted by zoom. A zoom is
    written while the next ones are divided, and its level then removed."""
    from featurespark.session import checkpoint_dir
    from featurespark.sources.manifest import _fs

    folder = folder or f"{checkpoint_dir(df.sparkSession)}/tiles-{uuid.uuid4().hex}"

    def write(z: int | None, made: Callable[[], DataFrame]) -> None:
        # a feature's text is stored once a row group, by its number in the rows, however many they are
        if z is None:        # appends, as do the others: they share the folder
            made().write.mode("append").partitionBy("z").option("parquet.dictionary.page.size", TEXTS).parquet(target)
        else:
            made().drop("z").write.mode("overwrite").option("parquet.dictionary.page.size", TEXTS).parquet(f"{target}/z={z}")

    def removed(before: int) -> None:
        for z in [z for z, job in jobs.items() if z is not None and z < before and job.done()]:
            fs, done = _fs(df.sparkSession, f"{folder}/z{z}")
            fs.delete(done, True)

    jobs: dict = {}
    with ThreadPoolExecutor(ZOOMS_AT_ONCE) as pool:
        for z, made in _pyramid(df, epsg, id_col, zmin, zmax, cap, extend, geom_col, refine, folder):
            jobs[z] = pool.submit(write, z, made)
            if z is not None:
                removed(z - 1)       # the last zoom is divided from the level before as it is written
        for job in jobs.values():
            job.result()
