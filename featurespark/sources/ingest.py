"""Batch ingest: uploaded feature datasets -> layers, GeoJSON exports, tiles.

Upload tree (any Hadoop-FS URI)::

    <uploads>/.../<dataset>.gdb/<layer>.geojsonl   newline-delimited GeoJSON features
    <uploads>/.../<dataset>.gdb/<layer>.parquet    a WKB geometry column (+ attributes)
    <uploads>/.../config.json                      layer registry, uploaded last

Steps (A7-A15, K4): list uploads -> discover datasets (directories ending
``.gdb``, any case, any depth) -> candidate layer files -> decide which have
geometry -> write every layer of the run below ``<out>/runs/<run>/`` (attributes +
extent + WKB, CRS in the column metadata and in a sidecar file), with its statistics, the
EPSG:4326 export and the tile table if wanted, the registry, the summary and the upload ledger -> commit -> delete
the sources that the ledger calls consumed.

A commit is the creation of the next version of the log (``manifest.py``), which says which
run's files are each layer's current ones, which registry holds, which upload markers are done and which
runs there were. Readers follow it, so they see all of a run or nothing of it; files
of older runs stay until ``remove_unpublished``. A run that fails in any
layer commits nothing and deletes nothing. A run that finds another one's commit of the same uploads drops its own work and starts
over with a new listing; runs over other uploads are merged. Whatever a lost driver leaves undone after its commit, the copy
of the registry and the clean-up, the next run or batch does first.

The ledger has a row for every uploaded file and version: the layer that consumed it, or why none did. Only consumed
files are deleted, and only while they are the version that was listed: an unknown file, a layer without geometry
and whatever was uploaded during the run stay.

Layers of one name in two datasets are an
error unless ``overwrite_duplicates`` is set (V6): then the last dataset by path
wins, which is settled before anything is written.

A layer's coordinates are in the CRS that it states: Parquet in the column metadata or
the ``geo`` footer, GeoJSON always EPSG:4326. Layers that state none take
``source_epsg``; without that they fail.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark import params
from featurespark.errors import LayerQueryError
from featurespark.functions import geometry as G
from featurespark.functions.crs import to_4326
from featurespark.functions.wkb import wkb_decode, wkb_extent
from featurespark.sources.manifest import (EMPTY, _fs, commit, literal_path, read_manifest, read_text, replace_file,
                                           trim_log)
from featurespark.sources.statistics import STATISTICS, write_statistics

# --- fixed values: reference pipeline defaults ---
DATASET_SUFFIX = ".gdb"
CONFIG_NAME = "config.json"
LAYER_EXTENSIONS = ("geojsonl", "parquet")
DELETE_BATCH = 1000
# ---------------------------------------------------

LAYERS_AT_ONCE = 4       # layers whose jobs are submitted together
KEPT_OF_RUNS = ("_summary", "_ledger", "_replaced")      # the log of a run whose layers are others' by now
ROW_GROUP = 16 << 20     # bytes of a row group of a stored layer, the least that a scan can pass over
FILE_ROWS = 1 << 20      # rows of a file of a stored layer, what a page in file order reads
CURVE_BITS = 16          # of each axis
NEW_STARTS = 5           # of a run whose uploads other runs took meanwhile

REGISTRY_SCHEMA = T.StructType([T.StructField("layers", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("visibleByDefault", T.BooleanType()), T.StructField("opacity", T.DoubleType()),
    T.StructField("color", T.StringType())])))])


@dataclass
class IngestOptions:
    uploads: str
    output: str
    source_epsg: int | None = None      # of layers that state no CRS
    make_geojson: bool = True
    make_tiles: bool = True
    tile_args: dict = field(default_factory=dict)
    delete_sources: bool = True
    overwrite_duplicates: bool = False
    dataset_suffix: str = DATASET_SUFFIX
    cluster_bytes: int = 32 << 20       # layers uploaded with at least so many bytes are clustered by place


# -- A7: listing --------------------------------------------------------------------
def list_uploads(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root`` (recursive) as ``(path, length, modificationTime)``.

    The ``binaryFile`` source with only metadata columns selected lists files
    without reading their bytes. Folders are listed by tasks, one level after the other, not by the driver; hidden files (``_x``, ``.x``)
    are not listed.
    """
    where = "spark.sql.sources.parallelPartitionDiscovery.threshold"
    before = spark.conf.get(where)
    spark.conf.set(where, "0")
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.set(where, before)
    return found.select("path", "length", "modificationTime").where(~F.col("path").endswith("/"))


# -- A8: datasets ------------------------------------------------------------------
def find_datasets(listing: DataFrame, suffix: str = DATASET_SUFFIX) -> DataFrame:
    """``(dataset_path, dataset)``: every ancestor directory ending ``suffix`` (any case)."""
    segs = F.split(F.col("path"), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segs) - 1),
                           lambda i: F.array_join(F.slice(segs, 1, i), "/"))
    d = listing.select(F.explode(prefixes).alias("dataset_path")) \
        .where(F.lower(F.col("dataset_path")).endswith(suffix.lower())).distinct()
    name = F.regexp_extract("dataset_path", r"([^/]+)$", 1)
    return d.select("dataset_path",
                    F.regexp_replace(name, "(?i)" + re.escape(suffix) + "$", "").alias("dataset"))


def upload_files(listing: DataFrame, suffix: str = DATASET_SUFFIX) -> DataFrame:
    """Every upload with the dataset and the entry that it belongs to.

    Adds ``dataset``, ``entry`` (what lies directly in the innermost dataset folder: the file itself, or the folder it
    is in at whatever depth), ``layer`` and ``format`` to the listing; nulls outside datasets. ``format`` is null where
    the extension is none of ``LAYER_EXTENSIONS``.
    """
    segs = F.split(F.col("path"), "/")
    depth = F.array_max(F.filter(F.sequence(F.lit(1), F.size(segs) - 1),
                                 lambda i: F.lower(F.element_at(segs, i.cast("int"))).endswith(suffix.lower())))
    f = listing.withColumns({"__segs": segs, "__depth": depth.cast("int")})
    name, base = F.element_at("__segs", F.col("__depth")), F.element_at("__segs", F.col("__depth") + 1)
    form = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    return f.withColumns({
        "dataset": F.regexp_replace(name, "(?i)" + re.escape(suffix) + "$", ""),
        "entry": F.when(F.col("__depth").isNotNull(), F.array_join(F.slice("__segs", F.lit(1), F.col("__depth") + 1), "/")),
        "layer": F.when(form.isin(*LAYER_EXTENSIONS), F.regexp_extract(base, r"^(.*)\.[^.]+$", 1)),
        "format": F.when(form.isin(*LAYER_EXTENSIONS), form)}).drop("__segs", "__depth")


def layer_files(listing: DataFrame, suffix: str = DATASET_SUFFIX) -> DataFrame:
    """Entries of dataset folders with a layer extension: ``(dataset, layer, path, format)``.

    An entry is a file, or a folder of part files, partitioned or not, written by a distributed writer.
    """
    return upload_files(listing, suffix).where(F.col("format").isNotNull()) \
        .select("dataset", "layer", F.col("entry").alias("path"), "format").distinct()


# -- A9: spatial layers ---------------------------------------------------------------
def spatial_layers(spark: SparkSession, candidates: DataFrame) -> DataFrame:
    """``(dataset, layer, path, format, has_geometry)`` for every candidate.

    A GeoJSON layer is spatial if any feature has a geometry, which a partial aggregate of its own
    lines tells; a Parquet layer if its footer has a geometry column.
    """
    found = None
    for r in candidates.orderBy("path").collect():       # a row for each layer: the catalogue, not data
        if r["format"] == "parquet":
            known = bool(geometry_column(spark.read.parquet(literal_path(r["path"])).schema))
            one = spark.range(1).select(F.lit(known).alias("has_geometry"))
        else:
            one = spark.read.text(literal_path(r["path"])).agg(F.coalesce(F.bool_or(
                F.get_json_object("value", "$.geometry.type").isNotNull()), F.lit(False)).alias("has_geometry"))
        row = one.select(*[F.lit(r[c]).alias(c) for c in ("dataset", "layer", "path", "format")], "has_geometry")
        found = row if found is None else found.unionByName(row)
    return found if found is not None else spark.createDataFrame(
        [], "dataset string, layer string, path string, format string, has_geometry boolean")


def geometry_column(schema: T.StructType) -> str | None:
    """The geometry column: a known name that holds bytes, else the first column of bytes."""
    binary = [f.name for f in schema.fields if isinstance(f.dataType, T.BinaryType)]
    named = [n for n in binary if n.lower() in params.GEOMETRY_NAMES]
    return (named or binary or [None])[0]


# -- A10: layer frames -------------------------------------------------------------------
def _geojson_to_wkb():
    from pyspark.sql.functions import arrow_udf

    from featurespark.functions.stsql import _from_geojson

    def run(a: pa.Array) -> pa.Array:
        return pa.array([_from_geojson(v) for v in a.to_pylist()], type=pa.binary())

    return arrow_udf(run, T.BinaryType())


def read_layer(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A layer file as attributes and one WKB geometry column.

    The properties' schema is inferred by Spark's JSON reader. A line that is no GeoJSON feature
    makes the job that reads the frame fail: a damaged upload is never half a layer.
    """
    where = literal_path(path)
    if fmt == "parquet":
        return spark.read.parquet(where)
    inferred = spark.read.json(where).schema
    props = next((f.dataType for f in inferred.fields if f.name == "properties"), None)
    props = props if isinstance(props, T.StructType) else T.StructType([])
    schema = T.StructType([T.StructField("type", T.StringType()), T.StructField("geometry", T.StringType()),
                           *([T.StructField("properties", props)] if props.fields else []),
                           T.StructField("__bad", T.StringType())])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "__bad").json(where)
    bad = F.col("__bad").isNotNull() | ~F.col("type").eqNullSafe(F.lit("Feature"))
    geometry = F.when(bad, F.raise_error(F.concat(F.lit(f"not a GeoJSON feature in {path}: "), F.substring(
        F.coalesce("__bad", "geometry", F.lit("")), 1, 200))).cast("string")).otherwise(F.col("geometry"))
    name = next(n for n in ("geometry", "geom", "the_geom", "wkb_geometry", "shape") if n not in props.names)
    return rows.select(*[F.col("properties")[f].alias(f) for f in props.names],
                       _geojson_to_wkb()(geometry).alias(name))


def stated_epsg(spark: SparkSession, df: DataFrame, geom_col: str, path: str, fmt: str) -> int | None:
    """The EPSG code that a layer states: column metadata, then the ``geo`` footer; GeoJSON is 4326."""
    if fmt != "parquet":
        return 4326
    stated = df.schema[geom_col].metadata.get("crs")
    if stated is None:
        files = df.select("_metadata.file_path").limit(1).collect()
        geo = _geo_footer(spark, files[0][0]) if files else None
        if geo is not None:
            column = geo.get("columns", {}).get(geom_col, {})
            if "crs" not in column:
                return 4326                                   # the format's default, longitude and latitude
            ident = (column["crs"] or {}).get("id") or {}
            stated = f"{ident.get('authority')}:{ident.get('code')}"
    if stated is None:
        return None
    m = re.fullmatch(r"(?i)(?:epsg|ogc):(\d+|crs84)", str(stated))
    if not m:
        raise LayerQueryError(f"{path}: CRS {stated!r} has no EPSG code")
    return 4326 if m[1].lower() == "crs84" else int(m[1])


def _geo_footer(spark: SparkSession, file: str) -> dict | None:
    """The GeoParquet metadata of one file, read from its footer."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
    try:
        text = reader.getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(text) if text else None


def with_bbox(df: DataFrame, geom_col: str = "geometry") -> DataFrame:
    """Add the extent of the geometry as a covering column, under a name that no attribute has."""
    from featurespark.operators.spatial import extent_column

    if extent_column(df.schema):
        return df
    name = next(n for n in ("bbox", *(f"bbox_{i}" for i in range(1, 1000))) if n not in df.columns)
    return df.withColumn(name, wkb_extent(F.col(f"`{geom_col}`"))).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col(name).alias(name, metadata={"covering": geom_col}))


def _spread(v):
    """The low ``CURVE_BITS`` bits of a number with a zero bit after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve_key(box, x0: float, y0: float, x1: float, y1: float):
    """The place of an extent's centre on the Z-order curve over the rectangle; null for a null extent."""
    def step(low, high, a, b):
        part = ((low + high) / 2 - a) / (b - a) if b > a else F.lit(0.0) * low
        cell = F.least(F.greatest(F.floor(part * (1 << CURVE_BITS)), F.lit(0)), F.lit((1 << CURVE_BITS) - 1))
        return F.when(part.isNotNull(), cell)

    return _spread(step(box["xmin"], box["xmax"], x0, x1)).bitwiseOR(
        F.shiftleft(_spread(step(box["ymin"], box["ymax"], y0, y1)), 1))


def clustered(df: DataFrame) -> DataFrame:
    """A stored frame dealt and sorted along the Z-order curve over its extent, so that a scan for a box passes over most files and
    row groups, whose stored extents are then small. One aggregate over the extents runs first."""
    from featurespark.operators.spatial import extent, extent_column

    bounds = extent(df).first()
    if bounds["xmin"] is None:
        return df
    key = curve_key(F.col(f"`{extent_column(df.schema)}`"), *[bounds[c] for c in ("xmin", "ymin", "xmax", "ymax")])
    return df.withColumn("__curve", key).repartitionByRange("__curve").sortWithinPartitions("__curve").drop("__curve")


def geo_metadata(epsg: int) -> dict:
    return {"encoding": "WKB", "crs": f"EPSG:{epsg}"}


def write_layer(df: DataFrame, layer: str, epsg: int, folder: str, geom_col: str = "geometry") -> str:
    """A10: write ``<folder>/<layer>.parquet``; CRS and encoding are in the column metadata and a sidecar.

    Spark's writer takes no footer keys of its own, so the GeoParquet metadata is the sidecar
    ``<layer>.parquet.geo.json``.
    """
    from featurespark.operators.spatial import extent_column

    cover = extent_column(df.schema)
    marks = {geom_col: geo_metadata(epsg), cover: {"covering": geom_col}}
    cols = [F.col(f"`{c}`").alias(c, metadata=marks[c]) if c in marks else F.col(f"`{c}`") for c in df.columns]
    target = f"{folder}/{layer}.parquet"
    df.select(*cols).write.option("parquet.block.size", ROW_GROUP).option("maxRecordsPerFile", FILE_ROWS) \
        .mode("overwrite").parquet(target)
    box = {k: [cover, k] for k in ("xmin", "ymin", "xmax", "ymax")}
    geo = {"version": "1.1.0", "primary_column": geom_col, "columns": {geom_col: {
        "encoding": "WKB", "geometry_types": [], "crs": {"id": {"authority": "EPSG", "code": epsg}},
        "covering": {"bbox": box}}}}
    replace_file(df.sparkSession, f"{target}.geo.json", json.dumps(geo))
    return target


def export_geojson(df: DataFrame, epsg: int, target: str, geom_col: str = "geometry") -> str:
    """Newline-delimited GeoJSON features in EPSG:4326 (one feature per line)."""
    from featurespark.functions.jsonfmt import json_object
    from featurespark.operators.spatial import extent_column

    attrs = [c for c in df.columns if c not in (geom_col, extent_column(df.schema))]
    dec = df.withColumn("__g", wkb_decode(F.col(f"`{geom_col}`")))
    g4326 = to_4326(F.col("__g"), epsg)
    text = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(G.geojson(g4326), F.lit("null")),
                    F.lit(',"properties":'), json_object(df.schema, attrs), F.lit("}"))
    dec.select(text.alias("value")).write.mode("overwrite").text(target)
    return target


# -- A13/A14/B10: registry ----------------------------------------------------------------
def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, id, label, visibleByDefault, opacity, color)``; array order kept."""
    cfg = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", "true").json(path)
    return cfg.select(F.posexplode("layers").alias("pos", "l")).select(
        (F.col("pos") + 1).cast("long").alias("pos"), "l.id", "l.label", "l.visibleByDefault",
        "l.opacity", "l.color")


def published_registry(spark: SparkSession, output: str) -> DataFrame:
    """The registry of the published state; the copy beside the layers may be that of an older one."""
    out = output.rstrip("/")
    at = (read_manifest(spark, out) or EMPTY)["registry"]
    if at is None:
        return spark.createDataFrame([], "pos long, id string, label string, visibleByDefault boolean, opacity double, color string")
    return read_registry(spark, f"{out}/{at}")


def visible_layers(registry: DataFrame) -> DataFrame:
    """Layers shown at start, in drawing order."""
    return registry.where(F.col("visibleByDefault"))


def registry_check(registry: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Registry ids with their catalogue status (``has_layer``)."""
    cat = catalogue.select(F.col("layer").alias("id"), F.lit(True).alias("has_layer"))
    return registry.join(cat, "id", "left").select(
        "pos", "id", F.coalesce("has_layer", F.lit(False)).alias("has_layer"))


# -- K4: the job ----------------------------------------------------------------------------
def delete_paths(spark: SparkSession, files, at_once: int = 16) -> list[str]:
    """Delete the listed versions of source files, in batches of 1000, one call a file and several together.

    ``files`` may be any iterable of ``(path, length, modified)``; with ``DataFrame.toLocalIterator()`` the
    ledger streams one partition at a time, so the driver never holds all of it. A file that is gone already counts as
    deleted. One with another length or modification time was uploaded anew: it stays and is returned. Raises if any
    listed version is left.
    """
    def gone(f) -> bool | None:
        path, length, modified = f
        fs, hp = _fs(spark, path)
        if not fs.exists(hp):
            return True
        st = fs.getFileStatus(hp)
        if (st.getLen(), st.getModificationTime()) != (length, modified):
            return None
        return fs.delete(hp, False) or not fs.exists(hp)

    failed, newer = 0, []
    batch: list[tuple] = []
    with ThreadPoolExecutor(at_once) as pool:
        def flush():
            nonlocal failed
            for f, ok in zip(batch, pool.map(gone, batch)):
                failed += ok is False
                if ok is None:
                    newer.append(f[0])
            batch.clear()

        for f in files:
            batch.append(tuple(f))
            if len(batch) >= DELETE_BATCH:
                flush()
        flush()
    if failed:
        raise RuntimeError(f"failed to delete {failed} source object(s)")
    return newer


SUMMARY_SCHEMA = "dataset string, layer string, rows long, outputs array<string>, status string"
LEDGER_SCHEMA = "path string, length long, modified long, dataset string, layer string, consumed boolean, reason string"


def _convert(s: SparkSession, opts: IngestOptions, r, folder: str, size: int) -> tuple:
    """Write one layer of a run, uploaded with ``size`` bytes, below ``folder``; its files relative to the run, and its statistics."""
    df = read_layer(s, r["path"], r["format"])
    geom = geometry_column(df.schema)
    epsg = stated_epsg(s, df, geom, r["path"], r["format"]) or opts.source_epsg
    if epsg is None:
        raise LayerQueryError(f"{r['path']} states no CRS; give source_epsg")
    files = {"layers": f"{r['layer']}.parquet"}
    boxed, staged = with_bbox(df, geom), None
    if size >= opts.cluster_bytes:       # decoded once, before it is dealt anew
        staged = f"{folder}/_staged/{r['layer']}"
        boxed.write.mode("overwrite").parquet(staged)
        boxed = clustered(s.read.parquet(literal_path(staged)))
    written = s.read.parquet(literal_path(write_layer(boxed, r["layer"], epsg, folder, geom)))
    if staged:
        fs, done = _fs(s, staged)
        fs.delete(done, True)
    facts = write_statistics(written, f"{folder}/{STATISTICS}/{r['layer']}")
    if opts.make_geojson:
        files["geojson"] = f"geojson/{r['layer']}"
        export_geojson(written, epsg, f"{folder}/{files['geojson']}", geom)
    if opts.make_tiles:
        from featurespark.operators.tiles import write_tiles

        files["tiles"] = f"tiles/{r['layer']}"
        work = f"{folder}/_tiles/{r['layer']}"
        write_tiles(written, epsg, f"{folder}/{files['tiles']}", geom_col=geom, folder=work, **{"refine": True, **opts.tile_args})
        fs, done = _fs(s, work)
        fs.delete(done, True)
    return files, facts


def run_ingest(spark: SparkSession, opts: IngestOptions) -> DataFrame:
    """K4: run the whole ingest; returns the per-layer summary DataFrame.

    If it fails, or finds its uploads taken, after another run committed, it starts over with what is there then.
    """
    from featurespark.session import checkpoint_dir, query_session

    s, out = query_session(spark), opts.output.rstrip("/")
    for turn in range(NEW_STARTS):
        finish_runs(s, opts)
        base = (read_manifest(s, out) or EMPTY)["version"]
        scratch = f"{checkpoint_dir(s)}/uploads-{uuid.uuid4().hex}"
        try:
            # written, as a listing looks again at every file when it is evaluated again: this one states what the run took
            list_uploads(s, opts.uploads).write.parquet(scratch)
            result = _run(s, opts, s.read.parquet(scratch), base)
            break
        except Exception:
            if turn + 1 == NEW_STARTS or (read_manifest(s, out) or EMPTY)["version"] == base:
                raise
        finally:
            fs, folder = _fs(s, scratch)
            fs.delete(folder, True)
    finish_runs(s, opts)     # S28: only after everything above succeeded
    return result


def _run(s: SparkSession, opts: IngestOptions, listing: DataFrame, base: int) -> DataFrame:
    if listing.isEmpty():   # S29: nothing uploaded
        return s.createDataFrame([], SUMMARY_SCHEMA)
    out = opts.output.rstrip("/")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    markers = listing.where(name == CONFIG_NAME).orderBy("path").select(
        "path", F.unix_millis("modificationTime").alias("at")).collect()
    files = upload_files(listing, opts.dataset_suffix)
    rows = spatial_layers(s, layer_files(listing, opts.dataset_suffix)).orderBy("path").collect()
    kept = [r for r in rows if r["has_geometry"]]
    summary = [(r["dataset"], r["layer"], 0, [], "skipped: no geometry") for r in rows if not r["has_geometry"]]
    unknown = files.where(F.col("entry").isNotNull() & F.col("format").isNull() & (name != CONFIG_NAME)) \
        .select("dataset", F.regexp_extract("entry", r"([^/]+)$", 1)).distinct().orderBy("dataset").collect()
    summary += [(d, e, 0, [], "skipped: unknown format") for d, e in unknown]
    winner = {r["layer"]: r for r in kept}               # the last by path, as a later one overwrites
    lost = [r for r in kept if winner[r["layer"]] is not r]
    if lost and not opts.overwrite_duplicates:
        raise LayerQueryError(f"layer names used by more than one dataset: {sorted({r['layer'] for r in lost})}")
    replaced = {r["path"]: f"replaced by {winner[r['layer']]['dataset']}" for r in lost}
    summary += [(r["dataset"], r["layer"], 0, [], f"skipped: {replaced[r['path']]}") for r in lost]
    if not kept:   # S29: nothing to convert -> no publish, no delete
        return s.createDataFrame(summary, SUMMARY_SCHEMA)

    sizes = {e: n for e, n in files.where("format is not null").groupBy("entry").agg(F.sum("length")).collect()}
    run = uuid.uuid4().hex
    folder = f"{out}/runs/{run}"
    chosen = list(winner.values())
    with ThreadPoolExecutor(LAYERS_AT_ONCE) as pool:
        done = list(pool.map(lambda r: _attempt(s, opts, r, folder, sizes[r["path"]]), chosen))
    failures = [f"{r['dataset']}/{r['layer']}: {d}" for r, d in zip(chosen, done) if isinstance(d, Exception)]
    if failures:             # S28: nothing published, nothing deleted
        raise RuntimeError("ingest failed, nothing was published or deleted: " + "; ".join(failures))
    summary += [(r["dataset"], r["layer"], int(facts["rows"]), [f"{folder}/{f}" for f in made.values()], "ok")
                for r, (made, facts) in zip(chosen, done)]
    result = s.createDataFrame(summary, SUMMARY_SCHEMA)
    result.write.parquet(f"{folder}/_summary")           # kept with the run, before any source goes
    taken = [(r["path"], True, replaced.get(r["path"], "converted")) for r in kept]
    taken += [(r["path"], False, "no geometry") for r in rows if not r["has_geometry"]]
    write_ledger(s, files, taken, [m["path"] for m in markers], f"{folder}/_ledger")
    registry = None
    if markers:              # S30: the first file named exactly config.json
        text = read_text(s, markers[0]["path"])
        json.loads(text)     # refuse to publish a broken registry
        registry = f"runs/{run}/{CONFIG_NAME}"
        replace_file(s, f"{out}/{registry}", text)

    entries = [r["path"] for r in kept] + [m["path"] for m in markers]

    def change(state: dict) -> dict:
        for r, (made, facts) in zip(chosen, done):
            for kind in ("layers", "geojson", "tiles"):      # what this run did not make is not left over from another
                state[kind].pop(r["layer"], None)
                if kind in made:
                    state[kind][r["layer"]] = f"runs/{run}/{made[kind]}"
            state["facts"][r["layer"]] = facts | {"statistics": f"runs/{run}/{STATISTICS}/{r['layer']}"}
        state["registry"] = registry or state["registry"]
        state["runs"].append(run)
        state["uncleaned"].append([run, opts.delete_sources])
        state["markers"].update({m["path"]: m["at"] for m in markers})
        return state | {"commit": {"run": run, "entries": entries}}

    # runs that took none of these uploads are no conflict
    commit(s, out, change, base, lambda other: not set(other.get("entries", [])) & set(entries))
    return result


def write_ledger(s: SparkSession, files: DataFrame, taken: list[tuple], markers: list[str], path: str) -> None:
    """A row for every uploaded file: which layer consumed it, or why none did."""
    known = s.createDataFrame(taken, "entry string, consumed boolean, reason string")
    marker = F.col("path").isin(markers)
    why = F.when(marker, "marker").when(F.col("entry").isNull(), "not in a dataset").otherwise(
        F.coalesce("reason", F.lit("unknown format")))
    ledger = files.join(F.broadcast(known), "entry", "left").select(
        "path", "length", F.unix_millis("modificationTime").alias("modified"), "dataset", "layer",
        (marker | F.coalesce("consumed", F.lit(False))).alias("consumed"), why.alias("reason"))
    ledger.write.parquet(path)


def upload_ledger(spark: SparkSession, output: str) -> DataFrame:
    """The ledgers of all runs: ``LEDGER_SCHEMA`` with ``run``, and ``replaced``: of consumed files, whether a newer upload
    was found at the clean-up, and left (null where a run has not been cleaned up)."""
    out = output.rstrip("/")
    manifest = read_manifest(spark, out) or EMPTY
    open_runs = {r for r, _ in manifest["uncleaned"]}
    ledger = spark.createDataFrame([], LEDGER_SCHEMA + ", run string, replaced boolean")
    for run in manifest["runs"]:
        one = spark.read.parquet(f"{out}/runs/{run}/_ledger").withColumn("run", F.lit(run))
        if run in open_runs:
            one = one.withColumn("replaced", F.lit(None).cast("boolean"))
        else:
            newer = spark.read.schema("path string").parquet(f"{out}/runs/{run}/_replaced").select("path", F.lit(True).alias("replaced"))
            one = one.join(newer, "path", "left").withColumn("replaced", F.coalesce("replaced", F.lit(False)))
        ledger = ledger.unionByName(one)
    return ledger


def finish_runs(s: SparkSession, opts: IngestOptions) -> None:
    """What follows a commit, for every run that has not got it yet: the copy of the registry for map clients, the
    clean-up by the ledger, and the note in the log that both are done. Each step may be repeated."""
    out = opts.output.rstrip("/")
    manifest = read_manifest(s, out)
    if manifest is None or not manifest["uncleaned"]:
        return
    if manifest["registry"]:
        replace_file(s, f"{out}/{CONFIG_NAME}", read_text(s, f"{out}/{manifest['registry']}"))
    for run, delete in manifest["uncleaned"]:
        newer = []
        if delete:
            ledger = s.read.parquet(f"{out}/runs/{run}/_ledger").where("consumed").select("path", "length", "modified")
            newer = delete_paths(s, ledger.toLocalIterator())
        s.createDataFrame([(p,) for p in newer], "path string").write.mode("overwrite").parquet(f"{out}/runs/{run}/_replaced")
    finished = [r for r, _ in manifest["uncleaned"]]

    def change(state: dict) -> dict:
        return state | {"uncleaned": [u for u in state["uncleaned"] if u[0] not in finished], "commit": {"cleaned": finished}}

    commit(s, out, change)
    trim_log(s, out)


def _attempt(s, opts, r, folder, size):
    try:
        return _convert(s, opts, r, folder, size)
    except Exception as exc:        # reported with its layer; the others of the run still show theirs
        return exc


def run_log(spark: SparkSession, output: str) -> DataFrame:
    """Summaries of all published runs: ``SUMMARY_SCHEMA`` with ``run`` and its number ``epoch`` from 0."""
    manifest = read_manifest(spark, output.rstrip("/")) or {"runs": []}
    log = spark.createDataFrame([], SUMMARY_SCHEMA + ", run string, epoch long")
    for i, run in enumerate(manifest["runs"]):
        one = spark.read.parquet(f"{output.rstrip('/')}/runs/{run}/_summary")
        log = log.unionByName(one.withColumns({"run": F.lit(run), "epoch": F.lit(i).cast("long")}))
    return log


def pending_markers(spark: SparkSession, opts: IngestOptions) -> list[tuple[str, int]]:
    """Markers whose upload (path and time) no published run has taken yet."""
    done = (read_manifest(spark, opts.output.rstrip("/")) or EMPTY)["markers"]
    fs, root = _fs(spark, opts.uploads)
    if not fs.exists(root):
        return []
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    found = list_uploads(spark, opts.uploads).where(base == CONFIG_NAME).select(
        "path", F.unix_millis("modificationTime").alias("at")).collect()
    return [(r["path"], r["at"]) for r in found if done.get(r["path"]) != r["at"]]


def unfinished_runs(spark: SparkSession, opts: IngestOptions) -> bool:
    """Whether a committed run has not been cleaned up."""
    return bool((read_manifest(spark, opts.output.rstrip("/")) or EMPTY)["uncleaned"])


def remove_unpublished(spark: SparkSession, output: str) -> int:
    """Delete run folders that no layer, export or tile table of the manifest uses; the run log keeps its own."""
    out = output.rstrip("/")
    manifest = read_manifest(spark, out)
    fs, root = _fs(spark, f"{out}/runs")
    if manifest is None or not fs.exists(root):
        return 0
    used = {p.split("/")[1] for kind in ("layers", "geojson", "tiles") for p in manifest[kind].values()}
    used |= {manifest["registry"].split("/")[1]} if manifest["registry"] else set()
    n = 0
    for st in fs.listStatus(root):
        if st.getPath().getName() not in used | set(manifest["runs"][-1:]):
            for part in fs.listStatus(st.getPath()):
                if part.getPath().getName() not in KEPT_OF_RUNS:
                    n += bool(fs.delete(part.getPath(), True))
    return n
