"""Layer catalogue: list, validate, describe and scan layers.

A layer is one ``<name>.parquet`` entry (a file, or a directory written by
Spark) directly under a root URI. Any Hadoop-FS URI works; listing is a
metadata call, schema comes from Parquet footers, and counts are
answered from footers by V2 scans with aggregate push-down, which emit a row a file. Under a root that
ingest publishes, the manifest says where each layer's current files are, and its facts (schema, rows, extent)
answer without reading any file.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark import params
from featurespark.errors import LayerQueryError
from featurespark.functions.types import type_name
from featurespark.session import count_session, query_session
from featurespark.sources.manifest import literal_path, read_manifest

SUFFIX = ".parquet"
FOOTERS_AT_ONCE = 8      # layers whose footers are asked for their schema together

COLUMNS_SCHEMA = T.StructType([
    T.StructField("layer", T.StringType(), False),
    T.StructField("pos", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("nullable", T.BooleanType(), False),
    T.StructField("is_geometry", T.BooleanType(), False),
])


def layer_entries(spark: SparkSession, root: str) -> dict[str, int]:
    """Stems of the ``*.parquet`` entries directly under root, with their modification times."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, int] = {}
    for st in fs.listStatus(path) if fs.exists(path) else []:
        name = st.getPath().getName()
        if name.endswith(SUFFIX) and len(name) > len(SUFFIX):
            found[name[: -len(SUFFIX)]] = st.getModificationTime()
    return found


def geometry_fields(schema: T.StructType) -> list[str]:
    return params.Columns(schema).geometry


class Layers:
    """The catalogue of layers under ``root`` (plus optional derived layers).

    The root is listed on every call, so layers that land or change meanwhile are
    seen; a schema is read again when its entry has changed.

    >>> layers = Layers(spark, "/data/layers")
    >>> layers.query("parcels", where='"AREA_HA" > 10', order_by="AREA_HA DESC").df
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.base = spark
        self.spark = query_session(spark)
        self.root = root.rstrip("/") if root else None
        self._schemas: dict[tuple, T.StructType] = {}
        self._derived: dict[str, DataFrame] = {}

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "Layers":
        return cls(spark, root)

    # -- catalogue -------------------------------------------------------
    def _state(self) -> tuple[dict[str, tuple[str, int]], dict[str, dict]]:
        """Path below the root and change stamp of every stored layer, and the facts of those that ingest published."""
        if not self.root:
            return {}, {}
        manifest = read_manifest(self.spark, self.root)
        if manifest is not None:          # a run's files never change
            return {n: (p, 0) for n, p in manifest["layers"].items()}, manifest["facts"]
        return {n: (n + SUFFIX, at) for n, at in layer_entries(self.spark, self.root).items()}, {}

    def _entries(self) -> dict[str, tuple[str, int]]:
        return self._state()[0]

    def facts(self, layer: str) -> dict | None:
        """Schema, rows, files and extent of a layer that ingest published; None for other layers."""
        return None if layer in self._derived else self._state()[1].get(layer)

    def statistics_df(self, layer: str) -> DataFrame | None:
        """The statistics table of a published layer, a row a file."""
        facts = self.facts(self.validate(layer))
        return self.spark.read.parquet(literal_path(f"{self.root}/{facts['statistics']}")) if facts else None

    def file_rows(self, layer: str) -> dict[str, int] | None:
        """Rows of each file of a published layer, by ``file_key`` (a number a file, as Spark's own file index holds)."""
        from featurespark.operators.query import file_key

        table = self.statistics_df(layer)
        return None if table is None else {file_key(r["file"]): r["rows"] for r in table.select("file", "rows").collect()}

    def add(self, name: str, df: DataFrame) -> "Layers":
        """Register a derived layer (a DataFrame built in this session)."""
        params.read(params.LAYER, {"layer": name})
        self._derived[name] = df
        return self

    def names(self) -> list[str]:
        return sorted({*self._entries(), *self._derived})

    def list(self) -> DataFrame:
        """A1: ``DataFrame(layer)`` of layer names, sorted."""
        rows = [(n,) for n in self.names()]
        return self.spark.createDataFrame(rows, "layer string").orderBy("layer")

    def validate(self, layer, entries: dict | None = None) -> str:
        params.read(params.LAYER, {"layer": layer})
        if layer not in self._derived and layer not in (self._entries() if entries is None else entries):
            raise LayerQueryError(f"unknown layer: {layer!r}")
        return layer

    def path(self, layer: str) -> str:
        return f"{self.root}/{self._entries()[layer][0]}"

    def _readable(self, layer: str) -> str:
        return literal_path(self.path(layer))

    def read(self, layer: str, session: SparkSession | None = None) -> DataFrame:
        """A2: scan a validated layer (lazy; prunes and pushes down)."""
        self.validate(layer)
        if layer in self._derived:
            return self._derived[layer]
        reader, facts = (session or self.spark).read, self.facts(layer)
        if facts:
            reader = reader.schema(T.StructType.fromJson(facts["schema"]))       # no footer is read for it
        return reader.parquet(self._readable(layer))

    def schema(self, layer: str) -> T.StructType:
        if layer in self._derived:
            return self._derived[layer].schema
        key = layer, self._entries().get(layer)
        if key not in self._schemas:
            self._schemas[key] = self.read(layer).schema
        return self._schemas[key]

    def columns(self, layer: str) -> list[dict]:
        """A4/A5: ``[{name, type, nullable, is_geometry}]`` in file order."""
        known = params.Columns(self.schema(self.validate(layer)))
        return [{"name": f.name, "type": type_name(f.dataType), "nullable": bool(f.nullable),
                 "is_geometry": f.name in known.geometry} for f in known.schema.fields]

    def attribute_names(self, layer: str) -> list[str]:
        return params.Columns(self.schema(self.validate(layer))).attributes

    def geometry_names(self, layer: str) -> list[str]:
        return geometry_fields(self.schema(self.validate(layer)))

    def columns_df(self, layers: list[str] | None = None) -> DataFrame:
        """Column descriptors of one or more layers as a DataFrame."""
        rows = []
        for layer in layers or self.names():
            for i, c in enumerate(self.columns(layer)):
                rows.append((layer, i + 1, c["name"], c["type"], c["nullable"], c["is_geometry"]))
        return self.spark.createDataFrame(rows, COLUMNS_SCHEMA)

    def count_df(self, layer: str) -> DataFrame:
        """``count(*)`` of a layer: from its facts, else from Parquet footers, a row a file."""
        facts = self.facts(self.validate(layer))
        if facts:
            return self.spark.createDataFrame([(layer, facts["rows"])], "layer string, feature_count long")
        if layer in self._derived:
            df = self._derived[layer]
        else:
            df = count_session(self.base).read.parquet(self._readable(layer))
        return df.agg(F.count(F.lit(1)).alias("feature_count")) \
                 .select(F.lit(layer).alias("layer"), "feature_count")

    def feature_counts(self, layers: list[str] | None = None) -> DataFrame:
        """A6 for many layers: ``(layer, feature_count)``; published ones from their facts, the others in one job."""
        facts, frames = self._described(layers)
        return self._counts(facts, frames)

    def _described(self, layers: list[str] | None) -> tuple[dict[str, dict], dict[str, DataFrame]]:
        """The facts of published layers, and the frames of the others; the root is listed once."""
        entries, published = self._state()
        names = [self.validate(n, entries) for n in (layers or sorted({*entries, *self._derived}))]
        facts = {n: published[n] for n in names if n in published and n not in self._derived}
        stored = [n for n in names if n not in facts and n not in self._derived]
        counting = count_session(self.base)
        with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
            read = list(pool.map(lambda n: counting.read.parquet(literal_path(f"{self.root}/{entries[n][0]}")), stored))
        frames = {n: self._derived[n] for n in names if n in self._derived} | dict(zip(stored, read))
        return facts, {n: frames[n] for n in names if n in frames}

    def _counts(self, facts: dict[str, dict], frames: dict[str, DataFrame]) -> DataFrame:
        known = [(n, f["rows"]) for n, f in facts.items()]
        counted = [df.agg(F.count(F.lit(1)).alias("feature_count")).select(F.lit(n).alias("layer"), "feature_count")
                   for n, df in frames.items()]
        if known or not counted:
            counted.append(self.spark.createDataFrame(known, "layer string, feature_count long"))
        return reduce(DataFrame.unionByName, counted)

    def extent(self, layer: str) -> DataFrame:
        """The extent of a whole layer: from its facts, else from the stored extents or the geometries."""
        from featurespark.operators.spatial import extent
        from featurespark.sources.statistics import BOX

        facts = self.facts(self.validate(layer))
        if facts:
            return self.spark.createDataFrame([tuple(facts["extent"] or [None] * 4)], ", ".join(f"{s} double" for s in BOX))
        return extent(self.read(layer), self.geometry_names(layer)[0])

    def layer_statistics(self, layers: list[str] | None = None) -> DataFrame:
        """``(layer, files, rows, xmin, ymin, xmax, ymax)`` of published layers, summed from their tables."""
        from featurespark.sources.statistics import total_statistics

        names = [n for n in (layers or self.names()) if self.facts(self.validate(n))]
        frames = [total_statistics(self.statistics_df(n)).select(F.lit(n).alias("layer"), "*") for n in names]
        schema = "layer string, files long, rows long, xmin double, ymin double, xmax double, ymax double"
        return reduce(DataFrame.unionByName, frames, self.spark.createDataFrame([], schema))

    def describe_df(self, layers: list[str] | None = None) -> DataFrame:
        """A6 for many layers: ``(layer, feature_count, n_columns, n_geometry)``; column facts from footers or the manifest."""
        facts, frames = self._described(layers)
        schemas = {n: T.StructType.fromJson(f["schema"]) for n, f in facts.items()} | {n: df.schema for n, df in frames.items()}
        known = {n: params.Columns(schema) for n, schema in schemas.items()}
        columns, geometry = (F.create_map(*[F.lit(v) for n, k in known.items() for v in (n, len(part(k)))])
                             if known else F.create_map().cast("map<string,int>") for part in (lambda k: k.every, lambda k: k.geometry))
        return self._counts(facts, frames).select("layer", "feature_count", columns[F.col("layer")].cast("long").alias("n_columns"),
                                                  geometry[F.col("layer")].cast("long").alias("n_geometry"))

    def describe(self, layer) -> dict:
        """``{layer, feature_count, columns}``; the count reads footers only."""
        self.validate(layer)
        cols = self.columns(layer)
        n = self.count_df(layer).first()["feature_count"]
        return {"layer": layer, "feature_count": int(n), "columns": cols}

    def register_views(self, names: list[str]) -> None:
        """Expose the named layers as temp views of the query session (for C1 subqueries)."""
        for n in names:
            self.read(n).createOrReplaceTempView(n)

    # -- request operators (thin wrappers over operators/*) ---------------
    def filter(self, layer, where=None, allow_subqueries=False) -> DataFrame:
        """Guarded ``where`` over a whole layer (unpaged; for bulk jobs)."""
        from featurespark.operators.query import apply_where
        from featurespark.plans.where import guard_where

        self.validate(layer)
        text = params.read(params.FORM, {"where": where}).where
        guarded = guard_where(self.spark, text, self.names() if allow_subqueries else None)
        if guarded and guarded.relations:
            self.register_views(guarded.relations)
        return apply_where(self.read(layer), guarded)

    def query(self, layer, **kw):
        from featurespark.operators.query import query_layer

        return query_layer(self, layer, **kw)

    def unique_values(self, layer, field, search=None, limit=None):
        from featurespark.operators.distinct import unique_values

        return unique_values(self, layer, field, search=search, limit=limit)

    def unique_values_df(self, layer, field, search=None, limit=None) -> DataFrame:
        """``DataFrame(value, pos)`` form of :meth:`unique_values`."""
        from featurespark.operators.distinct import unique_values_df

        return unique_values_df(self, layer, field, search=search, limit=limit)

    def suggest(self, layer, field, text=None, limit=params.DEFAULT_VALUES):
        from featurespark.operators.distinct import suggest

        return suggest(self, layer, field, text, limit)
