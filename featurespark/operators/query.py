"""``query``: filter, project, sort and page one layer.

One DataFrame chain per request:
``read.parquet -> where -> orderBy -> offset/limit -> select``. Catalyst turns
sort + limit into ``TakeOrderedAndProject`` (a per-partition top-k, merged in
one task, never a global sort), prunes the scan to the referenced columns and
pushes the predicate into the Parquet reader. The projection is last, so sort
keys need not be output columns.

A page in file order takes files one after the other, in batches that grow until
the page is full: rows per file are known from the layer's statistics or counted for the
batch alone, so a first page reads the first file and nothing else. A deep page of a sorted
request deals only the sort keys and the rows' places (file, index) into counted ranges, so no task holds
``offset + limit`` rows and no other column is written; the page's rows are then fetched by their places.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark import params
from featurespark.errors import LayerQueryError, as_user_error
from featurespark.functions.jsonfmt import json_columns
from featurespark.params import SortKey
from featurespark.plans.where import Guarded, check_analyzed, guard_where

BLOCK_ROWS = 1 << 16       # rows of a file that are counted together
DEEP_OFFSET = 20_000       # sorted pages from here on are found by ranges


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def order_columns(keys: list[SortKey]) -> list[Column]:
    """NULLs sort last in both directions."""
    return [quoted(k.field).desc_nulls_last() if k.descending else quoted(k.field).asc_nulls_last()
            for k in keys]


FILE, ROW = "_metadata.file_path", "_metadata.row_index"


def has_file_order(df: DataFrame) -> bool:
    try:
        df.select(FILE, ROW)
        return True
    except AnalysisException:
        return False


def sorted_page(df: DataFrame, keys: list[SortKey], offset: int, limit: int, stable: bool = True,
                known: dict[str, int] | None = None) -> DataFrame:
    """Sort (or file order when no keys), skip ``offset``, keep ``limit``.

    ``stable`` appends the file position as the last sort key (when the frame
    is a direct file scan), which makes paging deterministic for tied keys and
    gives the file-order page of S17 when no key is requested. ``known``: rows per file of an unfiltered layer.
    """
    in_files = has_file_order(df)
    if not keys and in_files:
        return file_page(df, offset, limit, known)
    cols = order_columns(keys)
    if stable and in_files:
        cols += [F.col(FILE).asc(), F.col(ROW).asc()]
    if cols and offset >= DEEP_OFFSET:
        return deep_page(df, keys, stable and in_files, offset, limit)
    if cols:
        df = df.orderBy(*cols)
    if offset:
        df = df.offset(offset)
    return df.limit(limit)


def _stretch(counts: list[tuple], offset: int, limit: int) -> tuple[list, int]:
    """Of ordered ``(key, rows)``: the keys that rows ``offset..offset+limit`` fall into, and the offset there."""
    chosen, before, start = [], 0, 0
    for key, n in counts:
        if before + n > offset and before < offset + limit:
            if not chosen:
                start = offset - before
            chosen.append(key)
        before += n
    return chosen, start


def file_key(path: str) -> str:
    """A file's URI with one slash after the scheme."""
    return re.sub("^([a-zA-Z0-9]+):/*", r"\1:/", path)


def file_keys() -> Column:
    """The ``file_key`` of each row's file; a filter on it prunes files before anything is read."""
    return F.regexp_replace(FILE, "^([a-zA-Z0-9]+):/*", "$1:/")


def file_page(df: DataFrame, offset: int, limit: int, known: dict[str, int] | None = None) -> DataFrame:
    """rows ``offset..offset+limit`` in order of file path and position in the file.

    Files are taken in batches of 1, 2, 4, ... in path order until the page is full. Rows per file come from
    ``known``, else a job counts those of the batch, from row-group metadata where there is no filter; files behind the page are not
    touched. A page that starts far inside a file counts blocks of rows there and reads only those it needs.
    """
    files = sorted({file_key(f) for f in df.inputFiles()})
    counts: list[tuple] = []
    seen, size = 0, 1
    while len(counts) < len(files) and seen < offset + limit:
        batch = files[len(counts):len(counts) + size]
        if known is not None and all(f in known for f in batch):
            found = known
        elif len(files) == 1 and not offset:
            found = {batch[0]: limit}
        else:
            rows = df.where(file_keys().isin(batch)).groupBy(file_keys().alias("f")).count().collect()
            found = {r["f"]: r["count"] for r in rows}
        counts += [(f, found.get(f, 0)) for f in batch]
        seen += sum(n for _, n in counts[-len(batch):])
        size *= 2
    chosen, offset = _stretch(counts, offset, limit)
    df = df.where(file_keys().isin(chosen))
    if offset >= BLOCK_ROWS:
        block = F.floor(F.col(ROW) / BLOCK_ROWS)
        blocks = df.groupBy(file_keys().alias("f"), block.alias("b")).count().orderBy("f", "b").collect()
        parts, offset = _stretch([((r["f"], r["b"]), r["count"]) for r in blocks], offset, limit)
        if parts:
            (f0, b0), (f1, b1) = parts[0], parts[-1]
            df = df.where(((file_keys() > f0) | (F.col(ROW) >= b0 * BLOCK_ROWS))
                          & ((file_keys() < f1) | (F.col(ROW) < (b1 + 1) * BLOCK_ROWS)))
    page = df.orderBy(F.col(FILE).asc(), F.col(ROW).asc())
    return (page.offset(offset) if offset else page).limit(limit)


def deep_page(df: DataFrame, keys: list[SortKey], by_file: bool, offset: int, limit: int) -> DataFrame:
    """a page far down a sorted layer, from the ranges of the sort order that hold it.

    Of a stored layer only the sort keys and each row's file and index are written, in ranges; a count a range tells which
    of them to sort, the page's places (``limit`` of them) come to the driver, and its rows are read from the files
    they are in. Frames that are no file scan write their rows instead. The ranges are deleted before this returns.
    """
    from featurespark.session import checkpoint_dir
    from featurespark.sources.manifest import _fs

    spark, order = df.sparkSession, [F.col(f"__k{i}").desc_nulls_last() if k.descending else F.col(f"__k{i}").asc_nulls_last()
                                     for i, k in enumerate(keys)]
    named = [quoted(k.field).alias(f"__k{i}") for i, k in enumerate(keys)]
    if by_file:
        order += [F.col("__file").asc(), F.col("__row").asc()]
        placed = df.select(*named, F.col(FILE).alias("__file"), F.col(ROW).alias("__row"))
    else:
        placed = df.select(*named, F.struct(*[quoted(c) for c in df.columns]).alias("__all"))
    path = f"{checkpoint_dir(spark)}/deep-page-{uuid.uuid4().hex}"
    try:
        placed.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()) \
            .write.partitionBy("__range").parquet(path)
        ranged = spark.read.parquet(path)
        counts = ranged.groupBy("__range").count().orderBy("__range").collect()
        chosen, offset = _stretch([(r["__range"], r["count"]) for r in counts], offset, limit)
        page = ranged.where(F.col("__range").isin(chosen)).orderBy(*order).offset(offset).limit(limit)
        rows = page.select("__file", "__row").collect() if by_file else page.select("__all.*").collect()
    finally:
        fs, scratch = _fs(spark, path)
        fs.delete(scratch, True)
    if not by_file:
        return spark.createDataFrame(rows, df.schema)
    places = spark.createDataFrame([(r["__file"], r["__row"], i) for i, r in enumerate(rows)],
                                   "__file string, __row long, __pos int")
    found = df.where(file_keys().isin(sorted({file_key(r["__file"]) for r in rows})))
    found = found.select("*", F.col(FILE).alias("__file"), F.col(ROW).alias("__row"))
    return found.join(F.broadcast(places), ["__file", "__row"]).orderBy("__pos").limit(limit) \
        .select(*[quoted(c) for c in df.columns])


def with_position(page: DataFrame, offset: int) -> DataFrame:
    """1-based absolute row position of a page (page <= 1000 rows, one task)."""
    return page.withColumn("pos", F.monotonically_increasing_id() + F.lit(offset + 1))


def apply_where(df: DataFrame, guarded: Guarded | None) -> DataFrame:
    """Filter by a guarded predicate.

    Where the layer stores the extent of its geometry, the boxes of constant
    spatial predicates become plain comparisons, which reach the Parquet reader;
    the exact test then runs on the rows that are left.
    """
    if guarded is None:
        return df
    from featurespark.operators.spatial import extent_column

    stored = extent_column(df.schema)
    geometry = params.Columns(df.schema).geometry
    for column, (x0, y0, x1, y1) in guarded.boxes if stored else []:
        if column in geometry:
            b = quoted(stored)
            df = df.where((b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0))
    try:
        return check_analyzed(df.where(guarded.text))
    except Exception as exc:  # analysis errors surface eagerly
        raise as_user_error(exc) from None


@dataclass
class QueryResult:
    layer: str
    kind: str                      # "count" | "json" | "geojson"
    df: DataFrame
    offset: int = 0
    limit: int = 0
    fields: list[str] = field(default_factory=list)

    def positioned(self) -> DataFrame:
        """The page with its 1-based absolute ``pos`` (order made testable)."""
        if self.kind == "count":
            return self.df
        return with_position(self.df, self.offset)

    def to_dict(self) -> dict:
        """V5: build the single response document (one clamped page only)."""
        import json

        try:
            rows = self.df.collect()
        except Exception as exc:
            raise as_user_error(exc) from None
        if self.kind == "count":
            return {"layer": self.layer, "count": int(rows[0]["count"])}
        if self.kind == "json":
            feats = [{k: _plain(r[k]) for k in self.fields} for r in rows]
            return {"layer": self.layer, "count": len(feats), "resultOffset": self.offset,
                    "resultRecordCount": self.limit, "fields": list(self.fields),
                    "features": feats}
        feats = [{"type": "Feature",
                  "geometry": json.loads(r["geometry"]) if r["geometry"] else None,
                  "properties": json.loads(r["properties"])} for r in rows]
        return {"type": "FeatureCollection", "features": feats, "layer": self.layer,
                "count": len(feats), "resultOffset": self.offset,
                "resultRecordCount": self.limit}


def _plain(v):
    if hasattr(v, "asDict"):
        return v.asDict(recursive=True)
    return v


def query_layer(layers, layer, *, allow_subqueries=False, **given) -> QueryResult:
    """K1/K2/D2. ``given``: the parameters of ``params.FORM`` and ``params.PAGE``.

    A count-only request ends before its page parameters are read (S11), and a missing
    geometry is reported after they were (S14).
    """
    layers.validate(layer)
    form = params.read(params.FORM, given)
    columns = params.Columns(layers.schema(layer))
    guarded = guard_where(layers.spark, form.where, layers.names() if allow_subqueries else None)
    if guarded and guarded.relations:
        layers.register_views(guarded.relations)
    df = apply_where(layers.read(layer), guarded)
    if form.return_count_only:
        counted = (count_matches(df) if guarded else layers.count_df(layer).withColumnRenamed("feature_count", "count")) \
            .select(F.lit(layer).alias("layer"), "count")
        return QueryResult(layer, "count", counted)

    page = params.read(params.PAGE, given)
    known = None if guarded else layers.file_rows(layer)
    fields, keys = columns.outputs(page.out_fields), columns.sorting(page.order_by)
    if form.f == "geojson" or form.return_geometry:
        if not columns.geometry:
            raise LayerQueryError(f"layer {layer!r} has no geometry column")
        from featurespark.operators.features import feature_page

        rows = feature_page(df, columns.schema, fields, columns.geometry[0], keys, page.offset, page.count, known)
        return QueryResult(layer, "geojson", rows, page.offset, page.count, fields)
    if not fields:
        raise LayerQueryError("out_fields selects no column")
    rows = sorted_page(df, keys, page.offset, page.count, known=known).select(*json_columns(columns.schema, fields))
    return QueryResult(layer, "json", rows, page.offset, page.count, fields)


def count_matches(df: DataFrame) -> DataFrame:
    """``count(*)`` of the filtered layer (partial counts, one tiny shuffle)."""
    return df.agg(F.count(F.lit(1)).alias("count"))
