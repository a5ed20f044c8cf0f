"""GeoJSON features.

The page is cut first (top-k on the sort keys), then only its <= 1000 rows
have their WKB decoded (Arrow UDF) and turned into GeoJSON text with native
expressions. Properties are ``to_json`` of the JSON-safe attribute struct
with NULL members kept; the geometry text is concatenated in as-is (never
re-parsed), so numbers and key order are preserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurespark.functions.geometry import geojson
from featurespark.functions.jsonfmt import json_object
from featurespark.functions.wkb import wkb_decode
from featurespark.operators.query import quoted, sorted_page, with_position

DECODED = "__geom"


def with_decoded(df: DataFrame, geom_col: str, name: str = DECODED) -> DataFrame:
    """Add the decoded geometry as its own column.

    Native higher-order functions cannot call a Python UDF inside their lambda,
    so the decode is projected once and the expressions read the column.
    """
    return df.withColumn(name, wkb_decode(quoted(geom_col)))


def feature_page(df: DataFrame, schema: T.StructType, fields: list[str], geom_col: str,
                 keys, offset: int, limit: int, known: dict[str, int] | None = None) -> DataFrame:
    # The single-partition exchange fences the page: without it the Python
    # evaluation would sit between the limit and the sort, and Catalyst would
    # plan a full range-partitioned sort instead of TakeOrderedAndProject.
    page = with_decoded(sorted_page(df, keys, offset, limit, known=known).repartition(1), geom_col)
    return page.select(F.lit("Feature").alias("type"),
                       geojson(F.col(DECODED)).alias("geometry"),
                       json_object(schema, fields).alias("properties"))


def features(df: DataFrame, geom_col: str, fields: list[str]) -> DataFrame:
    """Whole-layer feature rows ``(type, geometry, properties)`` (for exports)."""
    dec = with_decoded(df, geom_col)
    return dec.select(F.lit("Feature").alias("type"), geojson(F.col(DECODED)).alias("geometry"),
                      json_object(df.schema, fields).alias("properties"))


def feature_text(geometry: Column | str = "geometry", properties: Column | str = "properties") -> Column:
    """H9: one GeoJSON Feature object as text (geometry ``null`` when NULL)."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    p = F.col(properties) if isinstance(properties, str) else properties
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(g, F.lit("null")),
                    F.lit(',"properties":'), p, F.lit("}"))


def feature_collection(page: DataFrame, offset: int = 0) -> DataFrame:
    """One (clamped) page of features -> one FeatureCollection document.

    Only ever applied to one page (<= 1000 rows): ``collect_list`` of
    ``(pos, text)`` pairs, sorted by position, joined with commas.
    """
    pos = with_position(page, offset)
    items = pos.select(F.struct("pos", feature_text().alias("f")).alias("item"))
    return items.agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['),
                 F.array_join(F.transform("items", lambda i: i["f"]), ","),
                 F.lit("]}")).alias("collection"),
        F.size("items").cast("long").alias("count"))
