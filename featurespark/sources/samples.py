"""Layers Spark derives from the driver tables (for tests, oracle keys, bench).

Geometry layers are synthesised from attribute tables with fixed arithmetic
rules (the same SQL arithmetic runs in the oracle), so they grow with the
source tables:

* ``parcels`` (squares) from ``customer``;
* ``sites`` (points) from ``events``;
* ``zones`` (triangles) from ``nation``.

Each carries WKB ``geometry`` plus a ``bbox`` struct (GeoParquet covering
column) whose fields push down as Parquet filters once written.
Attribute-only variants: ``orders_nullstatus`` (NULLs in a sort key) and
``lineitem_decimal`` (a DECIMAL column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurespark.functions import geometry as G
from featurespark.functions.wkb import wkb_encode

# --- fixed values: coordinate rules of the synthetic layers (degrees) ---
PARCEL_X = "144e0 + (c_custkey * 37 % 1000) / 1000e0"
PARCEL_Y = "-38.5e0 + (c_custkey * 91 % 1000) / 1000e0"
PARCEL_SIDE = "(1 + c_custkey % 4) / 2000e0"
SITE_X = "144e0 + (event_id * 53 % 1000) / 1000e0 + 0.0003e0"
SITE_Y = "-38.5e0 + (event_id * 29 % 1000) / 1000e0 + 0.0004e0"
ZONE_X = "144e0 + (n_nationkey % 5) * 0.2e0"
ZONE_Y = "-38.5e0 + floor(n_nationkey / 5) * 0.2e0"
ZONE_LEG = 0.2
GRID_E = "300000e0 + (event_id * 53 % 1000) * 100e0"       # metres
GRID_N = "5800000e0 + (event_id * 29 % 1000) * 100e0"
# --------------------------------------------------------------------------


def _bbox(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def _pt(x: Column, y: Column) -> Column:
    return F.array(x, y)


def parcels(customer: DataFrame) -> DataFrame:
    x, y, s = F.expr(PARCEL_X), F.expr(PARCEL_Y), F.expr(PARCEL_SIDE)
    ring = F.array(_pt(x, y), _pt(x + s, y), _pt(x + s, y + s), _pt(x, y + s), _pt(x, y))
    return customer.select(
        F.col("c_custkey").alias("parcel_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"),
        _bbox(x, y, x + s, y + s).alias("bbox"),
        wkb_encode(G.make_polygon(ring)).alias("geometry"))


def sites(events: DataFrame) -> DataFrame:
    x, y = F.expr(SITE_X), F.expr(SITE_Y)
    return events.select(
        F.col("event_id").alias("site_id"), "event_type", "value",
        _bbox(x, y, x, y).alias("bbox"), wkb_encode(G.make_point(x, y)).alias("geometry"))


def zones(nation: DataFrame) -> DataFrame:
    x, y = F.expr(ZONE_X), F.expr(ZONE_Y)
    leg = F.lit(ZONE_LEG)
    ring = F.array(_pt(x, y), _pt(x + leg, y), _pt(x, y + leg), _pt(x, y))
    return nation.select(
        F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("name"),
        _bbox(x, y, x + leg, y + leg).alias("bbox"), wkb_encode(G.make_polygon(ring)).alias("geometry"))


def registry_entries(customer: DataFrame) -> DataFrame:
    """Layer registry rows derived from the data: one per customer segment."""
    seg = customer.select(F.col("c_mktsegment").alias("segment")).distinct()
    return seg.select(F.concat(F.lit("parcels_"), F.lower("segment")).alias("id"),
                      F.col("segment").alias("label"), (F.col("segment") < F.lit("H")).alias("visibleByDefault"),
                      F.lit(0.4).alias("opacity"), F.lit("#ef6c00").alias("color"))


def write_upload_tree(layers, root: str) -> str:
    """An upload tree Spark writes from the driver tables, for ingest jobs.

    ``parcels_ds.gdb/parcels.geojsonl`` (polygons), ``parcels_ds.gdb/nations.geojsonl``
    (no geometry), ``sites_ds.gdb/sites.parquet`` (points, WKB) and ``config.json``
    (registry from the parcel segments plus the ``parcels`` and ``sites`` layers).
    """
    import json

    from featurespark.operators.features import feature_text, features

    spark = layers.spark
    up = f"{root.rstrip('/')}/uploads"
    p = layers.read("parcels").drop("bbox")
    features(p, "geometry", [c for c in p.columns if c != "geometry"]) \
        .select(feature_text().alias("value")).write.mode("overwrite").text(f"{up}/parcels_ds.gdb/parcels.geojsonl")
    n = layers.read("nation")
    n.select(F.concat(F.lit('{"type":"Feature","geometry":null,"properties":'), F.to_json(F.struct(*n.columns)),
                      F.lit("}")).alias("value")).write.mode("overwrite").text(f"{up}/parcels_ds.gdb/nations.geojsonl")
    layers.read("sites").drop("bbox").write.mode("overwrite").parquet(f"{up}/sites_ds.gdb/sites.parquet")
    entries = [r.asDict() for r in registry_entries(layers.read("customer")).orderBy("id").collect()]
    entries += [{"id": "parcels", "label": "Parcels", "visibleByDefault": True, "opacity": 0.15, "color": "#ef6c00"},
                {"id": "sites", "label": "Sites", "visibleByDefault": False, "opacity": 1.0, "color": "#1976d2"}]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{up}/config.json")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(json.dumps({"layers": entries}, indent=2).encode("utf-8")))
    out.close()
    return up


def write_crs_tree(layers, root: str) -> str:
    """Two Parquet layers that state different CRS: grid points of zone 55 (EPSG:7855) and EPSG:4326 points."""
    up, e = f"{root.rstrip('/')}/uploads", layers.read("events")
    grid = wkb_encode(G.make_point(F.expr(GRID_E), F.expr(GRID_N)))
    ll = wkb_encode(G.make_point(F.expr(SITE_X), F.expr(SITE_Y)))
    for name, epsg, geometry in (("grid", 7855, grid), ("degrees", 4326, ll)):
        e.select(F.col("event_id").alias("site_id"), geometry.alias("geometry", metadata={"crs": f"EPSG:{epsg}"})) \
            .write.mode("overwrite").parquet(f"{up}/survey data.gdb/{name}.parquet")
    return up


def write_names_tree(layers, root: str) -> str:
    """A layer whose geometry column is ``SHAPE`` and that has an attribute called ``bbox``, in an odd folder."""
    up = f"{root.rstrip('/')}/uploads"
    layers.read("parcels").select("parcel_id", F.col("segment").alias("bbox"), F.col("geometry").alias(
        "SHAPE", metadata={"crs": "EPSG:7844"})).write.mode("overwrite").parquet(f"{up}/a [b] 100%.gdb/lots.parquet")
    return up


def steps(nation: DataFrame) -> DataFrame:
    """Right triangles of whole-number corners, to test points on their edges."""
    side = F.col("n_nationkey").cast("double") + 4
    ring = F.array(_pt(F.lit(0.0), F.lit(0.0)), _pt(side, F.lit(0.0)), _pt(side, side), _pt(F.lit(0.0), F.lit(0.0)))
    return nation.select(F.col("n_nationkey").alias("step_id"), wkb_encode(G.make_polygon(ring)).alias("geometry"))


def nested(nation: DataFrame) -> DataFrame:
    """Squares around the origin, each eight times as wide as the one before: 1/2 to 2^71."""
    h = F.pow(F.lit(2.0), F.col("n_nationkey") * 3 - 2)
    ring = F.array(_pt(-h, -h), _pt(h, -h), _pt(h, h), _pt(-h, h), _pt(-h, -h))
    return nation.select(F.col("n_nationkey").alias("square_id"), wkb_encode(G.make_polygon(ring)).alias("geometry"))


def lattice(events: DataFrame) -> DataFrame:
    """Points of whole-number coordinates from 0 to 39."""
    x, y = (F.pmod(F.col("event_id") * k, F.lit(40)).cast("double") for k in (7, 3))
    return events.select(F.col("event_id").alias("site_id"), wkb_encode(G.make_point(x, y)).alias("geometry"))


CROWD_X = "CASE WHEN event_id % 10 = 0 THEN 144.0003e0 + (event_id % 1000) / 1000e0 ELSE 144.0503e0 + (event_id % 97) * 0.001e0 END"
CROWD_Y = "CASE WHEN event_id % 10 = 0 THEN -38.4996e0 + (event_id % 999) / 1000e0 ELSE -38.4496e0 + (event_id % 89) * 0.001e0 END"


def crowd(events: DataFrame) -> DataFrame:
    """Points of which nine in ten lie in a tenth of a degree, the others along a diagonal."""
    return events.select(F.col("event_id").alias("site_id"),
                         wkb_encode(G.make_point(F.expr(CROWD_X), F.expr(CROWD_Y))).alias("geometry"))


def with_samples(layers):
    """Register the derived layers on a ``Layers`` catalogue built over driver tables."""
    names = set(layers.names())
    if "customer" in names:
        layers.add("parcels", parcels(layers.read("customer")))
    if "events" in names:
        layers.add("sites", sites(layers.read("events")))
        layers.add("lattice", lattice(layers.read("events")))
        layers.add("crowd", crowd(layers.read("events")))
    if "nation" in names:
        layers.add("zones", zones(layers.read("nation")))
        layers.add("steps", steps(layers.read("nation")))
        layers.add("nested", nested(layers.read("nation")))
    if "orders" in names:
        o = layers.read("orders")
        layers.add("orders_nullstatus", o.withColumn(
            "o_orderstatus", F.expr("nullif(o_orderstatus, 'F')")))
    if "lineitem" in names:
        li = layers.read("lineitem")
        layers.add("lineitem_decimal", li.select(
            "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("l_price_dec")))
    return layers
