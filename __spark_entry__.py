"""

Every query reads the driver's tables (each table is a layer) or layers Spark
derives from them, runs through the public ``featurespark`` API, and has an
equivalent DuckDB SQL text under the same key. Paged requests carry an
absolute ``pos`` column so that row order is part of the comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark import Layers
from featurespark.operators import predicates as P
from featurespark.operators.attributes import attribute_table
from featurespark.operators.distinct import distinct_values, truncated_flag
from featurespark.operators.query import count_matches

from featurespark.sources.samples import CROWD_X, CROWD_Y

SMOKE_DIR = "/root/testdata/sf0.001"

_layers_cache: dict[tuple[int, str], Layers] = {}


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    key = (id(spark), sf_dir)
    if key not in _layers_cache:
        from featurespark.sources import samples

        _layers_cache[key] = samples.with_samples(Layers(spark, sf_dir))
    return _layers_cache[key]


# -- stage 0: the minimum slice ---------------------------------------------------
FLAGSHIP = dict(
    where="\"o_totalprice\" > 100000 AND \"o_orderstatus\" = 'F'",
    out_fields="o_orderkey,o_totalprice,o_orderdate",
    order_by="o_totalprice DESC,o_orderkey ASC",
    count=100, offset=20,
)


def q_flagship(spark, d):
    return layers(spark, d).query("orders", **FLAGSHIP).positioned()


def entry(spark: SparkSession) -> DataFrame:
    """Flagship request on the smoke tables."""
    return q_flagship(spark, SMOKE_DIR)


def q_scan_layer(spark, d):
    return layers(spark, d).read("lineitem")


def q_query_all_attributes(spark, d):
    return layers(spark, d).query("customer", order_by="c_custkey", count=1000).positioned()


def q_query_out_fields(spark, d):
    return layers(spark, d).query("orders", out_fields=" o_orderkey, o_totalprice ,,o_orderstatus",
                                  order_by="o_orderkey", count=1000).positioned()


def q_query_where(spark, d):
    return layers(spark, d).query(
        "lineitem", where="\"l_quantity\" > 45 AND \"l_returnflag\" = 'R'",
        out_fields="l_orderkey,l_linenumber,l_quantity,l_extendedprice",
        order_by="l_orderkey, l_linenumber, l_extendedprice", count=1000).positioned()


def q_query_where_all(spark, d):
    return layers(spark, d).query("lineitem", where=" 1=1 ", return_count_only="true").df


def q_query_count_only(spark, d):
    return layers(spark, d).query(
        "lineitem", where="\"l_shipdate\" >= TIMESTAMP '1998-01-01' AND \"l_discount\" BETWEEN 0.05 AND 0.07",
        return_count_only="Yes").df


def q_query_order_by(spark, d):
    return layers(spark, d).query(
        "orders", where="\"o_orderstatus\" = 'O'", out_fields="o_orderkey,o_orderpriority,o_totalprice",
        order_by="o_orderpriority asc, o_totalprice DESC, o_orderkey", count=1000).positioned()


def q_query_order_by_nulls(spark, d):
    return layers(spark, d).query(
        "orders_nullstatus", out_fields="o_orderkey,o_orderstatus",
        order_by="o_orderstatus DESC, o_orderkey", offset=9500, count=1000).positioned()


def q_query_limit(spark, d):
    return layers(spark, d).query("lineitem", out_fields="l_orderkey,l_linenumber",
                                  order_by="l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC",
                                  count=5000).positioned()


def q_query_page(spark, d):
    return layers(spark, d).query("orders", out_fields="o_orderkey,o_orderdate",
                                  order_by="o_orderdate, o_orderkey", offset=2000,
                                  count=300).positioned()


def q_query_top_k(spark, d):
    return layers(spark, d).query(
        "lineitem", out_fields="l_orderkey,l_linenumber,l_extendedprice",
        order_by="l_extendedprice DESC, l_orderkey, l_linenumber", count=10).positioned()


def q_query_page_unsorted(spark, d):
    return layers(spark, d).query("lineitem", out_fields="l_orderkey,l_linenumber",
                                  offset=20, count=100).positioned()


def q_query_page_first(spark, d):
    """The default request, without a sort, on a layer of 12 files in order of its key."""
    key = ("twelve", id(spark), d)
    if key not in _runs:
        root = _scratch(spark, "twelve")
        layers(spark, d).read("orders").repartitionByRange(12, "o_orderkey").sortWithinPartitions("o_orderkey") \
            .write.parquet(f"{root}/ordered.parquet")
        _runs[key] = {"root": root}
    return Layers(spark, _runs[key]["root"]).query(
        "ordered", out_fields="o_orderkey,o_orderdate,o_totalprice", where="o_orderstatus <> 'F'", count=1000).positioned()


def q_query_page_deep(spark, d):
    return layers(spark, d).query("lineitem", out_fields="l_orderkey,l_linenumber,l_extendedprice",
                                  order_by="l_extendedprice DESC, l_orderkey, l_linenumber",
                                  offset=50000, count=100).positioned()


def q_query_page_unsorted_far(spark, d):
    return layers(spark, d).query("lineitem", where="l_quantity > 10", out_fields="l_orderkey,l_linenumber",
                                  offset=30000, count=50).positioned()


def q_query_json(spark, d):
    return layers(spark, d).query("orders", where="\"o_custkey\" < 100", order_by="o_orderkey",
                                  count=1000).positioned()


def q_query_page_count(spark, d):
    page = layers(spark, d).query("orders", order_by="o_orderkey", offset=14900, count=1000).df
    return count_matches(page)


# -- stage 1: catalogue ------------------------------------------------------------
def q_list_layers(spark, d):
    return Layers.open(spark, d).list()


def q_describe_columns(spark, d):
    return layers(spark, d).columns_df([*Layers.open(spark, d).names(), "zones"])


def q_feature_count(spark, d):
    return Layers.open(spark, d).feature_counts()


def q_describe_layer(spark, d):
    return Layers.open(spark, d).describe_df()


def q_describe_attributes(spark, d):
    L = layers(spark, d)
    return L.columns_df(["parcels", "customer"]).where(~F.col("is_geometry"))


# -- stage 2: predicate builder, distinct values, JSON forms -------------------------
def _pred(layer, field, op, value, out):
    def run(spark, d):
        df = layers(spark, d).read(layer)
        return P.predicate(df, field, op, value).select(*out)
    return run


def q_match_all(spark, d):
    L = layers(spark, d)
    flags = L.read("lineitem").select("l_returnflag", "l_linestatus", "l_tax", "l_discount")
    clicked = L.read("lineitem").where(F.col("l_quantity") == 50) \
        .select("l_returnflag", "l_linestatus", "l_tax", "l_discount")
    return P.match_all(L.read("lineitem"), clicked).select(
        "l_orderkey", "l_linenumber", *flags.columns)


def q_unique_values(spark, d):
    return layers(spark, d).unique_values_df("lineitem", "l_shipdate", limit=500)


def q_unique_values_search(spark, d):
    return layers(spark, d).unique_values_df("part", "p_brand", search=" BRAND#1 ")


def q_unique_values_truncated(spark, d):
    L = layers(spark, d)
    a = truncated_flag(distinct_values(L.read("customer"), "c_mktsegment", None, 5), 5) \
        .select(F.lit("c_mktsegment").alias("field"), "n_values", "truncated")
    b = truncated_flag(distinct_values(L.read("part"), "p_type", None, 50), 50) \
        .select(F.lit("p_type").alias("field"), "n_values", "truncated")
    return a.unionByName(b)


def q_suggest_strings(spark, d):
    return layers(spark, d).suggest("part", "p_size", "1", 50)


def q_json_dates(spark, d):
    L = layers(spark, d)
    from featurespark.functions.jsonfmt import json_columns

    df = L.read("events")
    return df.select("event_id", *json_columns(df.schema, ["ts"]))


def q_json_decimal(spark, d):
    L = layers(spark, d)
    from featurespark.functions.jsonfmt import json_columns

    df = L.read("lineitem_decimal")
    return df.select("l_orderkey", "l_linenumber", *json_columns(df.schema, ["l_price_dec"]))


def q_json_rows(spark, d):
    from featurespark.functions.jsonfmt import json_object

    df = layers(spark, d).read("customer")
    return df.select("c_custkey", json_object(df.schema, df.columns).alias("json"))


def q_feature_attributes(spark, d):
    return attribute_table(layers(spark, d).read("nation"), ["n_nationkey"])


# -- stage 3: where dialect families, subqueries ---------------------------------------
def _where(layer, where, out, subq=False):
    def run(spark, d):
        return layers(spark, d).filter(layer, where, allow_subqueries=subq).select(*out)
    return run


WHERE_CASES = {
    "where_compare": ("lineitem", "\"l_quantity\" <> 10 AND l_tax >= 0.05 AND \"l_discount\" != 0.0 "
                      "AND l_linenumber <= 3 AND (l_extendedprice < 2000 OR l_extendedprice > 90000)",
                      ["l_orderkey", "l_linenumber"]),
    "where_boolean": ("customer", "NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND (c_nationkey = 3 OR c_nationkey = 7)",
                      ["c_custkey"]),
    "where_between": ("lineitem", "l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08",
                      ["l_orderkey", "l_linenumber"]),
    "where_in": ("part", "p_size IN (1, 5, 9) AND p_type NOT IN ('ECONOMY', 'SMALL')", ["p_partkey"]),
    "where_null": ("orders_nullstatus", "o_orderstatus IS NULL AND o_orderpriority IS NOT NULL AND o_custkey IS DISTINCT FROM 7",
                   ["o_orderkey"]),
    "where_like": ("customer", "c_name LIKE 'Customer#00000_1%' OR c_mktsegment NOT LIKE '%I%'", ["c_custkey"]),
    "where_ilike": ("part", "p_name ILIKE '%RED%' AND p_brand LIKE 'Brand#1_'", ["p_partkey"]),
    "where_arith": ("lineitem", "l_extendedprice * (1 - l_discount) * (1 + l_tax) > 100000 AND l_quantity / 4 >= 11 AND -l_quantity % 7 = -3",
                    ["l_orderkey", "l_linenumber"]),
    "where_case": ("orders", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 400000 ELSE o_totalprice < 20000 END AND COALESCE(NULLIF(o_orderpriority, '1-URGENT'), 'x') <> 'x'",
                   ["o_orderkey"]),
    "where_cast": ("lineitem", "CAST(l_quantity AS INTEGER) = 7 AND CAST(l_linenumber AS VARCHAR) = '2' AND CAST(l_shipdate AS DATE) < DATE '1996-01-01'",
                   ["l_orderkey", "l_linenumber"]),
    "where_string": ("customer", "UPPER(c_mktsegment) = 'MACHINERY' AND SUBSTRING(c_name, 10, 3) = '000' AND CHAR_LENGTH(TRIM(c_name)) = 18 AND POSITION('#' IN c_name) = 9 AND REPLACE(c_name, 'Customer', 'C') || 'x' LIKE 'C#%x'",
                     ["c_custkey"]),
    "where_date": ("orders", "o_orderdate >= DATE '1997-01-01' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' + INTERVAL '3' MONTH AND EXTRACT(DAY FROM o_orderdate) = 15",
                   ["o_orderkey"]),
}


# through the SQL functions: layer, predicate, output, the same condition over the coordinates
_LINE = "ST_GeomFromText('LINESTRING(144.5003 -38.2, 144.5003 -37.9)')"
_HOLED = ("ST_GeomFromText('POLYGON((144.2 -38.4, 144.6 -38.4, 144.6 -38.0, 144.2 -38.0, 144.2 -38.4), "
          "(144.3 -38.3, 144.3 -38.2, 144.4 -38.2, 144.4 -38.3, 144.3 -38.3))')")
SPATIAL_CASES = {
    "where_st_contains": ("zones", "ST_Contains(geometry, ST_Point(144.253, -38.421))", "zone_id"),
    "where_st_covers": ("steps", "ST_Covers(geometry, ST_Point(7, 7))", "step_id"),
    "where_st_contains_edge": ("steps", "ST_Contains(geometry, ST_Point(7, 7))", "step_id"),
    "where_st_within": ("sites", f"ST_Within(geometry, {_HOLED})", "site_id"),
    "where_st_intersects_line": ("parcels", "ST_Intersects(geometry, ST_GeomFromText("
                                 "'LINESTRING(144.2003 -38.45, 144.2003 -37.6)'))", "parcel_id"),
    "where_st_disjoint": ("parcels", "ST_Disjoint(geometry, ST_MakeEnvelope(144.1001, -38.4999, 144.9001, -37.5999))",
                          "parcel_id"),
    "where_st_dwithin": ("sites", f"ST_DWithin(geometry, {_LINE}, 0.05)", "site_id"),
    "where_st_distance": ("sites", f"ST_Distance(geometry, {_LINE}) > 0.3", "site_id"),
    "where_st_area": ("parcels", "ST_Area(geometry) > 0.0000015 AND ST_Perimeter(geometry) < 0.007", "parcel_id"),
    "where_st_centroid": ("parcels", "ST_X(ST_Centroid(geometry)) < 144.3001", "parcel_id"),
    "where_st_asgeojson": ("sites", "ST_AsGeoJSON(geometry) LIKE '%[144.05%'", "site_id"),
    "where_st_astext": ("lattice", "ST_AsText(geometry) = 'POINT (7 3)'", "site_id"),
    "where_st_fromgeojson": ("sites", "ST_DWithin(geometry, ST_GeomFromGeoJSON("
                             "'{\"type\":\"Point\",\"coordinates\":[144.5003,-38.0]}'), 0.1001)", "site_id"),
}


def _spatial(layer, where, out):
    def run(spark, d):
        return layers(spark, d).filter(layer, where).select(out)
    return run


def q_semi_in(spark, d):
    return layers(spark, d).filter(
        "orders", "o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
        allow_subqueries=True).select("o_orderkey")


def q_semi_exists(spark, d):
    return layers(spark, d).filter(
        "customer", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
        allow_subqueries=True).select("c_custkey")


def q_anti_not_exists(spark, d):
    from featurespark.operators.semi import anti_filter

    L = layers(spark, d)
    big = L.read("orders").where(F.col("o_totalprice") > 300000)
    return anti_filter(L.read("customer"), big, [("c_custkey", "o_custkey")]).select("c_custkey")


# -- stage 4: geometry -----------------------------------------------------------------
def _geo():
    from featurespark.functions import geometry as G
    from featurespark.operators import features as FT
    from featurespark.operators import spatial as SP

    return G, FT, SP


def q_spatial_join_points(spark, d):
    G, FT, SP = _geo()
    L = layers(spark, d)
    return SP.points_in_polygons(L.read("sites"), L.read("parcels"), ["site_id"], ["parcel_id"])


def q_st_contains_point(spark, d):
    G, FT, SP = _geo()
    L = layers(spark, d)
    pairs = SP.points_in_polygons(L.read("sites"), L.read("zones"), ["site_id"], ["zone_id"])
    return pairs.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_sites"))


def q_spatial_join_boundary(spark, d):
    G, FT, SP = _geo()
    L = layers(spark, d)
    return SP.points_in_polygons(L.read("lattice"), L.read("steps"), ["site_id"], ["step_id"])


def q_spatial_join_sizes(spark, d):
    G, FT, SP = _geo()
    L = layers(spark, d)
    return SP.points_in_polygons(L.read("lattice"), L.read("nested"), ["site_id"], ["square_id"])


def q_spatial_join_hot(spark, d):
    """Most points fall into one cell of the join."""
    G, FT, SP = _geo()
    L = layers(spark, d)
    return SP.points_in_polygons(L.read("crowd"), L.read("zones"), ["site_id"], ["zone_id"])


def q_identify_point(spark, d):
    G, FT, SP = _geo()
    L = layers(spark, d)
    return SP.identify(L.read("sites"), [("zones", L.read("zones"), "zone_id"),
                                         ("parcels", L.read("parcels"), "parcel_id")], ["site_id"])


def _decoded(spark, d, layer):
    G, FT, SP = _geo()
    return FT.with_decoded(layers(spark, d).read(layer), "geometry", "g")


def q_st_area(spark, d):
    G, FT, SP = _geo()
    return _decoded(spark, d, "parcels").select("parcel_id", F.round(G.area("g"), 15).alias("area"),
                                                F.round(G.perimeter("g"), 12).alias("perimeter"))


def q_st_length(spark, d):
    G, FT, SP = _geo()
    z = _decoded(spark, d, "zones")
    line = F.struct(F.lit(2).alias("gtype"), F.col("g.zm").alias("zm"), F.array(F.struct(
        F.lit(2).alias("ptype"), F.array(F.col("g.parts")[0]["rings"][0]).alias("rings"))).alias("parts"))
    return z.select("zone_id", F.round(G.length(line), 12).alias("length"))


def q_st_distance(spark, d):
    G, FT, SP = _geo()
    s = _decoded(spark, d, "sites")
    return s.select("site_id", F.round(G.distance_point_point(
        G.point_x("g"), G.point_y("g"), F.lit(144.5), F.lit(-38.0)), 12).alias("distance"))


def q_st_centroid(spark, d):
    G, FT, SP = _geo()
    c = _decoded(spark, d, "parcels").select("parcel_id", G.centroid("g").alias("c"))
    return c.select("parcel_id", F.round("c.x", 12).alias("cx"), F.round("c.y", 12).alias("cy"))


def q_st_accessors(spark, d):
    G, FT, SP = _geo()
    s = _decoded(spark, d, "sites")
    return s.select("site_id", G.point_x("g").alias("x"), G.point_y("g").alias("y"),
                    G.num_points("g").alias("n_points"))


def q_geometry_extent(spark, d):
    G, FT, SP = _geo()
    z = SP.geometry_extents(layers(spark, d).read("zones"))
    return z.select("zone_id", "extent.xmin", "extent.ymin", "extent.xmax", "extent.ymax")


def q_st_intersects_box(spark, d):
    return layers(spark, d).filter(
        "parcels", "ST_Intersects(geometry, ST_MakeEnvelope(144.2, -38.4, 144.5, -38.1))").select("parcel_id")


def q_st_constructors(spark, d):
    G, FT, SP = _geo()
    e = layers(spark, d).read("events")
    from featurespark.sources.samples import SITE_X, SITE_Y

    pt = G.make_point(F.expr(SITE_X), F.expr(SITE_Y))
    return e.select(F.col("event_id").alias("site_id"), G.geojson(pt).alias("geometry"))


def q_wkb_decode(spark, d):
    G, FT, SP = _geo()
    p = _decoded(spark, d, "parcels")
    return p.select("parcel_id", F.col("g.gtype").alias("gtype"), F.col("g.zm").alias("zm"),
                    F.size("g.parts").alias("n_parts"), F.size(F.col("g.parts")[0]["rings"]).alias("n_rings"),
                    G.num_points("g").alias("n_points"))


def q_geojson_geometry(spark, d):
    G, FT, SP = _geo()
    return _decoded(spark, d, "parcels").select("parcel_id", G.geojson("g").alias("geometry"))


def q_geojson_feature(spark, d):
    G, FT, SP = _geo()
    L = layers(spark, d)
    p = L.read("parcels")
    f = FT.features(p, "geometry", L.attribute_names("parcels"))
    return f.select(F.get_json_object("properties", "$.parcel_id").cast("long").alias("parcel_id"),
                    FT.feature_text().alias("feature"))


GEO_PAGE = dict(f="geojson", where="segment = 'BUILDING'", order_by="acctbal DESC, parcel_id",
                offset=10, count=50)


def q_query_geojson(spark, d):
    return layers(spark, d).query("parcels", **GEO_PAGE).positioned()


def q_feature_collection(spark, d):
    G, FT, SP = _geo()
    r = layers(spark, d).query("parcels", **GEO_PAGE)
    return FT.feature_collection(r.df, r.offset)


def q_layer_extent(spark, d):
    G, FT, SP = _geo()
    return SP.extent(layers(spark, d).read("parcels"))


def q_query_extent(spark, d):
    G, FT, SP = _geo()
    return SP.extent(layers(spark, d).filter("parcels", "segment = 'BUILDING'"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "spatial_join_points": q_spatial_join_points,
    "st_contains_point": q_st_contains_point,
    "spatial_join_boundary": q_spatial_join_boundary,
    "spatial_join_sizes": q_spatial_join_sizes,
    "spatial_join_hot": q_spatial_join_hot,
    "identify_point": q_identify_point,
    "st_area": q_st_area,
    "st_length": q_st_length,
    "st_distance": q_st_distance,
    "st_centroid": q_st_centroid,
    "st_accessors": q_st_accessors,
    "geometry_extent": q_geometry_extent,
    "st_intersects_box": q_st_intersects_box,
    "st_constructors": q_st_constructors,
    "wkb_decode": q_wkb_decode,
    "geojson_geometry": q_geojson_geometry,
    "geojson_feature": q_geojson_feature,
    "query_geojson": q_query_geojson,
    "feature_collection": q_feature_collection,
    "layer_extent": q_layer_extent,
    "query_extent": q_query_extent,
    "query_flagship": q_flagship,
    "scan_layer": q_scan_layer,
    "query_all_attributes": q_query_all_attributes,
    "query_out_fields": q_query_out_fields,
    "query_where": q_query_where,
    "query_where_all": q_query_where_all,
    "query_count_only": q_query_count_only,
    "query_order_by": q_query_order_by,
    "query_order_by_nulls": q_query_order_by_nulls,
    "query_limit": q_query_limit,
    "query_page": q_query_page,
    "query_top_k": q_query_top_k,
    "query_page_unsorted": q_query_page_unsorted,
    "query_page_first": q_query_page_first,
    "query_page_deep": q_query_page_deep,
    "query_page_unsorted_far": q_query_page_unsorted_far,
    "query_json": q_query_json,
    "query_page_count": q_query_page_count,
    "list_layers": q_list_layers,
    "describe_columns": q_describe_columns,
    "feature_count": q_feature_count,
    "describe_layer": q_describe_layer,
    "describe_attributes": q_describe_attributes,
    "predicate_eq": _pred("lineitem", "l_returnflag", "=", "R", ["l_orderkey", "l_linenumber"]),
    "predicate_ne": _pred("orders", "o_orderpriority", "!=", "1-URGENT", ["o_orderkey"]),
    "predicate_gt": _pred("lineitem", "l_quantity", ">", "45", ["l_orderkey", "l_linenumber"]),
    "predicate_lt": _pred("customer", "c_acctbal", "<", "-500.5", ["c_custkey"]),
    "predicate_ge": _pred("customer", "c_name", ">=", "Customer#000001000", ["c_custkey"]),
    "predicate_le": _pred("part", "p_size", "<=", " 3 ", ["p_partkey"]),
    "predicate_like": _pred("customer", "c_name", "LIKE", "%#0000011%", ["c_custkey"]),
    "match_all": q_match_all,
    "unique_values": q_unique_values,
    "unique_values_search": q_unique_values_search,
    "unique_values_truncated": q_unique_values_truncated,
    "suggest_strings": q_suggest_strings,
    "json_dates": q_json_dates,
    "json_decimal": q_json_decimal,
    "json_rows": q_json_rows,
    "feature_attributes": q_feature_attributes,
    "semi_in": q_semi_in,
    "semi_exists": q_semi_exists,
    "anti_not_exists": q_anti_not_exists,
}
for _k, (_layer, _w, _out) in WHERE_CASES.items():
    _QUERIES[_k] = _where(_layer, _w, _out)
for _k, (_layer, _w, _out) in SPATIAL_CASES.items():
    _QUERIES[_k] = _spatial(_layer, _w, _out)


# -- stages 5-7: ingest, registry, reprojection, tiles, streaming -------------------------
_runs: dict[tuple, dict] = {}


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from featurespark.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/featurespark-{name}-{uuid.uuid4().hex[:8]}"


def _uploads(spark, d) -> str:
    """An upload tree written from the tables (kept: listing/discovery keys read it)."""
    key = ("uploads", id(spark), d)
    if key not in _runs:
        from featurespark.sources.samples import write_upload_tree

        _runs[key] = {"up": write_upload_tree(layers(spark, d), _scratch(spark, "uploads"))}
    return _runs[key]["up"]


def _ingested(spark, d) -> dict:
    """One full ingest run (tiles on, sources deleted) over its own upload tree."""
    key = ("ingest", id(spark), d)
    if key not in _runs:
        from featurespark.sources.ingest import IngestOptions, run_ingest
        from featurespark.sources.samples import write_upload_tree

        root = _scratch(spark, "ingest")
        up = write_upload_tree(layers(spark, d), root)
        opts = IngestOptions(uploads=up, output=f"{root}/out", source_epsg=7844,
                             tile_args={"zmin": 8, "zmax": 11, "cap": 50})
        summary = run_ingest(spark, opts)
        _runs[key] = {"root": root, "up": up, "out": opts.output, "summary": summary.collect(),
                      "schema": summary.schema}
    return _runs[key]


def _entries(listing):
    """Uploads by what lies in a dataset folder (or beside them all), with the bytes of the text ones."""
    from featurespark.sources.ingest import upload_files

    f = upload_files(listing).withColumn("entry", F.regexp_extract(F.coalesce("entry", "path"), "/uploads/(.*)$", 1))
    return f.groupBy("entry").agg(F.sum(F.when(F.col("format") == "geojsonl", F.col("length"))).alias("n_bytes"))


def q_ingest_listing(spark, d):
    """Part files have names and, of Parquet, sizes of their own, so the listing is summed up by entry."""
    from featurespark.sources.ingest import list_uploads

    return _entries(list_uploads(layers(spark, d).spark, _uploads(spark, d)))


def q_ingest_datasets(spark, d):
    from featurespark.sources.ingest import find_datasets, list_uploads

    return find_datasets(list_uploads(layers(spark, d).spark, _uploads(spark, d))).select("dataset")


def q_ingest_spatial_layers(spark, d):
    from featurespark.sources.ingest import layer_files, list_uploads, spatial_layers

    s = layers(spark, d).spark
    return spatial_layers(s, layer_files(list_uploads(s, _uploads(spark, d)))).select(
        "dataset", "layer", "format", "has_geometry")


def q_ingest_summary(spark, d):
    run = _ingested(spark, d)
    s = layers(spark, d).spark
    return s.createDataFrame(run["summary"], run["schema"]).select("dataset", "layer", "rows", "status")


def q_ingest_ledger(spark, d):
    """What became of the uploads, by dataset and layer; part files have names of their own."""
    from featurespark.sources.ingest import upload_ledger

    ledger = upload_ledger(layers(spark, d).spark, _ingested(spark, d)["out"])
    return ledger.groupBy("dataset", "layer", "consumed", "reason", "replaced").agg(
        F.countDistinct("run").alias("runs"), F.sum(F.when(F.col("dataset") == "parcels_ds", F.col("length"))).alias("n_bytes"))


def q_layer_statistics(spark, d):
    return Layers(spark, _ingested(spark, d)["out"]).layer_statistics().drop("files")


def q_ingest_layer_roundtrip(spark, d):
    G, FT, SP = _geo()
    out = Layers(spark, _ingested(spark, d)["out"])
    p = FT.with_decoded(out.read("parcels"), "geometry", "g")
    return p.select("parcel_id", "name", "segment", "acctbal", "bbox.xmin", "bbox.ymin", "bbox.xmax",
                    "bbox.ymax", G.geojson("g").alias("geometry"))


def _published(spark, out: str, kind: str, layer: str) -> str:
    from featurespark.sources.manifest import read_manifest

    return f"{out}/{read_manifest(spark, out)[kind][layer]}"


def q_export_geojson(spark, d):
    s = layers(spark, d).spark
    t = s.read.text(_published(s, _ingested(spark, d)["out"], "geojson", "parcels"))
    return t.select(F.get_json_object("value", "$.properties.parcel_id").cast("long").alias("parcel_id"),
                    F.regexp_extract("value", r'^\{"type":"Feature","geometry":(.*),"properties":', 1)
                    .alias("geometry"))


def _ingest_once(spark, d, name, write, **options) -> str:
    """The output of one ingest of an upload tree that ``write`` makes."""
    from featurespark.sources.ingest import IngestOptions, run_ingest

    key = (name, id(spark), d)
    if key not in _runs:
        root = _scratch(spark, name)
        opts = IngestOptions(uploads=write(layers(spark, d), root), output=f"{root}/out", make_tiles=False, **options)
        run_ingest(spark, opts)
        _runs[key] = {"out": opts.output}
    return _runs[key]["out"]


def q_ingest_crs_layer(spark, d):
    """Exports of two layers in different CRS, rounded to a ten-thousandth of a degree."""
    from featurespark.sources.samples import write_crs_tree

    out, s = _ingest_once(spark, d, "crs", write_crs_tree), layers(spark, d).spark
    frames = []
    for layer in ("grid", "degrees"):
        t = s.read.text(_published(s, out, "geojson", layer))
        at = [F.get_json_object("value", f"$.geometry.coordinates[{i}]").cast("double") for i in (0, 1)]
        frames.append(t.select(F.lit(layer).alias("layer"), F.get_json_object(
            "value", "$.properties.site_id").cast("long").alias("site_id"),
            F.round(at[0], 4).alias("lon"), F.round(at[1], 4).alias("lat")))
    return frames[0].unionByName(frames[1])


def q_scan_clustered(spark, d):
    """A box of a layer that ingest has clustered."""
    from featurespark.sources.samples import write_crs_tree

    out = _ingest_once(spark, d, "clustered", write_crs_tree, cluster_bytes=0)
    return Layers(spark, out).filter("degrees", "ST_Intersects(geometry, ST_MakeEnvelope(144.2, -38.4, 144.3, -38.3))") \
        .select("site_id", "bbox.xmin", "bbox.ymin")


def q_ingest_geometry_names(spark, d):
    from featurespark.sources.samples import write_names_tree

    lots = Layers(spark, _ingest_once(spark, d, "names", write_names_tree)).read("lots")
    return lots.select("parcel_id", "bbox", "bbox_1.xmin", "bbox_1.ymax", F.octet_length("SHAPE").alias("n_bytes"))


def _registry(spark, d):
    from featurespark.sources.ingest import published_registry

    return published_registry(layers(spark, d).spark, _ingested(spark, d)["out"])


def q_layer_registry(spark, d):
    return _registry(spark, d)


def q_registry_check(spark, d):
    from featurespark.sources.ingest import registry_check

    return registry_check(_registry(spark, d), Layers(spark, _ingested(spark, d)["out"]).list())


def q_registry_visible(spark, d):
    from featurespark.sources.ingest import visible_layers

    return visible_layers(_registry(spark, d)).select("pos", "id")


def _reprojected(spark, d, epsg, x, y, digits):
    """Fixed grid coordinates brought to longitude and latitude."""
    from featurespark.functions import crs
    from featurespark.functions.geometry import make_point

    e = layers(spark, d).read("events")
    g = e.select(F.col("event_id").alias("site_id"), crs.to_4326(make_point(F.expr(x), F.expr(y)), epsg).alias("g"))
    p = F.col("g.parts")[0]["rings"][0][0]
    return g.select("site_id", F.round(p[0], digits).alias("lon"), F.round(p[1], digits).alias("lat"))


MERCATOR = ("16000000e0 + (event_id * 53 % 1000) * 777e0", "-4500000e0 + (event_id * 29 % 1000) * 777e0")
LAMBERT = ("2300000e0 + (event_id * 53 % 1000) * 400e0", "2300000e0 + (event_id * 29 % 1000) * 400e0")


def q_reproject_3857_4326(spark, d):
    return _reprojected(spark, d, 3857, *MERCATOR, 8)


def q_reproject_tm(spark, d):
    from featurespark.sources.samples import GRID_E, GRID_N

    return _reprojected(spark, d, 7855, GRID_E, GRID_N, 4)


def q_reproject_lambert(spark, d):
    return _reprojected(spark, d, 7899, *LAMBERT, 4)


def _parcel_boxes(spark, d):
    return layers(spark, d).read("parcels").select("parcel_id", F.col("bbox").alias("__bb"))


def q_tile_assign(spark, d):
    from featurespark.operators.tiles import assign_tiles

    return assign_tiles(_parcel_boxes(spark, d), ["parcel_id"], 10, 12).select("parcel_id", "z", "x", "y")


def q_tile_density(spark, d):
    from featurespark.operators.tiles import assign_tiles, tile_density

    return tile_density(assign_tiles(_parcel_boxes(spark, d), ["parcel_id"], 12, 12))


def q_tile_zoom_guess(spark, d):
    from featurespark.operators.tiles import guess_max_zoom

    return guess_max_zoom(_parcel_boxes(spark, d), cap=8)


def q_tile_thin(spark, d):
    from featurespark.operators.tiles import assign_tiles, thin_tiles

    t = assign_tiles(_parcel_boxes(spark, d), ["parcel_id"], 10, 10)
    return thin_tiles(t, "parcel_id", cap=3)


def q_tile_refine(spark, d):
    """Below zoom 9, only tiles that hold more than 12 parcels are divided."""
    from featurespark.operators.tiles import refine_tiles

    return refine_tiles(_parcel_boxes(spark, d), ["parcel_id"], 9, 12, _scratch(spark, "refine"))


def q_tile_pyramid(spark, d):
    """The whole pyramid: zooms 8 to wherever no tile holds more than 40 parcels."""
    from featurespark.operators.tiles import build_tiles

    t = build_tiles(layers(spark, d).read("parcels"), 7844, id_col="parcel_id", zmin=8, zmax=9, cap=40, telling={
        "parcel_id": F.get_json_object("feature", "$.parcel_id").cast("long"), "name": F.get_json_object("feature", "$.name")})
    return t.select("z", "x", "y", "parcel_id", "name")


def q_stream_ingest(spark, d):
    from featurespark.sources.ingest import IngestOptions, run_log
    from featurespark.sources.samples import write_upload_tree
    from featurespark.streaming.arrival import ingest_on_arrival

    s = layers(spark, d).spark
    root = _scratch(spark, "stream")
    up = write_upload_tree(layers(spark, d), root)
    opts = IngestOptions(uploads=up, output=f"{root}/out", make_tiles=False, source_epsg=7844)
    q = ingest_on_arrival(s, opts, f"{root}/checkpoint", available_now=True)
    q.awaitTermination()
    return run_log(s, opts.output).select("dataset", "layer", "rows", "status", "epoch")


_QUERIES.update({
    "ingest_listing": q_ingest_listing,
    "ingest_datasets": q_ingest_datasets,
    "ingest_spatial_layers": q_ingest_spatial_layers,
    "ingest_summary": q_ingest_summary,
    "ingest_ledger": q_ingest_ledger,
    "layer_statistics": q_layer_statistics,
    "ingest_layer_roundtrip": q_ingest_layer_roundtrip,
    "export_geojson": q_export_geojson,
    "layer_registry": q_layer_registry,
    "registry_check": q_registry_check,
    "registry_visible": q_registry_visible,
    "reproject_3857_4326": q_reproject_3857_4326,
    "reproject_tm": q_reproject_tm,
    "reproject_lambert": q_reproject_lambert,
    "ingest_crs_layer": q_ingest_crs_layer,
    "scan_clustered": q_scan_clustered,
    "ingest_geometry_names": q_ingest_geometry_names,
    "tile_pyramid": q_tile_pyramid,
    "tile_refine": q_tile_refine,
    "tile_assign": q_tile_assign,
    "tile_density": q_tile_density,
    "tile_zoom_guess": q_tile_zoom_guess,
    "tile_thin": q_tile_thin,
    "stream_ingest": q_stream_ingest,
})


# -- training-data operators: an optional subpackage -----------------------------------
try:
    import corpus_pipeline
    from featurespark.llm import registry as _llm
except ImportError:          # the subpackage, the pipeline or a library that they need is not there
    _llm = None
else:
    _QUERIES.update(_llm.QUERIES)
    _QUERIES["pipeline"] = corpus_pipeline.run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


# ------------------------------------------------------------------------------------
# DuckDB oracle
# ------------------------------------------------------------------------------------
def _iso(c: str) -> str:
    return (f"CASE WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END")


def _paged(select: str, order: str, limit: int, offset: int = 0) -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY {order}) + {offset} AS pos FROM "
            f"({select} ORDER BY {order} LIMIT {limit} OFFSET {offset}) t")


TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
          "lineitem", "nation", "orders", "pages", "part", "region", "supplier")

_ORACLE = {
    "query_flagship": _paged(
        f"SELECT o_orderkey, o_totalprice, {_iso('o_orderdate')} AS o_orderdate, o_orderdate AS _d "
        "FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
        "o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS LAST", 100, 20).replace(
            "SELECT *,", "SELECT o_orderkey, o_totalprice, o_orderdate,"),
    "scan_layer": "SELECT * FROM lineitem",
    "query_all_attributes": _paged("SELECT * FROM customer", "c_custkey", 1000),
    "query_out_fields": _paged("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
                               "o_orderkey", 1000),
    "query_where": _paged(
        "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem "
        "WHERE l_quantity > 45 AND l_returnflag = 'R'", "l_orderkey, l_linenumber, l_extendedprice", 1000),
    "query_where_all": "SELECT 'lineitem' AS layer, count(*) AS count FROM lineitem",
    "query_count_only": "SELECT 'lineitem' AS layer, count(*) AS count FROM lineitem "
                        "WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07",
    "query_order_by": _paged(
        "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O'",
        "o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey", 1000),
    "query_order_by_nulls": _paged(
        "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS o_orderstatus FROM orders",
        "o_orderstatus DESC NULLS LAST, o_orderkey", 1000, 9500),
    "query_limit": "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey DESC, "
                   "l_linenumber DESC, l_extendedprice DESC) AS pos FROM (SELECT l_orderkey, l_linenumber, "
                   "l_extendedprice FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC, "
                   "l_extendedprice DESC LIMIT 1000) t",
    "query_page": _paged(f"SELECT o_orderkey, {_iso('o_orderdate')} AS o_orderdate FROM orders",
                         "o_orderdate, o_orderkey", 300, 2000),
    "query_top_k": _paged("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem",
                          "l_extendedprice DESC, l_orderkey, l_linenumber", 10),
    "query_page_unsorted": "SELECT l_orderkey, l_linenumber, row_number() OVER () + 20 AS pos "
                           "FROM (SELECT l_orderkey, l_linenumber FROM lineitem LIMIT 100 OFFSET 20) t",
    "query_json": _paged(
        f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_iso('o_orderdate')} AS o_orderdate, "
        "o_orderpriority FROM orders WHERE o_custkey < 100", "o_orderkey", 1000),
    "query_page_count": "SELECT count(*) AS count FROM (SELECT * FROM orders ORDER BY o_orderkey "
                        "LIMIT 1000 OFFSET 14900) t",
    "query_page_first": _paged(f"SELECT o_orderkey, {_iso('o_orderdate')} AS o_orderdate, o_totalprice FROM orders "
                               "WHERE o_orderstatus <> 'F'", "o_orderkey", 1000),
    "query_page_deep": _paged("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem",
                              "l_extendedprice DESC, l_orderkey, l_linenumber", 100, 50000),
    "query_page_unsorted_far": "SELECT l_orderkey, l_linenumber, row_number() OVER () + 30000 AS pos FROM (SELECT "
                               "l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 LIMIT 50 OFFSET 30000) t",
    "list_layers": f"SELECT unnest([{', '.join(repr(t) for t in TABLES)}]) AS layer",
    "describe_columns": "SELECT table_name AS layer, CAST(ordinal_position AS BIGINT) AS pos, "
                        "column_name AS name, data_type AS type, is_nullable = 'YES' AS nullable, "
                        "(lower(column_name) IN ('geometry','geom','shape','wkb_geometry','the_geom') "
                        "OR data_type = 'BLOB') AS is_geometry FROM information_schema.columns "
                        f"WHERE table_name IN ({', '.join(repr(t) for t in TABLES)}) UNION ALL "
                        "SELECT 'zones', * FROM (VALUES (1, 'zone_id', 'INTEGER', true, false), "
                        "(2, 'name', 'VARCHAR', true, false), (3, 'bbox', "
                        "'STRUCT(xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE)', false, false), "
                        "(4, 'geometry', 'BLOB', true, true)) v",
    "describe_attributes": None,  # filled below
    "predicate_eq": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'",
    "predicate_ne": "SELECT o_orderkey FROM orders WHERE o_orderpriority != '1-URGENT'",
    "predicate_gt": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45",
    "predicate_lt": "SELECT c_custkey FROM customer WHERE c_acctbal < -500.5",
    "predicate_ge": "SELECT c_custkey FROM customer WHERE c_name >= 'Customer#000001000'",
    "predicate_le": "SELECT p_partkey FROM part WHERE p_size <= 3",
    "predicate_like": "SELECT c_custkey FROM customer WHERE c_name LIKE '%#0000011%'",
    "match_all": "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_tax, l_discount "
                 "FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity = 50 "
                 "AND a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag "
                 "AND a.l_linestatus IS NOT DISTINCT FROM b.l_linestatus "
                 "AND a.l_tax IS NOT DISTINCT FROM b.l_tax AND a.l_discount IS NOT DISTINCT FROM b.l_discount)",
    "unique_values": "SELECT value, row_number() OVER (ORDER BY value) AS pos FROM (SELECT DISTINCT "
                     "l_shipdate AS value FROM lineitem WHERE l_shipdate IS NOT NULL ORDER BY value LIMIT 200) t",
    "unique_values_search": "SELECT value, row_number() OVER (ORDER BY value) AS pos FROM (SELECT DISTINCT "
                            "p_brand AS value FROM part WHERE p_brand IS NOT NULL AND "
                            "lower(CAST(p_brand AS VARCHAR)) LIKE '%brand#1%' ORDER BY value LIMIT 50) t",
    "unique_values_truncated": "SELECT 'c_mktsegment' AS field, count(*) AS n_values, count(*) >= 5 AS truncated "
                               "FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL "
                               "ORDER BY 1 LIMIT 5) a UNION ALL SELECT 'p_type', count(*), count(*) >= 50 FROM "
                               "(SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL ORDER BY 1 LIMIT 50) b",
    "suggest_strings": "SELECT CAST(value AS VARCHAR) AS suggestion, row_number() OVER (ORDER BY value) AS pos "
                       "FROM (SELECT DISTINCT p_size AS value FROM part WHERE p_size IS NOT NULL AND "
                       "lower(CAST(p_size AS VARCHAR)) LIKE '%1%' ORDER BY value LIMIT 50) t",
    "json_dates": f"SELECT event_id, {_iso('ts')} AS ts FROM events",
    "json_decimal": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) "
                    "AS l_price_dec FROM lineitem",
    "json_rows": "SELECT c_custkey, to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, "
                 "c_nationkey := c_nationkey, c_acctbal := c_acctbal, c_mktsegment := c_mktsegment)) AS json "
                 "FROM customer",
    "feature_attributes": "SELECT n_nationkey, field, value FROM (SELECT n_nationkey, "
                          "CAST(n_nationkey AS VARCHAR) AS n_nationkey_s, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey "
                          "FROM nation) UNPIVOT (value FOR field IN (n_nationkey_s AS 'n_nationkey', n_name, n_regionkey))",
    "semi_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer "
               "WHERE c_mktsegment = 'BUILDING')",
    "semi_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE "
                   "o_custkey = c_custkey AND o_totalprice > 450000)",
    "anti_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE "
                       "o_custkey = c_custkey AND o_totalprice > 300000)",
}

_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS layer, count(*) AS feature_count FROM {t}" for t in TABLES)
_ORACLE["feature_count"] = _COUNTS
_ORACLE["describe_layer"] = (
    f"SELECT c.layer, c.feature_count, CAST(k.n_columns AS BIGINT) AS n_columns, "
    f"CAST(k.n_geometry AS BIGINT) AS n_geometry FROM ({_COUNTS}) c JOIN (SELECT table_name AS layer, "
    "count(*) AS n_columns, sum(CASE WHEN data_type = 'BLOB' THEN 1 ELSE 0 END) AS n_geometry "
    "FROM information_schema.columns GROUP BY table_name) k ON c.layer = k.layer")
_ORACLE["describe_attributes"] = (
    "SELECT 'customer' AS layer, CAST(ordinal_position AS BIGINT) AS pos, column_name AS name, "
    "data_type AS type, true AS nullable, false AS is_geometry FROM information_schema.columns "
    "WHERE table_name = 'customer' UNION ALL SELECT 'parcels', p, n, t, nl, false FROM (VALUES "
    "(1, 'parcel_id', 'BIGINT', true), (2, 'name', 'VARCHAR', true), (3, 'segment', 'VARCHAR', true), "
    "(4, 'acctbal', 'DOUBLE', true), (5, 'bbox', 'STRUCT(xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE)', "
    "false)) v(p, n, t, nl)")
for _k, (_layer, _w, _out) in WHERE_CASES.items():
    _src = _layer if _layer != "orders_nullstatus" else (
        "(SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'F') AS o_orderstatus, o_totalprice, "
        "o_orderdate, o_orderpriority FROM orders)")
    _ORACLE[_k] = f"SELECT {', '.join(_out)} FROM {_src} WHERE ({_w})"


# geometry oracles: the same coordinate arithmetic as ``featurespark.sources.samples``
_PX = "(144e0 + (c_custkey * 37 % 1000) / 1000e0)"
_PY = "(-38.5e0 + (c_custkey * 91 % 1000) / 1000e0)"
_PS = "((1 + c_custkey % 4) / 2000e0)"
_SX = "(144e0 + (event_id * 53 % 1000) / 1000e0 + 0.0003e0)"
_SY = "(-38.5e0 + (event_id * 29 % 1000) / 1000e0 + 0.0004e0)"
_ZX = "(144e0 + (n_nationkey % 5) * 0.2e0)"
_ZY = "(-38.5e0 + floor(n_nationkey / 5) * 0.2e0)"


def _v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def _pos(x: str, y: str) -> str:
    return f"'[' || {_v(x)} || ',' || {_v(y)} || ']'"


_PARCEL_RING = (f"{_pos(_PX, _PY)} || ',' || {_pos(f'{_PX} + {_PS}', _PY)} || ',' || "
                f"{_pos(f'{_PX} + {_PS}', f'{_PY} + {_PS}')} || ',' || {_pos(_PX, f'{_PY} + {_PS}')} "
                f"|| ',' || {_pos(_PX, _PY)}")
_PARCEL_GEOJSON = (f"ST_AsGeoJSON(ST_GeomFromGeoJSON('{{\"type\":\"Polygon\",\"coordinates\":[[' || "
                   f"{_PARCEL_RING} || ']]}}'))")
_PARCEL_PROPS = (f"to_json(struct_pack(parcel_id := c_custkey, name := c_name, segment := c_mktsegment, "
                 f"acctbal := c_acctbal, bbox := struct_pack(xmin := {_PX}, ymin := {_PY}, "
                 f"xmax := {_PX} + {_PS}, ymax := {_PY} + {_PS})))")
_PARCEL_FEATURE = (f"'{{\"type\":\"Feature\",\"geometry\":' || {_PARCEL_GEOJSON} || ',\"properties\":' "
                   f"|| {_PARCEL_PROPS} || '}}'")
_SITE_IN_PARCEL = (f"{_SX} > {_PX} AND {_SX} < {_PX} + {_PS} AND {_SY} > {_PY} AND {_SY} < {_PY} + {_PS}")
_SITE_IN_ZONE = f"{_SX} > {_ZX} AND {_SY} > {_ZY} AND ({_SX} - {_ZX}) + ({_SY} - {_ZY}) < 0.2e0"
_GEO_PAGE_SQL = (f"SELECT 'Feature' AS type, {_PARCEL_GEOJSON} AS geometry, {_PARCEL_PROPS} AS properties, "
                 f"{_PARCEL_FEATURE} AS feature, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, "
                 f"c_custkey) + 10 AS pos FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' "
                 f"ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 10) t")

_ORACLE.update({
    "spatial_join_points": f"SELECT event_id AS site_id, c_custkey AS parcel_id FROM events, customer "
                           f"WHERE {_SITE_IN_PARCEL}",
    "st_contains_point": f"SELECT n_nationkey AS zone_id, count(*) AS n_sites FROM events, nation "
                         f"WHERE {_SITE_IN_ZONE} GROUP BY n_nationkey",
    "identify_point": "SELECT site_id, layer, feature_id FROM (SELECT site_id, layer, feature_id, row_number() "
                      "OVER (PARTITION BY site_id ORDER BY ord DESC, feature_id) AS rn FROM ("
                      f"SELECT event_id AS site_id, 'parcels' AS layer, 1 AS ord, CAST(c_custkey AS VARCHAR) AS "
                      f"feature_id FROM events, customer WHERE {_SITE_IN_PARCEL} UNION ALL "
                      f"SELECT event_id, 'zones', 0, CAST(n_nationkey AS VARCHAR) FROM events, nation "
                      f"WHERE {_SITE_IN_ZONE}) u) r WHERE rn = 1",
    "st_area": f"SELECT c_custkey AS parcel_id, round({_PS} * {_PS}, 15) AS area, "
               f"round(4 * {_PS}, 12) AS perimeter FROM customer",
    "st_length": "SELECT n_nationkey AS zone_id, round(0.4e0 + sqrt(0.08e0), 12) AS length FROM nation",
    "st_distance": f"SELECT event_id AS site_id, round(sqrt(({_SX} - 144.5e0) * ({_SX} - 144.5e0) + "
                   f"({_SY} + 38e0) * ({_SY} + 38e0)), 12) AS distance FROM events",
    "st_centroid": f"SELECT c_custkey AS parcel_id, round({_PX} + {_PS} / 2, 12) AS cx, "
                   f"round({_PY} + {_PS} / 2, 12) AS cy FROM customer",
    "st_accessors": f"SELECT event_id AS site_id, {_SX} AS x, {_SY} AS y, 1 AS n_points FROM events",
    "geometry_extent": f"SELECT n_nationkey AS zone_id, {_ZX} AS xmin, {_ZY} AS ymin, {_ZX} + 0.2e0 AS xmax, "
                       f"{_ZY} + 0.2e0 AS ymax FROM nation",
    "st_intersects_box": f"SELECT c_custkey AS parcel_id FROM customer WHERE {_PX} <= 144.5e0 AND "
                         f"{_PX} + {_PS} >= 144.2e0 AND {_PY} <= -38.1e0 AND {_PY} + {_PS} >= -38.4e0",
    "st_constructors": f"SELECT event_id AS site_id, ST_AsGeoJSON(ST_GeomFromGeoJSON('{{\"type\":\"Point\","
                       f"\"coordinates\":' || {_pos(_SX, _SY)} || '}}')) AS geometry FROM events",
    "wkb_decode": "SELECT c_custkey AS parcel_id, 3 AS gtype, 0 AS zm, 1 AS n_parts, 1 AS n_rings, "
                  "5 AS n_points FROM customer",
    "geojson_geometry": f"SELECT c_custkey AS parcel_id, {_PARCEL_GEOJSON} AS geometry FROM customer",
    "geojson_feature": f"SELECT c_custkey AS parcel_id, {_PARCEL_FEATURE} AS feature FROM customer",
    "query_geojson": f"SELECT type, geometry, properties, pos FROM ({_GEO_PAGE_SQL}) q",
    "feature_collection": "SELECT '{\"type\":\"FeatureCollection\",\"features\":[' || "
                          f"string_agg(feature, ',' ORDER BY pos) || ']}}' AS collection, count(*) AS count "
                          f"FROM ({_GEO_PAGE_SQL}) q",
    "layer_extent": f"SELECT min({_PX}) AS xmin, min({_PY}) AS ymin, max({_PX} + {_PS}) AS xmax, "
                    f"max({_PY} + {_PS}) AS ymax FROM customer",
    "query_extent": f"SELECT min({_PX}) AS xmin, min({_PY}) AS ymin, max({_PX} + {_PS}) AS xmax, "
                    f"max({_PY} + {_PS}) AS ymax FROM customer WHERE c_mktsegment = 'BUILDING'",
})


def _tx(lon: str, z: str) -> str:
    return f"CAST(least(greatest(floor(({lon} + 180e0) / 360e0 * pow(2e0, {z})), 0), pow(2e0, {z}) - 1) AS BIGINT)"


def _ty(lat: str, z: str) -> str:
    return (f"CAST(least(greatest(floor((1e0 - asinh(tan(radians({lat}))) / pi()) / 2e0 * pow(2e0, {z})), 0), "
            f"pow(2e0, {z}) - 1) AS BIGINT)")


def _tiles_sql(z0: int, z1: int) -> str:
    boxes = (f"SELECT c_custkey AS parcel_id, {_PX} AS xmin, {_PY} AS ymin, {_PX} + {_PS} AS xmax, "
             f"{_PY} + {_PS} AS ymax FROM customer")
    zs = f"SELECT b.*, CAST(z.z AS INTEGER) AS z FROM ({boxes}) b, range({z0}, {z1 + 1}) z(z)"
    xr = (f"SELECT parcel_id, z, unnest(generate_series({_tx('xmin', 'z')}, {_tx('xmax', 'z')})) AS x, "
          f"{_ty('ymax', 'z')} AS y0, {_ty('ymin', 'z')} AS y1, (xmin + xmax) / 2 AS cx, "
          f"(ymin + ymax) / 2 AS cy FROM ({zs}) q")
    return f"SELECT parcel_id, z, x, unnest(generate_series(y0, y1)) AS y, cx, cy FROM ({xr}) r"


_REGISTRY_SQL = (
    "SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS pos, id, label, visibleByDefault, opacity, color "
    "FROM (SELECT DISTINCT 'parcels_' || lower(c_mktsegment) AS id, c_mktsegment AS label, "
    "c_mktsegment < 'H' AS visibleByDefault, 0.4e0 AS opacity, '#ef6c00' AS color FROM customer) s "
    "UNION ALL SELECT (SELECT count(DISTINCT c_mktsegment) FROM customer) + 1, 'parcels', 'Parcels', true, "
    "0.15e0, '#ef6c00' UNION ALL SELECT (SELECT count(DISTINCT c_mktsegment) FROM customer) + 2, 'sites', "
    "'Sites', false, 1.0e0, '#1976d2'")

# The inverse projections as textbooks give them (footpoint latitude; series of the conformal latitude),
# on purpose by other formulas than the library's.
def _named(select: list[str]) -> str:
    """Nested selects, each of which adds columns that the next may use."""
    sql = "SELECT * FROM events"
    for cols in select:
        sql = f"SELECT *, {cols} FROM ({sql}) s"
    return sql


_E2 = "(2e0 / 298.257222101e0 - 1e0 / (298.257222101e0 * 298.257222101e0))"
_TM_SQL = "SELECT event_id AS site_id, lon, lat FROM (" + _named([
    f"{_E2} AS e2, 6378137e0 AS a, 300000e0 + (event_id * 53 % 1000) * 100e0 AS ge, "
    "5800000e0 + (event_id * 29 % 1000) * 100e0 AS gn",
    "(1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS e1, e2 / (1 - e2) AS ep, "
    "(gn - 10000000e0) / 0.9996e0 / (a * (1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256)) AS mu",
    "mu + (3 * e1 / 2 - 27 * pow(e1, 3) / 32) * sin(2 * mu) + (21 * e1 * e1 / 16 - 55 * pow(e1, 4) / 32) * sin(4 * mu) "
    "+ 151 * pow(e1, 3) / 96 * sin(6 * mu) + 1097 * pow(e1, 4) / 512 * sin(8 * mu) AS p",
    "ep * cos(p) * cos(p) AS c, tan(p) * tan(p) AS t, a / sqrt(1 - e2 * sin(p) * sin(p)) AS n1, "
    "a * (1 - e2) / pow(1 - e2 * sin(p) * sin(p), 1.5e0) AS r1",
    "(ge - 500000e0) / (n1 * 0.9996e0) AS dd",
    "degrees(p - n1 * tan(p) / r1 * (dd * dd / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * pow(dd, 4) / 24 "
    "+ (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * pow(dd, 6) / 720)) AS lat, "
    "147e0 + degrees((dd - (1 + 2 * t + c) * pow(dd, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) "
    "* pow(dd, 5) / 120) / cos(p)) AS lon"]) + ") q"


def _lm(p: str) -> str:
    return f"(cos({p}) / sqrt(1 - e2 * sin({p}) * sin({p})))"


def _lt(p: str) -> str:
    return f"(tan(pi() / 4 - ({p}) / 2) / pow((1 - e * sin({p})) / (1 + e * sin({p})), e / 2))"


_LAMBERT_SQL = "SELECT event_id AS site_id, lon, lat FROM (" + _named([
    f"{_E2} AS e2, sqrt({_E2}) AS e, radians(-37e0) AS p0, radians(-36e0) AS p1, radians(-38e0) AS p2, "
    f"({LAMBERT[0]}) - 2500000e0 AS dx, ({LAMBERT[1]}) - 2500000e0 AS dy",
    f"(ln({_lm('p1')}) - ln({_lm('p2')})) / (ln({_lt('p1')}) - ln({_lt('p2')})) AS n",
    f"{_lm('p1')} / (n * pow({_lt('p1')}, n)) AS f",
    f"6378137e0 * f * pow({_lt('p0')}, n) AS r0",
    "-sqrt(dx * dx + (r0 - dy) * (r0 - dy)) AS r, atan2(-dx, -(r0 - dy)) AS th",
    "pi() / 2 - 2 * atan(pow(r / (6378137e0 * f), 1 / n)) AS chi",
    "degrees(th / n) + 145e0 AS lon, degrees(chi + (e2 / 2 + 5 * e2 * e2 / 24 + pow(e2, 3) / 12 + 13 * pow(e2, 4) / 360) "
    "* sin(2 * chi) + (7 * e2 * e2 / 48 + 29 * pow(e2, 3) / 240 + 811 * pow(e2, 4) / 11520) * sin(4 * chi) "
    "+ (7 * pow(e2, 3) / 120 + 81 * pow(e2, 4) / 1120) * sin(6 * chi) + 4279 * pow(e2, 4) / 161280 * sin(8 * chi)) AS lat"
]) + ") q"

_PYRAMID_SQL = (
    f"WITH t AS ({_tiles_sql(8, 16)}), per AS (SELECT z, max(n) AS most FROM (SELECT z, x, y, count(*) AS n FROM t "
    "GROUP BY z, x, y) c GROUP BY z), top AS (SELECT min(z) AS z FROM per WHERE z >= 9 AND most <= 40), "
    f"d AS (SELECT *, count(*) OVER (PARTITION BY z, sx, sy) AS dens FROM (SELECT *, {_tx('cx', 'z + 4')} AS sx, "
    f"{_ty('cy', 'z + 4')} AS sy FROM t) u), r AS (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY dens, "
    "parcel_id) AS k FROM d) SELECT r.z, r.x, r.y, r.parcel_id, c_name AS name FROM r, top, customer "
    "WHERE parcel_id = c_custkey AND (r.z = top.z OR r.z < top.z AND k <= 40)")

# a tile is there if its parent holds too many: counts do not grow downwards, so all above it hold too many as well
_REFINE_SQL = (
    f"WITH t AS ({_tiles_sql(9, 24)}), c AS (SELECT z, x, y, count(*) AS n FROM t GROUP BY z, x, y), "
    "here AS (SELECT c.* FROM c LEFT JOIN c p ON p.z = c.z - 1 AND p.x = c.x // 2 AND p.y = c.y // 2 WHERE c.z = 9 OR p.n > 12), "
    "u AS (SELECT t.*, n, n > 12 AND t.z < 24 AS crowded FROM t JOIN here USING (z, x, y)), "
    f"s AS (SELECT *, {_tx('cx', 'z + 4')} AS sx, {_ty('cy', 'z + 4')} AS sy FROM u), "
    "d AS (SELECT *, count(*) OVER (PARTITION BY crowded, z, sx, sy) AS dens FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY dens, parcel_id) AS k FROM d) "
    "SELECT parcel_id, z, x, y FROM r WHERE NOT crowded OR k <= 12")

_SPATIAL_SQL = {
    "where_st_contains": f"nation WHERE 144.253e0 > {_ZX} AND -38.421e0 > {_ZY} AND (144.253e0 - {_ZX}) + "
                         f"(-38.421e0 - {_ZY}) < 0.2e0",
    "where_st_covers": "nation WHERE n_nationkey + 4 >= 7",
    "where_st_contains_edge": "nation WHERE false",
    "where_st_within": f"events WHERE {_SX} > 144.2e0 AND {_SX} < 144.6e0 AND {_SY} > -38.4e0 AND {_SY} < -38e0 AND "
                       f"NOT ({_SX} > 144.3e0 AND {_SX} < 144.4e0 AND {_SY} > -38.3e0 AND {_SY} < -38.2e0)",
    "where_st_intersects_line": f"customer WHERE {_PX} < 144.2003e0 AND {_PX} + {_PS} > 144.2003e0 AND "
                                f"{_PY} <= -37.6e0 AND {_PY} + {_PS} >= -38.45e0",
    "where_st_disjoint": f"customer WHERE {_PX} + {_PS} < 144.1001e0 OR {_PX} > 144.9001e0 OR "
                         f"{_PY} + {_PS} < -38.4999e0 OR {_PY} > -37.5999e0",
    "where_st_dwithin": f"events WHERE sqrt(pow({_SX} - 144.5003e0, 2) + pow({_SY} - least(greatest({_SY}, -38.2e0), "
                        "-37.9e0), 2)) <= 0.05e0",
    "where_st_distance": f"events WHERE sqrt(pow({_SX} - 144.5003e0, 2) + pow({_SY} - least(greatest({_SY}, -38.2e0), "
                         "-37.9e0), 2)) > 0.3e0",
    "where_st_area": f"customer WHERE {_PS} * {_PS} > 0.0000015e0 AND 4 * {_PS} < 0.007e0",
    "where_st_centroid": f"customer WHERE {_PX} + {_PS} / 2 < 144.3001e0",
    "where_st_asgeojson": f"events WHERE CAST({_SX} AS VARCHAR) LIKE '144.05%'",
    "where_st_astext": "events WHERE event_id * 7 % 40 = 7 AND event_id * 3 % 40 = 3",
    "where_st_fromgeojson": f"events WHERE sqrt(pow({_SX} - 144.5003e0, 2) + pow({_SY} + 38e0, 2)) <= 0.1001e0",
}
_IDS = {"events": "event_id", "customer": "c_custkey", "nation": "n_nationkey"}
for _k, _sql in _SPATIAL_SQL.items():
    _ORACLE[_k] = f"SELECT {_IDS[_sql.split()[0]]} AS {SPATIAL_CASES[_k][2]} FROM {_sql}"


_PARCEL_LINE = f"replace({_PARCEL_FEATURE}, ',\"bbox\":' || to_json(struct_pack(xmin := {_PX}, ymin := {_PY}, " \
               f"xmax := {_PX} + {_PS}, ymax := {_PY} + {_PS})), '')"
_NATION_LINE = "'{\"type\":\"Feature\",\"geometry\":null,\"properties\":' || to_json(nation) || '}'"
_PARCEL_BYTES = f"(SELECT CAST(sum(strlen({_PARCEL_LINE}) + 1) AS BIGINT) FROM customer)"
_NATION_BYTES = f"(SELECT CAST(sum(strlen({_NATION_LINE}) + 1) AS BIGINT) FROM nation)"

_ORACLE["spatial_join_hot"] = (
    f"SELECT event_id AS site_id, n_nationkey AS zone_id FROM (SELECT event_id, {CROWD_X} AS x, {CROWD_Y} AS y FROM events) e, nation "
    f"WHERE x > {_ZX} AND y > {_ZY} AND (x - {_ZX}) + (y - {_ZY}) < 0.2e0")
_ORACLE.update({
    "ingest_listing": f"SELECT 'parcels_ds.gdb/parcels.geojsonl' AS entry, {_PARCEL_BYTES} AS n_bytes UNION ALL "
                      f"SELECT 'parcels_ds.gdb/nations.geojsonl', {_NATION_BYTES} UNION ALL "
                      "SELECT 'sites_ds.gdb/sites.parquet', NULL UNION ALL SELECT 'config.json', NULL",
    "ingest_ledger": "SELECT dataset, layer, consumed, reason, false AS replaced, CAST(1 AS BIGINT) AS runs, n_bytes FROM "
                     f"(SELECT 'parcels_ds' AS dataset, 'parcels' AS layer, true AS consumed, 'converted' AS reason, "
                     f"{_PARCEL_BYTES} AS n_bytes UNION ALL SELECT 'parcels_ds', 'nations', false, 'no geometry', {_NATION_BYTES} "
                     "UNION ALL SELECT 'sites_ds', 'sites', true, 'converted', NULL UNION ALL SELECT NULL, NULL, true, 'marker', NULL) t",
    "layer_statistics": f"SELECT 'parcels' AS layer, count(*) AS rows, min({_PX}) AS xmin, min({_PY}) AS ymin, max({_PX} + {_PS}) AS xmax, "
                        f"max({_PY} + {_PS}) AS ymax FROM customer UNION ALL SELECT 'sites', count(*), min({_SX}), min({_SY}), "
                        f"max({_SX}), max({_SY}) FROM events",
    "ingest_datasets": "SELECT 'parcels_ds' AS dataset UNION ALL SELECT 'sites_ds'",
    "ingest_spatial_layers": "SELECT * FROM (VALUES ('parcels_ds', 'parcels', 'geojsonl', true), "
                             "('parcels_ds', 'nations', 'geojsonl', false), ('sites_ds', 'sites', 'parquet', true)) "
                             "v(dataset, layer, format, has_geometry)",
    "ingest_summary": "SELECT 'parcels_ds' AS dataset, 'parcels' AS layer, (SELECT count(*) FROM customer) AS rows, "
                      "'ok' AS status UNION ALL SELECT 'sites_ds', 'sites', (SELECT count(*) FROM events), 'ok' "
                      "UNION ALL SELECT 'parcels_ds', 'nations', 0, 'skipped: no geometry'",
    "ingest_layer_roundtrip": f"SELECT c_custkey AS parcel_id, c_name AS name, c_mktsegment AS segment, "
                              f"c_acctbal AS acctbal, {_PX} AS xmin, {_PY} AS ymin, {_PX} + {_PS} AS xmax, "
                              f"{_PY} + {_PS} AS ymax, {_PARCEL_GEOJSON} AS geometry FROM customer",
    "export_geojson": f"SELECT c_custkey AS parcel_id, {_PARCEL_GEOJSON} AS geometry FROM customer",
    "layer_registry": _REGISTRY_SQL,
    "registry_check": f"SELECT pos, id, id IN ('parcels', 'sites') AS has_layer FROM ({_REGISTRY_SQL}) r",
    "registry_visible": f"SELECT pos, id FROM ({_REGISTRY_SQL}) r WHERE visibleByDefault",
    "reproject_3857_4326": f"SELECT event_id AS site_id, round(degrees(({MERCATOR[0]}) / 6378137e0), 8) AS lon, "
                           f"round(degrees(atan(sinh(({MERCATOR[1]}) / 6378137e0))), 8) AS lat FROM events",
    "reproject_tm": f"SELECT site_id, round(lon, 4) AS lon, round(lat, 4) AS lat FROM ({_TM_SQL}) t",
    "reproject_lambert": f"SELECT site_id, round(lon, 4) AS lon, round(lat, 4) AS lat FROM ({_LAMBERT_SQL}) t",
    "ingest_crs_layer": "SELECT 'grid' AS layer, site_id, round(lon, 4) AS lon, round(lat, 4) AS lat "
                        f"FROM ({_TM_SQL}) t UNION ALL SELECT 'degrees', event_id, round({_SX}, 4), "
                        f"round({_SY}, 4) FROM events",
    "ingest_geometry_names": f"SELECT c_custkey AS parcel_id, c_mktsegment AS bbox, {_PX} AS xmin, "
                             f"{_PY} + {_PS} AS ymax, 93 AS n_bytes FROM customer",
    "tile_pyramid": _PYRAMID_SQL,
    "tile_refine": _REFINE_SQL,
    "scan_clustered": f"SELECT event_id AS site_id, {_SX} AS xmin, {_SY} AS ymin FROM events WHERE {_SX} BETWEEN 144.2e0 AND 144.3e0 "
                      f"AND {_SY} BETWEEN -38.4e0 AND -38.3e0",
    "stream_ingest": "SELECT 'parcels_ds' AS dataset, 'parcels' AS layer, count(*) AS rows, 'ok' AS status, "
                     "CAST(0 AS BIGINT) AS epoch FROM customer UNION ALL SELECT 'sites_ds', 'sites', count(*), 'ok', 0 "
                     "FROM events UNION ALL SELECT 'parcels_ds', 'nations', 0, 'skipped: no geometry', 0",
    "spatial_join_boundary": "SELECT event_id AS site_id, n_nationkey AS step_id FROM (SELECT event_id, "
                             "event_id * 7 % 40 AS x, event_id * 3 % 40 AS y FROM events) e, nation "
                             "WHERE y > 0 AND y < x AND x < n_nationkey + 4",
    "spatial_join_sizes": "SELECT event_id AS site_id, n_nationkey AS square_id FROM (SELECT event_id, "
                          "event_id * 7 % 40 AS x, event_id * 3 % 40 AS y FROM events) e, nation "
                          "WHERE greatest(x, y) < pow(2e0, n_nationkey * 3 - 2)",
    "tile_assign": f"SELECT parcel_id, z, x, y FROM ({_tiles_sql(10, 12)}) t",
    "tile_density": f"SELECT z, x, y, count(*) AS n FROM ({_tiles_sql(12, 12)}) t GROUP BY z, x, y",
    "tile_zoom_guess": (
        "SELECT CAST(coalesce(min(z), 14) AS INTEGER) AS zoom FROM (SELECT z, median(n) AS m FROM ("
        f"SELECT z, {_tx('cx', 'z')} AS x, {_ty('cy', 'z')} AS y, count(*) AS n FROM (SELECT "
        f"{_PX} + {_PS} / 2 AS cx, {_PY} + {_PS} / 2 AS cy, CAST(z.z AS INTEGER) AS z FROM customer, range(0, 15) z(z)) c "
        "GROUP BY ALL) t GROUP BY z) s WHERE m <= 2"),
    "tile_thin": (
        "SELECT parcel_id, z, x, y, dens FROM (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY dens, "
        "parcel_id) AS r FROM (SELECT *, count(*) OVER (PARTITION BY z, sx, sy) AS dens FROM (SELECT *, "
        f"{_tx('cx', 'z + 4')} AS sx, {_ty('cy', 'z + 4')} AS sy FROM ({_tiles_sql(10, 10)}) t) u) v) w WHERE r <= 3"),
})


def oracle_sql() -> dict[str, str]:
    if _llm is not None:
        _ORACLE.update(_llm.ORACLE)
    return {k: v for k, v in _ORACLE.items() if v is not None and k in _QUERIES}
