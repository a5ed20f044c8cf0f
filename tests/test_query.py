"""Layer queries: catalogue, paging, plans, distinct values, spatial join, tiles."""

import os
import time

import pytest
from pyspark.sql import functions as F

from featurespark.errors import LayerQueryError


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalogue(layers):
    assert "lineitem" in layers.names() and "parcels" in layers.names()
    d = layers.describe("events")
    assert d["feature_count"] > 0 and [c["type"] for c in d["columns"]][:2] == ["BIGINT", "TIMESTAMP"]
    with pytest.raises(LayerQueryError):
        layers.validate("nope")
    assert [c["is_geometry"] for c in layers.columns("parcels")][-1] is True


def test_check_order(layers):
    with pytest.raises(LayerQueryError, match="json, geojson"):
        layers.query("orders", f="xml")
    # count-only does not validate fields / order / paging
    r = layers.query("orders", out_fields="bogus", order_by="bogus", count="x", return_count_only="1")
    assert r.to_dict()["count"] == layers.read("orders").count()
    with pytest.raises(LayerQueryError, match="no geometry"):
        layers.query("orders", f="geojson")


def test_plan_shapes(layers):
    r = layers.query("lineitem", where="l_quantity > 45", out_fields="l_orderkey",
                     order_by="l_extendedprice DESC", count=10, offset=5)
    p = plan(r.df)
    assert "TakeOrderedAndProject" in p
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double" in p
    c = layers.count_df("lineitem")
    assert "PushedAggregation: [COUNT(*)]" in plan(c)
    g = layers.query("parcels", f="geojson", order_by="parcel_id", count=3)
    assert "TakeOrderedAndProject" in plan(g.df)


def test_paging_concatenates_to_sorted(layers):
    full = [r["o_orderkey"] for r in layers.read("orders").orderBy("o_totalprice", "o_orderkey")
            .select("o_orderkey").collect()]
    got = []
    for off in range(0, len(full), 400):
        page = layers.query("orders", out_fields="o_orderkey", order_by="o_totalprice, o_orderkey",
                            offset=off, count=400).to_dict()
        got += [f["o_orderkey"] for f in page["features"]]
    assert got == full


def test_unique_values(layers):
    p = plan(layers.unique_values_df("lineitem", "l_shipdate", limit=37))
    assert "partial" in p or "HashAggregate" in p
    assert "TakeOrderedAndProject" in p and "ReadSchema: struct<l_shipdate" in p
    u = layers.unique_values("customer", "c_mktsegment", limit=5)
    assert u["truncated"] is True and len(u["values"]) == 5


def test_file_pages_concatenate_to_the_layer(layers, tmp_path, monkeypatch):
    from featurespark import Layers
    from featurespark.operators import query

    monkeypatch.setattr(query, "BLOCK_ROWS", 64)
    layers.read("orders").repartition(6).write.parquet(str(tmp_path / "orders.parquet"))
    own = Layers(layers.base, str(tmp_path))
    order = own.read("orders").orderBy(query.FILE, query.ROW).select("o_orderkey").collect()
    for where in (None, "o_orderstatus = 'F'"):
        full = order if where is None else own.filter("orders", where).orderBy(query.FILE, query.ROW).select("o_orderkey").collect()
        got = []
        for off in range(0, len(full) + 300, 300):
            got += own.query("orders", where=where, out_fields="o_orderkey", offset=off, count=300).df.collect()
        assert [r[0] for r in got] == [r[0] for r in full]
    late = own.query("orders", out_fields="o_orderkey", offset=len(order) - 40, count=10)
    files = late.df.select("o_orderkey")._jdf.queryExecution().optimizedPlan().toString()
    assert "file_path" in files and "row_index" in files
    # only the blocks of the page reach the sort
    scanned = own.read("orders").count()
    page = query.file_page(own.read("orders"), len(order) - 40, 10)
    below = page._jdf.queryExecution().optimizedPlan().toString()
    assert scanned == len(order) and "Filter" in below


def test_deep_pages(layers, monkeypatch):
    from featurespark.operators import query

    monkeypatch.setattr(query, "DEEP_OFFSET", 100)
    full = [r[0] for r in layers.read("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").collect()]
    for off in (100, 777, len(full) - 3, len(full) + 5):
        page = layers.query("orders", out_fields="o_orderkey", order_by="o_totalprice DESC, o_orderkey", offset=off, count=50)
        assert [r[0] for r in page.df.collect()] == full[off:off + 50]
    tied = layers.query("lineitem", out_fields="l_orderkey", order_by="l_returnflag", offset=2000, count=10)
    assert tied.df.count() == 10


def twelve_files(layers, tmp_path):
    """A layer of 12 files of which all but the first three hold no readable data."""
    import glob

    from featurespark import Layers
    path = str(tmp_path / "twelve.parquet")
    layers.read("orders").repartition(12).write.parquet(path)
    own = Layers(layers.base, str(tmp_path))
    files = sorted(glob.glob(f"{path}/part-*"))
    parts = [[r[0] for r in layers.spark.read.parquet(f).select("o_orderkey").collect()] for f in files]
    for f in files[3:]:
        os.remove(f"{path}/.{os.path.basename(f)}.crc")
        with open(f, "r+b") as h:
            size = os.path.getsize(f)
            h.write(b"\0" * (size - 20_000 if size > 40_000 else size // 2))
            h.truncate(size - 4)
    return own, parts


def test_first_pages_read_the_first_files(layers, tmp_path):
    from featurespark.operators import query

    own, parts = twelve_files(layers, tmp_path)
    df = own.spark.read.schema(layers.read("orders").schema).parquet(own.path("twelve"))
    full = [k for p in parts for k in p]
    for off, n in ((0, 5), (0, len(parts[0])), (3, 20), (len(parts[0]) - 2, 40), (len(parts[0]) + 1, len(parts[1]) - 1)):
        assert [r[0] for r in query.file_page(df, off, n).select("o_orderkey").collect()] == full[off:off + n]
    last = len(parts[0]) + len(parts[1]) + 1
    known = {query.file_key(f): len(p) for f, p in zip(sorted(df.inputFiles()), parts)}
    assert [r[0] for r in query.file_page(df, last, 9, known).select("o_orderkey").collect()] == full[last:last + 9]
    odd = df.where("o_orderkey % 2 = 1")
    page = query.file_page(odd, 0, 4)
    assert [r[0] for r in page.select("o_orderkey").collect()] == [k for k in parts[0] if k % 2][:4]
    leaves = page._jdf.queryExecution().executedPlan().collectLeaves()
    page.collect()
    assert [leaves.apply(i).metrics().get("numFiles").get().value() for i in range(leaves.size())] == [1]
    with pytest.raises(Exception):          # further on, the damage shows
        query.file_page(df, len(full) - 5, 5).collect()


def test_deep_pages_write_places_only_and_leave_nothing(layers, tmp_path, monkeypatch):
    import glob

    from featurespark import Layers
    from featurespark.operators import query
    from featurespark.session import checkpoint_dir
    from featurespark.sources import manifest

    monkeypatch.setattr(query, "DEEP_OFFSET", 100)
    wide = layers.read("orders").withColumn("filler", F.concat(*[F.sha2(F.concat(F.col("o_orderkey"), F.lit(i)), 256) for i in range(12)]))
    wide.write.parquet(str(tmp_path / "wide.parquet"))
    own, written = Layers(layers.base, str(tmp_path)), []
    real = manifest._fs

    def sized(s, p):
        written.append((sum(os.path.getsize(f) for f in glob.glob(f"{p.removeprefix('file://')}/**/*.parquet", recursive=True)),
                        s.read.parquet(p).columns))
        return real(s, p)

    monkeypatch.setattr(manifest, "_fs", lambda s, p: sized(s, p) if "deep-page" in p else real(s, p))
    got = own.query("wide", order_by="o_totalprice DESC, o_orderkey", offset=500, count=20).df.collect()
    want = wide.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(500).limit(20).select("o_orderkey", "filler").collect()
    assert [(r["o_orderkey"], r["filler"]) for r in got] == [tuple(r) for r in want]
    (size, columns), = written
    stored = sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / "wide.parquet/part-*")))
    assert set(columns) == {"__k0", "__k1", "__file", "__row", "__range"} and size < stored / 10
    folder = checkpoint_dir(own.spark).removeprefix("file://")
    assert not glob.glob(f"{folder}/deep-page-*")
    own.add("made", wide.select("o_orderkey", F.col("o_totalprice").alias("p")).groupBy("o_orderkey").agg(F.max("p").alias("p")))
    made = own.query("made", order_by="p, o_orderkey", offset=300, count=7).df.collect()
    assert [r["o_orderkey"] for r in made] == [r[0] for r in wide.orderBy("o_totalprice", "o_orderkey").offset(300).limit(7)
                                               .select("o_orderkey").collect()]
    assert not glob.glob(f"{folder}/deep-page-*")


def test_counts_emit_a_row_a_file(layers, tmp_path):
    from featurespark import Layers

    for name in ("orders", "customer"):
        layers.read(name).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    own = Layers(layers.base, str(tmp_path))
    counted = own.feature_counts()
    p = plan(counted)
    assert p.count("PushedAggregation: [COUNT(*)]") == 2
    assert {r[0]: r[1] for r in counted.collect()} == {n: layers.read(n).count() for n in ("orders", "customer")}


def test_catalogue_follows_changes(layers, tmp_path):
    from featurespark import Layers

    own = Layers.open(layers.base, str(tmp_path))
    assert own.names() == []
    layers.read("nation").write.parquet(str(tmp_path / "n.parquet"))
    assert own.names() == ["n"] and own.attribute_names("n")[0] == "n_nationkey"
    time.sleep(1.1)
    layers.read("region").write.mode("overwrite").parquet(str(tmp_path / "n.parquet"))
    assert own.attribute_names("n")[0] == "r_regionkey"
    counts = own.feature_counts()
    assert counts.collect()[0]["feature_count"] == 5


def test_spatial_predicates_are_pushed(layers, tmp_path):
    from featurespark import Layers

    layers.read("parcels").write.parquet(str(tmp_path / "parcels.parquet"))
    own = Layers(layers.base, str(tmp_path))
    own.spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(own.filter("parcels", "segment = 'BUILDING' AND ST_Intersects(geometry, ST_MakeEnvelope(144.2, -38.4, 144.5, -38.1))"))
    pushed = p[p.index("PushedFilters"):]
    for part in ("LessThanOrEqual(bbox.xmin,144.5)", "GreaterThanOrEqual(bbox.xmax,144.2)", "EqualTo(segment,BUILDING)"):
        assert part in pushed
    for where in ("ST_DWithin(geometry, ST_Point(144.5, -38.0), 0.1)", "ST_Within(geometry, ST_GeomFromText('POLYGON((144 -38, 145 -38, 145 -37, 144 -38))'))"):
        assert "bbox.xmin" in plan(own.filter("parcels", where))
    # a negated or alternative condition must not narrow the scan
    for where in ("NOT ST_Intersects(geometry, ST_Point(144.2, -38.4))", "ST_Intersects(geometry, ST_Point(144.2, -38.4)) OR acctbal > 0"):
        assert "bbox.xmin" not in plan(own.filter("parcels", where))


def test_one_job_describes_all(layers):
    sc = layers.spark.sparkContext
    sc.setJobGroup("describe", "describe")
    assert layers.describe_df(["customer", "orders", "events"]).count() == 3
    sc.setJobGroup("", "")


def test_spatial_join_matches_brute_force(layers):
    from featurespark.operators.spatial import points_in_polygons
    got = {tuple(r) for r in points_in_polygons(layers.read("sites"), layers.read("zones"),
                                                ["site_id"], ["zone_id"]).collect()}
    s = layers.read("sites").select("site_id", F.col("bbox.xmin").alias("x"), F.col("bbox.ymin").alias("y"))
    z = layers.read("zones").select("zone_id", F.col("bbox.xmin").alias("x0"), F.col("bbox.ymin").alias("y0"))
    want = {(r["site_id"], r["zone_id"]) for r in s.crossJoin(z).where(
        "x > x0 AND y > y0 AND (x - x0) + (y - y0) < 0.2").collect()}
    assert got == want and got


def test_spatial_join_sizes_and_edges(layers):
    from featurespark.operators.spatial import points_in_polygons

    pts = {r[0]: (r[0] * 7 % 40, r[0] * 3 % 40) for r in layers.read("events").select("event_id").collect()}
    got = {tuple(r) for r in points_in_polygons(layers.read("lattice"), layers.read("nested"), ["site_id"], ["square_id"]).collect()}
    assert got == {(i, k) for i, (x, y) in pts.items() for k in range(25) if max(x, y) < 2.0 ** (3 * k - 2)}
    got = {tuple(r) for r in points_in_polygons(layers.read("lattice"), layers.read("steps"), ["site_id"], ["step_id"]).collect()}
    assert got == {(i, k) for i, (x, y) in pts.items() for k in range(25) if 0 < y < x < k + 4}


def test_points_are_decoded_once_for_a_join(layers):
    from featurespark.operators.spatial import points_in_polygons

    for points in ("lattice", "crowd"):
        df = points_in_polygons(layers.read(points), layers.read("nested"), ["site_id"], ["square_id"])
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("ArrowEvalPython" in line and "point_array" in line for line in plan.splitlines()) == 1


def test_levels_cover_their_extent(spark):
    from featurespark.operators.spatial import _level

    sizes = [2.0 ** k * f for k in range(-60, 61, 3) for f in (1.0, 1 - 2 ** -52, 1 + 2 ** -52)]
    box = F.struct(F.lit(0.0).alias("xmin"), F.col("s").alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(0.0).alias("ymax"))
    for r in spark.createDataFrame([(s,) for s in sizes], "s double").select("s", _level(box).alias("l")).collect():
        assert 2.0 ** r["l"] >= r["s"]


def test_tiles_build(layers):
    from featurespark.operators.tiles import build_tiles
    t = build_tiles(layers.read("parcels"), 7844, id_col="parcel_id", zmin=6, zmax=9, cap=5).cache()
    rows = t.groupBy("z", "x", "y").count().collect()
    assert rows and max(r["count"] for r in rows) <= 5
    # every feature is in the pyramid
    assert t.select(F.get_json_object("feature", "$.parcel_id")).distinct().count() == layers.read("parcels").count()


def test_stacked_features_all_appear(layers):
    from featurespark.operators import tiles
    same = layers.read("parcels").limit(30).select("parcel_id", "bbox", "geometry")
    one = same.limit(1).select("bbox", "geometry")
    stack = same.select("parcel_id").crossJoin(one)
    t = tiles.build_tiles(stack, 7844, id_col="parcel_id", zmin=3, zmax=4, cap=5)
    assert t.where("z < 24").groupBy("z", "x", "y").count().agg(F.max("count")).first()[0] <= 5
    assert t.where("z = 24").select("feature").distinct().count() == 30


def brute_refine(boxes, z, cap, tiles, last):
    def span(box, z):
        lo, hi = tiles(box[0], box[3], z), tiles(box[2], box[1], z)
        return {(x, y) for x in range(lo[0], hi[0] + 1) for y in range(lo[1], hi[1] + 1)}

    held = {}
    for i, box in boxes.items():
        for t in span(box, z):
            held.setdefault(t, set()).add(i)
    complete, crowded = set(), {}
    while held:
        complete |= {(z, *t, i) for t, own in held.items() if len(own) <= cap or z == last for i in own}
        full = {t: own for t, own in held.items() if len(own) > cap and z < last}
        crowded |= {(z, *t): own for t, own in full.items()}
        z, held = z + 1, {}
        for (x, y), own in full.items():
            for i in own:
                for t in span(boxes[i], z) if len(span(boxes[i], z)) < 50 else [(2 * x + a, 2 * y + b) for a in (0, 1) for b in (0, 1)]:
                    if t[0] // 2 == x and t[1] // 2 == y and t in span(boxes[i], z):
                        held.setdefault(t, set()).add(i)
    return complete, crowded


def test_refinement_matches_brute_force(spark, tmp_path):
    import math
    import random

    from featurespark.operators import tiles

    def at(lon, lat, z):
        n = 2 ** z
        clamp = lambda v: min(max(v, 0), n - 1)
        return clamp(math.floor((lon + 180) / 360 * n)), clamp(math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n))

    rng = random.Random(4)
    boxes = {}
    for i in range(300):
        x, y, w = rng.gauss(145, 0.2), rng.gauss(-38, 0.2), rng.choice([0, 0, 0.001, 0.05])
        boxes[i] = (x, y, x + w, y + w)
    rows = [(i, b) for i, b in boxes.items()]
    df = spark.createDataFrame(rows, "id int, __bb struct<xmin:double,ymin:double,xmax:double,ymax:double>").repartition(3)
    for cap, z in ((6, 5), (40, 8), (500, 3)):
        complete, crowded = brute_refine(boxes, z, cap, at, tiles.LAST_ZOOM)
        got = [(r["z"], r["x"], r["y"], r["id"]) for r in tiles.refine_tiles(df, ["id"], z, cap, f"{tmp_path}/{cap}").collect()]
        assert len(got) == len(set(got)) and complete <= set(got)
        more = {}
        for z_, x, y, i in set(got) - complete:
            more.setdefault((z_, x, y), set()).add(i)
        assert set(more) == set(crowded) and all(own <= crowded[t] and len(own) == cap for t, own in more.items())
        assert {i for *_, i in complete} == set(boxes)
    assert tiles.refine_tiles(df.limit(0), ["id"], 3, 5, f"{tmp_path}/none").count() == 0


def test_a_crowd_does_not_divide_large_features(spark, tmp_path):
    from featurespark.operators import tiles

    rows = [(i, (144.5, -37.5, 144.5, -37.5)) for i in range(60)] + [(100, (141.0, -39.0, 150.0, -34.0))]
    df = spark.createDataFrame(rows, "id int, __bb struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    got = tiles.refine_tiles(df, ["id"], 5, 50, str(tmp_path)).collect()
    assert max(r["z"] for r in got) == tiles.LAST_ZOOM and {r["id"] for r in got if r["z"] == tiles.LAST_ZOOM} >= set(range(60))
    assert 0 < sum(r["id"] == 100 for r in got) <= 4 * (tiles.LAST_ZOOM - 5 + 1)


def test_refined_pyramid_of_a_stored_layer(layers, tmp_path):
    from featurespark import Layers
    from featurespark.operators import tiles

    layers.read("parcels").write.parquet(str(tmp_path / "parcels.parquet"))
    t = tiles.build_tiles(Layers(layers.base, str(tmp_path)).read("parcels"), 7844, zmin=6, zmax=8, cap=5, refine=True,
                          folder=str(tmp_path / "work"))
    ids = F.get_json_object("feature", "$.parcel_id")
    assert t.select(ids).distinct().count() == layers.read("parcels").count()
    assert t.where("z < 24").groupBy("z", "x", "y").count().agg(F.max("count")).first()[0] <= 5
    whole = tiles.build_tiles(layers.read("parcels"), 7844, id_col="parcel_id", zmin=6, zmax=8, cap=5)
    assert t.count() < whole.count()


def test_thinning_reduces_before_the_shuffle(layers):
    from featurespark.operators import tiles
    boxes = layers.read("parcels").select("parcel_id", F.col("bbox").alias("__bb"))
    p = plan(tiles.thin_tiles(tiles.assign_tiles(boxes, ["parcel_id"], 2, 3), "parcel_id", tiles.DEFAULT_CAP))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_entry(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 100 and rows[0]["pos"] == 21


def test_stacks_are_not_spread_over_every_zoom(layers, tmp_path, monkeypatch):
    """Zooms where the corners alone exceed the cap are not counted in all tiles, and the last zoom is not written."""
    import os

    from featurespark.operators import tiles

    one = layers.read("parcels").limit(1).select("bbox", "geometry")
    stack = layers.read("parcels").limit(9).select("parcel_id").crossJoin(one).withColumn("__bb", F.col("bbox"))
    spread = []
    assign = tiles.assign_tiles
    monkeypatch.setattr(tiles, "assign_tiles", lambda df, ids, z0, z1, *a, **k: spread.append(z0) or assign(df, ids, z0, z1, *a, **k))
    assert tiles._top_zoom(stack, "parcel_id", 20, 8) == tiles.LAST_ZOOM and spread == []
    assert tiles._top_zoom(stack, "parcel_id", 5, 9) == 5 and spread == [5]
    monkeypatch.setattr(tiles, "LAST_ZOOM", 14)
    out = tiles.refine_tiles(stack.select("parcel_id", "__bb"), ["parcel_id"], 12, 3, str(tmp_path / "levels"))
    assert sorted(os.listdir(tmp_path / "levels")) == ["z12", "z13"]
    assert out.where("z = 14").select("parcel_id").distinct().count() == 9


def test_stored_pyramid_of_a_stack(layers, tmp_path, monkeypatch):
    """Zooms are stored one by one; the rows are those of the frame, the last zoom whole."""
    from featurespark import Layers
    from featurespark.operators import tiles

    monkeypatch.setattr(tiles, "LAST_ZOOM", 10)
    p = layers.read("parcels").where("parcel_id < 25")
    one = p.where("parcel_id = 3").select("bbox", "geometry")
    p.unionByName(p.drop("bbox", "geometry").where("parcel_id < 7").withColumn("parcel_id", F.col("parcel_id") + 100).crossJoin(one)) \
        .repartition(3).write.parquet(str(tmp_path / "p.parquet"))
    df = Layers(layers.base, str(tmp_path)).read("p")
    args = dict(zmin=7, zmax=8, cap=4, refine=True)
    tiles.write_tiles(df, 7844, str(tmp_path / "t"), folder=str(tmp_path / "w1"), **args)
    rows = [tuple(r) for r in df.sparkSession.read.parquet(str(tmp_path / "t")).select("z", "x", "y", "feature", "geometry").collect()]
    built = tiles.build_tiles(df, 7844, folder=str(tmp_path / "w2"), **args)
    assert sorted(rows) == sorted(tuple(r) for r in built.collect())
    # the last zoom holds the stack whole, in every tile that one of it touches
    last = df.sparkSession.createDataFrame([r for r in rows if r[0] == 10], "z int, x long, y long, feature string, geometry string")
    got = last.select(F.get_json_object("feature", "$.parcel_id").cast("long").alias("parcel_id"), "x", "y")
    stacked = F.expr("parcel_id = 3 or parcel_id >= 100")
    boxes = df.where(stacked).select("parcel_id", F.col("bbox").alias("__bb"))
    want = tiles.assign_tiles(boxes, ["parcel_id"], 10, 10).select("parcel_id", "x", "y").collect()
    assert sorted(map(tuple, got.where(stacked).collect())) == sorted(map(tuple, want)) and len(want) == 8 * len({r[1:] for r in want})


def test_levels_keep_the_tiles_of_a_stack_together(layers, tmp_path, monkeypatch):
    """A level is dealt by tile when it is written, so more tasks than one divide it and each counts a tile once."""
    from featurespark.operators import tiles

    monkeypatch.setattr(tiles, "LAST_ZOOM", 20)
    one = layers.read("parcels").where("parcel_id < 5").select("bbox")
    stack = layers.spark.range(0, 4000, 1, 1).withColumnRenamed("id", "parcel_id").crossJoin(F.broadcast(one)) \
        .select(F.expr("parcel_id * 10").alias("parcel_id"), F.col("bbox").alias("__bb"))
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"      # a test's level is small
    layers.spark.conf.set(size, "1KB")
    try:
        out = tiles.refine_tiles(stack, ["parcel_id"], 18, 50, str(tmp_path / "levels"))
    finally:
        layers.spark.conf.unset(size)
    at = layers.spark.read.parquet(str(tmp_path / "levels" / "z19")).select("x", "y", F.col("_metadata.file_path").alias("f"))
    assert at.select("f").distinct().count() > 1
    assert at.groupBy("x", "y").agg(F.countDistinct("f").alias("n")).agg(F.max("n")).first()[0] == 1
    assert out.where("z = 19").groupBy("x", "y").count().agg(F.max("count")).first()[0] == 50


def stack_of(spark, rows):
    return spark.createDataFrame(rows, "id int, __bb struct<xmin:double,ymin:double,xmax:double,ymax:double>")


def test_large_stacks_are_divided_in_blocks(spark, tmp_path, monkeypatch):
    """Overlapping features that cover many tiles: the rows of every tile counted alone, from a few stored rows a feature."""
    import random
    from collections import Counter, defaultdict

    from featurespark.operators import tiles

    monkeypatch.setattr(tiles, "LAST_ZOOM", 17)
    rng = random.Random(7)
    rows = [(i, (144.0, -38.0, 144.1, -37.95)) for i in range(30)]
    rows += [(30 + i, (144.0 + rng.random() / 20, -38.0, 144.06 + rng.random() / 20, -37.97)) for i in range(2)]
    df, cap = stack_of(spark, rows).repartition(3), 5
    got = [(r["z"], r["x"], r["y"], r["id"]) for r in tiles.refine_tiles(df, ["id"], 12, cap, str(tmp_path / "levels")).collect()]
    held = {z: tiles.assign_tiles(df, ["id"], z, z).withColumn("sx", tiles.tile_x(F.col("cx"), F.lit(z + 4)))
            .withColumn("sy", tiles.tile_y(F.col("cy"), F.lit(z + 4))).collect() for z in range(12, 18)}
    want, open_ = [], None
    for z, found in held.items():
        at = defaultdict(list)
        for r in found:
            if open_ is None or (r["x"] // 2, r["y"] // 2) in open_:
                at[r["x"], r["y"]].append(r)
        crowded = {t for t, own in at.items() if len(own) > cap and z < 17}
        dens = Counter((r["sx"], r["sy"]) for t in crowded for r in at[t])
        for t, own in at.items():
            first = sorted(own, key=lambda r: (dens[r["sx"], r["sy"]], r["id"]))[:cap] if t in crowded else own
            want += [(z, *t, r["id"]) for r in first]
        open_ = crowded
    assert sorted(got) == sorted(want) and len(held[17]) > 20_000
    stored = sum(spark.read.parquet(str(tmp_path / "levels" / f"z{z}")).count() for z in range(12, 17))
    assert 0 < stored < sum(len(held[z]) for z in range(12, 17)) / 2


def test_pyramid_of_large_stacks_is_thinned_in_blocks(spark, tmp_path, monkeypatch):
    """The rows of ``thin_tiles`` over every tile, without a row a tile before they are counted out."""
    from featurespark.operators import tiles

    monkeypatch.setattr(tiles, "LAST_ZOOM", 16)
    rows = [(i, (144.0, -38.0, 144.1, -37.95)) for i in range(12)] + [(20 + i, (144.05 + i / 90, -38.01, 144.2, -37.9)) for i in range(6)]
    rows += [(40 + i, (150.0 + i, -38.01, 150.3 + i, -37.9)) for i in range(6)]
    df = stack_of(spark, rows).repartition(3)
    assert tiles._wide(df, "id", 8, 15) and not tiles._wide(df, "id", 3, 5)
    want = tiles.thin_tiles(tiles.assign_tiles(df, ["id"], 8, 15), "id", 4).drop("dens")
    assign = tiles.assign_tiles
    monkeypatch.setattr(tiles, "assign_tiles", None)
    got = tiles._unfolded(tiles._thinned(df, "id", 8, 15, 4, str(tmp_path / "levels"))).select("id", "z", "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(tiles, "assign_tiles", assign)
    few = tiles._unfolded(tiles._thinned(df, "id", 8, 9, 100, str(tmp_path / "few"))).select("id", "z", "x", "y")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, assign(df, ["id"], 8, 9).select("id", "z", "x", "y").collect()))


def test_what_tiles_tell_is_computed_for_each_feature(layers, tmp_path):
    from featurespark.operators import tiles

    p = layers.read("parcels").where("parcel_id < 30")
    args = dict(id_col="parcel_id", zmin=8, zmax=14, cap=3)
    whole = tiles.build_tiles(p, 7844, folder=str(tmp_path / "a"), **args)
    told = tiles.build_tiles(p, 7844, folder=str(tmp_path / "b"), telling={"name": F.get_json_object("feature", "$.name")}, **args)
    assert told.columns == ["z", "x", "y", "name"] and "get_json_object" not in plan(told)
    want = whole.select("z", "x", "y", F.get_json_object("feature", "$.name"))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))


def test_points_and_polygons_meet_in_blocks(spark, monkeypatch):
    """Stacks of points and polygons: every pair, from fewer joined rows than pairs, however blocks are cut."""
    from featurespark.functions import geometry as G
    from featurespark.functions.wkb import wkb_encode
    from featurespark.operators import spatial as SP

    pts = spark.range(0, 300, 1, 3).withColumn("px", F.expr("id % 3 * 10 + 0.25")).withColumn("py", F.lit(0.5).cast("double"))
    pts = pts.select(F.concat(F.lit("p"), F.col("id")).alias("point"), wkb_encode(G.make_point(F.col("px").cast("double"), F.col("py"))).alias("geometry"))
    at = lambda dx, dy: F.array((F.col("id") % 2 * 10 + dx).cast("double"), F.lit(dy).cast("double"))
    ring = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))
    half = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 0))         # its box has the points, it has not
    polys = spark.range(0, 40, 1, 2).select(F.col("id").alias("poly"), wkb_encode(
        G.make_polygon(F.when(F.col("id") < 4, half).otherwise(ring))).alias("geometry"))
    want = sorted((f"p{p}", q) for p in range(300) for q in range(4, 40) if p % 3 == q % 2)
    top = sorted((f"p{p}", "a", min(str(q) for q in range(4, 40) if p % 3 == q % 2)) for p in range(300) if p % 3 < 2)
    for points, polygons, heavy in ((1 << 11, 1 << 8, 1 << 18), (7, 3, 1 << 18), (50, 100, 300)):
        for name, n in (("_POINTS", points), ("_POLYGONS", polygons), ("_EDGES", heavy)):
            monkeypatch.setattr(SP, name, n)
        got = SP.points_in_polygons(pts, polys, ["point"], ["poly"])
        assert sorted(map(tuple, got.collect())) == want
        found = SP.identify(pts, [("a", polys, "poly")], ["point"])
        assert sorted(map(tuple, found.select("point", "layer", "feature_id").collect())) == top
    monkeypatch.undo()
    assert SP._blocks(SP._kept(pts, ["point"], "geometry"), polys, ["point"], ["poly"], SP.POINT, "geometry").count() < len(want) / 50
