"""Ingest job and arrival-driven stream over an upload tree Spark derives from the tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from featurespark import Layers
from featurespark.errors import LayerQueryError
from featurespark.sources import ingest
from featurespark.sources.ingest import IngestOptions, pending_markers, run_ingest, run_log
from featurespark.sources.manifest import read_manifest
from featurespark.sources.samples import write_crs_tree, write_names_tree, write_upload_tree

POINT = '{"type":"Feature","geometry":{"type":"Point","coordinates":[144.5,-38.0]},"properties":{"name":"%s"}}'


def upload(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    return root


def left(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.startswith((".", "_")))


def options(tmp_path, up, **more):
    return IngestOptions(uploads=str(up), output=str(tmp_path / "out"), **{"make_tiles": False, "make_geojson": False, **more})


def test_ingest_and_clean(layers, tmp_path):
    up = write_upload_tree(layers, str(tmp_path))
    opts = options(tmp_path, up, make_tiles=True, make_geojson=True, source_epsg=7844, tile_args={"zmin": 8, "zmax": 9, "cap": 20})
    summary = {(r["layer"], r["status"]) for r in run_ingest(layers.spark, opts).collect()}
    assert summary == {("parcels", "ok"), ("sites", "ok"), ("nations", "skipped: no geometry")}
    out = Layers(layers.spark, str(tmp_path / "out"))
    assert out.names() == ["parcels", "sites"]
    assert out.read("parcels").count() == layers.read("customer").count()
    assert {r["layer"]: r["feature_count"] for r in out.feature_counts().collect()} == {
        "parcels": layers.read("customer").count(), "sites": layers.read("events").count()}
    assert os.path.exists(tmp_path / "out" / "config.json")
    assert {os.path.dirname(p) for p in left(up)} == {"parcels_ds.gdb/nations.geojsonl"}      # not converted, so kept
    manifest = read_manifest(layers.spark, str(tmp_path / "out"))
    assert set(manifest["tiles"]) == set(manifest["geojson"]) == {"parcels", "sites"}
    with open(tmp_path / "out" / f"{manifest['layers']['sites']}.geo.json") as f:
        geo = json.load(f)
    assert geo["columns"]["geometry"]["crs"]["id"] == {"authority": "EPSG", "code": 7844}
    assert geo["columns"]["geometry"]["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]


def test_exports_are_made_as_asked(layers, tmp_path):
    up = upload(str(tmp_path / "up"), {"a.gdb/p.geojsonl": POINT % "x", "config.json": "{}"})
    run_ingest(layers.spark, options(tmp_path, up, make_tiles=True, tile_args={"zmin": 2, "zmax": 3}))
    manifest = read_manifest(layers.spark, str(tmp_path / "out"))
    assert manifest["geojson"] == {} and set(manifest["tiles"]) == {"p"}


def test_odd_paths(layers, tmp_path):
    names = {"a b.gdb/my layer.geojsonl": POINT % "x", "c [1]*.gdb/é+100%25 {x}.geojsonl": POINT % "y",
             "deep/er/D.GDB/none.geojsonl": POINT.replace('{"type":"Point","coordinates":[144.5,-38.0]}', "null") % "z",
             "config.json": "{}"}
    up = upload(str(tmp_path / "up"), names)
    got = {(r["layer"], r["rows"], r["status"]) for r in run_ingest(layers.spark, options(tmp_path, up)).collect()}
    assert got == {("my layer", 1, "ok"), ("é+100%25 {x}", 1, "ok"), ("none", 0, "skipped: no geometry")}
    assert left(up) == ["deep/er/D.GDB/none.geojsonl"]


@pytest.mark.parametrize("bad", [POINT[:60], '{"type":"Feature","geometry":{"type":"Point"},"properties":{}}', "not json", '{"type":"Thing"}'])
def test_damaged_features_fail_the_run(layers, tmp_path, bad):
    files = {"a.gdb/good.geojsonl": POINT % "x", "a.gdb/bad.geojsonl": (POINT % "x") + "\n" + bad + "\n" + (POINT % "y"),
             "config.json": "{}"}
    up = upload(str(tmp_path / "up"), files)
    with pytest.raises(RuntimeError, match="a/bad"):
        run_ingest(layers.spark, options(tmp_path, up))
    assert left(up) == sorted(files)
    assert Layers(layers.spark, str(tmp_path / "out")).names() == [] and not os.path.exists(tmp_path / "out" / "config.json")


def test_duplicates(layers, tmp_path):
    files = {"a.gdb/p.geojsonl": POINT % "first", "b.gdb/p.geojsonl": (POINT % "second") + "\n" + (POINT % "2"), "config.json": "{}"}
    up = upload(str(tmp_path / "up"), files)
    with pytest.raises(LayerQueryError, match="more than one dataset"):
        run_ingest(layers.spark, options(tmp_path, up))
    assert left(up) == sorted(files)
    got = run_ingest(layers.spark, options(tmp_path, up, overwrite_duplicates=True)).collect()
    assert {(r["dataset"], r["status"]) for r in got} == {("a", "skipped: replaced by b"), ("b", "ok")}
    out = Layers(layers.spark, str(tmp_path / "out"))
    assert {r["name"] for r in out.read("p").collect()} == {"second", "2"} and left(up) == []


def test_runs_replace_and_keep_layers(layers, tmp_path):
    up = str(tmp_path / "up")
    for names in (("p", "q"), ("q", "r")):
        upload(up, {f"a.gdb/{n}.geojsonl": POINT % f"{n}{len(names)}{names[0]}" for n in names} | {"config.json": "{}"})
        run_ingest(layers.spark, options(tmp_path, up))
    out = Layers(layers.spark, str(tmp_path / "out"))
    assert {n: out.read(n).first()["name"] for n in out.names()} == {"p": "p2p", "q": "q2q", "r": "r2q"}
    assert run_log(layers.spark, str(tmp_path / "out")).where("status = 'ok'").groupBy("epoch").count().count() == 2
    upload(up, {"a.gdb/p.geojsonl": POINT % "new", "config.json": "{}"})
    run_ingest(layers.spark, options(tmp_path, up))
    assert ingest.remove_unpublished(layers.spark, str(tmp_path / "out")) > 0        # the first run holds no layer now
    assert {n: out.read(n).first()["name"] for n in out.names()} == {"p": "new", "q": "q2q", "r": "r2q"}
    assert ingest.remove_unpublished(layers.spark, str(tmp_path / "out")) == 0
    upload(up, {f"a.gdb/{n}.geojsonl": POINT % "last" for n in "pqr"} | {"config.json": "{}"})
    run_ingest(layers.spark, options(tmp_path, up))
    assert ingest.remove_unpublished(layers.spark, str(tmp_path / "out")) > 0
    assert {out.read(n).first()["name"] for n in out.names()} == {"last"}
    assert run_log(layers.spark, str(tmp_path / "out")).count() == 8


def test_crs_of_each_layer(layers, tmp_path):
    up = write_crs_tree(layers, str(tmp_path))
    run_ingest(layers.spark, options(tmp_path, up, make_geojson=True, delete_sources=False))
    out = str(tmp_path / "out")
    for layer in ("grid", "degrees"):
        text = layers.spark.read.text(f"{out}/{read_manifest(layers.spark, out)['geojson'][layer]}")
        x = text.select(F.get_json_object("value", "$.geometry.coordinates[0]").cast("double").alias("x"))
        assert x.where("x BETWEEN 143 AND 150").count() == layers.read("events").count()
    plain = str(tmp_path / "plain")
    layers.read("sites").drop("bbox").write.parquet(f"{plain}/s.gdb/sites.parquet")
    with pytest.raises(RuntimeError, match="no CRS"):
        run_ingest(layers.spark, options(tmp_path, plain))


def test_clustered_layers_are_passed_over(layers, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq
    monkeypatch.setattr(ingest, "ROW_GROUP", 1)
    monkeypatch.setattr(ingest, "FILE_ROWS", 10)
    up = write_crs_tree(layers, str(tmp_path))
    share = {}
    for cluster in (0, 1 << 40):
        out = str(tmp_path / f"out{cluster}")
        run_ingest(layers.spark, IngestOptions(uploads=up, output=out, make_tiles=False, make_geojson=False, delete_sources=False,
                                               cluster_bytes=cluster))
        got = Layers(layers.spark, out)
        assert got.read("degrees").count() == layers.read("events").count()
        groups = hit = 0
        for f in glob.glob(f"{got.path('degrees')}/*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
                groups += 1
                hit += stats["bbox.xmin"].min <= 144.3 and stats["bbox.xmax"].max >= 144.2 and stats["bbox.ymin"].min <= -38.3 \
                    and stats["bbox.ymax"].max >= -38.4
        share[cluster] = hit / groups
        box = got.filter("degrees", "ST_Intersects(geometry, ST_MakeEnvelope(144.2, -38.4, 144.3, -38.3))")
        assert box.count() == layers.read("events").selectExpr("144e0 + (event_id * 53 % 1000) / 1000e0 + 0.0003e0 AS x",
                                                                "-38.5e0 + (event_id * 29 % 1000) / 1000e0 + 0.0004e0 AS y") \
            .where("x BETWEEN 144.2 AND 144.3 AND y BETWEEN -38.4 AND -38.3").count()
    assert share[0] < 0.1 < share[1 << 40]


def test_curve_keys(spark):
    box = F.struct(F.col("x").alias("xmin"), F.col("x").alias("xmax"), F.col("y").alias("ymin"), F.col("y").alias("ymax"))
    rows = [(x / 8, y / 8) for x in range(8) for y in range(8)] + [(1.0, 1.0), (None, None)]
    got = spark.createDataFrame(rows, "x double, y double").select("x", "y", ingest.curve_key(box, 0.0, 0.0, 1.0, 1.0).alias("k")).collect()
    for r in got:
        if r["x"] is None:
            assert r["k"] is None
            continue
        ix, iy = (min(int(v * 65536), 65535) for v in (r["x"], r["y"]))
        assert r["k"] == sum((ix >> b & 1) << 2 * b | (iy >> b & 1) << 2 * b + 1 for b in range(16))
    flat = spark.createDataFrame(rows, "x double, y double").select(ingest.curve_key(box, 3.0, 0.0, 3.0, 1.0).alias("k"))
    assert flat.where("k is null").count() == 1


def test_geometry_names(layers, tmp_path):
    up = write_names_tree(layers, str(tmp_path))
    run_ingest(layers.spark, options(tmp_path, up))
    out = Layers(layers.spark, str(tmp_path / "out"))
    from featurespark.operators.spatial import extent, extent_column
    lots = out.read("lots")
    assert extent_column(lots.schema) == "bbox_1" and dict(lots.dtypes)["bbox"] == "string"
    assert extent(lots, "SHAPE").first()["xmin"] >= 144.0


def test_failure_in_a_layer_keeps_the_sources(layers, tmp_path, monkeypatch):
    up = upload(str(tmp_path / "up"), {"a.gdb/p.geojsonl": POINT % "x", "a.gdb/q.geojsonl": POINT % "y", "config.json": "{}"})
    before = left(up)
    real = ingest.write_layer

    def broken(df, layer, *a):
        if layer == "q":
            raise OSError("disk full")
        return real(df, layer, *a)

    monkeypatch.setattr(ingest, "write_layer", broken)
    with pytest.raises(RuntimeError, match="disk full"):
        run_ingest(layers.spark, options(tmp_path, up))
    assert left(up) == before and read_manifest(layers.spark, str(tmp_path / "out")) is None
    upload(up, {"config.json": "{broken"})
    monkeypatch.setattr(ingest, "write_layer", real)
    with pytest.raises(json.JSONDecodeError):
        run_ingest(layers.spark, options(tmp_path, up))
    assert left(up) == before


def test_clean_up_failure_is_reported(layers, tmp_path, monkeypatch):
    class Stuck:
        def delete(self, *_):
            return False

        def exists(self, *_):
            return True

        def getFileStatus(self, _):
            return self

        def getLen(self):
            return 1

        def getModificationTime(self):
            return 2

    monkeypatch.setattr(ingest, "_fs", lambda s, p: (Stuck(), p))
    with pytest.raises(RuntimeError, match="2 source"):
        ingest.delete_paths(layers.spark, [("a", 1, 2), ("b", 1, 2)])
    assert ingest.delete_paths(layers.spark, [("a", 1, 3), ("b", 2, 2)]) == ["a", "b"]      # uploaded anew


def test_nothing_to_do(layers, tmp_path):
    up = upload(str(tmp_path / "up"), {"readme.txt": "x", "config.json": "{}"})
    assert run_ingest(layers.spark, options(tmp_path, up)).count() == 0
    assert left(up) == ["config.json", "readme.txt"] and not os.path.exists(tmp_path / "out")


def test_every_upload_of_the_marker_starts_a_run(layers, tmp_path):
    from featurespark.streaming.arrival import ingest_on_arrival
    up, opts, ck = str(tmp_path / "up"), None, str(tmp_path / "ck")
    for turn, name in enumerate(("first", "second")):
        upload(up, {"a.gdb/p.geojsonl": POINT % name, "config.json": json.dumps({"layers": [], "turn": turn})})
        os.utime(os.path.join(up, "config.json"), (1_700_000_000 + turn,) * 2)
        opts = options(tmp_path, up)
        for _ in range(2):          # the second start finds no new marker
            ingest_on_arrival(layers.spark, opts, ck, available_now=True).awaitTermination()
        out = Layers(layers.spark, opts.output)
        assert out.read("p").first()["name"] == name and left(up) == []
        assert run_log(layers.spark, opts.output).count() == turn + 1
    # a marker that stays is not taken twice
    upload(up, {"a.gdb/p.geojsonl": POINT % "third", "config.json": "{}"})
    opts = options(tmp_path, up, delete_sources=False)
    for _ in range(2):
        ingest_on_arrival(layers.spark, opts, ck, available_now=True).awaitTermination()
    assert run_log(layers.spark, opts.output).count() == 3 and pending_markers(layers.spark, opts) == []


class Lost(Exception):
    pass


STEPS = ("write_statistics", "write_ledger", "before commit", "after commit", "replace_file", "delete_paths", "half deleted",
         "before cleaned", "after cleaned")


def lose_at(monkeypatch, step):
    """The driver is lost at a step: what comes before has happened, what comes after has not."""
    real = {n: getattr(ingest, n) for n in ("commit", "replace_file", "delete_paths", "write_ledger", "write_statistics")}

    def lost(*_, **__):
        raise Lost(step)

    def commit(s, out, change, *more):
        cleaning = not more
        if step == ("before cleaned" if cleaning else "before commit"):
            raise Lost(step)
        state = real["commit"](s, out, change, *more)
        if step == ("after cleaned" if cleaning else "after commit"):
            monkeypatch.setattr(ingest, "replace_file", lost)         # nor does anything follow
            raise Lost(step)
        return state

    def half(s, files):
        files = sorted(files)
        real["delete_paths"](s, files[:1])
        raise Lost(step)

    if step in real:
        monkeypatch.setattr(ingest, step, lost)
    elif step == "half deleted":
        monkeypatch.setattr(ingest, "delete_paths", half)
    else:
        monkeypatch.setattr(ingest, "commit", commit)


@pytest.mark.parametrize("step", STEPS)
def test_a_driver_lost_at_any_step(layers, tmp_path, monkeypatch, step):
    from featurespark.streaming.arrival import ingest_on_arrival
    registry = json.dumps({"layers": [{"id": "p"}]})
    up = upload(str(tmp_path / "up"), {"a.gdb/p.geojsonl": POINT % "x", "a.gdb/q.geojsonl": POINT % "y", "a.gdb/notes.pdf": "?",
                                       "config.json": registry})
    opts, ck = options(tmp_path, up), str(tmp_path / "ck")
    with monkeypatch.context() as m:
        lose_at(m, step)
        with pytest.raises(Exception, match=step):
            ingest_on_arrival(layers.spark, opts, ck, available_now=True).awaitTermination()
    out = Layers(layers.spark, opts.output)
    assert out.names() in ([], ["p", "q"])                # all of a run or nothing
    if not out.names():
        assert len(left(up)) == 4
    for _ in range(2):          # the next start finishes or repeats it, the one after finds nothing to do
        ingest_on_arrival(layers.spark, opts, ck, available_now=True).awaitTermination()
    assert out.names() == ["p", "q"] and left(up) == ["a.gdb/notes.pdf"]
    assert [r["id"] for r in ingest.published_registry(layers.spark, opts.output).collect()] == ["p"]
    with open(tmp_path / "out" / "config.json") as f:
        assert f.read() == registry
    log = run_log(layers.spark, opts.output)
    assert log.where("status = 'ok'").count() == 2 and log.select("run").distinct().count() == 1
    assert not ingest.unfinished_runs(layers.spark, opts)


def test_unconverted_uploads_are_kept_and_reported(layers, tmp_path):
    up = str(tmp_path / "up")
    upload(up, {"d.gdb/good.geojsonl": POINT % "x", "d.gdb/plain.geojson": "[]", "d.gdb/sub/deep.geojsonl": POINT % "z", "readme.txt": "hi",
                "d.gdb/E.GDB/inner.geojsonl": POINT % "i", "d.gdb/none.geojsonl": '{"type":"Feature","geometry":null,"properties":{"a":1}}',
                "config.json": "{}"})
    sites = layers.read("sites").drop("bbox").selectExpr("*", "site_id % 2 AS yr")
    sites.write.partitionBy("yr").parquet(f"{up}/d.gdb/years.parquet")
    got = {(r["dataset"], r["layer"], r["rows"], r["status"]) for r in run_ingest(
        layers.spark, options(tmp_path, up, source_epsg=4326)).collect()}
    assert got == {("d", "good", 1, "ok"), ("E", "inner", 1, "ok"), ("d", "years", sites.count(), "ok"),
                   ("d", "none", 0, "skipped: no geometry"), ("d", "plain.geojson", 0, "skipped: unknown format"),
                   ("d", "sub", 0, "skipped: unknown format")}
    kept = ["d.gdb/none.geojsonl", "d.gdb/plain.geojson", "d.gdb/sub/deep.geojsonl", "readme.txt"]
    assert left(up) == kept
    out = Layers(layers.spark, str(tmp_path / "out"))
    assert out.read("years").groupBy("yr").count().count() == 2
    ledger = ingest.upload_ledger(layers.spark, str(tmp_path / "out")).collect()
    reasons = {r["path"].split("/up/")[1]: (r["consumed"], r["reason"], r["layer"]) for r in ledger if "years" not in r["path"]}
    assert reasons == {"d.gdb/good.geojsonl": (True, "converted", "good"), "d.gdb/E.GDB/inner.geojsonl": (True, "converted", "inner"),
                       "config.json": (True, "marker", None), "d.gdb/plain.geojson": (False, "unknown format", None),
                       "d.gdb/sub/deep.geojsonl": (False, "unknown format", None), "readme.txt": (False, "not in a dataset", None),
                       "d.gdb/none.geojsonl": (False, "no geometry", "none")}
    parts = [r for r in ledger if "years" in r["path"]]
    assert len(parts) >= 2 and all(r["consumed"] and r["layer"] == "years" and r["length"] > 0 and not r["replaced"] for r in parts)


def test_uploads_during_a_run_are_kept_and_taken_next(layers, tmp_path, monkeypatch):
    from featurespark.streaming.arrival import ingest_on_arrival
    up = upload(str(tmp_path / "up"), {"a.gdb/p.geojsonl": POINT % "old", "a.gdb/q.geojsonl": POINT % "q", "config.json": '{"layers": []}'})
    opts, ck, real = options(tmp_path, up), str(tmp_path / "ck"), ingest.write_ledger

    def while_running(*a):
        upload(up, {"a.gdb/p.geojsonl": "\n".join([POINT % "new"] * 30), "config.json": '{"layers": [{"id": "p"}]}'})
        real(*a)

    with monkeypatch.context() as m:
        m.setattr(ingest, "write_ledger", while_running)
        ingest_on_arrival(layers.spark, opts, ck, available_now=True).awaitTermination()
    out = Layers(layers.spark, opts.output)
    assert out.read("p").count() == 1 and left(up) == ["a.gdb/p.geojsonl", "config.json"]
    assert [p.split("/up/")[1] for p, _ in pending_markers(layers.spark, opts)] == ["config.json"]
    replaced = ingest.upload_ledger(layers.spark, opts.output).where("replaced").collect()
    assert sorted(r["path"].split("/up/")[1] for r in replaced) == ["a.gdb/p.geojsonl", "config.json"]
    ingest_on_arrival(layers.spark, opts, ck, available_now=True).awaitTermination()
    assert out.read("p").count() == 30 and out.names() == ["p", "q"] and left(up) == []
    assert [r["id"] for r in ingest.published_registry(layers.spark, opts.output).collect()] == ["p"]


def test_two_runs_at_once(layers, tmp_path, monkeypatch):
    ups = [upload(str(tmp_path / f"up{i}"), {f"a.gdb/{n}.geojsonl": POINT % n, "config.json": json.dumps({"layers": [{"id": n}]})})
           for i, n in enumerate("pq")]
    first, second = (IngestOptions(uploads=u, output=str(tmp_path / "out"), make_tiles=False, make_geojson=False) for u in ups)
    real = ingest.write_ledger

    def and_meanwhile(other, times):
        left_over = [other] * times

        def run(*a):
            if left_over:
                run_ingest(layers.spark, left_over.pop())
            real(*a)
        return run

    with monkeypatch.context() as m:        # other uploads: both are published, whichever is first
        m.setattr(ingest, "write_ledger", and_meanwhile(second, 1))
        run_ingest(layers.spark, first)
    out = Layers(layers.spark, first.output)
    assert out.names() == ["p", "q"] and left(ups[0]) == left(ups[1]) == []
    assert len(read_manifest(layers.spark, first.output)["markers"]) == 2
    upload(ups[0], {"a.gdb/p.geojsonl": POINT % "again", "config.json": "{}"})
    with monkeypatch.context() as m:        # the same uploads: taken once, by the one that commits first
        m.setattr(ingest, "write_ledger", and_meanwhile(first, 1))
        assert run_ingest(layers.spark, first).count() == 0
    assert out.read("p").first()["name"] == "again" and left(ups[0]) == []
    assert run_log(layers.spark, first.output).where("layer = 'p'").count() == 2


def test_commits_are_created_never_replaced(layers, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from featurespark.sources import manifest
    s, out = layers.spark, str(tmp_path / "log")

    def add(i):
        return manifest.commit(s, out, lambda state: state | {"runs": state["runs"] + [i]})["version"]

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(add, range(24)))
    assert sorted(got) == list(range(1, 25)) == manifest.versions(s, out)
    state = read_manifest(s, out)
    assert sorted(state["runs"]) == list(range(24)) and manifest.read_version(s, out, 3)["runs"] == state["runs"][:3]
    assert not manifest.put_if_absent(s, manifest.version_path(out, 7), "{}")
    assert not [f for f in os.listdir(f"{out}/_log") if f.endswith(".tmp")]
    with pytest.raises(manifest.Conflict):
        manifest.commit(s, out, lambda state: state, 23, lambda commit: False)
    assert manifest.commit(s, out, lambda state: state, 24, lambda commit: False)["version"] == 25
    assert manifest.trim_log(s, out) == 5 and read_manifest(s, out)["version"] == 25
    with pytest.raises(manifest.Conflict):      # what happened meanwhile cannot be told any more
        manifest.commit(s, out, lambda state: state, 2)


def test_published_layers_are_described_without_reading_files(layers, tmp_path):
    up = write_upload_tree(layers, str(tmp_path))
    run_ingest(layers.spark, options(tmp_path, up, source_epsg=7844))
    out = Layers(layers.spark, str(tmp_path / "out"))
    want = {n: out.read(n).count() for n in out.names()}
    box = {n: tuple(out.extent(n).first()) for n in out.names()}
    before = {n: out.columns(n) for n in out.names()}
    for folder, _, files in os.walk(tmp_path / "out" / "runs"):      # the layers' own files are gone
        for f in files:
            if ".parquet" in folder and "_statistics" not in folder:
                os.remove(os.path.join(folder, f))
    fresh = Layers(layers.spark, str(tmp_path / "out"))
    assert {n: fresh.describe(n)["feature_count"] for n in fresh.names()} == want
    assert {r["layer"]: r["feature_count"] for r in fresh.describe_df().collect()} == want
    assert {n: fresh.columns(n) for n in fresh.names()} == before
    assert {n: tuple(fresh.extent(n).first()) for n in fresh.names()} == box
    assert fresh.query("parcels", return_count_only=True).to_dict()["count"] == want["parcels"]
    table = {r["layer"]: r for r in fresh.layer_statistics().collect()}
    assert {n: r["rows"] for n, r in table.items()} == want and {n: tuple(r)[3:] for n, r in table.items()} == box
    assert sum(fresh.file_rows("sites").values()) == want["sites"]


def test_scheduled_ingest(layers, tmp_path):
    from featurespark.streaming.arrival import scheduled_ingest
    up = upload(str(tmp_path / "up"), {"a.gdb/p.geojsonl": POINT % "x"})
    opts = options(tmp_path, up, delete_sources=False)
    scheduled_ingest(layers.spark, opts, str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert Layers(layers.spark, opts.output).names() == ["p"]
