"""Extra columns may have any name, also those that an operator uses inside."""

from helpers import awkward_rows, frame, prose
from pyspark.sql import functions as F

from featurespark.llm import decontaminate, fill_in_middle, line_dedup, mixing, periodic_runs, sharding, simhash_dedup, url_reputation
from featurespark.llm.shared import fresh

INNER = ["_row", "_aside", "_key", "_tie", "_size", "_range", "_rank", "_bytes0", "_decon", "__decon", "_Decon2", "_n", "_i", "_name", "_src", "_draw", "_block",
         "_below", "_extra", "_always", "_target", "_source_size", "_copies", "_shards", "_order", "_part", "_id", "_removed", "removed", "id",
         "_kept", "fp", "component", "node", "key", "host", "n", "runs", "bad"]


def clashing(spark, rows):
    return frame(spark, rows).withColumns({c: F.concat(F.lit(c + "/"), F.col("doc_id").cast("string")) for c in INNER})


def unchanged(got, but=()):
    for r in got:
        for c in INNER:
            if c not in but:
                assert r[c] == (None if r["doc_id"] is None else f"{c}/{r['doc_id']}"), c


def test_sharding_and_mixing(spark):
    rows = awkward_rows(n=30)
    docs = clashing(spark, rows)
    got = sharding.shard_documents(docs, shards=4).collect()
    want = {(r["doc_id"], r["text"], r["shard"]) for r in sharding.shard_documents(frame(spark, rows), shards=4).collect()}
    unchanged(got)
    assert len(got) == len(rows) and {(r["doc_id"], r["text"], r["shard"]) for r in got} == want
    plan, mixed = mixing.mix(docs, shards=3)
    plain, less = mixing.mix(frame(spark, rows), shards=3)
    assert mixed.columns == docs.columns and mixed.count() == less.count()
    unchanged(mixed.collect())
    unchanged(plan.collect(), mixing.PLAN)
    assert sorted(str((r["doc_id"], r["_copies"], r["_target"])) for r in plan.collect()) == \
        sorted(str((r["doc_id"], r["_copies"], r["_target"])) for r in plain.collect())
    assert plan.columns.count("_size") == 1


def test_filters(spark):
    rows = awkward_rows(n=30)
    docs = clashing(spark, rows)
    bench = spark.createDataFrame([(1, rows[4][1], "x", "y")], "item_id long, text string, _item string, _decon string")
    got = decontaminate.drop_contaminated(docs, bench)
    assert got.columns == docs.columns
    unchanged(got.collect())
    assert got.count() == decontaminate.drop_contaminated(frame(spark, rows), bench).count() < len(rows)
    assert decontaminate.contaminated_pairs(docs, bench).count() == decontaminate.contaminated_pairs(frame(spark, rows), bench).count()
    left = line_dedup.without_lines(docs, line_dedup.repeated_lines(docs))
    assert left.columns == docs.columns
    unchanged(left.collect())
    assert sorted(str(r["text"]) for r in left.collect()) == sorted(
        str(r["text"]) for r in line_dedup.without_lines(frame(spark, rows), line_dedup.repeated_lines(frame(spark, rows))).collect())
    one = simhash_dedup.keep_one(docs)
    assert one.columns == docs.columns
    unchanged(one.collect())


def test_transforms_and_urls(spark):
    rows = awkward_rows(n=10)
    docs = clashing(spark, rows)
    unchanged(periodic_runs.periodic_runs(docs).collect())
    unchanged(fill_in_middle.fill_in_middle(docs).collect())
    pages = docs.withColumn("url", F.concat(F.lit("http://a.b.org/"), F.col("doc_id").cast("string")))
    outcomes = spark.createDataFrame([(1, True, "x"), (2, False, "y")], "doc_id long, bad boolean, id string")
    got = url_reputation.filter_urls(pages, outcomes, id_col="doc_id").collect()
    assert len(got) == len(rows)
    unchanged(got, ("host",))


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "_A int, __a int")
    assert fresh(df, "_a") == "___a" and fresh(df, "b") == "b" and prose
