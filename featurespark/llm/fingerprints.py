"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A document's elements are its paragraphs (lines), each with the number of times
it occurs, hashed to a 64-bit key. A sketch has three tables of cells; a key goes into one cell of
each, which counts its keys and holds the XOR of them and of a check hash. Two
sketches of one size subtract cell by cell: what both documents hold cancels.
A cell that is left with a single key gives it away; taking that key out of its
other cells bares further ones, until nothing is left and the differing keys are
known. If cells remain, the pair is retried with larger sketches: its keys are
dealt into blocks by hash, a small sketch each, and a block that fails again is
sketched anew at twice the size.

The fingerprint is the first sketch, as text; likeness is the share of common
keys: of all keys that either document holds, those that do not differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurespark.llm.shared import materialize

SIDE = 8                 # cells in each of the three tables of a first sketch
PER_BLOCK = 4            # keys of either document for each block of a retry
DOUBLINGS = 6            # sketch sizes that a block tries
GROUP_ROWS = 4000        # documents ordered together


def _place(key: Column, table: Column, side: Column) -> Column:
    """Cell of a key in one of the tables."""
    return F.pmod(F.xxhash64(key, table, side), side).cast("int")


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cell(n, k, x) -> Column:
    return F.struct(n.cast("long").alias("n"), k.cast("long").alias("k"), x.cast("long").alias("x"))


def _let(value: Column, fn) -> Column:
    """Bind a value to a lambda variable, so that it is computed once however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), 0)


def _tables(fn) -> Column:
    return F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), fn)


def _spots(keys: Column, side: Column, of=lambda e: e) -> Column:
    """For each table, ``(cell, key, element)`` of every element."""
    return _tables(lambda t: F.transform(keys, lambda e: F.struct(
        _place(of(e), t, side).alias("i"), of(e).alias("k"), e.alias("e"))))


def sketch(keys: Column, side: Column | int) -> Column:
    """The three tables of an array of keys."""
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))
    side = F.lit(side) if isinstance(side, int) else side
    return F.transform(_spots(keys, side), lambda spots: F.transform(
        F.sequence(F.lit(0), side - 1), lambda i: F.aggregate(
            F.filter(spots, lambda e: e["i"] == i), zero,
            lambda c, e: _cell(c["n"] + 1, c["k"].bitwiseXOR(e["k"]), c["x"].bitwiseXOR(_check(e["k"]))))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda s, t: F.zip_with(s, t, lambda x, y: _cell(
        x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["x"].bitwiseXOR(y["x"]))))


def peel(cells: Column, side: Column | int) -> Column:
    """``struct(left, found)``: what stays in the cells, and the keys recovered with their sign.

    A round takes every key that some cell shows alone and removes it from its
    three cells; rounds go on while they find keys.
    """
    side = F.lit(side) if isinstance(side, int) else side

    def alone(tables):
        return F.array_distinct(F.transform(
            F.filter(F.flatten(tables), lambda c: (F.abs(c["n"]) == 1) & (c["x"] == _check(c["k"]))),
            lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k"))))

    def state(left, found):
        return F.struct(left.alias("left"), found.alias("found"), alone(left).alias("next"))

    def without(tables, spots):
        return F.zip_with(tables, spots, lambda cells, own: F.transform(cells, lambda c, i: F.aggregate(
            F.filter(own, lambda e: e["i"] == i), c, lambda c, e: _cell(
                c["n"] - e["e"]["n"], c["k"].bitwiseXOR(e["k"]), c["x"].bitwiseXOR(_check(e["k"]))))))

    def step(s, _):
        spots = _spots(s["next"], side, lambda p: p["k"])
        after = _let(without(s["left"], spots), lambda left: state(left, F.concat(s["found"], s["next"])))
        return F.when(F.size(s["next"]) == 0, s).otherwise(after)

    none = F.array().cast("array<struct<n:bigint,k:bigint>>")
    return F.aggregate(F.sequence(F.lit(1), side * 3), _let(cells, lambda c: state(c, none)), step,
                       lambda s: F.struct(s["left"].alias("left"), s["found"].alias("found")))


def differing(cells: Column, side: Column | int) -> Column:
    """Number of keys in which two subtracted sketches differ; null if peeling got stuck."""
    return _let(peel(cells, side), lambda done: F.when(
        F.forall(F.flatten(done["left"]), lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["x"] == 0)),
        F.size(done["found"])))


def as_text(cells: Column) -> Column:
    """A sketch as text: count, key and check of every cell that is in use."""
    return F.array_join(F.transform(F.flatten(cells), lambda c: F.when(
        (c["n"] == 0) & (c["k"] == 0) & (c["x"] == 0), F.lit("")).otherwise(
        F.concat_ws(":", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["x"])))), ";")


def paragraph_keys(text: Column) -> Column:
    """A key for each different line of a text and the number of times it occurs."""
    hashes = F.array_sort(F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p, F.lit("paragraph"))))

    def keys(lines, starts):
        return F.transform(starts, lambda s, j: F.xxhash64(
            F.get(lines, s), F.coalesce(F.get(starts, j + 1), F.size(lines)) - s))

    def starts(lines):
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.filter(at, lambda i: (i == 0) | (F.get(lines, i) != F.get(lines, i - 1)))

    return _let(hashes, lambda lines: _let(starts(lines), lambda first: keys(lines, first)))


def _with_next_text(own: DataFrame, group_rows: int) -> DataFrame:
    """Adds ``next``: the text of the document before it by id; of the smallest, the text of the largest.

    Documents are dealt into groups of neighbouring ids; the last document of a group visits
    the group after it, and the largest of all the first.
    """
    spark = own.sparkSession
    parts = max(1, -(-own.select("id").count() // group_rows))
    bounds = []
    if parts > 1:
        bounds = sorted(set(own.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts))
                            .first()[0] or []))
    group = _group_of(F.col("id"), bounds)
    tops = own.filter("id is not null").groupBy(group.alias("g")).agg(F.max("id").alias("top")).orderBy("g").collect()
    guests = [(a["top"], b["g"]) for a, b in zip(tops, tops[1:])]
    if tops:
        guests.append((tops[-1]["top"], min(0, tops[0]["g"])))
        guests.append((tops[-1]["top"], tops[0]["g"])) if tops[0]["g"] > 0 else None
    kind = own.schema["id"].dataType.simpleString()
    visit = F.broadcast(spark.createDataFrame(guests, f"top {kind}, to int"))        # a row for each group
    visitors = own.join(visit, own["id"] == visit["top"]).select(own["id"], "text", F.col("to").alias("g"),
                                                                 F.lit(0).alias("home"))
    home = own.select("id", "text", group.alias("g"), F.lit(1).alias("home"))
    w = Window.partitionBy("g").orderBy("home", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return home.unionByName(visitors).withColumn("next", F.coalesce(F.lag("text").over(w), F.col("text"))) \
        .filter("home = 1").select("g", "id", "text", "next")


def _group_of(key: Column, bounds: list) -> Column:
    """Number of bounds below the key, by a search of two levels; a null key is below all."""
    if not bounds:
        return F.lit(0)
    wide = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i:i + wide] for i in range(0, len(bounds), wide)]
    row = F.size(F.filter(F.lit([r[0] for r in rows]), lambda b: b < key)) - 1
    inner = F.size(F.filter(F.get(F.array(*[F.lit(r) for r in rows]), row), lambda b: b < key))
    return F.when(key.isNull() | (row < 0), 0).otherwise(row * wide + inner).cast("int")


def _likeness(n, m, d) -> Column:
    """Common keys over all keys of two documents with ``n`` and ``m`` keys of which ``d`` differ."""
    return F.when(n + m == 0, 1.0).otherwise((n + m - d) / (n + m + d))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text has the last half of the code points replaced by as many from the start of the
    next document by descending id (after the last, the first). A null text is empty, which is one
    empty paragraph. Rows that share an id are neighbours in order of a hash of their text; null ids
    come after all others. A lone document is its own next.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = materialize(_with_next_text(own, group_rows).select(
        F.monotonically_increasing_id().alias("row"), "id", n.cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"), paragraph_keys(F.col("text")).alias("keys"),
        paragraph_keys(edited).alias("edited_keys"), paragraph_keys(F.col("next")).alias("next_keys")), "paragraphs")
    names = ["keys", "edited_keys", "next_keys"]
    first = rows.withColumns({f"{k}_cells": sketch(F.col(k), SIDE) for k in names}) \
        .withColumn("near_e", differing(subtract(F.col("keys_cells"), F.col("edited_keys_cells")), SIDE)) \
        .withColumn("near_n", differing(subtract(F.col("keys_cells"), F.col("next_keys_cells")), SIDE)) \
        .drop(*[f"{k}_cells" for k in names])
    return _retried(materialize(first, "fingerprints")).select(
        "id", "n_chars", "edited_sha256", as_text(sketch(F.col("keys"), SIDE)).alias("fingerprint"),
        as_text(sketch(F.col("edited_keys"), SIDE)).alias("edited_fingerprint"), "near_edited", "near_next")


def _retried(kept: DataFrame) -> DataFrame:
    """Differences of the pairs that the first sketch could not tell, block by block, and the likeness."""
    pairs = kept.select("row", F.explode(F.array(
        F.struct(F.lit("e").alias("pair"), F.col("near_e").alias("d"), F.col("edited_keys").alias("other")),
        F.struct(F.lit("n").alias("pair"), F.col("near_n").alias("d"), F.col("next_keys").alias("other")))).alias("p"),
        "keys").filter("p.d is null").select("row", "p.pair", "keys", F.col("p.other").alias("other"))
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.size("keys"), F.size("other")) / PER_BLOCK)).cast("int")
    sides = pairs.withColumn("blocks", blocks).select("row", "pair", "blocks", F.explode(F.concat(
        F.transform("keys", lambda k: F.struct(F.lit(True).alias("own"), k.alias("k"))),
        F.transform("other", lambda k: F.struct(F.lit(False).alias("own"), k.alias("k"))))).alias("e"))
    dealt = sides.select("row", "pair", F.pmod(F.xxhash64("e.k", F.lit("block")), "blocks").alias("block"), "e.own", "e.k") \
        .groupBy("row", "pair", "block").agg(
            F.collect_list(F.when(F.col("own"), F.col("k"))).alias("a"),
            F.collect_list(F.when(~F.col("own"), F.col("k"))).alias("b"))

    def attempt(found, side):
        return F.when(found.isNotNull(), found).otherwise(
            differing(subtract(sketch(F.col("a"), side), sketch(F.col("b"), side)), side))

    sides = F.array(*[F.lit(SIDE << level) for level in range(DOUBLINGS + 1)])
    tried = F.aggregate(sides, F.lit(None).cast("int"), attempt)
    # sketches that fail at every size leave the block to a plain comparison of its keys
    plain = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    again = dealt.withColumn("d", F.coalesce(tried, plain)).groupBy("row") \
        .agg(F.sum(F.when(F.col("pair") == "e", F.col("d"))).alias("again_e"),
             F.sum(F.when(F.col("pair") == "n", F.col("d"))).alias("again_n"))
    n = {k: F.size(k) for k in ("keys", "edited_keys", "next_keys")}
    return kept.join(again, "row", "left").withColumns({
        "near_edited": _likeness(n["keys"], n["edited_keys"], F.coalesce("near_e", "again_e")),
        "near_next": _likeness(n["keys"], n["next_keys"], F.coalesce("near_n", "again_n"))})


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")) \
        .withColumnRenamed("id", "doc_id")
