import collections
import hashlib
import random

import pytest
from helpers import awkward_rows, frame, prose
from pyspark.sql import functions as F

from featurespark.llm import fingerprints as fp


def elements(text):
    return set(collections.Counter((text or "").split("\n")).items())


def likeness(a, b):
    x, y = elements(a), elements(b)
    return len(x & y) / len(x | y)


def brute(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, r in enumerate(order):
        text, nxt = r[1] or "", order[k - 1][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        out[r[0]] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited), likeness(text, nxt), edited)
    return out


@pytest.mark.parametrize("group_rows", [7, 4000])
def test_matches_brute_force(spark, group_rows):
    rng = random.Random(1)
    rows = [r for r in awkward_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    lines = [prose(rng, 5) for _ in range(400)]
    for i in range(30):         # long documents that share most lines
        own = lines[:rng.randint(30, 400)]
        for _ in range(rng.randint(0, 60)):
            own[rng.randrange(len(own))] = rng.choice(["", "same", prose(rng, 3)])
        rows.append((100 + i, "\n".join(own), "en", "s", 1, "y"))
    want = brute(rows)
    got = fp.document_fingerprints(frame(spark, rows), group_rows=group_rows).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    seen = collections.defaultdict(set)
    for r in got:
        n, sha, near_e, near_n, edited = want[r["id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(near_e) and r["near_next"] == pytest.approx(near_n)
        seen[text[r["id"]]].add(r["fingerprint"])
        seen[edited].add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in seen.values())
    assert len({min(v) for v in seen.values()}) == len({frozenset(elements(t)) for t in seen})


def test_awkward_rows_and_small_tables(spark):
    rows = awkward_rows()
    got = fp.document_fingerprints(frame(spark, rows), group_rows=9).collect()
    assert len(got) == len(rows) and all(0 <= r["near_next"] <= 1 for r in got)
    assert fp.document_fingerprints(frame(spark, [])).count() == 0
    alone = fp.document_fingerprints(frame(spark, rows[:1])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    same = fp.document_fingerprints(frame(spark, [(None, "a\nb", None, None, None, None)] * 3)).collect()
    assert len(same) == 3


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        common = [rng.getrandbits(62) for _ in range(rng.randint(0, 50))]
        a, b = ([rng.getrandbits(62) for _ in range(rng.randint(0, 4))] for _ in range(2))
        rows.append((common + a, b + common, sorted(a), sorted(b)))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, a array<long>, b array<long>")
    done = fp.peel(fp.subtract(fp.sketch(F.col("x"), 16), fp.sketch(F.col("y"), 16)), 16)
    right = 0
    for r in df.select("a", "b", done.alias("p")).collect():
        assert {f["k"] for f in r["p"]["found"]} <= set(r["a"] + r["b"])
        if not any(c["n"] or c["k"] for table in r["p"]["left"] for c in table):
            right += 1
            assert sorted(f["k"] for f in r["p"]["found"] if f["n"] == 1) == r["a"]
            assert sorted(f["k"] for f in r["p"]["found"] if f["n"] == -1) == r["b"]
    assert right >= 55


def test_group_of(spark):
    bounds = list(range(0, 100, 3))
    got = spark.range(-5, 110).select("id", fp._group_of(F.col("id"), bounds).alias("g")).collect()
    assert all(r["g"] == sum(b < r["id"] for b in bounds) for r in got)


def test_no_python_on_the_main_path(spark):
    plan = fp.document_fingerprints(frame(spark, awkward_rows())) \
        ._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
