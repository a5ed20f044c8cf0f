import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from helpers import awkward_rows, frame, prose

from pyspark.sql import functions as F

from featurespark.llm import fill_in_middle as fim
from featurespark.llm import periodic_runs as pr
from featurespark.llm import url_reputation as ur

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- periodic runs -------------------------------------------------------------------------
def brute_runs(words, least):
    n, out = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - s
            if length >= max(least, 2 * p) and not any(a <= s and s + length <= a + l and q < p for a, l, q in out):
                out.add((s, length, p))
    return sorted((s, l, p) for s, l, p in out)


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(words[k] == words[k + p] for k in range(len(words) - p)))


def brute_collapse(words, runs):
    gone = {k for s, l, p in runs for k in range(s + p, s + l)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_text(rng):
    kind = rng.randrange(5)
    letters = [chr(97 + k) for k in range(rng.choice([1, 2, 2, 3, 5, 30]))]
    words = [rng.choice(letters) for _ in range(rng.randint(0, 120))]
    if kind == 1:
        words = (words[:rng.randint(1, 20)] * 40)[:rng.randint(1, 200)] if words else words
    if kind == 2:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        words = words[:40] + unit * rng.randint(2, 6) + words[40:] + (unit + ["x"] + unit) * 3
    if kind == 3:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(2, 8)):
            a, b = b, b + a
        words = b
    return words


def test_runs_match_brute_force():
    rng = random.Random(5)
    texts = [periodic_text(rng) for _ in range(1500)]
    for least in (12, 2, 7):
        found, kept = pr.collapse(pa.array([" ".join(w) for w in texts]), least)
        for words, runs, text in zip(texts, found, kept):
            want = brute_runs(words, least)
            assert [tuple(r) for r in runs.tolist()] == want, words
            assert text.decode() == brute_collapse(words, want)
    for words in texts[:200]:
        for s, l, p in brute_runs(words, 12):
            assert smallest_period(words[s:s + l]) == p


def test_runs_do_not_depend_on_neighbouring_documents():
    rng = random.Random(6)
    texts = [" ".join(periodic_text(rng)) for _ in range(60)]
    texts += texts[:20] + ["again and again " * 30] * 3
    together, _ = pr.collapse(pa.array(texts), 12)
    for text, runs in zip(texts, together):
        alone, _ = pr.collapse(pa.array([text]), 12)
        assert alone[0].tolist() == runs.tolist()


def test_runs_of_long_texts():
    n = 60_000
    for unit in (["w"], [f"w{k}" for k in range(9_000)], [f"w{k % 77}{k % 5}" for k in range(385)]):
        words = (unit * (n // len(unit) + 1))[:n]
        (runs,), (kept,) = pr.collapse(pa.array([" ".join(["head"] + words)]), 12)
        assert runs.tolist() == [[1, n, len(unit)]]
        assert kept.decode().split() == ["head"] + unit


def test_sets_that_merge_are_sorted_anew():
    # two blocks with many repeats of one word each, apart from each other: large sets meet late
    words = []
    for k in range(200):
        words += ["a", "b", "c", "d", "e", "f", "g", f"x{k % 2}", f"y{k // 2 % 2}", f"z{k // 4 % 3}"]
    (runs,), _ = pr.collapse(pa.array([" ".join(words)]), 12)
    assert [tuple(r) for r in runs.tolist()] == brute_runs(words, 12)


def test_periodic_runs_of_awkward_rows(spark):
    rows = awkward_rows() + [(900, "b a " * 9 + "\nend", "en", "s", 1, "x"), (901, "b\u00a0a " * 14, "en", "s", 1, "x")]
    out = pr.periodic_runs(frame(spark, rows).withColumn("periodic", F.lit(1))).collect()
    assert len(out) == len(rows) and out[0].__fields__[-1] == "periodic"
    for r in out:
        words = WORD.findall(r["text"] or "")
        want = brute_runs(words, 12) if len(words) < 500 else [tuple(x) for x in r["periodic"]["runs"]]
        assert [tuple(x) for x in r["periodic"]["runs"]] == want
        assert r["periodic"]["collapsed"] == brute_collapse(words, want)
    assert sum(bool(r["periodic"]["runs"]) for r in out) == 2
    assert pr.periodic_runs(frame(spark, [])).count() == 0


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in awkward_rows(n=60)] + [(1000 + k, prose(rng, rng.randint(1, 90))) for k in range(300)]
    rows += [(5000 + k, " ".join(periodic_text(rng))) for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pr.op11_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    want = []
    for i, text in rows:
        words = WORD.findall(text or "")
        n = len(words)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words, 12) if n < 500 else None
        if runs is None:
            continue
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want.append((i, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     sha("".join("%d,%d,%d\n" % r for r in runs)), sha(brute_collapse(words, runs))))
    long = {i for i, t in rows if len(WORD.findall(t or "")) >= 500}
    assert sorted((tuple(r) for r in got if r["doc_id"] not in long), key=lambda r: (str(r[0]), r[6], r[7])) == \
        sorted(want, key=lambda r: (str(r[0]), r[6], r[7]))
    assert len(got) == len(rows) and sum(r["n_runs"] > 0 for r in got) > 60


# -- fill in the middle ---------------------------------------------------------------------
def brute_fim(doc, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, monkeypatch):
    rng = random.Random(9)
    rows = awkward_rows(n=60) + [(700 + k, t, "en", "s", 1, "x") for k, t in enumerate(
        ["\n", "\n\n\n", "a\n", "\na", "a<", "<P", "S>\n<", "x<P>y", "<M>", "a\r\nb", "<\n<S\n<P\n>\n" * 9, "ü\n日本\n👍" * 40])]
    rows += [(800 + k, "\n".join(prose(rng, 4) for _ in range(rng.randint(1, 60))), "en", "s", 1, "x") for k in range(200)]
    for bytes_, rate, spm in ((1 << 24, 100, 50), (300, 60, 0), (1, 0, 50)):
        monkeypatch.setattr(fim, "GROUP_BYTES", bytes_)
        docs = frame(spark, rows).withColumn("fim", F.lit(1))
        out = fim.fill_in_middle(docs, rate=rate, spm_rate=spm)
        out = out.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
        assert len(out) == len(rows)
        for r in out:
            assert tuple(r["fim"]) == brute_fim(r["doc_id"], r["text"], rate, spm), r["text"]
            assert r["back"] == (r["text"] or "")
        assert rate or {r["fim"]["form"] for r in out} == {"plain"}
    assert {r["fim"]["form"] for r in fim.fill_in_middle(docs).collect()} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame(spark, [])).count() == 0


def test_markers_must_be_told_apart(spark):
    for bad in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("<<P>>", "<P>", "<M>"), ("aa", "b", "aab"), ("x.x", "b", "c")):
        with pytest.raises(ValueError):
            fim.Markers(*bad)
    marks = fim.Markers("[pre]", "[suf]", "[mid]")
    docs = spark.createDataFrame([(k, "a\nb[suf\nc\n" + "d\n" * k) for k in range(30)], "doc_id long, text string")
    for r in fim.fill_in_middle(docs, marks=marks).withColumn(
            "back", fim.restored(F.col("fim.output"), F.col("fim.form"), marks)).collect():
        assert r["back"] == r["text"] and r["fim"]["form"] != "plain"


# -- url filter -------------------------------------------------------------------------------
def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path, rules):
    fits = []
    for action, rule in rules:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), action == "block", rule))
    return max(fits, default=(0, None, None))[1:]


def brute_parts(host):
    name = re.sub(r"\.?(:[0-9]*)?$", "", re.sub(r"^.*@", "", host))
    def suffix(n):
        two = ".".join(n.split(".")[-2:])
        if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", n) or n.startswith("["):
            return n
        return two if two in ur.SUFFIXES else n.split(".")[-1]
    s = suffix(name)
    domain = name if s == name else ".".join(name.split(".")[-3 if "." in s else -2:])
    return domain, suffix(re.sub(r"\.?(:[0-9]*)?$", "", re.sub(r"^.*@", "", domain)))


def brute_blocked(pages, outcomes, z=1.645, max_bad=0.5):
    import collections
    by_id = collections.defaultdict(list)
    for i, bad in outcomes:
        if i is not None and bad is not None:
            by_id[i].append(bad)
    hosts = collections.defaultdict(lambda: [0, 0])
    for i, url in pages:
        c = hosts[brute_host(url)[0]]
        for bad in by_id.get(i, []):
            c[0] += 1
            c[1] += bad
    domains, suffixes = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(lambda: [0, 0])
    for h, (n, b) in hosts.items():
        d, s = brute_parts(h)
        for c in (domains[d], suffixes[s]):
            c[0] += n
            c[1] += b

    def strength(groups):
        num = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in groups if n)
        den = sum(n * (n - 1) * m * (1 - m) for n, b, m in groups if n)
        return 1 / min(0.999, max(1e-6, num / den)) - 1 if den else 10.0
    n = sum(c[0] for c in hosts.values())
    top = (sum(c[1] for c in hosts.values()) + 0.5) / (n + 1)
    k = strength([(*c, top) for c in suffixes.values()])
    suffix = {s: (k * top + b) / (k + n) for s, (n, b) in suffixes.items()}
    above = {d: suffix[brute_parts(d)[1]] for d in domains}
    k = strength([(*c, above[d]) for d, c in domains.items()])
    domain = {d: (k * above[d] + b) / (k + n) for d, (n, b) in domains.items()}
    prior = {h: domain[brute_parts(h)[0]] for h in hosts}
    k = strength([(*c, prior[h]) for h, c in hosts.items()])
    out = {}
    for h, (n, b) in hosts.items():
        mean = (k * prior[h] + b) / (k + n)
        out[h] = mean, mean - z * (mean * (1 - mean) / (k + n + 1)) ** 0.5 > max_bad
    return out


def urls(rng):
    rows, outcomes = [], []
    rate = {f"s{d}.farm{d % 3}.com": (0.97 if d % 3 == 0 else 0.05) for d in range(12)}
    rate |= {f"h{k}.co.uk": 0.1 for k in range(6)} | {"www.bad.co.uk": 0.95, "big.example.org": 0.02}
    i = 0
    for host, p in rate.items():
        for _ in range(400 if host.startswith("big") else rng.randint(1, 40)):
            rows.append((i, f"http://{host.upper() if i % 5 == 0 else host}/en/{i}?q#f"))
            if rng.random() < 0.5:
                outcomes.append((i, rng.random() < p))
            i += 1
    odd = [None, "", "no scheme", "http://", "://x", "http://A.Example.NET/en/a?b", "http://example.net", "http://example.net?x",
           "http://notexample.com/de/", "https://u:p@Example.com:80/de/x#y://z", "ftp://10.0.0.1/a", "http://[::1]:8/b", "http://z.[x.y/c",
           "http://a.org./fr/", "http://a.org/fr/x/../y", "HTTP://ÄB.org/fr/Ü", "http://new.farm0.com/x", "http://x/y://z"]
    rows += [(10_000 + k, u) for k, u in enumerate(odd)] + [(None, "http://h0.co.uk/"), (0, rows[0][1]), rows[1], rows[1]]
    outcomes += [(1, True), (None, True), (2, None), (999_999, True)]
    return rows, outcomes


def test_url_filter_matches_brute_force(spark):
    rng = random.Random(10)
    rows, outcomes = urls(rng)
    pages = spark.createDataFrame([(i, u, "kept", j, 1) for j, (i, u) in enumerate(rows)],
                                  "page_id long, url string, verdict string, key_0 int, key_1_about int").repartition(3)
    marked = spark.createDataFrame(outcomes, "page_id long, bad boolean")
    rules = [*ur.RULES, ("block", "farm1.com/en/1"), ("allow", "www.bad.co.uk/en/"), ("block", "www.bad.co.uk/en/")]
    got = ur.filter_urls(pages, marked, rules).collect()
    assert sorted(r["key_0"] for r in got) == list(range(len(rows)))
    assert set(got[0].__fields__) == {"page_id", "url", "verdict", "key_0", "key_1_about", "host", "path", "rule"}
    blocked = brute_blocked(rows, outcomes)
    for r in got:
        host, path = brute_host(r["url"])
        block, rule = brute_rule(host, path, rules)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == ("block" if (blocked[host][1] if block is None else block) else "allow"), host
    judged = {r["host"]: r["verdict"] for r in got if r["rule"] is None}
    assert judged["s0.farm0.com"] == "block" == judged["new.farm0.com"] and judged["big.example.org"] == "allow"
    table = ur.host_reputation(pages, marked).collect()
    for r in table:
        assert (r["domain"], r["suffix"]) == brute_parts(r["host"])
        assert r["mean"] == pytest.approx(blocked[r["host"]][0])


def test_url_filter_without_rows_or_outcomes(spark):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    pages = spark.createDataFrame([(k, f"http://h{k}.example.org/{k}") for k in range(20)], "page_id long, url string")
    assert {r["verdict"] for r in ur.filter_urls(pages, none).collect()} == {"allow"}
    assert {r["verdict"] for r in ur.filter_urls(pages, none, [("block", "org/")]).collect()} == {"block"}
    assert ur.filter_urls(pages.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        ur.filter_urls(pages, none, [("drop", "org/")])


def test_hot_hosts_are_broadcast_and_others_are_not(spark, monkeypatch):
    monkeypatch.setattr(ur, "HOT", 4)
    rows = spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"h{k}") for k in range(300)], "i int, host string")
    table = rows.groupBy("host").agg(F.count("*").alias("size"), F.max("i").alias("top"))
    out = ur.attach(rows, table, "host", "size")
    assert sorted((r["i"], r["top"]) for r in out.collect()) == sorted((k, 297 if k % 3 == 0 else k) for k in range(300))
