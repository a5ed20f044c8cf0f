import hashlib
import random
import re

import numpy as np
import xxhash
from helpers import awkward_rows, frame, prose

from featurespark.llm import line_dedup, simhash_dedup, substring_dedup
from featurespark.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[j] for j in range(n) if linked(i, j)] + [label[i]]) for i in range(n)]
        if new == label:
            return label
        label = new


def test_simhash_matches_brute_force(spark):
    rng = random.Random(1)
    rows = awkward_rows()
    long = prose(rng, 400).split()
    for i in range(12):      # a chain of near copies
        long[i * 7] = "changed"
        rows.append((100 + i, " ".join(long), "en", "s", 1, "y"))
    got = {(r["id"], r["fp"] % (1 << 64)): r["component"] for r in
           simhash_dedup.simhash_components(frame(spark, rows)).collect()}
    fps = [brute_fingerprint(r[1]) for r in rows]
    assert {(r[0], f) for r, f in zip(rows, fps)} == set(got)
    roots = brute_components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        assert got[r[0], fps[i]] == (min(ids) if ids else None)


def test_simhash_links_on_random_bits_and_split_groups(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(0, 8)):
            for _ in range(rng.randint(1, 5)):
                base ^= 1 << rng.randrange(64)
            fps.add(base)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for most in (12, 1 << 16):
        edges = simhash_dedup.near_links(df, 4, most)
        roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
        got = [roots.get(x, x) for x in signed]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))
        assert most < 100 or edges.count() <= 5 * len(fps)      # forests, not pairs


def test_keep_one(spark):
    rows = awkward_rows()
    out = simhash_dedup.keep_one(frame(spark, rows)).collect()
    ids = [r["doc_id"] for r in out]
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "note"}
    assert 3 in ids and 40 not in ids and 41 not in ids and ids.count(46) == 1 and None in ids
    assert sum(i in (43, 44, 45) for i in ids) == 1
    assert simhash_dedup.keep_one(frame(spark, [])).count() == 0


def brute_repeats(rows, window=13):
    words = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            if i is not None and (g not in least or i < least[g]):
                least[g] = i
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings_match_brute_force(spark):
    rng = random.Random(4)
    rows = awkward_rows()
    passages = [prose(rng, n).split() for n in (12, 13, 14, 40, 200)]
    for i in range(60):
        words = prose(rng, rng.randint(0, 60)).split()
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randint(0, len(words))
            words[at:at] = p[a:a + rng.randint(1, 60)]
        rows.append((200 - i, " ".join(words), "en", "s", 1, "y"))
    rows.append((300, "el " * 100, "en", "s", 1, "y"))
    rows.append((301, "el " * 40, "en", "s", 1, "y"))
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == \
        sorted(brute_repeats(rows), key=str)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert sum(r["n_removed"] for r in got) > 500 and any(r["longest_factor"] >= 13 for r in got)
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            b[rng.randint(0, len(b)):rng.randint(0, len(b))] = rng.choice(["x", "", "bc"])
        b = "".join(b)
        assert line_dedup.edit_distance(a, b) == brute_edit(a, b)


def normal(line):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in line).encode()
    return " ".join(x.decode() for x in re.findall(rb"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", folded))


def test_lines_match_brute_force(spark):
    import pyarrow as pa

    from featurespark.llm.shared import text_chunks

    rng = random.Random(6)
    base = [prose(rng, 60) for _ in range(6)]
    rows = awkward_rows(n=15)
    for i in range(60):
        text = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "edited" + rng.choice("abc")
            text.append(" ".join(words).capitalize() + rng.choice(["", ".", " !"]))
        rows.append((200 + i, "\n".join(text), "en", "s", 1, "y"))
    rows = [r for r in rows if r[0] is not None]
    got = {r["id"]: (r["n_lines"], r["n_removed"], r["removed"]) for r in line_dedup.repeated_lines(frame(spark, rows)).collect()}
    occ = sorted({(r[0], k, normal(x)) for r in rows for k, x in enumerate((r[1] or "").split("\n")) if normal(x)})
    nodes = sorted({o[2] for o in occ})
    (_, buf, off), = text_chunks(pa.array(["\n".join(nodes)]), 1 << 30)
    fp = line_dedup.Lines(buf, off).simhash().tolist()
    roots = brute_components(len(nodes), lambda i, j: i == j or (fp[i] ^ fp[j]).bit_count() <= 3 and
                             1 - brute_edit(nodes[i], nodes[j]) / max(len(nodes[i]), len(nodes[j])) >= 0.8)
    root = dict(zip(nodes, roots))
    seen, want = set(), {r[0]: [0, 0, []] for r in rows}
    for i, k, t in occ:
        want[i][0] += 1
        if root[t] in seen:
            want[i][1] += 1
            want[i][2].append(k)
        seen.add(root[t])
    assert got == {i: tuple(w) for i, w in want.items()}
    assert len(set(roots)) < len(nodes)       # some links are fuzzy
    docs = frame(spark, rows)
    left = line_dedup.without_lines(docs, line_dedup.repeated_lines(docs)).collect()
    assert len(left) == len(rows) and left[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "note"}
    assert line_dedup.repeated_lines(frame(spark, [])).count() == 0


def test_line_simhash_of_long_lines():
    import pyarrow as pa

    from featurespark.llm.shared import text_chunks

    rng = random.Random(7)
    text = prose(rng, 700) + "\n\n" + prose(rng, 255) + "\nshort"
    (_, buf, off), = text_chunks(pa.array([text]), 1 << 30)
    x = line_dedup.Lines(buf, off)
    for i, f in enumerate(x.simhash().tolist()):
        h = x.words[x.first[i]:x.first[i + 1]].tolist()
        assert f == sum(1 << b for b in range(64) if sum(w >> b & 1 for w in h) * 2 > len(h))
    assert np.diff(x.first).tolist() == [700, 0, 255, 1]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (102, 101), (None, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 101: 101, 102: 101}


def test_lines_of_any_simhash(spark):
    rng = random.Random(8)
    pairs = []
    for words in [*range(5, 21), 25, 40, 60, 90] * 4:
        line = prose(rng, words)
        at = rng.randrange(len(line))
        one = line[:at] + ("q" if line[at] != " " else " q ") + line[at + 1:]
        many = "".join(c if rng.random() > 0.08 else "z" for c in line)
        pairs += [(line, x) for x in (one, many) if len(line) >= 20 and brute_edit(line, x) <= 0.2 * max(len(line), len(x))]
    rows = [(i * 1000 + k, t) for k, p in enumerate(pairs) for i, t in enumerate(p)]
    got = {r["id"] for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), distance=None)
           .filter("n_removed = 1").collect()}
    want = {1000 + k for k in range(len(pairs))}
    assert len(want & got) >= 0.95 * len(want) and len(want) > 120
    short = ["abcde fgh", "abcde fgx", "hello", "hullo", "hi", "ho", "twelve chars", "twelfe charz", "a rather short line", "a rother shart lime"]
    texts = sorted({x for x in short + [p[0][:rng.randint(3, 24)] for p in pairs]})
    texts += [x[:len(x) // 2] + "q" + x[len(x) // 2 + 1:] for x in texts if len(x) > 4]
    nodes = sorted({normal(x) for x in texts if normal(x)})
    roots = brute_components(len(nodes), lambda i, j: i == j or len(nodes[i]) < 25 and
                             brute_edit(nodes[i], nodes[j]) <= 0.2 * max(len(nodes[i]), len(nodes[j])))
    rows = list(enumerate(nodes))
    got = {r["id"] for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), distance=None)
           .filter("n_removed = 0").collect()}
    assert got == set(roots)


def test_packed_texts_are_opened_a_part_at_a_time(monkeypatch):
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(substring_dedup, "_ROWS", 10)
    texts = [prose(random.Random(i), 30) for i in range(35)]
    packed = pa.array([zstandard.ZstdCompressor().compress(t.encode()) for t in texts], pa.binary())
    parts = [(some.tolist(), buf.tobytes().decode()) for some, buf, _ in
             substring_dedup._chunks(pa.RecordBatch.from_arrays([packed], names=["packed"]), 13)]
    assert parts == [([*range(lo, min(lo + 10, 35))], "".join(texts[lo:lo + 10])) for lo in range(0, 35, 10)]


def test_fuzzy_lines_free_the_disk_of_each_step(spark, monkeypatch):
    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    write, before = line_dedup.materialize, spark.conf.get(name)
    monkeypatch.setattr(line_dedup, "materialize", lambda df, label: seen.append((label, spark.conf.get(name))) or write(df, label))
    line_dedup.repeated_lines(spark.createDataFrame([(1, "a line of words\nanother one"), (2, "a line of wards")], "doc_id long, text string"),
                              distance=None)
    # the documents' lines are not sampled twice: what the second round compares was put aside by the first
    assert {s[1] for s in seen} == {"true"} and {"buckets", "more-candidates"} <= {s[0] for s in seen}
    assert spark.conf.get(name) == before
