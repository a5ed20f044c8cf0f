"""Small tables with the awkward rows that every operator must take."""

import random


DOCS = "doc_id long, text string, lang string, source string, n_chars long, note string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "ti", "on", "the", "in", "ou", "re", "st"])
                            for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward_rows(seed=3, n=40):
    rng = random.Random(seed)
    rows = [(i, "\n".join(prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 5)))) for i in range(n)]
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, rows[5][1] + " extra"), (n + 3, None), (n + 4, ""),
             (n + 5, " \t\n "), (n + 6, "one"), (n + 6, "one"), (n + 7, prose(rng, 4000)), (None, prose(rng, 20)),
             (n + 8, "Ünïcode ßtraße — “quoted” 日本語 text with spaces 👍 it's 12,5%"), (n + 9, "a\n\n\nb\r\n c  d")]
    return [(i, t, None if j % 11 == 0 else "en", None if j % 7 == 0 else f"s{j % 3}", None, "x") for j, (i, t) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)
