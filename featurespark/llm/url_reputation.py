"""URL filter: explicit rules, and empirical-Bayes reputation of hosts for what no rule judges.

Labelled page outcomes (good or bad) are counted per host. The bad rate of a host is beta-distributed around that of
its registered domain, a domain's around its suffix's, a suffix's around the mean of all; how closely is
estimated at each level by the method of moments, from how much the counts vary beyond binomial noise. So a host
with few labels leans on its domain, a domain without labels on its suffix. A host is blocked where the
lower bound of its posterior, ``z`` standard deviations below the mean, is above ``max_bad``: where it is bad beyond doubt.

A rule ``(action, host + path)`` fits its host and all subdomains, if the url's path starts with the rule's; the longest
fitting rule decides before any reputation (of equally long ones a block). Rules are a list in the driver's memory.

Only counts per host, domain and suffix are shuffled. Where they go back to their rows, keys with more than
``1 / HOT`` of these rows, of which there are fewer than ``HOT``, are broadcast; the others meet in a shuffle whose keys are small.

Defined results: a null url or one without ``://`` has empty host and path, which form a host like any other; outcomes without a
page, pages without id and null outcomes count nothing; an outcome counts on every row of its page id; without any
outcome nothing is blocked but by rules. Page rows are kept as they are, repeated ones too; a result column
replaces a column of its name, and no other name is reserved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featurespark.llm.shared import materialize

# fixed values: public suffixes of two labels that are known by default
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
            "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# ---------------------------------------------------------------------------------

HOT = 1024                   # keys with more than this part of the rows are broadcast
UNKNOWN_STRENGTH = 10.0      # strength of a prior that no group with two labels tells anything about
LEAST, MOST = 1e-6, 0.999    # range of the correlation within a group


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.regexp_replace(_rest(url), "^[^/?#]*", ""), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.char_length(url))), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The last label, or the last two where they are a known suffix; an address in numbers is its own."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    number = name.rlike(r"^[0-9]+(\.[0-9]+){3}$") | name.startswith("[")
    return F.when(number, name).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The suffix and one label more (the suffix itself where there is none)."""
    name, suffix = name_of(host), suffix_of(host, suffixes)
    more = F.when(F.instr(suffix, ".") > 0, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(suffix == name, name).otherwise(more)


def attach(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` to a ``table`` with one line a ``key``, ``size`` being the number of its rows.

    Keys with more than ``1 / HOT`` of all rows, fewer than ``HOT`` of them, are broadcast, and their rows stay where they are.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(size) * HOT > total).drop(size))
    cold = table.where(F.col(size) * HOT <= total).drop(size)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))


@dataclass(frozen=True)
class Level:
    """The prior's mean and strength of one level."""

    mean: Column
    strength: float

    def mean_of(self, bad: Column, n: Column) -> Column:
        return (F.lit(self.strength) * self.mean + bad) / (F.lit(self.strength) + n)


def strength_of(groups: DataFrame, mean: Column) -> float:
    """Strength of the beta prior around ``mean``, by moments of the groups' counts ``bad`` of ``n``."""
    n, bad = F.col("n"), F.col("bad")
    noise = mean * (1 - mean)
    spread, binomial, pairs = groups.where("n > 0").agg(
        F.sum((bad - n * mean) * (bad - n * mean)), F.sum(n * noise), F.sum(n * (n - 1) * noise)).first()
    if not pairs:
        return UNKNOWN_STRENGTH
    within = min(MOST, max(LEAST, (spread - binomial) / pairs))
    return 1 / within - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    bad_col: str = "bad", z: float = 1.645, max_bad: float = 0.5, suffixes=SUFFIXES) -> DataFrame:
    """A row per host: ``host, domain, suffix, pages, n, bad, mean, bound, blocked``.

    ``outcomes`` has ``id_col`` and the boolean ``bad_col``.
    """
    own = pages.select(F.col(f"`{id_col}`").alias("id"), url_host(F.col(f"`{url_col}`")).alias("host"))
    counted = outcomes.where(F.col(f"`{bad_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(f"`{bad_col}`").cast("long")).alias("bad"))
    zero = F.lit(0).cast("long")
    hosts = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).select("host", "pages", zero.alias("n"), zero.alias("bad"))
    seen = own.join(counted, "id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.unionByName(seen.select("host", zero.alias("pages"), "n", "bad")) \
        .groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "bad")])
    hosts = hosts.withColumn("domain", domain_of(F.col("host"), suffixes))
    hosts = materialize(hosts.withColumn("suffix", suffix_of(F.col("domain"), suffixes)), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("rows")), "domains")
    every = domains.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("rows"))
    n, bad = every.agg(F.sum("n"), F.sum("bad")).first()
    top = F.lit(((bad or 0) + 0.5) / ((n or 0) + 1))
    level = Level(top, strength_of(every, top))
    every = every.select("suffix", "rows", level.mean_of(F.col("bad"), F.col("n")).alias("above"))

    domains = materialize(attach(domains.withColumnRenamed("rows", "hosts"), every, "suffix", "rows"), "domains")
    level = Level(F.col("above"), strength_of(domains, F.col("above")))
    domains = domains.select("domain", "hosts", level.mean_of(F.col("bad"), F.col("n")).alias("above"))

    hosts = materialize(attach(hosts, domains, "domain", "hosts"), "hosts")
    k = strength_of(hosts, F.col("above"))
    weight = F.lit(k) + F.col("n")
    hosts = hosts.withColumn("mean", Level(F.col("above"), k).mean_of(F.col("bad"), F.col("n")))
    hosts = hosts.withColumn("bound", F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1)))
    return hosts.select("host", "domain", "suffix", "pages", "n", "bad", "mean", "bound",
                        (F.col("bound") > max_bad).alias("blocked"))


def _fitting_rules(hosts: DataFrame, rules) -> DataFrame:
    """``(host, rules)``: for each host that some rule fits, those rules with their paths."""
    rows = [(rule.split("/", 1)[0].lower(), "/" + rule.split("/", 1)[1], rule, action) for action, rule in rules]
    listed = hosts.sparkSession.createDataFrame(rows, "name string, path string, rule string, action string")
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return hosts.select("host", F.explode(names).alias("name")).join(listed, "name").groupBy("host").agg(
        F.collect_list(F.struct("path", "rule", "action")).alias("rules"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
                **how) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` (allow or block)."""
    for action, rule in rules:
        if action not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"a rule is ('allow' or 'block', 'host/path'): {(action, rule)!r}")
    hosts = host_reputation(pages, outcomes, id_col, url_col, **how).select("host", "pages", "blocked")
    hosts = materialize(hosts.join(_fitting_rules(hosts, rules), "host", "left"), "judged")
    # the joined columns travel in structs under names that no column of the pages has
    key = next(c for c in (f"key_{i}" for i in range(len(pages.columns) + 1))
               if not any(own.lower().startswith(c) for own in pages.columns))
    about, size = key + "_about", key + "_size"
    table = hosts.select(F.col("host").alias(key), F.struct("blocked", "rules").alias(about), F.col("pages").alias(size))
    rows = attach(pages.withColumn(key, url_host(F.col(f"`{url_col}`"))), table, key, size)
    path = url_path(F.col(f"`{url_col}`"))
    best = F.array_max(F.transform(
        F.filter(F.col(about)["rules"], lambda r: F.startswith(path, r["path"])),
        lambda r: F.struct(F.char_length(r["rule"]).alias("size"), (r["action"] == "block").alias("block"), r["rule"].alias("rule"))))
    block = F.coalesce(best["block"], F.col(about)["blocked"])
    return rows.withColumns({"host": F.col(key), "path": path, "rule": best["rule"],
                             "verdict": F.when(block, "block").otherwise("allow")}).drop(key, about)


# -- the query ------------------------------------------------------------------------------
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ``i``'s outcome is what ``labels`` says of id ``i``: bad if of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = F.col("quality").isNotNull() | F.col("toxic").isNotNull()
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    outcomes = labels.where(known).select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _strength(groups: str, mean: str) -> str:
    x = f"{mean} * (1 - {mean})"
    return f"""(SELECT CASE WHEN coalesce(sum(n * (n - 1) * {x}), 0) = 0 THEN {UNKNOWN_STRENGTH}::DOUBLE ELSE 1 / least({MOST}::DOUBLE,
        greatest({LEAST}::DOUBLE, (sum((bad - n * {mean}) * (bad - n * {mean})) - sum(n * {x})) / sum(n * (n - 1) * {x}))) - 1 END
        FROM {groups} WHERE n > 0)"""


OP13_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
o AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS bad
      FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
              regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name
       FROM q LEFT JOIN o ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, string_split(name, '.') AS parts FROM h0),
h2 AS (SELECT *, CASE WHEN regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$') OR starts_with(name, '[') THEN name
                      WHEN array_to_string(parts[-2:], '.') IN ({_listed(SUFFIXES)}) THEN array_to_string(parts[-2:], '.')
                      ELSE parts[-1] END AS suffix FROM h1),
h3 AS (SELECT * EXCLUDE suffix, CASE WHEN suffix = name THEN name WHEN contains(suffix, '.') THEN array_to_string(parts[-3:], '.')
                     ELSE array_to_string(parts[-2:], '.') END AS domain FROM h2),
h AS (SELECT *, CASE WHEN regexp_matches(domain, '^[0-9]+(\\.[0-9]+){{3}}$') OR starts_with(domain, '[') THEN domain
                     WHEN array_to_string(string_split(domain, '.')[-2:], '.') IN ({_listed(SUFFIXES)})
                     THEN array_to_string(string_split(domain, '.')[-2:], '.') ELSE string_split(domain, '.')[-1] END AS suffix FROM h3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) FROM h) AS above
      FROM d GROUP BY suffix),
s1 AS (SELECT suffix, (k * above + bad) / (k + n) AS mean FROM s, (SELECT {_strength("s", "above")} AS k)),
d1 AS (SELECT d.*, s1.mean AS above FROM d JOIN s1 USING (suffix)),
d2 AS (SELECT domain, (k * above + bad) / (k + n) AS mean FROM d1, (SELECT {_strength("d1", "above")} AS k)),
g AS (SELECT h.*, d2.mean AS above FROM h JOIN d2 USING (domain)),
g1 AS (SELECT host, k + n AS w, (k * above + bad) / (k + n) AS mean FROM g, (SELECT {_strength("g", "above")} AS k)),
v AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.5 AS blocked FROM g1),
r AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for a, r in RULES)})
      AS t(action, rule, name, start)),
b AS (SELECT page_id, host, path, max({{'size': length(rule), 'block': action = 'block', 'rule': rule}}) AS best
      FROM (SELECT DISTINCT page_id, host, path FROM q) JOIN r
      ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL)
SELECT q.page_id, q.host, q.path, best.rule AS rule,
       CASE WHEN coalesce(best.block, blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM q JOIN v USING (host) LEFT JOIN b ON b.page_id = q.page_id AND b.host = q.host AND b.path = q.path
"""
