"""The guarded ``where`` predicate (blocklist, parser, allow-list, subqueries)."""

import pytest

from featurespark.errors import LayerQueryError
from featurespark.plans.where import guard_where, rewrite_dialect


def test_no_filter_idioms(layers):
    assert guard_where(layers.spark, None) is None
    for none in (" 1=1 ", "", None):
        assert layers.filter("nation", none).count() == 25


@pytest.mark.parametrize("bad", [
    "1=1; DROP TABLE x", "a = 1 -- c", "a /* x */ = 1", "read_csv('x') = 1",
    "x IN (SELECT * FROM parquet_scan('y'))", "glob('*') = 1", "a = 'http://x'", "a = 'file:/etc'",
    "spread_rate > 1",   # substring rule also hits identifiers (S3)
])
def test_blocklist(layers, bad):
    with pytest.raises(LayerQueryError, match="disallowed"):
        guard_where(layers.spark, bad)


@pytest.mark.parametrize("bad", [
    "1=1) UNION SELECT 1 FROM orders WHERE (1=1",
    "java_method('java.lang.System', 'exit', 0) = 1",
    "reflect('java.lang.Thread', 'sleep', 1000) IS NULL",
    "o_orderkey IN (SELECT o_orderkey FROM orders)",
    "EXISTS (SELECT 1 FROM parquet.`/etc`)",
    "rand() > 0.5",
])
def test_rejected(layers, bad):
    with pytest.raises(LayerQueryError):
        guard_where(layers.spark, bad)


def test_subqueries_only_over_layer_views(layers):
    ok = guard_where(layers.spark, "o_custkey IN (SELECT c_custkey FROM customer)", ["customer", "orders"])
    assert ok.text.startswith("(") and ok.relations == ["customer"]
    with pytest.raises(LayerQueryError, match="relation"):
        guard_where(layers.spark, "o_custkey IN (SELECT c_custkey FROM secret)", ["customer"])


@pytest.mark.parametrize("bad", [
    "o_custkey IN (WITH customer AS (SELECT length(java_method('java.lang.System', 'getProperty', 'user.home')) AS c) SELECT c FROM customer)",
    "o_custkey IN (WITH x AS (SELECT c_custkey FROM customer) SELECT c_custkey FROM x)",
    "EXISTS (WITH x AS (SELECT 1) SELECT * FROM x)",
    "o_custkey IN (SELECT * FROM VALUES (1), (2) AS t(a))",
    "o_custkey IN (SELECT id FROM range(10))",
    "o_custkey IN (SELECT c FROM customer LATERAL VIEW explode(array(1)) t AS c)",
    "o_custkey IN (SELECT t.c FROM customer, LATERAL (SELECT 1 AS c) t)",
    "EXISTS (SELECT java_method('java.lang.System', 'gc') FROM customer)",
    "EXISTS (SELECT 1 FROM customer WHERE reflect('java.lang.System', 'gc') IS NULL)",
    "EXISTS (SELECT 1 FROM (SELECT rand() AS r FROM customer) q WHERE r > 0)",
    "EXISTS (SELECT 1 FROM customer ORDER BY uuid())",
    "EXISTS (SELECT 1 FROM default.customer)",
])
def test_subqueries_hold_nothing_unlisted(layers, bad):
    with pytest.raises(LayerQueryError):
        guard_where(layers.spark, bad, ["customer", "orders"])


@pytest.mark.parametrize("same", ["o_custkey IN (TABLE customer)", "o_custkey IN (FROM customer |> SELECT c_custkey)"])
def test_other_spellings_of_a_layer(layers, same):
    assert guard_where(layers.spark, same, ["customer"]).relations == ["customer"]


def test_subqueries_register_only_what_they_name(layers):
    for t in layers.spark.catalog.listTables():
        if t.isTemporary:
            layers.spark.catalog.dropTempView(t.name)
    df = layers.filter("orders", "o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", allow_subqueries=True)
    assert [t.name for t in layers.spark.catalog.listTables() if t.isTemporary] == ["customer"]
    assert 0 < df.count() < layers.read("orders").count()


def test_analysed_predicates_are_checked(layers):
    from featurespark.plans.where import check_analyzed
    df = layers.read("nation")
    check_analyzed(df.where("st_area(unhex('00')) > 0 OR upper(n_name) = 'X'"))
    for foreign in ("java_method('java.lang.System', 'getProperty', 'x') IS NULL",
                    "n_nationkey IN (SELECT length(reflect('java.lang.System', 'getProperty', 'x')))"):
        with pytest.raises(LayerQueryError):
            check_analyzed(df.where(foreign))


def test_boxes_of_constant_predicates(layers):
    def boxes(w):
        return guard_where(layers.spark, w).boxes

    assert boxes("ST_Intersects(geometry, ST_MakeEnvelope(1, -2, 3, 4)) AND a > 1") == [("geometry", (1.0, -2.0, 3.0, 4.0))]
    assert boxes("ST_DWithin(ST_Point(-1.5, 2), geom, 0.5)") == [("geom", (-2.0, 1.5, -1.0, 2.5))]
    assert boxes("ST_Within(g, ST_GeomFromText('LINESTRING(0 0, 2 3)'))") == [("g", (0.0, 0.0, 2.0, 3.0))]
    assert boxes("ST_Disjoint(geometry, ST_Point(1, 2))") == boxes("ST_Intersects(geometry, ST_Point(x, 2))") == []


def test_double_quoted_identifiers_and_varchar(layers):
    df = layers.filter("orders", "\"o_orderstatus\" = 'F' AND CAST(o_orderkey AS VARCHAR) LIKE '1%'")
    assert df.count() > 0
    assert rewrite_dialect("CAST(a AS varchar) = 'VARCHAR'") == "CAST(a AS STRING) = 'VARCHAR'"
    assert rewrite_dialect('"varchar" = CAST(b AS VARCHAR(3))') == '"varchar" = CAST(b AS VARCHAR(3))'


def test_user_errors(layers):
    with pytest.raises(LayerQueryError):
        layers.query("orders", where="no_such_column = 1")
    with pytest.raises(LayerQueryError):
        layers.query("orders", where="o_orderkey = 'abc'", return_count_only="true").to_dict()
    with pytest.raises(LayerQueryError):
        layers.query("orders", where="o_orderkey / 0 > 1", return_count_only="true").to_dict()
