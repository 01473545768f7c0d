"""Text functions and identifiers on literal inputs."""

import pytest
from pyspark.sql import functions as F

from weftlake.functions import calls, ids
from weftlake.functions.select_list import column_source, output_columns, select_columns, select_sources, split_commas, top_level_from
from weftlake.operators import select


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "x string").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "sql,want",
    [
        ("select * from {{ ref('a') }}", [(None, "a")]),
        ('{{ ref("a") }} {{- ref( \'b\' ) -}}', [(None, "a"), (None, "b")]),
        ("{{ ref('p', 'm') }}", [("p", "m")]),
        ("{# {{ ref('no') }} #} {{ ref('yes') }}", [(None, "yes")]),
        ("{{ ref('a\") }}", [(None, "a")]),
        ("{{ f(ref('a')) }}", []),
        ("{{ref('é_1')}}", [(None, "é_1")]),
        ("", []),
        ("no calls", []),
    ],
)
def test_refs(spark, sql, want):
    assert [tuple(r) for r in one(spark, calls.refs, sql)] == want


def test_sources_and_comments(spark):
    assert [tuple(r) for r in one(spark, calls.sources, "{{ source('s', 't') }} {#{{ source('x','y') }}#} {{- source(\"a\",'b') -}}")] == [("s", "t"), ("a", "b")]
    assert one(spark, calls.strip_comments, "a{# b\nc #}d{##}e") == "ade"
    assert one(spark, calls.strip_template, "{% if x %}a{{ b }}{# c #}") == "__jinja__a__jinja__"
    assert one(spark, calls.refs, None) is None


@pytest.mark.parametrize(
    "sql,want",
    [
        ("{{ config(materialized='table') }}", ("table", [])),
        ("{{ config(\n materialized = \"view\",\n tags=['a', \"b\"]\n) }}", ("view", ["a", "b"])),
        ("{{ config(tags='a') }}", (None, [])),
        ("{# {{ config(materialized='x') }} #}", (None, [])),
        ("{{ config(materialized='one') }}{{ config(materialized='two') }}", ("one", [])),
    ],
)
def test_config(spark, sql, want):
    assert tuple(one(spark, calls.config, sql)) == want


def test_table_refs(spark):
    got = one(spark, calls.table_refs, "from {{ ref('a') }} x JOIN {{ source('s', 't') }} AS y left join {{ ref('b') }}\nWHERE {{ ref(\"c\") }}, from {{- ref('d') }}")
    assert [tuple(r) for r in got] == [("x", "model.a"), ("y", "source.s.t"), ("WHERE", "model.b")]


def test_exposure_ref(spark):
    assert [one(spark, calls.exposure_ref, x) for x in ("ref('a')", 'ref("b")', "source('a', 'b')", "a", None)] == ["a", "b", None, None, None]


@pytest.mark.parametrize(
    "sql,want",
    [
        ("select a, b.c, d as e from t", ["a", "c", "e"]),
        ("SELECT DISTINCT `x`, \"y\" z FROM t", ["x", "z"]),
        ("select * from t", ["*"]),
        ("select o.*, count(*) from t", ["*", "count(*)"]),
        ("select cast(a as int) as b, coalesce(x, y) v, (select max(q) from z) as m from t", ["b", "v", "m"]),
        ("select {{ macro('a, b') }}, c from t", ["__jinja__", "c"]),
        ("with q as (select i from s) select j from q", ["i"]),
        ("select a", []),
        ("nothing", []),
        (None, []),
        ("select a,\n  b, from t", ["a", "b"]),
        ("select (a + b) as ab, (c) from t", ["ab"]),
    ],
)
def test_output_columns(spark, sql, want):
    assert output_columns(sql) == want
    assert one(spark, select_columns, sql) == want


def test_scanning():
    assert split_commas("a, f(b, c), d ,") == ["a", " f(b, c)", " d "] and split_commas("") == []
    assert top_level_from("(x from y) from_date, a from b") == "(x from y) from_date, a from b".index("from b")
    assert top_level_from(") from b") == 2 and top_level_from("fromage") is None


def test_column_source(spark):
    source = column_source
    assert source("select o.id as key from t", "key") == ("o", "id", False)
    assert source("select o.id from t", "id") == ("o", "id", False)
    assert source("select sum(x) as s from t", "s") == (None, None, True)
    assert source("select id as key from t", "key") == (None, "key", False)
    assert source("select a.x y, b from t", "y") == ("a", "x", False)
    assert source("select é_1.x AS y1 from t", "y1") == ("é_1", "x", False) and source("select f(a.b) from t", "c.*d") == (None, "c.*d", False)
    got = one(spark, select_sources, "select o.id as k, *, {{ m() }}, count(*) as n from {{ ref('t') }} o")
    assert [tuple(r) for r in got] == [("k", "o", "id", False, False), ("*", None, None, True, False), ("__jinja__", None, None, False, True), ("n", None, None, False, True)]
    assert one(spark, select_sources, None) == []


def test_ids(spark):
    f = lambda e, xs: [one(spark, e, x) for x in xs]
    assert f(ids.manifest_id, ["source.p.s.t", "model.p.m", "test.p.a.b", "a.b", "a"]) == ["source.s.t", "model.m", "test.b", "a.b", "a"]
    assert f(ids.run_id, ["model.p.m", "a.b", "a"]) == ["model.m", "a.b", None]
    assert f(ids.graph_id, ["source.s.t", "model.m", "a"]) == ["source.t", "model.m", "a"]
    assert f(ids.file_stem, ["a/b/c.sql", "x.y.sql", "n", "", None, ".hidden"]) == ["c", "x.y", "n", "unknown", "unknown", ".hidden"]
    assert f(ids.node_type, ["seed", "analysis", "exposure"]) == ["seed", "model", "exposure"]
    assert f(ids.edge_type, ["source.a", "test.b", "model.c"]) == ["source", "test", "ref"]
    assert f(ids.non_blank, [" a ", "  ", "", None]) == [" a ", None, None, None]


def test_selectors():
    assert select.parse_selectors(" tag:a ,, path:b/c, m,") == [("tag", "a"), ("path", "b/c"), ("name", "m")] and select.parse_selectors("") == []


def test_selectors_of_a_column(spark):
    for text in (" tag:a ,, path:b/c, m,", "", "tag:", "x:y,tag:a:b"):
        assert [tuple(x) for x in one(spark, select.parsed_selectors, text)] == select.parse_selectors(text)


def test_sql_functions(spark):
    from weftlake.functions import sql

    sql.register(spark)
    spark.createDataFrame([(1, "select a from {{ ref('p', 'm') }} join {{ source('s', 't') }} {# {{ ref('x') }} #}"), (2, None)], "id int, q string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, c.* FROM texts, LATERAL lineage_calls(q) c").collect()
    assert sorted(map(tuple, got)) == [(1, "ref", "p", "m", None), (1, "source", None, "s", "t")]
    assert spark.sql("SELECT select_columns(q) AS c FROM texts ORDER BY id").first().c == ["a"]
