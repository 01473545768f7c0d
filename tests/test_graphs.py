"""Traversals of random graphs against plain Python, and every query against its SQL."""

import os
import random
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
from weftlake.errors import CycleDetected
from weftlake.operators import layout, traverse
from weftlake.plans.oracle import ORACLE
from weftlake.plans.queries import QUERIES
from weftlake.schemas import EDGES, NODES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def graph(spark, seed, n=25, m=40):
    r = random.Random(seed)
    pairs = [tuple(sorted(r.sample(range(n), 2))) for _ in range(m)]
    nodes = spark.createDataFrame([(f"n{i:02}", f"n{i:02}", "model", None, None, None, [], []) for i in range(n)], NODES)
    return nodes, spark.createDataFrame([(f"n{a:02}", f"n{b:02}", "ref") for a, b in pairs], EDGES), pairs


def plain(pairs, n):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    layer = {}
    for i in range(n):
        layer[i] = max((layer[a] + 1 for a, b in pairs if b == i), default=0)
    return out, layer


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    nodes, edges, pairs = graph(spark, seed)
    out, layer = plain(pairs, 25)
    assert {r.unique_id: r.layer for r in traverse.layers(nodes, edges).collect()} == {f"n{i:02}": k for i, k in layer.items()}
    start = pairs[0][0]
    far, todo = {start: 0}, [start]
    for x in todo:
        for y in out[x]:
            if y not in far:
                far[y] = far[x] + 1
                todo.append(y)
    one = nodes.where(f"unique_id = 'n{start:02}'")
    assert {r.unique_id: r.depth for r in traverse.reach(edges, one).collect()} == {f"n{i:02}": d for i, d in far.items()}
    assert {r.unique_id for r in traverse.reach(edges, one, 1).collect()} == {f"n{i:02}" for i, d in far.items() if d < 2}
    longest = {}
    for i in reversed(range(25)):
        longest[i] = max((longest[j] + 1 for j in out[i]), default=0)
    path = [int(r.unique_id[1:]) for r in traverse.longest_path(edges, one).orderBy("position").collect()]
    assert len(path) == longest[start] + 1 and path[0] == start and all(b in out[a] for a, b in zip(path, path[1:]))


def test_cycles(spark):
    nodes, edges, _ = graph(spark, 7)
    assert not traverse.has_cycle(edges) and not traverse.has_cycle(edges.limit(0))
    loop = edges.union(spark.createDataFrame([("n20", "n01", "ref"), ("n01", "n20", "ref")], EDGES))
    assert traverse.has_cycle(loop)
    with pytest.raises(CycleDetected):
        layout.layout(nodes, loop)
    assert {r.unique_id: r.layer for r in layout.layout(nodes, loop, cyclic="spread").collect()} == {f"n{i:02}": i for i in range(25)}


def test_ranks_within_groups(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), i, r.random()) for i in range(500)]
    got = traverse.ranked(spark.createDataFrame(rows, "g int, i int, k double").repartition(5), "g", ["k"]).collect()
    for g in range(3):
        assert [x.i for x in sorted((x for x in got if x.g == g), key=lambda x: x.rank)] == [i for h, i, _ in sorted(rows, key=lambda x: x[2]) if h == g]
        assert sorted(x.rank for x in got if x.g == g) == list(range(sum(h == g for h, _, _ in rows)))
    assert traverse.ranked(spark.createDataFrame([], "g int, k double"), "g", ["k"]).count() == 0


def test_crossings_reduced_on_executors_as_on_the_driver(spark, monkeypatch):
    nodes, edges, _ = graph(spark, 5, 14, 20)
    here = {(r.unique_id, r.layer, r.pos) for r in layout.layout(nodes, edges).collect()}
    monkeypatch.setattr(layout, "FEW", 0)
    assert {(r.unique_id, r.layer, r.pos) for r in layout.layout(nodes, edges).collect()} == here


def test_written_tables_are_deleted(spark, tmp_path):
    from weftlake import runtime

    with runtime.scratch(spark):
        kept = runtime.cut(spark.range(5))
        path = kept._written.removeprefix("file://")
        assert kept.count() == 5 and os.path.exists(path)
        with runtime.scratch(spark):
            inner = runtime.cut(spark.range(3))._written.removeprefix("file://")
        assert not os.path.exists(inner) and os.path.exists(path)
    assert not os.path.exists(path)


def test_barycenter_orders_by_mean(spark):
    edges = spark.createDataFrame([("a", "y", "ref"), ("b", "x", "ref"), ("b", "x", "ref")], EDGES)
    p = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("x", 1, 0), ("y", 1, 1), ("z", 1, 2)], "unique_id string, layer int, pos int")
    assert {r.unique_id: r.pos for r in layout.barycenter(p, edges).where("layer = 1").collect()} == {"y": 0, "x": 1, "z": 2}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain_rows = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))
    assert plain_rows(got) == plain_rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
