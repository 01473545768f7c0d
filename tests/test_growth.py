"""What must not grow faster than the tables: rows of one task, tables that are exchanged or written again."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from weftlake import runtime
from weftlake.operators import build, diff, explore, status, traverse
from weftlake.schemas import EDGES, NODES
from weftlake.sources import artifacts


@contextmanager
def settings(spark, **given):
    """Shuffles as over large tables: no broadcasts, 8 partitions that aren't put together."""
    given = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"} | given
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nodes_without_a_file_are_not_one_tasks(spark):
    nodes = spark.createDataFrame([(f"model.n{i}", f"n{i}", "model", f"n{i}.sql" if i < 10 else None, None, None, [], []) for i in range(400)], NODES)
    results = spark.createDataFrame([(i, f"model.n{i}", "success", None, []) for i in range(0, 400, 2)], "seq long, unique_id string, status string, message string, timing array<struct<name:string,completed_at:timestamp>>")
    modified = spark.sql("select 'n2.sql' as file_path, timestamp '2100-01-01 00:00:00' as modified_at")
    with settings(spark):
        got = status.statuses(nodes, results, modified)
        assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
        assert {r.status: r.n for r in got.groupBy("status").agg(F.count("unique_id").alias("n")).collect()} == {"outdated": 1, "success": 199, "never_run": 200}


def test_nearest_and_neighbours_without_a_layer_in_one_task(spark):
    rows = [(f"a{i:03}", 0, i) for i in range(300)] + [("b0", 1, 0), ("b1", 1, 1)] + [("c", 2, 5)]
    p = spark.createDataFrame(rows, "unique_id string, layer int, pos int")
    with settings(spark):
        right = explore.nearest(p)
        assert right.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
        assert {r.unique_id: r.nearest for r in right.collect()} == {f"a{i:03}": "b0" if i == 0 else "b1" for i in range(300)} | {"b0": "c", "b1": "c"}
        assert {r.unique_id: r.nearest for r in explore.nearest(p, "left").collect()} == {"b0": "a000", "b1": "a001", "c": "b1"}
        beside = explore.layer_neighbours(p)
        assert beside.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 200
        got = {r.unique_id: (r.before, r.after) for r in beside.collect()}
        assert got["a000"] == ("a299", "a001") and got["a299"] == ("a298", "a000") and got["b0"] == ("b1", "b1") and got["c"] == ("c", "c") and len(got) == 303


def test_edges_in_buckets_arent_exchanged_again(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(3)], "src string, dst string")
    with settings(spark):
        e = runtime.cut(edges, by="src")
        ids = e.select("src").distinct()
        plan = e.join(ids.hint("shuffle_hash"), "src", "left_semi")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan
        assert {r.unique_id: r.layer for r in traverse.layers(e.selectExpr("src as unique_id"), e).collect()} == {f"n{i}": i for i in range(4)}


def test_a_manifest_is_parsed_once_and_edges_of_two_versions_are_exchanged_once(spark):
    text = '{"nodes": {"model.s.a": {"unique_id": "model.s.a", "name": "a", "resource_type": "model"}}}'
    nodes, edges = build.from_manifest(artifacts.parse_manifest(spark, text))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan(nodes) + plan(edges) and nodes.first().unique_id == "model.a"
    a, b = (spark.createDataFrame(rows, EDGES) for rows in ([("x", "y", "ref"), ("x", "y", "ref"), ("p", "q", None)], [("x", "z", "ref"), ("p", "q", None)]))
    with settings(spark):
        found = diff.edge_diff(a, b)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert {tuple(r) for r in found.collect()} == {("x", "z", "ref", "added"), ("x", "y", "ref", "removed")}
