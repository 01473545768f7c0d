"""What a change of a node affects, and how badly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ModelNotFound
from ..runtime import cut
from . import traverse

SEVERITIES = ["low", "medium", "high", "critical"]


def severity_rank() -> Column:
    """0 to 3: tests, most others, tables and marts, exposures."""
    mart = F.coalesce(F.contains("file_path", F.lit("mart")), F.lit(False))
    table = F.coalesce(F.col("materialization").isin("table", "incremental"), F.lit(False))
    return F.when(F.col("node_type") == "exposure", 3).when(F.col("node_type") == "test", 0).when((F.col("node_type") == "model") & (table | mart), 2).otherwise(1)


def severity(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank + 1)


def lookup(nodes: DataFrame, name: str) -> DataFrame:
    """The node that a name means: a model of that label, another node of it, then one whose id ends in it."""
    suffix = F.col("unique_id").endswith("." + name)
    rank = F.when((F.col("label") == name) & (F.col("node_type") == "model"), 0).when(F.col("label") == name, 1).when(suffix, 2)
    found = nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", "unique_id").limit(1).drop("rank")
    if found.isEmpty():
        raise ModelNotFound(name)
    return found


def impacted(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """(unique_id, label, node_type, distance, severity_rank, severity) of all that the start leads to."""
    far = traverse.reach(edges, start).where("depth > 0")
    return far.join(nodes, "unique_id").select("unique_id", "label", "node_type", F.col("depth").alias("distance"), severity_rank().alias("severity_rank")).withColumn("severity", severity(F.col("severity_rank")))


def ordered(rows: DataFrame) -> DataFrame:
    """Worst first, then nearest."""
    return rows.orderBy(F.desc("severity_rank"), "distance", "unique_id")


def placed(rows: DataFrame) -> DataFrame:
    """The same order as a column: place, from 0."""
    keyed = rows.withColumns({"all": F.lit(0), "good": 3 - F.col("severity_rank")})
    return traverse.ranked(keyed, "all", ["good", "distance", "unique_id"]).drop("all", "good").withColumnRenamed("rank", "place")


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many models, tests and exposures, and the worst severity (low if nothing is affected)."""
    count = lambda t: F.count_if(F.col("node_type") == t).alias(f"{t}s")
    worst = F.coalesce(F.max("severity_rank"), F.lit(0))
    return rows.agg(F.count("unique_id").alias("affected"), count("model"), count("test"), count("exposure"), severity(worst).alias("overall"))


def report_row(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """One row: the source, the summary, and the labels of a longest path."""
    rows = impacted(nodes, edges, start)
    labels = nodes.groupBy("unique_id").agg(F.min("label").alias("label"))
    path = traverse.longest_path(edges, start).join(labels, "unique_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "label"))), lambda x: x.label).alias("longest_path"))
    one = start.agg(F.min("unique_id").alias("source"))
    return one.crossJoin(summary(rows)).crossJoin(path).withColumn("longest_path_length", F.size("longest_path") - 1)


def report(nodes: DataFrame, edges: DataFrame, name: str) -> dict:
    """All of it for one node, collected; for renderers."""
    nodes, edges = cut(nodes), cut(edges)
    start = cut(lookup(nodes, name))
    return {**report_row(nodes, edges, start).first().asDict(), "impacted": [r.asDict() for r in ordered(impacted(nodes, edges, start)).collect()]}
