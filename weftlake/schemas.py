"""The tables that operators take and give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_TYPES = ["model", "source", "seed", "snapshot", "test", "exposure", "phantom"]
EDGE_TYPES = ["ref", "source", "test", "exposure"]
NODES = "unique_id string, label string, node_type string, file_path string, description string, materialization string, tags array<string>, columns array<string>"
EDGES = "src string, dst string, edge_type string"
COLUMN_EDGES = "source_node string, source_column string, target_node string, target_column string, confidence string"
RUN_RESULTS = "results array<struct<unique_id:string,status:string,message:string,timing:array<struct<name:string,completed_at:timestamp>>>>"
MANIFEST = """nodes map<string,struct<unique_id:string,name:string,resource_type:string,depends_on:struct<nodes:array<string>>,config:struct<materialized:string,tags:array<string>>,description:string,path:string,original_file_path:string>>,
sources map<string,struct<unique_id:string,name:string,source_name:string,resource_type:string,description:string,path:string,original_file_path:string>>,
exposures map<string,struct<unique_id:string,name:string,depends_on:struct<nodes:array<string>>,description:string,label:string>>"""
PREFIX = {"model": "", "source": "src:", "seed": "seed:", "snapshot": "snap:", "test": "test:", "exposure": "exp:", "phantom": "?:"}


def empty_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NODES)


def display_name():
    """Label with the prefix of its node type."""
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])
    return F.concat(F.coalesce(prefix[F.col("node_type")], F.lit("")), F.col("label"))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, detail): values outside the closed sets, repeated ids and edges without both ends."""
    ids = nodes.select("unique_id")
    return (
        nodes.where(~F.col("node_type").isin(NODE_TYPES)).select(F.lit("node_type").alias("kind"), F.col("unique_id").alias("detail"))
        .unionByName(edges.where(~F.col("edge_type").isin(EDGE_TYPES)).select(F.lit("edge_type").alias("kind"), F.concat_ws(" ", "src", "dst").alias("detail")))
        .unionByName(ids.groupBy("unique_id").count().where("count > 1").select(F.lit("duplicate").alias("kind"), F.col("unique_id").alias("detail")))
        .unionByName(edges.join(ids.withColumnRenamed("unique_id", "src"), "src", "left_anti").unionByName(edges.join(ids.withColumnRenamed("unique_id", "dst"), "dst", "left_anti")).select(F.lit("dangling").alias("kind"), F.concat_ws(" ", "src", "dst").alias("detail")).distinct())
    )
