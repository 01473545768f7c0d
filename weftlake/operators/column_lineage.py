"""Which columns an output column comes from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calls
from ..functions.select_list import select_sources
from ..runtime import cut, light


def select_items(sql: DataFrame) -> DataFrame:
    """(unique_id, at, column_name, source_alias, source_column, is_star, is_derived) of (unique_id, content)."""
    return sql.select("unique_id", F.posexplode(select_sources("content")).alias("at", "s")).select("unique_id", "at", "s.*")


def table_refs(sql: DataFrame) -> DataFrame:
    """(unique_id, at, alias, node_id) of the tables in (unique_id, content)."""
    return sql.select("unique_id", F.posexplode(calls.table_refs(F.col("content"))).alias("at", "r")).select("unique_id", "at", "r.alias", "r.node_id")


def column_edges(sql: DataFrame, nodes: DataFrame) -> DataFrame:
    """COLUMN_EDGES of the texts in (unique_id, content).

    star: every known column of every table of the text. derived: a column without one source. aliased or direct: by the
    alias, else by the only table of the text; without either there is no edge.
    """
    refs, items = table_refs(sql), cut(select_items(sql))
    named = refs.where("alias is not null").groupBy("unique_id", F.col("alias").alias("source_alias")).agg(F.max_by("node_id", "at").alias("named"))
    only = refs.groupBy("unique_id").agg(F.when(F.count("node_id") == 1, F.first("node_id")).alias("only"))
    known = nodes.select(F.col("unique_id").alias("node_id"), "columns")
    star = items.where("is_star").select("unique_id", "at").join(refs.select("unique_id", "node_id"), "unique_id").join(known, "node_id").select("node_id", "unique_id", F.explode("columns").alias("c"))
    star = star.select(F.col("node_id").alias("source_node"), F.col("c").alias("source_column"), F.col("unique_id").alias("target_node"), F.col("c").alias("target_column"), F.lit("star").alias("confidence"))
    i = items.where("not is_star").join(only, "unique_id", "left").join(named, ["unique_id", "source_alias"], "left")
    node = F.when(F.col("is_derived"), F.coalesce("only", F.lit(""))).otherwise(F.coalesce("named", "only"))
    kind = F.when(F.col("is_derived"), "derived").when(F.col("source_alias").isNotNull() & (F.col("source_column") != F.col("column_name")), "aliased").otherwise("direct")
    plain = i.select(node.alias("source_node"), F.when(F.col("is_derived"), "").otherwise(F.col("source_column")).alias("source_column"), F.col("unique_id").alias("target_node"), F.col("column_name").alias("target_column"), kind.alias("confidence")).where("source_node is not null")
    return plain.unionByName(star)


def resolve(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """COLUMN_EDGES of all nodes whose file is among the files, paths being relative to the project."""
    sql = nodes.where("file_path is not null and node_type in ('model', 'snapshot', 'test')").select("unique_id", "file_path").join(files.select(F.col("path").alias("file_path"), "content"), "file_path").select("unique_id", "content")
    return column_edges(sql, nodes)


def into(edges: DataFrame, unique_id: str) -> DataFrame:
    return edges.where(F.col("target_node") == unique_id)


def provenance(edges: DataFrame, node: str, column: str, depth: int = 100) -> DataFrame:
    """(node, column, hops) of all columns that one comes from, over any number of nodes."""
    spark = edges.sparkSession
    levels = [spark.createDataFrame([(node, column, 0)], "node string, `column` string, hops int")]
    pairs = cut(edges.where("source_column != ''").select("source_node", "source_column", "target_node", "target_column").distinct())
    while len(levels) <= depth:
        at = levels[-1].select(F.col("node").alias("target_node"), F.col("column").alias("target_column"))
        step = pairs.join(light(at), ["target_node", "target_column"]).select(F.col("source_node").alias("node"), F.col("source_column").alias("column")).distinct()
        seen = reduce(DataFrame.unionByName, levels).select("node", "column")
        new = cut(step.join(seen, ["node", "column"], "left_anti").withColumn("hops", F.lit(len(levels))))
        if new.isEmpty():
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, levels)
