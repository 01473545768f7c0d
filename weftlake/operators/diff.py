"""Differences between two graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import traverse

STATUSES = ["added", "modified", "removed", "unchanged"]
_COMPARED = ["materialization", "tags", "columns", "description"]


def one_per_id(nodes: DataFrame) -> DataFrame:
    """The last row of each id, by label, path and settings."""
    rest = [c for c in nodes.columns if c != "unique_id"]
    return nodes.groupBy("unique_id").agg(F.max(F.struct(*rest)).alias("n")).select("unique_id", "n.*")


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "edge_type").distinct()


def _quoted(c):
    return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("none"))


def node_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(unique_id, label, node_type, status, changes): a full outer join; what changed, in words, if both have the node."""
    b, h = one_per_id(base), one_per_id(head)
    j = b.select("unique_id", F.struct(*[c for c in b.columns if c != "unique_id"]).alias("b")).join(h.select("unique_id", F.struct(*[c for c in h.columns if c != "unique_id"]).alias("h")), "unique_id", "full")
    differs = {c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}")) for c in _COMPARED}
    words = F.array_compact(F.array(
        F.when(differs["materialization"], F.concat(F.lit("materialization: "), _quoted(F.col("b.materialization")), F.lit(" -> "), _quoted(F.col("h.materialization")))),
        F.when(differs["tags"], F.concat(F.lit("tags: ["), F.array_join("b.tags", ", "), F.lit("] -> ["), F.array_join("h.tags", ", "), F.lit("]"))),
        F.when(differs["columns"], F.concat(F.lit("columns: "), F.size("b.columns").cast("string"), F.lit(" -> "), F.size("h.columns").cast("string"))),
        F.when(differs["description"], F.lit("description changed")),
    ))
    both = F.col("b").isNotNull() & F.col("h").isNotNull()
    changes = F.when(both, words).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").when(F.size(words) > 0, "modified").otherwise("unchanged")
    return j.select("unique_id", F.coalesce("h.label", "b.label").alias("label"), F.coalesce("h.node_type", "b.node_type").alias("node_type"), status.alias("status"), changes.alias("changes"))


def edge_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(src, dst, edge_type, status): edges that one side alone has."""
    key = ["src", "dst", "edge_type"]
    one = lambda df, b, h: df.select(*key, F.lit(b).alias("b"), F.lit(h).alias("h"))
    both = one(base, 1, 0).unionByName(one(head, 0, 1)).groupBy(*key).agg(F.max("b").alias("b"), F.max("h").alias("h"))  # exchanged once
    return both.where("b != h").select(*key, F.when(F.col("h") == 1, "added").otherwise("removed").alias("status"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of five counts."""
    n = nodes.agg(*(F.count_if(F.col("status") == s).alias(f"nodes_{s}") for s in STATUSES[:3]))
    return n.crossJoin(edges.agg(*(F.count_if(F.col("status") == s).alias(f"edges_{s}") for s in ("added", "removed"))))


def ordered(nodes: DataFrame) -> DataFrame:
    """Added, modified, removed, unchanged."""
    return nodes.orderBy(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), "unique_id")


def placed(nodes: DataFrame) -> DataFrame:
    """The same order as a column: place, from 0."""
    keyed = nodes.withColumns({"all": F.lit(0), "kind": F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))})
    return traverse.ranked(keyed, "all", ["kind", "unique_id"]).drop("all", "kind").withColumnRenamed("rank", "place")
