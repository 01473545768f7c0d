"""Parts of a graph: focus, selectors, node types, induced subgraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CycleDetected, ModelNotFound
from ..runtime import cut
from . import traverse

OPTIONAL = ("test", "seed", "snapshot", "exposure")


def parse_selectors(text: str) -> list[tuple[str, str]]:
    """(kind, value) of each part between commas: tag:x, path:x, or a name."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        kind, colon, value = part.partition(":")
        out.append((kind, value) if colon and kind in ("tag", "path") else ("name", part))
    return out


def parsed_selectors(text: Column) -> Column:
    """The same as array<struct<kind, value>> of a column of selector texts."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    prefix = lambda p: F.when(p.startswith("tag:"), "tag").when(p.startswith("path:"), "path")
    return F.transform(parts, lambda p: F.struct(F.coalesce(prefix(p), F.lit("name")).alias("kind"), F.when(prefix(p).isNull(), p).otherwise(F.regexp_replace(p, "^[a-z]+:", "")).alias("value")))


def selector(text: str) -> Column:
    """Nodes that any part selects: by tag, by the beginning of the path, by label."""
    tests = {"tag": lambda v: F.array_contains("tags", v), "path": lambda v: F.coalesce(F.col("file_path").startswith(v), F.lit(False)), "name": lambda v: F.col("label") == v}
    return reduce(lambda a, b: a | b, (tests[k](v) for k, v in parse_selectors(text)), F.lit(False))


def focus(nodes: DataFrame, name: str) -> DataFrame:
    """The node of that label or model id: a model before others, then the least id."""
    found = nodes.where((F.col("label") == name) | (F.col("unique_id") == f"model.{name}")).orderBy(F.col("node_type") != "model", "unique_id").limit(1)
    if found.isEmpty():
        raise ModelNotFound(name)
    return found


def keep_types(nodes: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """Models, sources and phantoms, and those of the other types that are asked for."""
    return nodes.where(~F.col("node_type").isin([t for t in OPTIONAL if t not in include] or [""]))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    ids = kept.select("unique_id").distinct()
    return edges.join(ids.withColumnRenamed("unique_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("unique_id", "dst"), "dst", "left_semi").select("src", "dst", "edge_type")


def filtered(nodes: DataFrame, edges: DataFrame, model: str | None = None, up: int | None = None, down: int | None = None, select: str | None = None, include: tuple[str, ...] = OPTIONAL, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """The part of a graph that was asked for. With a focus, selectors narrow what it reaches; "+m", "m+" name neighbours."""
    edges = cut(edges)
    if check and traverse.has_cycle(edges):
        raise CycleDetected("the graph has a cycle")
    kept = nodes
    if model is not None:
        if model[:1] == "+" or model[-1:] == "+":
            up, down = None if model[0] == "+" else 0, None if model[-1] == "+" else 0
        start = focus(nodes, model.strip("+"))
        ids = traverse.reach(edges, start, down).union(traverse.reach(edges, start, up, upstream=True)).select("unique_id").distinct()
        kept = kept.join(ids, "unique_id", "left_semi")
    if select:
        kept = kept.where(selector(select))
    kept = keep_types(kept, include)
    return kept, induced(edges, kept)


def neighbours(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(unique_id, direction, neighbour): direct ones, as often as there are edges."""
    s = starts.select("unique_id")
    up = edges.join(s.withColumnRenamed("unique_id", "dst"), "dst", "left_semi").select(F.col("dst").alias("unique_id"), F.lit("upstream").alias("direction"), F.col("src").alias("neighbour"))
    down = edges.join(s.withColumnRenamed("unique_id", "src"), "src", "left_semi").select(F.col("src").alias("unique_id"), F.lit("downstream").alias("direction"), F.col("dst").alias("neighbour"))
    return up.unionByName(down)
