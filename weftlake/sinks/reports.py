"""Reports of impact and of differences, as text and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff
from . import drawings, lines

FORMATS = {"dot": lines.dot, "mermaid": lines.mermaid, "json": lines.to_json, "svg": drawings.svg, "html": drawings.html, "ascii": drawings.ascii}


def impact_lines(rows: DataFrame) -> DataFrame:
    """(unique_id, line) of what is affected."""
    return rows.select("unique_id", F.format_string("  [%s] %s (%s, %d away)", "severity", "label", "node_type", "distance").alias("line"))


def diff_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, line) of nodes that changed, with what changed in lines below, and of edges."""
    sign = lambda: F.when(F.col("status") == "added", "+").when(F.col("status") == "removed", "-").otherwise("~")
    more = F.array_join(F.transform("changes", lambda c: F.concat(F.lit("\n    "), c)), "")
    n = nodes.where("status != 'unchanged'").select(F.col("unique_id").alias("key"), F.concat(F.format_string("%s %s (%s)", sign(), "label", "node_type"), more).alias("line"))
    return n.unionByName(edges.select(F.concat_ws(" ", "src", "dst").alias("key"), F.format_string("%s %s -> %s (%s)", sign(), "src", "dst", "edge_type").alias("line")))


def impact_text(report: dict) -> str:
    head = [f"Impact of {report['source']}: {report['overall']}", f"  {report['models']} models, {report['tests']} tests, {report['exposures']} exposures"]
    rows = [f"  [{r['severity']}] {r['label']} ({r['node_type']}, {r['distance']} away)" for r in report["impacted"]]
    return "\n".join([*head, f"  longest path ({report['longest_path_length']}): {' -> '.join(report['longest_path'])}", *rows, ""])


def impact_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


def diff_data(nodes: DataFrame, edges: DataFrame) -> dict:
    return {"summary": diff.summary(nodes, edges).first().asDict(), "nodes": [r.asDict() for r in diff.ordered(nodes).collect()], "edges": [r.asDict() for r in edges.orderBy("status", "src", "dst").collect()]}


def diff_text(found: dict) -> str:
    s, sign = found["summary"], {"added": "+", "modified": "~", "removed": "-"}
    rows = [f"{sign[n['status']]} {n['label']} ({n['node_type']})" + "".join(f"\n    {c}" for c in n["changes"]) for n in found["nodes"] if n["status"] != "unchanged"]
    ends = [f"{sign[e['status']]} {e['src']} -> {e['dst']} ({e['edge_type']})" for e in found["edges"]]
    return "\n".join([f"nodes: {s['nodes_added']} added, {s['nodes_modified']} modified, {s['nodes_removed']} removed; edges: {s['edges_added']} added, {s['edges_removed']} removed", *rows, *ends, ""])


def diff_json(found: dict) -> str:
    return json.dumps(found, indent=2, ensure_ascii=False)
