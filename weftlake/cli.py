"""Command line: lineage, impact and diff of a project."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import FileReadError, LineageError
from .operators import build, diff, impact, select
from .runtime import cut
from .session import ship
from .sinks import reports
from .sources import artifacts, git, project


def graph(spark: SparkSession, root: str | Path, manifest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a manifest if one is given, else of the project's files; written once, as all that follows rereads them."""
    if manifest:
        made = build.from_manifest(artifacts.read_manifest(spark, manifest))
    else:
        made = build.from_files(cut(project.discover(spark, project.Project.load(root))))
    return cut(made[0]), cut(made[1])


def graph_at(spark: SparkSession, root: str | Path, ref: str) -> tuple[DataFrame, DataFrame]:
    """The graph at a revision: of its manifest if it has one, else of its files, edges included."""
    git.check_ref(root, ref)
    try:
        made = build.from_manifest(artifacts.parse_manifest(spark, git.show(root, ref, "target/manifest.json"), ref))
    except FileReadError:
        p = project.Project.parse(git.show(root, ref, "dbt_project.yml"), Path(root), ref)
        made = build.from_files(git.files_at(spark, root, ref, {"model": p.model_paths, "seed": p.seed_paths, "snapshot": p.snapshot_paths, "test": p.test_paths}))
    return cut(made[0]), cut(made[1])


def working_tree(spark: SparkSession, root: str | Path) -> tuple[DataFrame, DataFrame]:
    there = Path(root) / "target" / "manifest.json"
    return graph(spark, root, str(there) if there.is_file() else None)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("lineage", "impact", "diff"):
        c = sub.add_parser(name)
        c.add_argument("-p", "--project-dir", default=".")
        c.add_argument("--manifest")
        c.add_argument("-o", "--output", default="ascii" if name == "lineage" else "text", choices=list(reports.FORMATS) if name == "lineage" else ["text", "json"])
    c = sub.choices["lineage"]
    c.add_argument("model", nargs="?")
    c.add_argument("-u", "--upstream", type=int)
    c.add_argument("-d", "--downstream", type=int)
    c.add_argument("-s", "--select")
    for t in select.OPTIONAL:
        c.add_argument(f"--include-{t}s", action="store_true")
    sub.choices["impact"].add_argument("model")
    sub.choices["diff"].add_argument("--base", required=True)
    sub.choices["diff"].add_argument("--head")
    return p


def run(spark: SparkSession, argv: list[str]) -> str:
    a = parser().parse_args(argv)
    ship(spark)
    if a.command == "diff":
        if not git.is_repo(a.project_dir):
            raise FileReadError(f"{a.project_dir} is no repository")
        base = graph_at(spark, a.project_dir, a.base)
        head = graph_at(spark, a.project_dir, a.head) if a.head else working_tree(spark, a.project_dir)
        found = reports.diff_data(diff.node_diff(base[0], head[0]), diff.edge_diff(base[1], head[1]))
        return reports.diff_json(found) if a.output == "json" else reports.diff_text(found)
    nodes, edges = graph(spark, a.project_dir, a.manifest)
    if a.command == "impact":
        found = impact.report(nodes, edges, a.model)
        return reports.impact_json(found) if a.output == "json" else reports.impact_text(found)
    include = tuple(t for t in select.OPTIONAL if getattr(a, f"include_{t}s"))
    return reports.FORMATS[a.output](*select.filtered(nodes, edges, a.model, a.upstream, a.downstream, a.select, include))


def main() -> int:
    spark = SparkSession.builder.appName("weftlake").config("spark.ui.enabled", "false").getOrCreate()
    try:
        print(run(spark, sys.argv[1:]), end="")
    except LineageError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
