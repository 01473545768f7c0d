"""A small project on disk, as files, as a manifest and in git; reports and the command line."""

import json
import os
import subprocess

import pytest

from weftlake import cli
from weftlake.errors import ArtifactParseError, CycleDetected, FileReadError, ModelNotFound, ProjectNotFound, YamlParseError
from weftlake.operators import build, column_lineage, diff, explore, impact, layout, select, status, traverse
from weftlake.schemas import EDGES, NODES, violations
from weftlake.sinks import reports
from weftlake.sources import artifacts, git, project
from weftlake.streaming import run_status

FILES = {
    "dbt_project.yml": "name: shop\nmodel-paths: [models]\n",
    "models/stage/schema.yml": "sources:\n - name: raw\n   description: all\n   tables: [{name: sales, description: each sale}, {name: people}]\nmodels:\n - {name: st_sales, description: Sales., tags: [b, a], config: {materialized: view, tags: [c, a]}}\n",
    "models/stage/st_sales.sql": "select id as sale_id, person_id, price from {{ source('raw', 'sales') }}",
    "models/stage/st_people.sql": "{{ config(materialized='view', tags=['p']) }} select id as person_id, name from {{ source('raw', 'people') }}",
    "models/marts/spend.sql": "{{ config(materialized='table') }} select p.person_id, p.name as who, sum(s.price) as total from {{ ref('st_people') }} p join {{ ref('st_sales') }} s on s.person_id = p.person_id group by 1, 2",
    "models/marts/broken.yml": "a: [",
    "models/marts/extra.yaml": "exposures:\n - {name: board, description: d, depends_on: [\"ref('spend')\", \"source('raw', 'sales')\", \"ref('nope')\"]}\n",
    "models/marts/lost.sql": "select * from {{ ref('gone') }} union all select * from {{ source('un', 'known') }} union all select * from {{ ref('places') }}",
    "seeds/places.csv": "a,b\n1,2\n",
    "tests/positive.sql": "select * from {{ ref('spend') }} where total < 0",
    "snapshots/hist.sql": "select * from {{ ref('st_sales') }}",
}


def entry(key, kind=None, on=(), **more):
    return {key: {"unique_id": key, "name": key.rpartition(".")[2], "depends_on": {"nodes": list(on)}, **({"resource_type": kind} if kind else {}), **more}}


MANIFEST = {
    "nodes": entry("model.shop.st", "model", ["source.shop.raw.sales", "model.shop.nope"], config=dict(materialized="view", tags=["x"]), description=" ", extra=1)
    | entry("model.shop.mart", "analysis", ["model.st"], config=dict(materialized="table"), description="d", path="marts/mart.sql"),
    "sources": entry("source.shop.raw.sales", source_name="raw"),
    "exposures": entry("exposure.shop.board", on=["model.shop.mart"]),
}
RESULTS = {"results": [
    {"unique_id": "model.shop.st_sales", "status": "error", "timing": []},
    {"unique_id": "model.shop.st_sales", "status": "success", "timing": [{"name": "c", "completed_at": "2000-01-01T00:00:00Z"}, {"name": "e", "completed_at": None}]},
    {"unique_id": "model.shop.st_people", "status": "pass", "timing": [{"name": "e", "completed_at": "2100-01-01T00:00:00Z"}]},
    {"unique_id": "model.shop.spend", "status": "fail", "message": "bad", "timing": []},
    {"unique_id": "model.shop.lost", "status": "skipped"}, {"unique_id": "odd", "status": "success"},
]}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("proj ect")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def built(spark, root):
    files = project.discover(spark, project.Project.load(root))
    nodes, edges = build.from_files(files)
    return nodes.cache(), edges.cache(), files.cache()


def pairs(edges):
    return sorted((r.src, r.dst, r.edge_type) for r in edges.collect())


def test_graph_from_files(built):
    nodes, edges, files = built
    n = {r.unique_id: r for r in nodes.collect()}
    assert sorted(n) == sorted(["source.raw.sales", "source.raw.people", "model.st_sales", "model.st_people", "model.spend", "model.lost", "seed.places", "snapshot.hist", "test.positive", "exposure.board", "model.gone", "source.un.known"])
    assert n["model.gone"].node_type == n["source.un.known"].node_type == "phantom" and n["source.un.known"].label == "un.known"
    s = n["model.st_sales"]
    assert (s.materialization, s.tags, s.description, s.file_path, s.columns) == ("view", ["a", "b", "c"], "Sales.", "models/stage/st_sales.sql", ["sale_id", "person_id", "price"])
    assert n["source.raw.sales"].description == "each sale" and n["source.raw.people"].description == "all"
    assert pairs(edges) == sorted([
        ("source.raw.sales", "model.st_sales", "source"), ("source.raw.people", "model.st_people", "source"), ("model.st_people", "model.spend", "ref"), ("model.st_sales", "model.spend", "ref"),
        ("model.gone", "model.lost", "ref"), ("seed.places", "model.lost", "ref"), ("source.un.known", "model.lost", "source"), ("model.spend", "test.positive", "ref"), ("model.st_sales", "snapshot.hist", "ref"), ("model.spend", "exposure.board", "exposure"),
    ])
    assert violations(nodes, edges).count() == 0 and files.where("kind = 'seed'").first().content is None


def test_column_lineage(built):
    nodes, _, files = built
    edges = column_lineage.resolve(nodes, files)
    got = {(r.source_node, r.source_column, r.target_node, r.target_column, r.confidence) for r in edges.collect()}
    assert ("model.st_people", "name", "model.spend", "who", "aliased") in got and ("model.st_people", "person_id", "model.spend", "person_id", "direct") in got
    assert ("", "", "model.spend", "total", "derived") in got and ("source.raw.sales", "sale_id", "model.st_sales", "sale_id", "direct") in got
    assert {x for x in got if x[2] == "test.positive"} == {("model.spend", c, "test.positive", c, "star") for c in ("person_id", "who", "total")}
    up = column_lineage.provenance(edges, "model.spend", "who").collect()
    assert {(r.node, r.column, r.hops) for r in up} == {("model.spend", "who", 0), ("model.st_people", "name", 1), ("source.raw.people", "name", 2)}
    assert column_lineage.into(edges, "test.positive").count() == 3


def test_queries_on_the_project(spark, built):
    nodes, edges, _ = built
    kept, sub = select.filtered(nodes, edges, "st_sales", up=1, down=1, include=())
    assert {r.unique_id for r in kept.collect()} == {"source.raw.sales", "model.st_sales", "model.spend"} and sub.count() == 2
    assert {r.unique_id for r in select.filtered(nodes, edges, "+spend+", select="path:models/marts,tag:p")[0].collect()} == {"model.spend", "model.st_people", "exposure.board"}
    with pytest.raises(ModelNotFound):
        select.focus(nodes, "nothing")
    with pytest.raises(CycleDetected):
        select.filtered(nodes, edges.union(spark.createDataFrame([("model.spend", "model.st_sales", "ref")], EDGES)))
    report = impact.report(nodes, edges, "st_sales")
    assert (report["source"], report["overall"], report["models"], report["tests"], report["exposures"], report["longest_path_length"]) == ("model.st_sales", "critical", 1, 1, 1, 2)
    assert [r["severity"] for r in report["impacted"]] == ["critical", "high", "medium", "low"] and "spend" in reports.impact_text(report) and json.loads(reports.impact_json(report))
    assert impact.lookup(nodes, "raw.sales").first().unique_id == "source.raw.sales"
    assert impact.summary(impact.impacted(nodes, edges, nodes.where("unique_id = 'exposure.board'"))).first().overall == "low"
    levels = {r.unique_id: r.layer for r in traverse.layers(nodes, edges).collect()}
    assert levels["source.raw.sales"] == 0 and levels["model.spend"] == 2 and levels["exposure.board"] == 3
    g = {r.group_key: (r.label, r.n_nodes) for r in explore.groups(nodes).collect()}
    assert g["models/marts"] == ("models/marts", 3) or g["models/marts"][1] >= 2 and g["(unresolved)"][1] == 2
    detail = explore.node_detail(nodes, edges, "model.spend")
    assert detail["neighbours"].count() == 4 and detail["impact"].first().affected == 2


def test_run_status(spark, built, root):
    nodes, _, files = built
    (root / "target").mkdir(exist_ok=True)
    assert artifacts.read_run_results(spark, root) is None
    (root / "target" / "run_results.json").write_text(json.dumps(RESULTS, indent=1))
    results = artifacts.read_run_results(spark, root)
    times = files.selectExpr("path as file_path", "modified_at")
    got = {r.unique_id: r for r in status.statuses(nodes, results, times).collect()}
    assert {k[6:]: v.status for k, v in got.items() if v.status != "never_run"} == {"st_sales": "outdated", "st_people": "success", "spend": "error", "lost": "skipped"}
    assert got["model.spend"].message == "bad" and got["model.st_sales"].modified_at is not None and len(got) == 12
    looks = {r.status: (r.symbol, r.label, r.colour) for r in status.statuses(nodes, results, times).select("status", *status.look()).collect()}
    assert looks["error"] == ("x", "Error: bad", "red") and looks["success"][1] == "Success (2100-01-01 00:00:00)" and looks["never_run"][1] == "Never Run"
    (root / "target" / "run_results.json").write_text("{")
    with pytest.raises(ArtifactParseError):
        artifacts.read_run_results(spark, root)
    (root / "target" / "run_results.json").unlink()


def test_streamed_run_results(spark, built, tmp_path):
    nodes, _, files = built
    times = files.selectExpr("path as file_path", "modified_at")
    inbox, out, mark = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/mark"
    inbox.mkdir()

    def step(name, rows):
        (inbox / f".{name}").write_text(json.dumps({"results": rows}))
        os.rename(inbox / f".{name}", inbox / name)
        run_status.follow(spark, f"file://{inbox}", nodes, times, out, mark).awaitTermination()
        return {r.unique_id: r.status for r in run_status.current(spark, out).collect()}

    assert step("1.json", RESULTS["results"])["model.spend"] == "error"
    now = step("2.json", [{"unique_id": "model.shop.spend", "status": "success", "timing": [{"name": "e", "completed_at": "2100-01-01T00:00:00Z"}]}])
    assert now["model.spend"] == "success" and now["model.lost"] == "skipped" and len(now) == 12
    assert spark.read.parquet(f"{out}/v=1").count() == 1
    run_status.compact(spark, out)
    assert {r.unique_id: r.status for r in run_status.current(spark, out).collect()} == now and run_status.versions(spark, out) == [1]
    assert step("3.json", [{"unique_id": "model.shop.spend", "status": "fail"}])["model.spend"] == "error"


def test_column_lineage_is_resolved_when_first_shown(built):
    nodes, _, files = built
    lazy = explore.ColumnLineage(nodes, files)
    first = lazy.toggle()
    assert first.count() > 0 and lazy.toggle() is None and lazy.toggle() is first


def test_manifest(spark, tmp_path):
    nodes, edges = build.from_manifest(artifacts.parse_manifest(spark, json.dumps(MANIFEST)))
    n = {r.unique_id: r for r in nodes.collect()}
    assert set(n) == {"source.raw.sales", "model.st", "model.mart", "exposure.board"} and n["model.st"].tags == ["x"] and n["model.st"].description is None and n["model.mart"].node_type == "model"
    assert pairs(edges) == [("model.mart", "exposure.board", "exposure"), ("model.st", "model.mart", "ref"), ("source.raw.sales", "model.st", "source")]
    for text in ("{", "[]", json.dumps({"nodes": {"a": {"name": "x"}}})):
        with pytest.raises(ArtifactParseError):
            artifacts.parse_manifest(spark, text)
    with pytest.raises(FileReadError):
        artifacts.manifest_path(tmp_path)


def test_project_errors(tmp_path):
    with pytest.raises(ProjectNotFound):
        project.Project.load(tmp_path)
    (tmp_path / "dbt_project.yml").write_text("version: 1")
    with pytest.raises(YamlParseError):
        project.Project.load(tmp_path)
    with pytest.raises(FileReadError):
        project.read_file(tmp_path / "none")


def test_diff_of_versions(spark, root, built):
    def g(*a):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)

    assert not git.is_repo(root)
    g("init", "-q", "-b", "trunk")
    g("add", "-A")
    g("commit", "-qm", "one")
    assert git.is_repo(root) and git.current_ref(root) == "trunk" and "models/marts/spend.sql" in git.listed(root, "trunk", "models")
    with pytest.raises(FileReadError):
        git.check_ref(root, "nowhere")
    same = json.loads(cli.run(spark, ["diff", "-p", str(root), "--base", "trunk", "-o", "json"]))
    assert set(same["summary"].values()) == {0} and not same["edges"]
    (root / "models/marts/more.sql").write_text("select 1 as one from {{ ref('spend') }}")
    (root / "models/stage/st_people.sql").write_text(FILES["models/stage/st_people.sql"].replace("'view'", "'table'"))
    (root / "models/marts/lost.sql").unlink()
    text = cli.run(spark, ["diff", "-p", str(root), "--base", "trunk"])
    assert "+ more (model)" in text and "- lost (model)" in text and 'materialization: "view" -> "table"' in text and "+ model.spend -> model.more (ref)" in text
    g("checkout", "-q", ".")
    (root / "models/marts/more.sql").unlink()
    with pytest.raises(FileReadError):
        git.show_all(root, "trunk", ["models/marts/spend.sql", "none"])
    (root / "dbt_project.yml").write_text("name: shop\nmodel-paths: [elsewhere]\n")  # a revision is read by its own settings
    assert cli.graph_at(spark, root, "trunk")[0].where("unique_id = 'model.spend'").count() == 1
    g("checkout", "-q", ".")


def test_node_changes(spark):
    base = spark.createDataFrame([("a", "a", "model", None, None, "view", ["x"], ["c"]), ("b", "b", "model", None, "d", None, [], [])], NODES)
    head = spark.createDataFrame([("a", "a", "model", None, "new", None, ["x", "y"], ["c", "e"]), ("b", "b", "model", "p", "d", None, [], []), ("b", "b", "model", "p", "d", None, [], [])], NODES)
    got = {r.unique_id: (r.status, r.changes) for r in diff.node_diff(base, head).collect()}
    assert got == {"a": ("modified", ['materialization: "view" -> none', "tags: [x] -> [x, y]", "columns: 1 -> 2", "description changed"]), "b": ("unchanged", [])}


@pytest.mark.parametrize("form,parts", [("dot", ["digraph lineage", '"model.st_sales" -> "model.spend"']), ("mermaid", ["flowchart LR", "model_st_sales --> model_spend"]), ("json", ['"unique_id": "model.spend"']), ("svg", ["<svg", "spend</text>", "<path"]), ("html", ["<!DOCTYPE html>", "JSON.parse"]), ("ascii", ["[ spend ]", "model.st_sales ──▶ model.spend"])])
def test_formats(spark, root, form, parts):
    out = cli.run(spark, ["lineage", "-p", str(root), "spend", "-o", form, "--include-exposures"])
    assert all(p in out for p in parts)
    if form == "json":
        found = json.loads(out)
        assert len(found["nodes"]) == 6 and all("description" not in n or n["description"] for n in found["nodes"])


def test_impact_command(spark, root):
    assert "critical" in cli.run(spark, ["impact", "-p", str(root), "st_sales"])
    with pytest.raises(ModelNotFound):
        cli.run(spark, ["impact", "-p", str(root), "nothing"])


def test_layout_crosses_less():
    order = layout.sweep({0: ["a", "b"], 1: ["x", "y"]}, [("a", "y"), ("b", "x")])
    assert [order[0].index(a) - order[0].index("a") for a in "ab"] == [order[1].index(z) - order[1].index("y") for z in "yx"]


def test_yaml_of_one_file_is_parsed_by_many_tasks_and_json_as_yaml(spark):
    import yaml

    files = spark.createDataFrame([(f"m{i}.yml", "yaml", "{}", None) for i in range(50)], project.FILES).coalesce(1)
    assert project.schema_files(files).rdd.getNumPartitions() > 1
    texts = ['{"a":1,"b":[true,null,"x\\u00e9\\ud83d\\ude00\\/"],"a":-2}', '{"a":1e3,"b":1.50}', '{"a":-0,"<<":{"b":"2020-01-01"}}', '{"a":"\x7f"}', '{"a":"x\u2028 y"}', '{"a":\n 1}', "{a: b}", "- {c: 1}", "{", '{"' + "k" * 1100 + '":1}', '{"' + '\\"' * 600 + '":"' + "v" * 1100 + '"}', '{"k":"' + "v" * 1100 + '"}', '{"a":"\U0001f600"}']

    def read(parse, text):
        try:
            return json.dumps(parse(text), default=str)
        except (yaml.YAMLError, ValueError, TypeError):
            return None

    assert [read(project.parsed, t) for t in texts] == [read(yaml.safe_load, t) for t in texts]
