"""Nodes and edges of a dependency graph, from files or from a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calls, ids
from ..functions.select_list import select_columns
from ..runtime import cut
from ..schemas import NODES
from ..sources.project import schema_files

_COLUMNS = [c.strip().split()[0] for c in NODES.split(", ")]


def _none() -> Column:
    return F.lit(None).cast("string")


def _empty() -> Column:
    return F.array().cast("array<string>")


def node_rows(df: DataFrame, unique_id: Column, label: Column, node_type: Column | str, file_path=None, description=None, materialization=None, tags=None, columns=None) -> DataFrame:
    """Rows of NODES; what isn't given is null, lists are empty."""
    texts = [_none() if x is None else x for x in (file_path, description, materialization)]
    lists = [_empty() if x is None else x for x in (tags, columns)]
    given = (unique_id, label, F.lit(node_type) if isinstance(node_type, str) else node_type, *texts, *lists)
    return df.select(*(x.alias(n) for x, n in zip(given, _COLUMNS)))


def source_nodes(yaml: DataFrame) -> DataFrame:
    """A node for each table of each source; a table's description goes before its source's."""
    t = yaml.select("path", F.explode("sources").alias("s")).select("path", "s", F.explode("s.tables").alias("t"))
    label = F.concat_ws(".", "s.name", "t.name")
    return node_rows(t, F.concat(F.lit("source."), label), label, "source", F.col("path"), F.coalesce("t.description", "s.description"))


def merged_tags(*lists) -> object:
    """Distinct tags of all lists, in order."""
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(x, _empty()) for x in lists))))


def model_meta(yaml: DataFrame) -> DataFrame:
    """(name, description, tags, materialized) of models in YAML; of several files the last path counts."""
    m = yaml.select("path", F.posexplode("models").alias("at", "m"))
    last = F.row_number().over(Window.partitionBy("m.name").orderBy(F.desc("path"), F.desc("at")))
    return m.withColumn("rank", last).where("rank = 1").select("m.name", "m.description", merged_tags(F.col("m.tags"), F.col("m.config.tags")).alias("tags"), F.col("m.config.materialized").alias("materialized"))


def model_nodes(files: DataFrame, meta: DataFrame) -> DataFrame:
    """A node for each model file; SQL settings go before YAML's, tags of both are merged."""
    f = files.where("kind = 'model'").select("path", "content", ids.file_stem(F.col("path")).alias("name"), calls.config(F.col("content")).alias("sql"))
    f = f.join(meta.withColumnsRenamed({"tags": "yaml_tags", "materialized": "yaml_materialized"}), "name", "left")
    return node_rows(f, F.concat(F.lit("model."), "name"), F.col("name"), "model", F.col("path"), F.col("description"), F.coalesce("sql.materialized", "yaml_materialized"), merged_tags(F.col("sql.tags"), F.col("yaml_tags")), select_columns("content"))


def duplicate_names(files: DataFrame) -> DataFrame:
    """(name, n_files) of model names that several files define."""
    return files.where("kind = 'model'").groupBy(ids.file_stem(F.col("path")).alias("name")).agg(F.count("path").alias("n_files")).where("n_files > 1")


def file_nodes(files: DataFrame, kind: str) -> DataFrame:
    """Nodes of seeds, snapshots or tests: one for each file."""
    f = files.where(F.col("kind") == kind).select("path", ids.file_stem(F.col("path")).alias("name"))
    return node_rows(f, F.concat(F.lit(f"{kind}."), "name"), F.col("name"), kind, F.col("path"))


def sql_calls(files: DataFrame) -> DataFrame:
    """(dst, ref_name, source_label, edge_type): a row for each call in models, snapshots and tests."""
    f = files.where("kind in ('model', 'snapshot', 'test')").select(F.concat_ws(".", "kind", ids.file_stem(F.col("path"))).alias("dst"), "content")
    r = f.select("dst", F.explode(calls.refs(F.col("content"))).alias("c")).select("dst", F.col("c.name").alias("ref_name"), _none().alias("source_label"), F.lit("ref").alias("edge_type"))
    s = f.select("dst", F.explode(calls.sources(F.col("content"))).alias("c")).select("dst", _none().alias("ref_name"), F.concat_ws(".", "c.source_name", "c.table_name").alias("source_label"), F.lit("source").alias("edge_type"))
    return r.unionByName(s)


def resolve_refs(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_name, unique_id): a model, else a seed, else a snapshot of that name, else the model it would be."""
    kinds = F.array_position(F.array(*map(F.lit, ("model", "seed", "snapshot"))), F.col("node_type"))
    known = nodes.where("node_type in ('model', 'seed', 'snapshot')").groupBy(F.col("label").alias("ref_name")).agg(F.min_by("unique_id", kinds).alias("found"))
    return names.select("ref_name").distinct().join(known, "ref_name", "left").select("ref_name", F.coalesce("found", F.concat(F.lit("model."), "ref_name")).alias("unique_id"))


def sql_edges(called: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of all calls, repeated ones too; ends may be missing among the nodes."""
    r = called.where("ref_name is not null").join(resolve_refs(called.where("ref_name is not null"), nodes), "ref_name").select(F.col("unique_id").alias("src"), "dst", "edge_type")
    return r.unionByName(called.where("source_label is not null").select(F.concat(F.lit("source."), "source_label").alias("src"), "dst", "edge_type"))


def phantoms(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node for each start of an edge that is missing among the nodes."""
    missing = edges.select(F.col("src").alias("unique_id")).distinct().join(nodes.select("unique_id"), "unique_id", "left_anti")
    label = F.regexp_replace("unique_id", r"^[^.]*\.", "")
    return node_rows(missing, F.col("unique_id"), label, "phantom")


def exposures(yaml: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of exposures, and edges from the refs among their dependencies that there are."""
    e = yaml.select("path", F.explode("exposures").alias("e"))
    made = node_rows(e, F.concat(F.lit("exposure."), "e.name"), F.col("e.name"), "exposure", F.col("path"), F.col("e.description"))
    d = e.select(F.concat(F.lit("exposure."), "e.name").alias("dst"), F.explode("e.depends_on").alias("d")).select("dst", calls.exposure_ref(F.col("d")).alias("ref_name")).where("ref_name is not null")
    found = d.join(resolve_refs(d, nodes), "ref_name").join(nodes.select("unique_id").distinct(), "unique_id", "left_semi")
    return made, found.select(F.col("unique_id").alias("src"), "dst", F.lit("exposure").alias("edge_type"))


def from_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a project's files. Only ids and labels are written; what else a node has is read when it is asked for."""
    yaml = cut(schema_files(files))
    named = ["unique_id", "label", "node_type"]
    nodes = source_nodes(yaml).unionByName(model_nodes(files, model_meta(yaml)))
    for kind in ("seed", "snapshot"):
        nodes = nodes.unionByName(file_nodes(files, kind))
    known = cut(nodes.select(named))
    edges = cut(sql_edges(sql_calls(files), known))
    tests = file_nodes(files, "test")
    lost = cut(phantoms(edges, known.unionByName(tests.select(named))))
    nodes = nodes.unionByName(tests).unionByName(lost)
    made, more = exposures(yaml, known.unionByName(tests.select(named)).unionByName(lost.select(named)))
    return nodes.unionByName(made), edges.unionByName(more)


def manifest_nodes(manifest: DataFrame) -> DataFrame:
    """Sources, then other nodes, then exposures; columns are unknown."""
    path = F.coalesce("v.original_file_path", "v.path")
    s = manifest.select(F.explode("sources").alias("k", "v"))
    n = manifest.select(F.explode("nodes").alias("k", "v"))
    e = manifest.select(F.explode("exposures").alias("k", "v"))
    description = ids.non_blank(F.col("v.description"))
    label = F.concat_ws(".", "v.source_name", "v.name")
    return (
        node_rows(s, ids.manifest_id(F.col("k")), label, "source", path, description)
        .unionByName(node_rows(n, ids.manifest_id(F.col("k")), F.col("v.name"), ids.node_type(F.col("v.resource_type")), path, description, F.col("v.config.materialized"), F.coalesce("v.config.tags", _empty())))
        .unionByName(node_rows(e, ids.manifest_id(F.col("k")), F.coalesce("v.label", "v.name"), "exposure", _none(), description))
    )


def manifest_edges(manifest: DataFrame) -> DataFrame:
    """An edge for each dependency that is in the manifest, by its full or its short id."""
    full = manifest.select(F.explode(F.map_keys("sources")).alias("k")).unionByName(manifest.select(F.explode(F.map_keys("nodes")).alias("k")))
    known = full.select("k", ids.manifest_id(F.col("k")).alias("src"))
    known = known.unionByName(known.select(F.col("src").alias("k"), "src")).distinct()
    n = manifest.select(F.explode("nodes").alias("id", "v")).select("id", F.explode("v.depends_on.nodes").alias("k"), ids.edge_type(F.col("k")).alias("edge_type"))
    e = manifest.select(F.explode("exposures").alias("id", "v")).select("id", F.explode("v.depends_on.nodes").alias("k"), F.lit("exposure").alias("edge_type"))
    return n.unionByName(e).join(known, "k").select("src", ids.manifest_id(F.col("id")).alias("dst"), "edge_type")


def from_manifest(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges. The parsed manifest is written, since seven parts are read from it and each would parse the JSON again."""
    manifest = cut(manifest)
    return manifest_nodes(manifest), manifest_edges(manifest)
