"""A query for each operator, over the graphs and texts derived from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calls, ids
from ..functions.select_list import select_columns
from ..operators import build, column_lineage, diff, explore, impact, layout, select, status, traverse
from ..runtime import cut
from ..schemas import display_name
from ..sinks import drawings, lines, reports
from . import workloads as W

START, MODEL, MODEL_ID = "seed.nation_3", "order_7", "model.order_7"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


def _start(s: SparkSession, d: str) -> DataFrame:
    return W.nodes(s, d).where(F.col("unique_id") == START)


def _lines_of(s: SparkSession, d: str) -> DataFrame:
    return W.nodes(s, d).where(F.col("label").startswith("line_7_"))


# texts


@query
def extract_refs(s, d):
    return W.models(s, d).select("unique_id", F.explode(calls.refs(F.col("content"))).alias("r")).select("unique_id", "r.package", "r.name")


@query
def extract_sources(s, d):
    return W.models(s, d).select("unique_id", F.explode(calls.sources(F.col("content"))).alias("r")).select("unique_id", "r.source_name", "r.table_name")


@query
def extract_config(s, d):
    c = W.models(s, d).select("unique_id", calls.config(F.col("content")).alias("c"))
    return c.select("unique_id", "c.materialized", F.array_join("c.tags", ",").alias("tags"))


@query
def strip_comments(s, d):
    return W.models(s, d).select("unique_id", calls.strip_comments(F.col("content")).alias("sql"))


@query
def strip_template(s, d):
    return W.models(s, d).select("unique_id", calls.strip_template(F.col("content")).alias("sql"))


@query
def table_refs(s, d):
    return column_lineage.table_refs(W.models(s, d))


@query
def select_items(s, d):
    return column_lineage.select_items(W.models(s, d))


@query
def column_edges(s, d):
    n = W.nodes(s, d).where(F.col("label").startswith("customer_")).withColumn("columns", F.array(F.lit("id"), F.lit("name")))
    return column_lineage.column_edges(W.models(s, d), n)


@query
def star_edges(s, d):
    return column_edges(s, d).where("confidence = 'star'")


@query
def derived_edges(s, d):
    return column_edges(s, d).where("confidence = 'derived'")


@query
def exposure_refs(s, d):
    dep = F.concat(F.lit("ref('customer_"), F.col("o_custkey").cast("string"), F.lit("')"))
    other = F.concat(F.lit("source('tpch', '"), F.col("o_orderkey").cast("string"), F.lit("')"))
    o = W.table(s, d, "orders")
    return o.select("o_orderkey", calls.exposure_ref(F.when(F.col("o_orderkey") % 3 == 0, other).otherwise(dep)).alias("name"))


@query
def simplify_ids(s, d):
    n = W.nodes(s, d).select("unique_id", F.concat_ws(".", F.substring_index("unique_id", ".", 1), F.lit("shop"), F.substring_index("unique_id", ".", -1)).alias("x")).withColumn("x", F.when(F.col("x").startswith("source."), F.replace("x", F.lit("shop."), F.lit("shop.raw."))).otherwise(F.col("x")))
    return n.select("unique_id", ids.manifest_id(F.col("x")).alias("manifest_id"), ids.run_id(F.col("x")).alias("run_id"), ids.graph_id(F.col("unique_id")).alias("graph_id"))


@query
def file_stems(s, d):
    return W.nodes(s, d).where("file_path is not null").select("unique_id", ids.file_stem(F.col("file_path")).alias("stem"))


@query
def edge_type_infer(s, d):
    return W.edges(s, d).groupBy(ids.edge_type(F.col("src")).alias("edge_type")).agg(F.count("src").alias("n"))


@query
def resource_types(s, d):
    return W.nodes(s, d).groupBy(ids.node_type(F.when(F.col("node_type") == "seed", "analysis").otherwise(F.col("node_type"))).alias("node_type")).agg(F.count("unique_id").alias("n"))


@query
def non_blank_descriptions(s, d):
    return W.nodes(s, d).select("unique_id", ids.non_blank(F.coalesce("description", F.lit("  "))).alias("description")).where("description is not null")


@query
def parse_selectors(s, d):
    text = F.concat(F.lit(" tag:"), "o_orderpriority", F.lit(", ,path:models/"), F.lower("o_orderstatus"), F.lit(" , order_"), F.col("o_orderkey").cast("string"), F.lit(", other:x,"))
    return W.table(s, d, "orders").select("o_orderkey", F.posexplode(select.parsed_selectors(text)).alias("at", "s")).select("o_orderkey", "at", "s.*")


@query
def item_aliases(s, d):
    o = W.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return o.select("k", F.posexplode(select_columns(F.expr(W.ITEM_TEXT))).alias("at", "column_name"))


def _all_columns(s, d):
    """Column lineage from nodes and files: orders have files, customers known columns."""
    n = W.nodes(s, d)
    known = n.where(F.col("label").startswith("customer_")).withColumn("columns", F.array(F.lit("id"), F.lit("name")))
    o = n.where(F.col("label").startswith("order_"))
    files = o.select("unique_id", F.col("file_path").alias("path")).join(W.models(s, d), "unique_id").select("path", "content")
    return column_lineage.resolve(known.unionByName(o), files)


@query
def resolve_columns(s, d):
    return _all_columns(s, d)


@query
def columns_into(s, d):
    return column_lineage.into(_all_columns(s, d), MODEL_ID)


@query
def column_provenance(s, d):
    return column_lineage.provenance(_all_columns(s, d), "model.order_8", "name")


# construction


@query
def graph_nodes(s, d):
    return W.nodes(s, d).withColumn("tags", F.array_join("tags", ",")).drop("columns")


@query
def graph_edges(s, d):
    return W.edges(s, d)


@query
def display_names(s, d):
    return W.nodes(s, d).select("unique_id", display_name().alias("display_name"))


@query
def resolve_refs(s, d):
    names = W.table(s, d, "orders").select(F.concat(F.lit("customer_"), ((F.col("o_custkey") * 3).cast("string"))).alias("ref_name"))
    more = W.table(s, d, "nation").select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("ref_name"))
    return build.resolve_refs(names.union(more), W.nodes(s, d))


@query
def phantom_refs(s, d):
    known = W.nodes(s, d).where(~((F.col("node_type") == "source") & F.col("label").startswith("parts.") & F.col("label").endswith("0")))
    return build.phantoms(W.edges(s, d), known).select("unique_id", "label", "node_type")


@query
def duplicate_names(s, d):
    o = W.table(s, d, "orders")
    files = o.select(F.concat(F.lit("models/"), F.lower(F.col("o_orderpriority")), F.lit("/c_"), F.col("o_custkey").cast("string"), F.lit(".sql")).alias("path"), F.lit("model").alias("kind"))
    return build.duplicate_names(files)


@query
def model_meta_merge(s, d):
    o = W.table(s, d, "orders").select(F.concat(F.lit("models/f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".yml")).alias("path"), F.array(F.struct(F.concat(F.lit("m"), (F.col("o_custkey") % 500).cast("string")).alias("name"), F.col("o_orderpriority").alias("description"), F.array("o_orderpriority").alias("tags"), F.struct(F.col("o_orderstatus").alias("materialized"), F.array("o_orderstatus").alias("tags")).alias("config"))).alias("models"))
    return build.model_meta(o).select("name", "description", _joined("tags"), "materialized")


@query
def tag_merge(s, d):
    return W.models(s, d).select("unique_id", F.array_join(build.merged_tags(calls.config(F.col("content")).tags, F.array(F.lit("mart"), F.lit("a"))), ",").alias("tags"))


@query
def sql_edges(s, d):
    files = W.models(s, d).select(F.concat(F.lit("models/"), F.substring_index("unique_id", ".", -1), F.lit(".sql")).alias("path"), F.lit("model").alias("kind"), "content")
    return build.sql_edges(build.sql_calls(files), W.nodes(s, d))


@query
def files_nodes(s, d):
    return build.from_files(W.files(s, d))[0].select("unique_id", "label", "node_type", "file_path", "description", "materialization", _joined("tags"), _joined("columns"))


@query
def files_edges(s, d):
    return build.from_files(W.files(s, d))[1]


@query
def manifest_nodes(s, d):
    return build.manifest_nodes(W.manifest(s, d)).select("unique_id", "label", "node_type", "file_path", "description", "materialization", _joined("tags"))


@query
def manifest_edges(s, d):
    return build.manifest_edges(W.manifest(s, d))


@query
def manifest_graph(s, d):
    n, e = build.from_manifest(W.manifest(s, d))
    count = lambda df, kind, c: df.groupBy(F.lit(kind).alias("part"), F.col(c).alias("type")).agg(F.count(c).alias("n"))
    return count(n, "node", "node_type").unionByName(count(e, "edge", "edge_type"))


# traversal and filters


@query
def cycle_check(s, d):
    e = W.edges(s, d)
    back = s.createDataFrame([("model.order_7", START, "ref")], e.schema)
    return s.createDataFrame([("graph", traverse.has_cycle(e)), ("with an edge back", traverse.has_cycle(e.unionByName(back)))], "what string, value boolean")


@query
def bfs_down(s, d):
    return traverse.reach(W.edges(s, d), _start(s, d))


@query
def bfs_up(s, d):
    return traverse.reach(W.edges(s, d), _lines_of(s, d), upstream=True)


@query
def bfs_bounded(s, d):
    return traverse.reach(W.edges(s, d), _start(s, d), 2)


@query
def path_through(s, d):
    return traverse.path_through(W.edges(s, d), W.nodes(s, d).where("unique_id = 'model.customer_11'"))


@query
def focus(s, d):
    return select.focus(W.nodes(s, d), MODEL).select("unique_id", "node_type")


def _selected(text: str):
    def run(s, d):
        return W.nodes(s, d).where(select.selector(text)).select("unique_id")

    return run


QUERIES |= {f"select_{k}": _selected(v) for k, v in {"tag": "tag:BUILDING", "path": "path:models/marts", "name": "order_7", "union": "tag:BUILDING, path:seeds/ , supplier_1"}.items()}


@query
def select_focus_intersect(s, d):
    e = W.edges(s, d)
    return W.nodes(s, d).where(select.selector("path:models/marts,tag:5-LOW")).join(traverse.reach(e, _start(s, d)), "unique_id", "left_semi").select("unique_id")


@query
def type_filter(s, d):
    return select.keep_types(W.nodes(s, d), ("seed", "exposure")).groupBy("node_type").agg(F.count("unique_id").alias("n"))


@query
def induced_subgraph(s, d):
    kept = W.nodes(s, d).where("node_type in ('model', 'seed')")
    return select.induced(W.edges(s, d), kept)


@query
def filter_pipeline(s, d):
    n, e = select.filtered(W.nodes(s, d), W.edges(s, d), "nation_3", up=1, down=2, select="path:models,path:seeds", include=("seed",))
    return e


@query
def neighbors(s, d):
    return select.neighbours(W.edges(s, d), W.nodes(s, d).where("unique_id in ('model.customer_11', 'model.order_7')"))


# impact


@query
def severity(s, d):
    n = W.nodes(s, d).withColumn("r", impact.severity_rank())
    return n.groupBy("node_type", impact.severity(F.col("r")).alias("severity")).agg(F.count("unique_id").alias("n"))


@query
def impact_nodes(s, d):
    return impact.impacted(W.nodes(s, d), W.edges(s, d), _start(s, d))


@query
def impact_summary(s, d):
    return impact.summary(impact_nodes(s, d))


@query
def impact_histogram(s, d):
    return impact_nodes(s, d).groupBy("distance", "node_type", "severity").agg(F.count("unique_id").alias("n"))


@query
def impact_ordered(s, d):
    return impact.placed(impact_nodes(s, d)).select("unique_id", "place")


@query
def impact_report(s, d):
    r = impact.report_row(W.nodes(s, d), W.edges(s, d), _start(s, d))
    return r.withColumn("longest_path", F.array_join("longest_path", " -> "))


@query
def impact_lines(s, d):
    return reports.impact_lines(impact_nodes(s, d)).select("line")


@query
def impact_lookup(s, d):
    n = W.nodes(s, d)
    return impact.lookup(n, "order_7").unionByName(impact.lookup(n, "3")).select("unique_id")


@query
def longest_path_length(s, d):
    return traverse.longest_path(W.edges(s, d), _start(s, d)).agg((F.count("position") - 1).alias("hops"))


@query
def longest_path(s, d):
    return traverse.longest_path(W.edges(s, d), _start(s, d))


# layout


@query
def layers(s, d):
    return traverse.layers(W.nodes(s, d), W.edges(s, d))


@query
def layout_summary(s, d):
    return layout.summary(layers(s, d))


@query
def barycenter_pass(s, d):
    e = _edges(s, d)
    return layout.barycenter(_placed(s, d, e), e).withColumn("barycenter", F.round("barycenter", 6))


def _edges(s, d):
    """In buckets by their start: for layers and then for what is drawn along them."""
    return cut(W.edges(s, d), by="src")


def _placed(s, d, e=None):
    return cut(layout.initial(traverse.layers(W.nodes(s, d), W.edges(s, d) if e is None else e)))


@query
def crossing_sweep(s, d):
    e = _edges(s, d)
    return layout.reduce_crossings(_placed(s, d, e), e, rounds=1)


@query
def layers_of_a_cycle(s, d):
    """Customers and orders with an edge from each order back: there are no layers, so each node has its own."""
    e = W.edges(s, d).where(F.col("dst").startswith("model.order_"))
    e = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type")))
    n = e.select(F.col("src").alias("unique_id")).distinct()
    return traverse.layers(n, e, cyclic="spread")


@query
def svg_coords(s, d):
    e = _edges(s, d)
    return drawings.curves(_placed(s, d, e), e)


@query
def svg_elements(s, d):
    e = _edges(s, d)
    return drawings.svg_elements(W.nodes(s, d), e, _placed(s, d, e)).select("element")


@query
def edge_routes(s, d):
    e = _edges(s, d)
    return explore.routes(_placed(s, d, e), e)


@query
def ascii_widths(s, d):
    n = W.nodes(s, d)
    return drawings.widths(layout.initial(layers(s, d)), n)


# differences


@query
def node_diff(s, d):
    return diff.node_diff(*W.versions(s, d)).select("unique_id", "node_type", "status")


@query
def node_changes(s, d):
    return diff.node_diff(*W.versions(s, d)).where("status = 'modified'").select("unique_id", F.array_join("changes", "; ").alias("changes"))


@query
def diff_ordered(s, d):
    return diff.placed(diff.node_diff(*W.versions(s, d))).select("unique_id", "status", "place")


@query
def diff_lines(s, d):
    return reports.diff_lines(diff.node_diff(*W.versions(s, d)), edge_diff(s, d)).select("line")


@query
def edge_diff(s, d):
    return diff.edge_diff(*W.edge_versions(s, d))


@query
def diff_summary(s, d):
    return diff.summary(diff.node_diff(*W.versions(s, d)), edge_diff(s, d))


# run status


@query
def run_completed_at(s, d):
    return W.run_results(s, d).select("seq", status.completed_at().alias("completed_at"))


@query
def run_lookup(s, d):
    return status.lookup(W.run_results(s, d))


@query
def run_status(s, d):
    return status.statuses(W.nodes(s, d), W.run_results(s, d), W.modified(s, d))


@query
def freshness(s, d):
    return run_status(s, d).groupBy("status").agg(F.count("unique_id").alias("n"))


@query
def run_status_merge(s, d):
    r = W.run_results(s, d)
    old = status.statuses(W.nodes(s, d), r.where("seq % 2 = 0"), W.modified(s, d))
    return status.merge(old, status.statuses(W.nodes(s, d), r.where("seq % 7 = 1"), W.modified(s, d)))


@query
def status_labels(s, d):
    return run_status(s, d).select("unique_id", *status.look())


# browsing


@query
def search(s, d):
    return explore.search(W.nodes(s, d), "Order_12").select("unique_id")


@query
def search_next(s, d):
    return explore.next_hit(explore.search(W.nodes(s, d), "order_12"), "model.order_120").select("unique_id")


@query
def group_counts(s, d):
    return explore.groups(W.nodes(s, d))


@query
def list_entries(s, d):
    collapsed = s.createDataFrame([("models/marts",), ("(other)",)], "group_key string")
    return explore.entries(W.nodes(s, d), collapsed)


@query
def status_filter(s, d):
    return explore.viewed(W.nodes(s, d), ["model"], "errored", run_status(s, d)).select("unique_id")


@query
def nearest_right(s, d):
    return explore.nearest(_placed(s, d))


@query
def nearest_left(s, d):
    return explore.nearest(_placed(s, d), "left")


@query
def layer_neighbors(s, d):
    return explore.layer_neighbours(_placed(s, d))


@query
def cycle_next(s, d):
    p = _placed(s, d)
    return explore.cycle(p, START).unionByName(explore.cycle(p, START, back=True))


@query
def list_order(s, d):
    return _placed(s, d).orderBy("layer", "pos")


@query
def hit_test(s, d):
    return explore.hit_test(_placed(s, d), 60, 41)


@query
def node_detail_neighbors(s, d):
    return explore.node_detail(W.nodes(s, d), W.edges(s, d), "model.order_7")["neighbours"]


@query
def highlighted_path(s, d):
    return explore.highlighted(W.nodes(s, d), W.edges(s, d), "model.customer_11")[0]


@query
def highlighted_impact(s, d):
    return explore.highlighted(W.nodes(s, d), W.edges(s, d), "model.customer_11")[1]


# sinks


@query
def dot_lines(s, d):
    return lines.dot_nodes(W.nodes(s, d)).select("line").union(lines.dot_edges(W.edges(s, d)).select("line"))


@query
def mermaid_lines(s, d):
    return lines.mermaid_nodes(W.nodes(s, d)).select("line").union(lines.mermaid_edges(W.edges(s, d)).select("line"))


@query
def json_nodes(s, d):
    return lines.json_nodes(W.nodes(s, d))


@query
def json_edges(s, d):
    return lines.json_edges(W.edges(s, d)).select("json")
