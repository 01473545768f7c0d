"""Graphs, run results and SQL texts derived from the tables in a scale folder, so that operators run at any scale.

The graph: regions lead to nations, these to customers and suppliers, customers to orders, and orders, suppliers and parts
to lines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators.build import node_rows
from ..schemas import MANIFEST
from ..sources.project import FILES

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(*columns: str):
    return F.concat_ws("_", *(F.col(c).cast("string") for c in columns))


def _rank():
    """The flag as a number in the same order, so that its maximum is found by hashing: 3 is R, 1 is A."""
    f = F.col("l_returnflag")
    return F.when(f > "R", 4).when(f == "R", 3).when(f > "A", 2).when(f == "A", 1).otherwise(0)


def _kind(rank: str):
    return F.when(F.col(rank) == 3, "test").when(F.col(rank) == 1, "exposure").otherwise("model")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, kind): numbers of lines repeat in an order, so they are grouped."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(_rank()).alias("rank"))
    return rows.select(F.concat(_kind("rank"), F.lit(".line_"), _key("l_orderkey", "l_linenumber")).alias("line_id"), _kind("rank").alias("kind"))


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): what leads to each line, its order, suppliers and parts, each once. Keys are exchanged once, as numbers, by line."""
    line = ["l_orderkey", "l_linenumber"]
    rows = table(spark, sf_dir, "lineitem").select(*line, "l_suppkey", "l_partkey", _rank().alias("rank")).withColumn("rank", F.max("rank").over(Window.partitionBy(*line)))
    froms = F.array(*(F.struct(F.lit(i).alias("t"), F.col(c).alias("k")) for i, c in enumerate(("l_orderkey", "l_suppkey", "l_partkey"))))
    ends = rows.select(*line, "rank", F.explode(froms).alias("e")).select(*line, "rank", "e.t", "e.k").distinct()
    prefix = F.when(F.col("t") == 0, "model.order_").when(F.col("t") == 1, "snapshot.supplier_").otherwise("source.parts.")
    return ends.select(F.concat(prefix, F.col("k").cast("string")).alias("src"), F.concat(_kind("rank"), F.lit(".line_"), _key(*line)).alias("dst"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)

    def made(df: DataFrame, kind: str, label, path=None, description=None, materialization=None, tags=None) -> DataFrame:
        return node_rows(df, F.concat(F.lit(f"{kind}."), label), label, kind, path, description, materialization, tags)

    name = lambda prefix, *c: F.concat(F.lit(prefix), _key(*c))
    file = lambda folder, prefix, c, suffix=".sql": F.concat(F.lit(folder), name(prefix, c), F.lit(suffix))
    o = t("orders")
    stage = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "models/marts/").otherwise("models/intermediate/")
    kind = F.when(F.col("o_orderstatus") == "F", "table").when(F.col("o_orderstatus") == "O", "view").otherwise("incremental")
    rest = lines(spark, sf_dir)
    return (
        made(t("region"), "source", name("tpch.", "r_regionkey"), description=F.col("r_name"))
        .unionByName(made(t("nation"), "seed", name("nation_", "n_nationkey"), file("seeds/", "nation_", "n_nationkey", ".csv"), F.col("n_name")))
        .unionByName(made(t("customer"), "model", name("customer_", "c_custkey"), file("models/staging/", "customer_", "c_custkey"), materialization=F.lit("view"), tags=F.array("c_mktsegment")))
        .unionByName(made(o, "model", name("order_", "o_orderkey"), F.concat(stage, name("order_", "o_orderkey"), F.lit(".sql")), materialization=kind, tags=F.array("o_orderpriority")))
        .unionByName(made(t("supplier"), "snapshot", name("supplier_", "s_suppkey"), file("snapshots/", "supplier_", "s_suppkey")))
        .unionByName(made(t("part"), "source", name("parts.", "p_partkey")))
        .unionByName(node_rows(rest, F.col("line_id"), F.substring_index("line_id", ".", -1), F.col("kind")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    i = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    pairs = [
        t("nation").select(i("source.tpch.", "n_regionkey").alias("src"), i("seed.nation_", "n_nationkey").alias("dst")),
        t("customer").select(i("seed.nation_", "c_nationkey"), i("model.customer_", "c_custkey")),
        t("supplier").select(i("seed.nation_", "s_nationkey"), i("snapshot.supplier_", "s_suppkey")),
        t("orders").select(i("model.customer_", "o_custkey"), i("model.order_", "o_orderkey")),
        line_pairs(spark, sf_dir),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    return out.withColumn("edge_type", F.when(F.col("dst").startswith("exposure."), "exposure").otherwise(ids.edge_type(F.col("src"))))


#: SQL text of an order's model, by its key modulo 4; <k> is the order, <c> its customer.
TEMPLATES = [
    "{# {{ ref('hidden') }} #}\n{{ config(materialized='table', tags=[\"daily\", 'mart']) }}\nselect o.id as order_id, c.name, o.total from {{ ref('customer_<c>') }} c join {{ source('tpch', '<k>') }} as o on o.id = c.id where o.id > 0",
    "{{ config(tags='solo') }}\nSELECT DISTINCT id AS key_id, amount FROM {{ ref(\"pkg\", \"customer_<c>\") }}\nLEFT JOIN {{- source(\"tpch\", \"<k>\") -}} x ON 1 = 1",
    "with a as (select * from {{ source('tpch', '<k>') }}) select a.id, sum(a.v) as total, upper(a.n) name from {{ ref('customer_<c>') }} a group by 1",
    "select a.id as order_ref, a.*, {{ money('v') }}, count(*) as n, coalesce(a.v, 0) as v from {{ ref('customer_<c>') }} a where {{ var('x') }} = 1",
]


def sql_concat(template: str) -> str:
    """An expression of Spark's and DuckDB's SQL that makes the text from columns k and c."""
    special = {"'": "chr(39)", "\n": "chr(10)", "<k>": "CAST(k AS STRING)", "<c>": "CAST(c AS STRING)"}
    return "concat(" + ", ".join(special.get(x, f"'{x}'") for x in re.split(r"('|\n|<k>|<c>)", template) if x) + ")"


SQL_TEXT = "CASE k % 4 " + " ".join(f"WHEN {i} THEN {sql_concat(t)}" for i, t in enumerate(TEMPLATES)) + " END"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unique_id, content) of every order's SQL text."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    return o.select(F.concat(F.lit("model.order_"), F.col("k").cast("string")).alias("unique_id"), F.expr(SQL_TEXT).alias("content"))


def _number(c: str):
    return F.regexp_extract(c, r"(\d+)$", 1).cast("long")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All nodes of two versions, by the number k that their ids end in: even ones and multiples of 3, odd ones and multiples of 3;
    in the second some settings, tags, descriptions and columns differ, and some ids repeat."""
    n = nodes(spark, sf_dir).withColumn("k", _number("unique_id"))
    base = n.where("k % 2 = 0 or k % 3 = 0").drop("k")
    head = n.where("k % 2 = 1 or k % 3 = 0").withColumns({
        "materialization": F.when((F.col("materialization") == "view") & (F.col("k") % 9 == 0), "table").otherwise(F.col("materialization")),
        "tags": F.when(F.col("k") % 15 == 0, F.array_append("tags", "new")).otherwise(F.col("tags")),
        "description": F.when(F.col("k") % 21 == 0, "changed").otherwise(F.col("description")),
        "columns": F.when(F.col("k") % 33 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("columns")),
    })
    again = head.where("k % 50 = 0").withColumn("materialization", F.lit("zeta"))
    return base, head.unionByName(again).drop("k")


def edge_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, sf_dir).withColumn("k", _number("dst"))
    return e.where("k % 2 = 0 or k % 3 = 0").drop("k"), e.where("k % 2 = 1 or k % 3 = 0").drop("k")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled artifact for each order, read from JSON: its model, its source and, for each tenth, an exposure."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    join = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    before, after = ((F.col("o_orderkey") + d).cast("string") for d in (-1, 1))
    model, source, board = join("model.shop.order_", k), join("source.shop.tpch.", k), join("exposure.shop.board_", k)
    deps = lambda *x: F.struct(F.array(*x).alias("nodes")).alias("depends_on")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "analysis").otherwise("model").alias("resource_type")
    node = F.struct(
        model.alias("unique_id"), join("order_", k).alias("name"), kind, deps(join("model.shop.customer_", c), source, join("model.shop.order_", before)),
        F.struct(F.lit("view").alias("materialized"), F.array(join("t", (F.col("o_orderkey") % 3).cast("string"))).alias("tags")).alias("config"),
        F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(join("d", k)).alias("description"), join("marts/order_", k, ".sql").alias("path"),
        F.when(F.col("o_orderkey") % 2 == 0, join("models/marts/order_", k, ".sql")).alias("original_file_path"),
    )
    src = F.struct(source.alias("unique_id"), k.alias("name"), F.lit("tpch").alias("source_name"), F.lit("source").alias("resource_type"), F.lit("s").alias("description"))
    exposure = F.struct(board.alias("unique_id"), join("board_", k).alias("name"), deps(model, join("model.order_", after)), F.when(F.col("o_orderkey") % 20 == 0, "Board").alias("label"))
    parts = F.struct(F.create_map(model, node).alias("nodes"), F.create_map(source, src).alias("sources"), F.when(F.col("o_orderkey") % 10 == 0, F.create_map(board, exposure)).alias("exposures"))
    text = table(spark, sf_dir, "orders").select(F.to_json(parts).alias("value"))
    return text.select(F.from_json("value", MANIFEST).alias("m")).select("m.*")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FILES of a project: models of orders and customers, a YAML file for each customer, seeds, snapshots and tests."""
    t = lambda name: table(spark, sf_dir, name)
    c, n, s, part = (F.col(x).cast("string") for x in ("c_custkey", "n_nationkey", "s_suppkey", "p_partkey"))
    join = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))

    def made(df: DataFrame, path, kind: str, content) -> DataFrame:
        return df.select(path.alias("path"), F.lit(kind).alias("kind"), content.alias("content"), F.lit(None).cast("timestamp").alias("modified_at"))

    tables = F.array(F.struct(c.alias("name"), F.when(F.col("c_custkey") % 2 == 0, "t").alias("description")))
    yaml = F.struct(
        F.array(F.struct(F.lit("tpch").alias("name"), F.lit("all").alias("description"), tables.alias("tables"))).alias("sources"),
        F.array(F.struct(join("customer_", c).alias("name"), F.lit("c").alias("description"), F.array(F.lit("z"), F.lit("a")).alias("tags"), F.struct(F.lit("view").alias("materialized"), F.array(F.lit("m"), F.lit("a")).alias("tags")).alias("config"))).alias("models"),
        F.array(F.struct(join("board_", c).alias("name"), F.lit("b").alias("description"), F.array(join("ref('customer_", c, "')"), F.lit("source('tpch', '1')"), join("ref('nope_", c, "')")).alias("depends_on"))).alias("exposures"),
    )
    out = made(models(spark, sf_dir).withColumn("k", F.substring_index("unique_id", "_", -1)), join("models/marts/order_", F.col("k"), ".sql"), "model", F.col("content"))
    for df in (
        made(t("customer"), join("models/staging/customer_", c, ".sql"), "model", join("select id, name from {{ source('tpch', '", c, "') }}")),
        made(t("customer"), join("models/staging/c_", c, ".yml"), "yaml", F.to_json(yaml)),
        made(t("nation"), join("seeds/nation_", n, ".csv"), "seed", F.lit(None).cast("string")),
        made(t("supplier"), join("snapshots/supplier_", s, ".sql"), "snapshot", join("select * from {{ ref('nation_", F.col("s_nationkey").cast("string"), "') }}")),
        made(t("part"), join("tests/part_", part, ".sql"), "test", join("select * from {{ ref('order_", part, "') }}")),
    ):
        out = out.unionByName(df)
    return spark.createDataFrame([], FILES).unionByName(out)


#: Texts with items in parentheses and quoted names, by an order's key modulo 3.
ITEM_TEXTS = [
    "select (a + b) as total, (select max(x) from t) `mx`, o.\"Big\" from {{ ref('customer_<c>') }} o",
    "select (a), (b) c, `d` from {{ ref('customer_<c>') }}",
    "select count(*), sum(x) as \"S\", y AS `y z` from {{ ref('customer_<c>') }}",
]
ITEM_TEXT = "CASE k % 3 " + " ".join(f"WHEN {i} THEN {sql_concat(t)}" for i, t in enumerate(ITEM_TEXTS)) + " END"


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run results of customers' models: (seq, unique_id, status, message, timing)."""
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type").isin("click", "purchase"), "success").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").otherwise("pass")
    timing = F.array(F.struct(F.lit("compile").alias("name"), F.col("ts").alias("completed_at")), F.struct(F.lit("execute").alias("name"), F.when(F.col("event_type") != "view", F.col("ts")).alias("completed_at")))
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("model.shop.customer_"), F.col("user_id").cast("string")).alias("unique_id"), state.alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("message"), timing.alias("timing"))


def modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_path, modified_at) of customers' files: the last order's date, moved to the time of events."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"))
    last = table(spark, sf_dir, "events").agg(F.max("ts").alias("t"))
    return o.crossJoin(F.broadcast(last)).select(F.concat(F.lit("models/staging/customer_"), F.col("o_custkey").cast("string"), F.lit(".sql")).alias("file_path"), (F.col("t") - F.make_dt_interval(F.dayofyear("d") % 30)).alias("modified_at"))
