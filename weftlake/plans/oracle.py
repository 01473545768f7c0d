"""DuckDB SQL with the same rows as the queries."""

from __future__ import annotations

from .workloads import SQL_TEXT

START = "seed.nation_3"
LINES = """lines AS (SELECT CASE max(l_returnflag) WHEN 'R' THEN 'test' WHEN 'A' THEN 'exposure' ELSE 'model' END AS kind, l_orderkey, l_linenumber FROM lineitem GROUP BY ALL),
line AS (SELECT kind || '.line_' || l_orderkey || '_' || l_linenumber AS line_id, kind, l_orderkey, l_linenumber FROM lines)"""
NODES = (
    LINES
    + """,
nodes AS (
SELECT 'source.tpch.' || r_regionkey AS unique_id, 'tpch.' || r_regionkey AS label, 'source' AS node_type, NULL::VARCHAR AS file_path, r_name AS description, NULL::VARCHAR AS materialization, []::VARCHAR[] AS tags FROM region
UNION ALL SELECT 'seed.nation_' || n_nationkey, 'nation_' || n_nationkey, 'seed', 'seeds/nation_' || n_nationkey || '.csv', n_name, NULL, [] FROM nation
UNION ALL SELECT 'model.customer_' || c_custkey, 'customer_' || c_custkey, 'model', 'models/staging/customer_' || c_custkey || '.sql', NULL, 'view', [c_mktsegment] FROM customer
UNION ALL SELECT 'model.order_' || o_orderkey, 'order_' || o_orderkey, 'model', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'models/marts/' ELSE 'models/intermediate/' END || 'order_' || o_orderkey || '.sql', NULL,
  CASE o_orderstatus WHEN 'F' THEN 'table' WHEN 'O' THEN 'view' ELSE 'incremental' END, [o_orderpriority] FROM orders
UNION ALL SELECT 'snapshot.supplier_' || s_suppkey, 'supplier_' || s_suppkey, 'snapshot', 'snapshots/supplier_' || s_suppkey || '.sql', NULL, NULL, [] FROM supplier
UNION ALL SELECT 'source.parts.' || p_partkey, 'parts.' || p_partkey, 'source', NULL, NULL, NULL, [] FROM part
UNION ALL SELECT line_id, 'line_' || l_orderkey || '_' || l_linenumber, kind, NULL, NULL, NULL, [] FROM line)"""
)
PAIRS = """pairs AS (
SELECT 'source.tpch.' || n_regionkey AS src, 'seed.nation_' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'seed.nation_' || c_nationkey, 'model.customer_' || c_custkey FROM customer
UNION ALL SELECT 'seed.nation_' || s_nationkey, 'snapshot.supplier_' || s_suppkey FROM supplier
UNION ALL SELECT 'model.customer_' || o_custkey, 'model.order_' || o_orderkey FROM orders
UNION ALL SELECT 'model.order_' || l_orderkey, line_id FROM line
UNION ALL SELECT DISTINCT 'snapshot.supplier_' || l_suppkey, line_id FROM lineitem JOIN line USING (l_orderkey, l_linenumber)
UNION ALL SELECT DISTINCT 'source.parts.' || l_partkey, line_id FROM lineitem JOIN line USING (l_orderkey, l_linenumber))"""
EDGES = PAIRS + """,
edges AS (SELECT src, dst, CASE WHEN dst LIKE 'exposure.%' THEN 'exposure' WHEN src LIKE 'source.%' THEN 'source' WHEN src LIKE 'test.%' THEN 'test' ELSE 'ref' END AS edge_type FROM pairs)"""
GRAPH = NODES + ",\n" + EDGES
RANK = "CASE WHEN node_type = 'exposure' THEN 3 WHEN node_type = 'test' THEN 0 WHEN node_type = 'model' AND (coalesce(materialization IN ('table', 'incremental'), FALSE) OR coalesce(contains(file_path, 'mart'), FALSE)) THEN 2 ELSE 1 END"
SEVERITY = "['low', 'medium', 'high', 'critical']"


def walk(start: str, a: str = "src", b: str = "dst", depth: int = 20, name: str = "walk") -> str:
    return f"{name} AS (SELECT unique_id, 0 AS depth FROM nodes WHERE {start} UNION SELECT e.{b}, w.depth + 1 FROM {name} w JOIN edges e ON e.{a} = w.unique_id WHERE w.depth < {depth})"


def reached(start: str, a: str = "src", b: str = "dst", depth: int = 20, name: str = "reached") -> str:
    return walk(start, a, b, depth, f"{name}_walk") + f",\n{name} AS (SELECT unique_id, CAST(min(depth) AS INTEGER) AS depth FROM {name}_walk GROUP BY 1)"


def graph(rest: str, body: str) -> str:
    return f"WITH RECURSIVE {GRAPH}{',' if rest else ''}\n{rest}\n{body}"


IS_START = f"unique_id = '{START}'"
LAYERS = "lwalk AS (SELECT unique_id, 0 AS k FROM nodes UNION SELECT e.dst, w.k + 1 FROM lwalk w JOIN edges e ON e.src = w.unique_id),\nlayers AS (SELECT unique_id, CAST(max(k) AS INTEGER) AS layer FROM lwalk GROUP BY 1)"
IMPACT = reached(IS_START) + f""",
imp AS (SELECT unique_id, label, node_type, depth AS distance, CAST({RANK} AS INTEGER) AS severity_rank, {SEVERITY}[{RANK} + 1] AS severity FROM reached JOIN nodes USING (unique_id) WHERE depth > 0)"""
PLACED = LAYERS + """,
placed AS MATERIALIZED (SELECT unique_id, layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY unique_id) - 1 AS INTEGER) AS pos FROM layers),
ends AS (SELECT layer, max(pos) AS last FROM placed GROUP BY 1)"""
PATH = walk(IS_START) + """,
back AS (SELECT max(depth) AS depth, (SELECT min(unique_id) FROM walk WHERE depth = (SELECT max(depth) FROM walk)) AS unique_id FROM walk
UNION ALL SELECT b.depth - 1, (SELECT min(w.unique_id) FROM walk w JOIN edges e ON e.src = w.unique_id AND e.dst = b.unique_id WHERE w.depth = b.depth - 1) FROM back b WHERE b.depth > 0)"""
Q = "['\"\"]".replace('""', '"')
SQLQ = Q.replace("'", "''")
MODELS = f"models AS (SELECT 'model.order_' || k AS unique_id, k, c, {SQL_TEXT} AS content FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)),\nbare AS (SELECT *, regexp_replace(content, '\\{{#[\\s\\S]*?#\\}}', '', 'g') AS sql FROM models)"
OPEN, CLOSE = r"\{\{-?\s*", r"\s*-?\}\}"
NAME = f"{SQLQ}([^''\"]+){SQLQ}"
REF = f"{OPEN}ref\\(\\s*{NAME}(?:\\s*,\\s*{NAME})?\\s*\\){CLOSE}"
SOURCE = f"{OPEN}source\\(\\s*{NAME}\\s*,\\s*{NAME}\\s*\\){CLOSE}"
_S = "''([^'']+)''"
TABLE = rf"(?i)\b(?:from|join)\s+[{{]{{2}}\s*(?:ref[(]\s*{_S}\s*[)]|source[(]\s*{_S}\s*,\s*{_S}\s*[)])\s*[}}]{{2}}(?:\s+(?:as\s+)?(\w+))?"
CALLS = f"""refs AS (SELECT unique_id, unnest(regexp_extract_all(sql, '{REF}', 1)) AS a, unnest(regexp_extract_all(sql, '{REF}', 2)) AS b FROM bare),
srcs AS (SELECT unique_id, unnest(regexp_extract_all(sql, '{SOURCE}', 1)) AS source_name, unnest(regexp_extract_all(sql, '{SOURCE}', 2)) AS table_name FROM bare)"""
TABLES = f"""hits AS (SELECT unique_id, unnest(regexp_extract_all(content, '{TABLE}', 0)) AS h, unnest(range(len(regexp_extract_all(content, '{TABLE}', 0)))) AS "at" FROM models),
tables AS (SELECT unique_id, CAST("at" AS INTEGER) AS "at", nullif(regexp_extract(h, '{TABLE}', 4), '') AS alias,
  CASE WHEN regexp_extract(h, '{TABLE}', 1) <> '' THEN 'model.' || regexp_extract(h, '{TABLE}', 1) ELSE 'source.' || regexp_extract(h, '{TABLE}', 2) || '.' || regexp_extract(h, '{TABLE}', 3) END AS node_id FROM hits)"""
#: What the select lists of the texts hold, by key modulo 4: place, column, alias, source column, star, derived.
ITEMS = """items AS (SELECT 'model.order_' || o_orderkey AS unique_id, o_custkey AS c, i.* EXCLUDE (m) FROM orders JOIN (VALUES
  (0, 0, 'order_id', 'o', 'id', FALSE, FALSE), (0, 1, 'name', 'c', 'name', FALSE, FALSE), (0, 2, 'total', 'o', 'total', FALSE, FALSE),
  (1, 0, 'key_id', NULL, 'key_id', FALSE, FALSE), (1, 1, 'amount', NULL, 'amount', FALSE, FALSE),
  (2, 0, '*', NULL, NULL, TRUE, FALSE),
  (3, 0, 'order_ref', 'a', 'id', FALSE, FALSE), (3, 1, '*', NULL, NULL, TRUE, FALSE), (3, 2, '__jinja__', NULL, NULL, FALSE, TRUE), (3, 3, 'n', NULL, NULL, FALSE, TRUE), (3, 4, 'v', 'a', 'v', FALSE, FALSE)
  ) i(m, "at", column_name, source_alias, source_column, is_star, is_derived) ON o_orderkey % 4 = i.m)"""
COLUMN_EDGES = f"""WITH {MODELS},
{TABLES},
{ITEMS},
sole AS (SELECT unique_id, CASE WHEN count(*) = 1 THEN any_value(node_id) END AS single FROM tables GROUP BY 1),
star AS (SELECT node_id AS source_node, cc AS source_column, i.unique_id AS target_node, cc AS target_column, 'star' AS confidence
  FROM items i JOIN tables t USING (unique_id) JOIN customer ON t.node_id = 'model.customer_' || c_custkey, (VALUES ('id'), ('name')) v(cc) WHERE is_star),
plain AS (SELECT CASE WHEN is_derived THEN coalesce(single, '') ELSE coalesce(t.node_id, single) END AS source_node, CASE WHEN is_derived THEN '' ELSE source_column END AS source_column, i.unique_id AS target_node, column_name AS target_column,
  CASE WHEN is_derived THEN 'derived' WHEN source_alias IS NOT NULL AND source_column <> column_name THEN 'aliased' ELSE 'direct' END AS confidence
  FROM items i LEFT JOIN sole USING (unique_id) LEFT JOIN tables t ON t.unique_id = i.unique_id AND t.alias = i.source_alias WHERE NOT is_star)
SELECT * FROM (SELECT * FROM plain WHERE source_node IS NOT NULL UNION ALL SELECT * FROM star)"""
VERSIONS = NODES + """,
v AS (SELECT *, CAST(regexp_extract(unique_id, '(\\d+)$', 1) AS BIGINT) AS k FROM nodes),
base AS (SELECT *, 0 AS n_columns FROM v WHERE k % 2 = 0 OR k % 3 = 0),
head AS (SELECT * REPLACE (CASE WHEN k % 50 = 0 THEN 'zeta' WHEN materialization = 'view' AND k % 9 = 0 THEN 'table' ELSE materialization END AS materialization, CASE WHEN k % 15 = 0 THEN list_append(tags, 'new') ELSE tags END AS tags,
  CASE WHEN k % 21 = 0 THEN 'changed' ELSE description END AS description), CASE WHEN k % 33 = 0 THEN 2 ELSE 0 END AS n_columns FROM v WHERE k % 2 = 1 OR k % 3 = 0),
d AS (SELECT coalesce(b.unique_id, h.unique_id) AS unique_id, coalesce(h.label, b.label) AS label, coalesce(h.node_type, b.node_type) AS node_type, b.unique_id IS NULL AS added, h.unique_id IS NULL AS removed, b.materialization AS m1, h.materialization AS m2, b.tags AS t1, h.tags AS t2,
  b.n_columns AS c1, h.n_columns AS c2, b.description AS d1, h.description AS d2 FROM base b FULL JOIN head h ON b.unique_id = h.unique_id),
nd AS (SELECT *, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN m1 IS DISTINCT FROM m2 OR t1 IS DISTINCT FROM t2 OR c1 <> c2 OR d1 IS DISTINCT FROM d2 THEN 'modified' ELSE 'unchanged' END AS status FROM d)"""
CHANGES = """[x FOR x IN [CASE WHEN m1 IS DISTINCT FROM m2 THEN 'materialization: ' || coalesce('"' || m1 || '"', 'none') || ' -> ' || coalesce('"' || m2 || '"', 'none') END, CASE WHEN t1 IS DISTINCT FROM t2 THEN 'tags: [' || array_to_string(t1, ', ') || '] -> [' || array_to_string(t2, ', ') || ']' END,
  CASE WHEN c1 <> c2 THEN 'columns: ' || c1 || ' -> ' || c2 END, CASE WHEN d1 IS DISTINCT FROM d2 THEN 'description changed' END] IF x IS NOT NULL]"""
EDGE_VERSIONS = EDGES + """,
ev AS (SELECT DISTINCT *, CAST(regexp_extract(dst, '(\\d+)$', 1) AS BIGINT) AS k FROM edges),
ed AS (SELECT src, dst, edge_type, 'added' AS status FROM ev WHERE k % 2 = 1 AND k % 3 <> 0 UNION ALL SELECT src, dst, edge_type, 'removed' FROM ev WHERE k % 2 = 0 AND k % 3 <> 0)"""
#: After NODES, which has the lines already.
EDGE_VERSIONS_ONLY = EDGE_VERSIONS
RUNS = NODES + """,
runs AS (SELECT event_id AS seq, 'model.customer_' || user_id AS key, CASE WHEN event_type IN ('click', 'purchase') THEN 'success' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'skipped' ELSE 'pass' END AS result, ts AS completed_at, CASE WHEN event_type = 'error' THEN 'event ' || event_id END AS message FROM events),
mods AS (SELECT 'model.customer_' || o_custkey AS unique_id, (SELECT max(ts) FROM events) - to_days(CAST(dayofyear(max(o_orderdate)) % 30 AS INTEGER)) AS modified_at FROM orders GROUP BY o_custkey)"""


def statuses(name: str, where: str) -> str:
    return f"""{name}_l AS (SELECT * FROM runs WHERE {where} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
{name} AS (SELECT unique_id, CASE WHEN good AND modified_at > completed_at THEN 'outdated' WHEN good THEN 'success' ELSE coalesce(result, 'never_run') END AS status, completed_at,
  CASE WHEN result = 'error' THEN coalesce(message, 'Unknown error') END AS message, CASE WHEN good AND modified_at > completed_at THEN modified_at END AS modified_at
  FROM (SELECT nodes.unique_id, l.*, l.result IN ('success', 'pass') AS good, m.modified_at FROM nodes LEFT JOIN {name}_l l ON l.key = nodes.unique_id LEFT JOIN mods m ON m.unique_id = nodes.unique_id))"""


STATUS = RUNS + ",\n" + statuses("st", "TRUE")
PREFIX = "CASE node_type WHEN 'source' THEN 'src:' WHEN 'seed' THEN 'seed:' WHEN 'snapshot' THEN 'snap:' WHEN 'test' THEN 'test:' WHEN 'exposure' THEN 'exp:' ELSE '' END || label"
FILL = "CASE node_type WHEN 'model' THEN '#4A90D9' WHEN 'source' THEN '#27AE60' WHEN 'seed' THEN '#F39C12' WHEN 'snapshot' THEN '#8E44AD' WHEN 'test' THEN '#1ABC9C' ELSE '#E74C3C' END"
GROUP = "CASE WHEN file_path IS NOT NULL THEN regexp_replace(file_path, '/[^/]*$', '') WHEN node_type = 'exposure' THEN '(exposures)' ELSE '(other)' END"
SHORT = "CASE WHEN x LIKE 'source.%' THEN 'source.' || split_part(x, '.', 3) || '.' || split_part(x, '.', 4) ELSE split_part(x, '.', 1) || '.' || split_part(x, '.', -1) END"

CURVES = """curves AS (SELECT src, dst, edge_type, 200 + 220 * a.layer AS x1, 60 + 60 * a.pos AS y1, CAST(floor((200 + 220 * a.layer + 40 + 220 * z.layer) / 2) AS INTEGER) AS cx, 40 + 220 * z.layer AS x2, 60 + 60 * z.pos AS y2
  FROM edges JOIN placed a ON a.unique_id = src JOIN placed z ON z.unique_id = dst)"""


def sweeps(last: int = 4) -> tuple[str, int]:
    """Tables s0, s1, ...: each has one layer more put in order, down and up again."""
    out, n = "s0 AS (SELECT * FROM placed)", 0
    for step, ks in ((-1, range(1, last + 1)), (1, range(last - 1, -1, -1))):
        for k in ks:
            me, other = ("dst", "src") if step < 0 else ("src", "dst")
            out += f""",
s{n + 1} AS MATERIALIZED (SELECT unique_id, layer, CASE WHEN layer = {k} THEN CAST(row_number() OVER (PARTITION BY layer ORDER BY bc NULLS LAST, pos) - 1 AS INTEGER) ELSE pos END AS pos FROM s{n} LEFT JOIN
  (SELECT m.unique_id, avg(n.pos) AS bc FROM edges e JOIN s{n} n ON n.unique_id = e.{other} AND n.layer = {k + step} JOIN s{n} m ON m.unique_id = e.{me} AND m.layer = {k} GROUP BY 1) USING (unique_id))"""
            n += 1
    return out, n


SWEEP, SWEEPS = sweeps()
MANIFEST = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
mn AS (SELECT 'source.tpch.' || k AS unique_id, 'tpch.' || k AS label, 'source' AS node_type, NULL::VARCHAR AS file_path, 's' AS description, NULL::VARCHAR AS materialization, '' AS tags FROM o
UNION ALL SELECT 'model.order_' || k, 'order_' || k, 'model', CASE WHEN k % 2 = 0 THEN 'models/' ELSE '' END || 'marts/order_' || k || '.sql', CASE WHEN k % 4 <> 0 THEN 'd' || k END, 'view', 't' || (k % 3) FROM o
UNION ALL SELECT 'exposure.board_' || k, CASE WHEN k % 20 = 0 THEN 'Board' ELSE 'board_' || k END, 'exposure', NULL, NULL, NULL, '' FROM o WHERE k % 10 = 0),
me AS (SELECT 'source.tpch.' || k AS src, 'model.order_' || k AS dst, 'source' AS edge_type FROM o
UNION ALL SELECT 'model.order_' || p.k, 'model.order_' || o.k, 'ref' FROM o JOIN o p ON p.k = o.k - 1
UNION ALL SELECT 'model.order_' || p.k, 'exposure.board_' || o.k, 'exposure' FROM o JOIN o p ON p.k IN (o.k, o.k + 1) WHERE o.k % 10 = 0)"""
FILE_NODES = f"""WITH {MODELS},
{CALLS},
fn AS (SELECT 'source.tpch.' || c_custkey AS unique_id, 'tpch.' || c_custkey AS label, 'source' AS node_type, 'models/staging/c_' || c_custkey || '.yml' AS file_path, CASE WHEN c_custkey % 2 = 0 THEN 't' ELSE 'all' END AS description, NULL::VARCHAR AS materialization, '' AS tags, '' AS columns FROM customer
UNION ALL SELECT 'model.customer_' || c_custkey, 'customer_' || c_custkey, 'model', 'models/staging/customer_' || c_custkey || '.sql', 'c', 'view', 'a,m,z', 'id,name' FROM customer
UNION ALL SELECT 'model.order_' || k, 'order_' || k, 'model', 'models/marts/order_' || k || '.sql', NULL, CASE WHEN k % 4 = 0 THEN 'table' END, CASE WHEN k % 4 = 0 THEN 'daily,mart' ELSE '' END, ['order_id,name,total', 'key_id,amount', '*', 'order_ref,*,__jinja__,n,v'][k % 4 + 1] FROM models
UNION ALL SELECT 'seed.nation_' || n_nationkey, 'nation_' || n_nationkey, 'seed', 'seeds/nation_' || n_nationkey || '.csv', NULL, NULL, '', '' FROM nation
UNION ALL SELECT 'snapshot.supplier_' || s_suppkey, 'supplier_' || s_suppkey, 'snapshot', 'snapshots/supplier_' || s_suppkey || '.sql', NULL, NULL, '', '' FROM supplier
UNION ALL SELECT 'test.part_' || p_partkey, 'part_' || p_partkey, 'test', 'tests/part_' || p_partkey || '.sql', NULL, NULL, '', '' FROM part
UNION ALL SELECT 'exposure.board_' || c_custkey, 'board_' || c_custkey, 'exposure', 'models/staging/c_' || c_custkey || '.yml', 'b', NULL, '', '' FROM customer),
fe AS (SELECT 'model.' || CASE WHEN b <> '' THEN b ELSE a END AS src, unique_id AS dst, 'ref' AS edge_type FROM refs UNION ALL SELECT 'source.' || source_name || '.' || table_name, unique_id, 'source' FROM srcs
UNION ALL SELECT 'source.tpch.' || c_custkey, 'model.customer_' || c_custkey, 'source' FROM customer
UNION ALL SELECT 'seed.nation_' || s_nationkey, 'snapshot.supplier_' || s_suppkey, 'ref' FROM supplier
UNION ALL SELECT 'model.order_' || p_partkey, 'test.part_' || p_partkey, 'ref' FROM part),
missing AS (SELECT DISTINCT src AS unique_id, src[strpos(src, '.') + 1:] AS label FROM fe WHERE src NOT IN (SELECT unique_id FROM fn))
"""

ORACLE: dict[str, str] = {
    "extract_refs": f"WITH {MODELS},\n{CALLS} SELECT unique_id, CASE WHEN b <> '' THEN a END AS package, CASE WHEN b <> '' THEN b ELSE a END AS name FROM refs",
    "extract_sources": f"WITH {MODELS},\n{CALLS} SELECT * FROM srcs",
    "extract_config": f"""WITH {MODELS},
b AS (SELECT unique_id, regexp_extract(sql, '{OPEN}config\\(([\\s\\S]*?)\\){CLOSE}', 1) AS body FROM bare)
SELECT unique_id, nullif(regexp_extract(body, 'materialized\\s*=\\s*{NAME}', 1), '') AS materialized, array_to_string(regexp_extract_all(regexp_extract(body, 'tags\\s*=\\s*\\[([^\\]]*)\\]', 1), '{NAME}', 1), ',') AS tags FROM b""",
    "strip_comments": f"WITH {MODELS} SELECT unique_id, sql FROM bare",
    "strip_template": f"WITH {MODELS} SELECT unique_id, regexp_replace(sql, '\\{{\\{{[\\s\\S]*?\\}}\\}}|\\{{%[\\s\\S]*?%\\}}', '__jinja__', 'g') AS sql FROM bare",
    "table_refs": f"WITH {MODELS},\n{TABLES} SELECT * FROM tables",
    "select_items": f"WITH {ITEMS} SELECT unique_id, CAST(\"at\" AS INTEGER) AS \"at\", column_name, source_alias, source_column, is_star, is_derived FROM items",
    "column_edges": COLUMN_EDGES,
    "star_edges": COLUMN_EDGES + " WHERE confidence = 'star'",
    "derived_edges": COLUMN_EDGES + " WHERE confidence = 'derived'",
    "exposure_refs": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'customer_' || o_custkey END AS name FROM orders",
    "simplify_ids": f"""WITH {NODES}, x AS (SELECT unique_id, split_part(unique_id, '.', 1) || CASE WHEN node_type = 'source' THEN '.shop.raw.' ELSE '.shop.' END || split_part(unique_id, '.', -1) AS x FROM nodes)
SELECT unique_id, {SHORT} AS manifest_id, split_part(x, '.', 1) || '.' || split_part(x, '.', -1) AS run_id, split_part(unique_id, '.', 1) || '.' || split_part(unique_id, '.', -1) AS graph_id FROM x""",
    "file_stems": f"WITH {NODES} SELECT unique_id, regexp_extract(file_path, '([^/]+)\\.[^./]*$', 1) AS stem FROM nodes WHERE file_path IS NOT NULL",
    "edge_type_infer": f"WITH {LINES}, {PAIRS} SELECT CASE WHEN src LIKE 'source.%' THEN 'source' ELSE 'ref' END AS edge_type, count(*) AS n FROM pairs GROUP BY 1",
    "resource_types": f"WITH {NODES} SELECT CASE node_type WHEN 'seed' THEN 'model' ELSE node_type END AS node_type, count(*) AS n FROM nodes GROUP BY 1",
    "non_blank_descriptions": f"WITH {NODES} SELECT unique_id, description FROM nodes WHERE trim(coalesce(description, '')) <> ''",
    "parse_selectors": """WITH t AS (SELECT o_orderkey, [trim(x) FOR x IN string_split(' tag:' || o_orderpriority || ', ,path:models/' || lower(o_orderstatus) || ' , order_' || o_orderkey || ', other:x,', ',') IF trim(x) <> ''] AS p FROM orders),
u AS (SELECT o_orderkey, unnest(range(len(p))) AS i, unnest(p) AS x FROM t)
SELECT o_orderkey, CAST(i AS INTEGER) AS "at", CASE WHEN starts_with(x, 'tag:') THEN 'tag' WHEN starts_with(x, 'path:') THEN 'path' ELSE 'name' END AS kind, CASE WHEN starts_with(x, 'tag:') THEN x[5:] WHEN starts_with(x, 'path:') THEN x[6:] ELSE x END AS value FROM u""",
    "item_aliases": """SELECT o_orderkey AS k, CAST(i."at" AS INTEGER) AS "at", i.column_name FROM orders JOIN (VALUES (0, 0, 'total'), (0, 1, 'mx'), (0, 2, 'Big'), (1, 0, 'c'), (1, 1, 'd'), (2, 0, 'count(*)'), (2, 1, 'S'), (2, 2, 'y z')) i(m, "at", column_name) ON o_orderkey % 3 = i.m""",
    "resolve_columns": COLUMN_EDGES,
    "columns_into": COLUMN_EDGES + " WHERE target_node = 'model.order_7'",
    "column_provenance": COLUMN_EDGES.replace("WITH models", "WITH RECURSIVE models", 1).rpartition("SELECT * FROM (")[0] + """, ce AS (SELECT * FROM plain WHERE source_node IS NOT NULL UNION ALL SELECT * FROM star),
r AS (SELECT 'model.order_8' AS node, 'name' AS "column", 0 AS hops UNION SELECT source_node, source_column, hops + 1 FROM r JOIN ce ON target_node = node AND target_column = "column" AND source_column <> '' WHERE hops < 20)
SELECT node, "column", CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY 1, 2""",
    "graph_nodes": f"WITH {NODES} SELECT * REPLACE (array_to_string(tags, ',') AS tags) FROM nodes",
    "graph_edges": f"WITH {LINES}, {EDGES} SELECT * FROM edges",
    "display_names": f"WITH {NODES} SELECT unique_id, {PREFIX} AS display_name FROM nodes",
    "resolve_refs": f"""WITH {NODES}, names AS (SELECT DISTINCT 'customer_' || (o_custkey * 3) AS ref_name FROM orders UNION SELECT 'nation_' || n_nationkey FROM nation),
k AS (SELECT label AS ref_name, arg_min(unique_id, CASE node_type WHEN 'model' THEN 1 WHEN 'seed' THEN 2 ELSE 3 END) AS u FROM nodes WHERE node_type IN ('model', 'seed', 'snapshot') GROUP BY 1)
SELECT ref_name, coalesce(u, 'model.' || ref_name) AS unique_id FROM names LEFT JOIN k USING (ref_name)""",
    "phantom_refs": "SELECT DISTINCT 'source.parts.' || l_partkey AS unique_id, 'parts.' || l_partkey AS label, 'phantom' AS node_type FROM lineitem WHERE l_partkey % 10 = 0",
    "duplicate_names": "SELECT 'c_' || o_custkey AS name, count(*) AS n_files FROM orders GROUP BY o_custkey HAVING count(*) > 1",
    "model_meta_merge": """SELECT 'm' || (o_custkey % 500) AS name, o_orderpriority AS description, array_to_string(list_sort(list_distinct([o_orderpriority, o_orderstatus])), ',') AS tags, o_orderstatus AS materialized
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey DESC) = 1""",
    "tag_merge": "SELECT 'model.order_' || o_orderkey AS unique_id, CASE WHEN o_orderkey % 4 = 0 THEN 'a,daily,mart' ELSE 'a,mart' END AS tags FROM orders",
    "sql_edges": f"WITH {MODELS},\n{CALLS} SELECT 'model.' || CASE WHEN b <> '' THEN b ELSE a END AS src, unique_id AS dst, 'ref' AS edge_type FROM refs UNION ALL SELECT 'source.' || source_name || '.' || table_name, unique_id, 'source' FROM srcs",
    "files_nodes": FILE_NODES + "SELECT unique_id, label, node_type, file_path, description, materialization, tags, columns FROM fn UNION ALL SELECT p.unique_id, p.label, 'phantom', NULL, NULL, NULL, '', '' FROM missing p",
    "files_edges": FILE_NODES + "SELECT src, dst, edge_type FROM fe UNION ALL SELECT 'model.customer_' || c_custkey, 'exposure.board_' || c_custkey, 'exposure' FROM customer",
    "manifest_nodes": MANIFEST + " SELECT * FROM mn",
    "manifest_edges": MANIFEST + " SELECT * FROM me",
    "manifest_graph": MANIFEST + " SELECT 'node' AS part, node_type AS type, count(*) AS n FROM mn GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM me GROUP BY ALL",
    "cycle_check": graph(
        """back AS (SELECT src, dst FROM edges UNION ALL SELECT 'model.order_7', 'seed.nation_3'),
lwalk AS (SELECT unique_id, 0 AS k FROM nodes UNION SELECT e.dst, w.k + 1 FROM lwalk w JOIN edges e ON e.src = w.unique_id WHERE w.k < 50),
bwalk AS (SELECT unique_id, 0 AS k FROM nodes UNION SELECT e.dst, w.k + 1 FROM bwalk w JOIN back e ON e.src = w.unique_id WHERE w.k < 50)""",
        "SELECT 'graph' AS what, EXISTS (SELECT 1 FROM lwalk WHERE k = 50) AS value UNION ALL SELECT 'with an edge back', EXISTS (SELECT 1 FROM bwalk WHERE k = 50)",
    ),
    "bfs_down": graph(reached(IS_START), "SELECT * FROM reached"),
    "bfs_up": graph(reached("label LIKE 'line\\_7\\_%' ESCAPE '\\'", "dst", "src"), "SELECT * FROM reached"),
    "bfs_bounded": graph(reached(IS_START, depth=2), "SELECT * FROM reached"),
    "path_through": graph(reached("unique_id = 'model.customer_11'") + ",\n" + reached("unique_id = 'model.customer_11'", "dst", "src", name="above"), "SELECT unique_id FROM reached UNION SELECT unique_id FROM above"),
    "focus": f"WITH {NODES} SELECT unique_id, node_type FROM nodes WHERE label = 'order_7' OR unique_id = 'model.order_7' ORDER BY node_type <> 'model', unique_id LIMIT 1",
    "select_tag": f"WITH {NODES} SELECT unique_id FROM nodes WHERE list_contains(tags, 'BUILDING')",
    "select_path": f"WITH {NODES} SELECT unique_id FROM nodes WHERE starts_with(file_path, 'models/marts')",
    "select_name": f"WITH {NODES} SELECT unique_id FROM nodes WHERE label = 'order_7'",
    "select_union": f"WITH {NODES} SELECT unique_id FROM nodes WHERE list_contains(tags, 'BUILDING') OR starts_with(file_path, 'seeds/') OR label = 'supplier_1'",
    "select_focus_intersect": graph(reached(IS_START), "SELECT unique_id FROM nodes JOIN reached USING (unique_id) WHERE starts_with(file_path, 'models/marts') OR list_contains(tags, '5-LOW')"),
    "type_filter": f"WITH {NODES} SELECT node_type, count(*) AS n FROM nodes WHERE node_type NOT IN ('test', 'snapshot') GROUP BY 1",
    "induced_subgraph": f"WITH {GRAPH}, k AS (SELECT unique_id FROM nodes WHERE node_type IN ('model', 'seed')) SELECT edges.* FROM edges JOIN k a ON a.unique_id = src JOIN k z ON z.unique_id = dst",
    "filter_pipeline": graph(
        reached("label = 'nation_3'", depth=2) + ",\n" + reached("label = 'nation_3'", "dst", "src", 1, "above") + """,
k AS (SELECT unique_id FROM nodes WHERE unique_id IN (SELECT unique_id FROM reached UNION SELECT unique_id FROM above) AND (starts_with(file_path, 'models') OR starts_with(file_path, 'seeds')) AND node_type NOT IN ('test', 'snapshot', 'exposure'))""",
        "SELECT edges.* FROM edges JOIN k a ON a.unique_id = src JOIN k z ON z.unique_id = dst",
    ),
    "neighbors": f"WITH {LINES}, {EDGES} SELECT dst AS unique_id, 'upstream' AS direction, src AS neighbour FROM edges WHERE dst IN ('model.customer_11', 'model.order_7') UNION ALL SELECT src, 'downstream', dst FROM edges WHERE src IN ('model.customer_11', 'model.order_7')",
    "severity": f"WITH {NODES} SELECT node_type, {SEVERITY}[{RANK} + 1] AS severity, count(*) AS n FROM nodes GROUP BY ALL",
    "impact_nodes": graph(IMPACT, "SELECT * FROM imp"),
    "impact_summary": graph(IMPACT, f"SELECT count(*) AS affected, count(*) FILTER (node_type = 'model') AS models, count(*) FILTER (node_type = 'test') AS tests, count(*) FILTER (node_type = 'exposure') AS exposures, {SEVERITY}[coalesce(max(severity_rank), 0) + 1] AS overall FROM imp"),
    "impact_histogram": graph(IMPACT, "SELECT distance, node_type, severity, count(*) AS n FROM imp GROUP BY ALL"),
    "impact_ordered": graph(IMPACT, "SELECT unique_id, CAST(row_number() OVER (ORDER BY severity_rank DESC, distance, unique_id) - 1 AS INTEGER) AS place FROM imp"),
    "impact_report": graph(
        IMPACT + ",\n" + PATH,
        f"""SELECT s.*, p.*, '{START}' AS source FROM (SELECT count(*) AS affected, count(*) FILTER (node_type = 'model') AS models, count(*) FILTER (node_type = 'test') AS tests, count(*) FILTER (node_type = 'exposure') AS exposures, {SEVERITY}[coalesce(max(severity_rank), 0) + 1] AS overall FROM imp) s,
(SELECT string_agg(label, ' -> ' ORDER BY depth) AS longest_path, CAST(count(*) - 1 AS INTEGER) AS longest_path_length FROM back JOIN nodes USING (unique_id)) p""",
    ),
    "impact_lines": graph(IMPACT, "SELECT '  [' || severity || '] ' || label || ' (' || node_type || ', ' || distance || ' away)' AS line FROM imp"),
    "impact_lookup": f"""WITH {NODES}, r AS (SELECT unique_id, CASE WHEN label = n AND node_type = 'model' THEN 0 WHEN label = n THEN 1 WHEN suffix(unique_id, '.' || n) THEN 2 END AS rank, n FROM nodes, (VALUES ('order_7'), ('3')) v(n))
SELECT unique_id FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n ORDER BY rank, unique_id) = 1""",
    "longest_path_length": graph(walk(IS_START), "SELECT CAST(max(depth) AS BIGINT) AS hops FROM walk"),
    "longest_path": graph(PATH, "SELECT CAST(depth AS INTEGER) AS position, unique_id FROM back"),
    "layers": graph(LAYERS, "SELECT * FROM layers"),
    "layout_summary": graph(LAYERS, "SELECT count(*) AS num_layers, max(n) AS max_layer_width FROM (SELECT layer, count(*) AS n FROM layers GROUP BY 1)"),
    "barycenter_pass": graph(
        LAYERS + """,
p AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY unique_id) - 1 AS pos FROM layers),
b AS (SELECT m.unique_id, avg(n.pos) AS bc FROM edges e JOIN p n ON n.unique_id = e.src JOIN p m ON m.unique_id = e.dst WHERE n.layer - m.layer = -1 GROUP BY 1)""",
        "SELECT unique_id, layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY bc NULLS LAST, pos) - 1 AS INTEGER) AS pos, round(bc, 6) AS barycenter FROM p LEFT JOIN b USING (unique_id)",
    ),
    "crossing_sweep": graph(PLACED + ",\n" + SWEEP, f"SELECT unique_id, layer, pos FROM s{SWEEPS}"),
    "layers_of_a_cycle": "SELECT unique_id, CAST(row_number() OVER (ORDER BY unique_id) - 1 AS INTEGER) AS layer FROM (SELECT 'model.customer_' || o_custkey AS unique_id FROM orders UNION SELECT 'model.order_' || o_orderkey FROM orders)",
    "svg_coords": graph(PLACED + ",\n" + CURVES, "SELECT * FROM curves"),
    "svg_elements": graph(
        PLACED + ",\n" + CURVES,
        f"""SELECT '<path d="M' || x1 || ',' || y1 || ' C' || cx || ',' || y1 || ' ' || cx || ',' || y2 || ' ' || x2 || ',' || y2 || '" fill="none" stroke="#888" class="' || CASE edge_type WHEN 'ref' THEN 'solid' WHEN 'source' THEN 'dashed' WHEN 'test' THEN 'dotted' ELSE 'bold' END || '"/>' AS element FROM curves
UNION ALL SELECT '<g data-id="' || unique_id || '"><rect x="' || (40 + 220 * layer) || '" y="' || (40 + 60 * pos) || '" width="160" height="40" rx="6" fill="' || {FILL} || '"/><text x="' || (120 + 220 * layer) || '" y="' || (65 + 60 * pos) || '" text-anchor="middle">' || {PREFIX} || '</text></g>' FROM placed JOIN nodes USING (unique_id)""",
    ),
    "edge_routes": graph(
        PLACED + """,
w AS (SELECT src, dst, edge_type, a.layer * 28 + 20 AS sx, a.pos * 4 + 1 AS sy, z.layer * 28 AS tx, z.pos * 4 + 1 AS ty FROM edges JOIN placed a ON a.unique_id = src JOIN placed z ON z.unique_id = dst),
m AS (SELECT *, CAST(floor((sx + tx) / 2) AS INTEGER) AS mid FROM w)""",
        """SELECT * FROM (SELECT src, dst, edge_type, 0 AS segment, sx AS x1, sy AS y1, CASE WHEN sy = ty THEN tx - 1 ELSE mid - 1 END AS x2, sy AS y2 FROM m
UNION ALL SELECT src, dst, edge_type, 1, mid, least(sy, ty), mid, greatest(sy, ty) FROM m WHERE sy <> ty UNION ALL SELECT src, dst, edge_type, 2, mid + 1, ty, tx - 1, ty FROM m WHERE sy <> ty) WHERE x1 <= x2""",
    ),
    "ascii_widths": graph(LAYERS, f"SELECT layer, width, CAST(coalesce(sum(width + 4) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT layer, CAST(max(length({PREFIX}) + 4) AS INTEGER) AS width FROM layers JOIN nodes USING (unique_id) GROUP BY 1)"),
    "node_diff": f"WITH {VERSIONS} SELECT unique_id, node_type, status FROM nd",
    "node_changes": f"WITH {VERSIONS} SELECT unique_id, array_to_string({CHANGES}, '; ') AS changes FROM nd WHERE status = 'modified'",
    "diff_ordered": f"WITH {VERSIONS} SELECT unique_id, status, CAST(row_number() OVER (ORDER BY status, unique_id) - 1 AS INTEGER) AS place FROM nd",
    "diff_lines": f"""WITH {VERSIONS},
{EDGE_VERSIONS_ONLY} SELECT CASE status WHEN 'added' THEN '+' WHEN 'removed' THEN '-' ELSE '~' END || ' ' || label || ' (' || node_type || ')' || CASE WHEN status = 'modified' THEN array_to_string(list_transform({CHANGES}, lambda c: chr(10) || '    ' || c), '') ELSE '' END AS line FROM nd WHERE status <> 'unchanged'
UNION ALL SELECT CASE status WHEN 'added' THEN '+' ELSE '-' END || ' ' || src || ' -> ' || dst || ' (' || edge_type || ')' FROM ed""",
    "edge_diff": f"WITH {LINES}, {EDGE_VERSIONS} SELECT * FROM ed",
    "diff_summary": f"WITH {VERSIONS},\n{EDGE_VERSIONS_ONLY} SELECT * FROM (SELECT count(*) FILTER (status = 'added') AS nodes_added, count(*) FILTER (status = 'modified') AS nodes_modified, count(*) FILTER (status = 'removed') AS nodes_removed FROM nd), (SELECT count(*) FILTER (status = 'added') AS edges_added, count(*) FILTER (status = 'removed') AS edges_removed FROM ed)",
    "run_completed_at": "SELECT event_id AS seq, ts AS completed_at FROM events",
    "run_lookup": f"WITH {RUNS} SELECT key, result, completed_at, message FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1",
    "run_status": f"WITH {STATUS} SELECT * FROM st",
    "freshness": f"WITH {STATUS} SELECT status, count(*) AS n FROM st GROUP BY 1",
    "run_status_merge": f"WITH {RUNS},\n{statuses('o', 'seq % 2 = 0')},\n{statuses('n', 'seq % 7 = 1')},\nf AS (SELECT * FROM n WHERE status <> 'never_run') SELECT * FROM o WHERE unique_id NOT IN (SELECT unique_id FROM f) UNION ALL SELECT * FROM f",
    "status_labels": f"""WITH {STATUS} SELECT unique_id, CASE status WHEN 'success' THEN 'ok' WHEN 'error' THEN 'x' WHEN 'skipped' THEN '-' WHEN 'outdated' THEN '!' ELSE ' ' END AS symbol,
CASE status WHEN 'never_run' THEN 'Never Run' ELSE upper(status[1]) || status[2:] END || coalesce(' (' || CAST(date_trunc('second', completed_at) AS VARCHAR) || ')', '') || coalesce(': ' || message, '') AS label,
CASE status WHEN 'success' THEN 'green' WHEN 'error' THEN 'red' WHEN 'skipped' THEN 'gray' WHEN 'outdated' THEN 'yellow' ELSE 'default' END AS colour FROM st""",
    "search": f"WITH {NODES} SELECT unique_id FROM nodes WHERE contains(lower(label), 'order_12') OR contains(lower(unique_id), 'order_12')",
    "search_next": f"WITH {NODES} SELECT unique_id FROM nodes WHERE contains(lower(unique_id), 'order_12') ORDER BY unique_id <= 'model.order_120', unique_id LIMIT 1",
    "group_counts": f"WITH {NODES} SELECT g AS group_key, CASE g WHEN '' THEN '(root)' ELSE g END AS label, count(*) AS n_nodes, min(unique_id) AS first_id FROM (SELECT *, {GROUP} AS g FROM nodes) GROUP BY g",
    "list_entries": f"WITH {NODES}, k AS (SELECT *, {GROUP} AS g FROM nodes) SELECT DISTINCT g AS group_key, TRUE AS is_header, NULL::VARCHAR AS unique_id, CASE g WHEN '' THEN '(root)' ELSE g END AS label FROM k UNION ALL SELECT g, FALSE, unique_id, label FROM k WHERE g NOT IN ('models/marts', '(other)')",
    "status_filter": f"WITH {STATUS} SELECT unique_id FROM st JOIN nodes USING (unique_id) WHERE status = 'error' AND node_type = 'model'",
    "nearest_right": graph(PLACED, "SELECT a.unique_id, b.unique_id AS nearest FROM placed a JOIN ends m ON m.layer = a.layer + 1 JOIN placed b ON b.layer = m.layer AND b.pos = least(a.pos, m.last)"),
    "nearest_left": graph(PLACED, "SELECT a.unique_id, b.unique_id AS nearest FROM placed a JOIN ends m ON m.layer = a.layer - 1 JOIN placed b ON b.layer = m.layer AND b.pos = least(a.pos, m.last)"),
    "layer_neighbors": graph(PLACED, "SELECT unique_id, coalesce(lag(unique_id) OVER w, last_value(unique_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before, coalesce(lead(unique_id) OVER w, first_value(unique_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after FROM placed WINDOW w AS (PARTITION BY layer ORDER BY pos)"),
    "cycle_next": graph(PLACED, f"SELECT coalesce((SELECT unique_id FROM placed WHERE (layer, pos) > (p.layer, p.pos) ORDER BY layer, pos LIMIT 1), (SELECT unique_id FROM placed ORDER BY layer, pos LIMIT 1)) AS unique_id FROM placed p WHERE {IS_START} UNION ALL SELECT coalesce((SELECT unique_id FROM placed WHERE (layer, pos) < (p.layer, p.pos) ORDER BY layer DESC, pos DESC LIMIT 1), (SELECT unique_id FROM placed ORDER BY layer DESC, pos DESC LIMIT 1)) FROM placed p WHERE {IS_START}"),
    "list_order": graph(PLACED, "SELECT * FROM placed"),
    "hit_test": graph(PLACED, "SELECT unique_id, layer * 28 AS x, pos * 4 AS y FROM placed WHERE 60 >= layer * 28 AND 60 < layer * 28 + 20 AND 41 >= pos * 4 AND 41 < pos * 4 + 3"),
    "highlighted_path": graph(reached("unique_id = 'model.customer_11'") + ",\n" + reached("unique_id = 'model.customer_11'", "dst", "src", name="above"), "SELECT unique_id FROM reached UNION SELECT unique_id FROM above"),
    "highlighted_impact": graph(IMPACT.replace(IS_START, "unique_id = 'model.customer_11'"), f"SELECT count(*) AS affected, count(*) FILTER (node_type = 'model') AS models, count(*) FILTER (node_type = 'test') AS tests, count(*) FILTER (node_type = 'exposure') AS exposures, {SEVERITY}[coalesce(max(severity_rank), 0) + 1] AS overall FROM imp"),
    "json_edges": f"""WITH {LINES}, {EDGES} SELECT '{{"source":"' || src || '","target":"' || dst || '","edge_type":"' || edge_type || '"}}' AS json FROM edges""",
    "node_detail_neighbors": f"WITH {LINES}, {EDGES} SELECT dst AS unique_id, 'upstream' AS direction, src AS neighbour FROM edges WHERE dst = 'model.order_7' UNION ALL SELECT src, 'downstream', dst FROM edges WHERE src = 'model.order_7'",
    "dot_lines": f"""WITH {GRAPH} SELECT '  "' || unique_id || '" [label="' || {PREFIX} || '", fillcolor="' || {FILL} || '", fontcolor="' || CASE node_type WHEN 'seed' THEN 'black' ELSE 'white' END || '"];' AS line FROM nodes
UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [label="' || edge_type || '", style=' || CASE edge_type WHEN 'ref' THEN 'solid' WHEN 'source' THEN 'dashed' WHEN 'test' THEN 'dotted' ELSE 'bold' END || '];' FROM edges""",
    "mermaid_lines": f"""WITH {GRAPH} SELECT '  ' || replace(unique_id, '.', '_') || CASE node_type WHEN 'model' THEN '[' WHEN 'source' THEN '([' WHEN 'seed' THEN '[(' WHEN 'snapshot' THEN '[[' WHEN 'test' THEN '{{{{' ELSE '>' END || '"' || {PREFIX} || '"' || CASE node_type WHEN 'source' THEN '])' WHEN 'seed' THEN ')]' WHEN 'snapshot' THEN ']]' WHEN 'test' THEN '}}}}' ELSE ']' END AS line FROM nodes
UNION ALL SELECT '  ' || replace(src, '.', '_') || ' ' || CASE edge_type WHEN 'ref' THEN '-->' WHEN 'source' THEN '-.->' WHEN 'test' THEN '-.-' ELSE '==>' END || ' ' || replace(dst, '.', '_') FROM edges""",
    "json_nodes": f"""WITH {NODES} SELECT unique_id, '{{"unique_id":"' || unique_id || '","label":"' || label || '","node_type":"' || node_type || '"' || coalesce(',"file_path":"' || file_path || '"', '') || coalesce(',"description":"' || description || '"', '') || coalesce(',"materialization":"' || materialization || '"', '') || CASE WHEN len(tags) > 0 THEN ',"tags":["' || array_to_string(tags, '","') || '"]' ELSE '' END || '}}' AS json FROM nodes""",
}
