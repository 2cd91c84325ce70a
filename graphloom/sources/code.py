"""The test tables told as a graph of source code: projects, files, types, functions, tables, topics.

NODES and EDGES are SQL that Spark and DuckDB both take, so one text makes the
typed frames and the oracle's tables.  A node's nid is its id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans import builtin
from graphloom.sources.graph import Edges, Graph, Lazy

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events")

# kind: SELECT id and properties
NODES = {
    "Workspace": "SELECT 'ws:1' AS id, 'warehouse' AS name, '/ws' AS path FROM region WHERE r_regionkey = 0",
    "ProjectsStructure": "SELECT 'ws:1:projects' AS id, 'projects' AS name FROM region WHERE r_regionkey = 0",
    "Project": "SELECT 'ws:1:proj:' || n_nationkey AS id, lower(n_name) AS name, CASE n_regionkey % 3 WHEN 0 THEN 'csharp' WHEN 1 THEN 'python' ELSE 'go' END AS project_type, '/ws/' || lower(n_name) AS path FROM nation",
    "ProjectSyntax": "SELECT 'ws:1:syntax:' || n_nationkey AS id, lower(n_name) AS name FROM nation",
    "Folder": "SELECT 'ws:1:folder:' || r_regionkey AS id, lower(r_name) AS name FROM region UNION ALL SELECT 'ws:1:folder:src:' || n_nationkey, lower(n_name) || '_src' FROM nation",
    "File": "SELECT 'ws:1:file:' || c_custkey AS id, 'f' || (c_custkey % 60) || CASE c_custkey % 2 WHEN 0 THEN '.cs' ELSE '.ts' END AS name, '/ws/n' || c_nationkey || '/' || c_custkey || '/f' || (c_custkey % 60) || CASE c_custkey % 2 WHEN 0 THEN '.cs' ELSE '.ts' END AS path, c_custkey % 7 = 0 AS is_test, CASE c_mktsegment WHEN 'BUILDING' THEN 'vendor' WHEN 'MACHINERY' THEN NULL ELSE 'source' END AS artifact_role, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 500 END AS line_count, md5(c_mktsegment) AS content_hash FROM customer",
    "Type": "SELECT 'ws:1:type:' || s_suppkey AS id, 'Svc' || s_suppkey AS name, CASE s_suppkey % 3 WHEN 0 THEN 'interface' WHEN 1 THEN 'class' ELSE 'struct' END AS kind, 'app.Svc' || s_suppkey AS symbol, s_suppkey * 3 AS start_line, s_suppkey * 3 + 40 AS end_line, s_suppkey % 10 = 9 AS is_test, 'p' || s_nationkey AS project FROM supplier",
    "Function": "SELECT 'ws:1:fn:' || p_partkey AS id, 'fn' || p_partkey AS name, 'app:fn' || p_partkey AS symbol, CASE WHEN p_partkey % 9 = 4 THEN NULL ELSE p_size END AS start_line, p_size + p_partkey % 400 AS end_line, CASE WHEN p_partkey % 5 = 2 THEN true WHEN p_partkey % 5 = 3 THEN NULL ELSE false END AS is_test, CASE p_partkey % 3 WHEN 0 THEN '/ws/tests/' ELSE '/ws/src/' END || p_partkey || '.cs' AS file_path, 'p' || (p_partkey % 25) AS project, 'p' || (p_partkey % 25) || CASE WHEN p_partkey % 13 = 0 THEN '.Tests' ELSE '' END AS project_name, CASE WHEN p_partkey % 5 = 2 THEN 'xunit' END AS test_framework, p_partkey % 2 = 0 AS is_exported FROM part",
    "Member": "SELECT 'ws:1:member:' || o_orderkey AS id, 'm' || o_orderkey AS name, 'field' AS kind, o_orderkey % 900 AS line FROM orders",
    "CatchClause": "SELECT 'ws:1:catch:' || event_id AS id, 'catch_' || event_type AS name, event_id % 3 = 0 AS is_empty, event_id % 4 = 1 AS is_test, CASE WHEN event_id % 50 = 0 THEN NULL ELSE '/ws/c' || (event_id % 90) || '.cs' END AS file_path, event_id AS line, 'p' || (event_id % 25) AS project_name FROM events",
    "Endpoint": "SELECT 'ws:1:ep:' || n_nationkey AS id, 'ep_' || lower(n_name) AS name, CASE n_nationkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' END AS http_method, '/api/' || lower(n_name) AS route_template, CASE WHEN n_nationkey % 4 = 0 THEN 'gRPC' END AS protocol, n_nationkey % 2 = 0 AS is_anonymous, 'Req' || n_nationkey AS request_type FROM nation",
    "EntryPoint": "SELECT 'ws:1:main:' || r_regionkey AS id, 'main_' || lower(r_name) AS name, 'app.Main' || r_regionkey AS symbol, '/ws/main' || r_regionkey || '.cs' AS file_path FROM region",
    "Database": "SELECT 'ws:1:proj:' || n_nationkey || ':db' AS id, 'db_' || (n_nationkey % 4) AS name FROM nation WHERE n_regionkey <> 2",
    "ExternalService": "SELECT 'ws:1:es:' || r_regionkey AS id, 'svc-' || lower(r_name) AS name FROM region",
    "Table": "SELECT DISTINCT 'ws:1:table:' || p_brand AS id, lower(p_brand) AS name FROM part",
    "Query": "SELECT DISTINCT 'ws:1:query:' || p_type AS id, 'q_' || lower(p_type) AS name, 'SELECT * FROM ' || p_type AS query_text, '/ws/sql/' || p_type || '.sql' AS path FROM part",
    "Procedure": "SELECT 'ws:1:proc:' || r_regionkey AS id, 'proc_' || lower(r_name) AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'function' END AS sub_kind, '/ws/sql/proc' || r_regionkey || '.sql' AS path FROM region",
    "Topic": "SELECT DISTINCT 'ws:1:topic:' || event_type AS id, event_type AS name, 'kafka' AS broker_type FROM events",
}

_FILE = "'ws:1:file:' || ({key} % (SELECT count(*) FROM customer) + 1)"
_TYPE = "'ws:1:type:' || ({key} % (SELECT count(*) FROM supplier) + 1)"
_FN = "'ws:1:fn:' || ({key} % (SELECT count(*) FROM part) + 1)"

# kind: (kinds of sources, kinds of targets, SELECT src and dst)
EDGES = {
    "CONTAINS": (
        ("Workspace", "ProjectsStructure", "Folder", "ProjectSyntax", "Project"),
        ("ProjectsStructure", "Project", "Folder", "Function", "Type", "Endpoint", "EntryPoint", "ExternalService"),
        "SELECT 'ws:1' AS src, 'ws:1:projects' AS dst FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'ws:1:projects', 'ws:1:proj:' || n_nationkey FROM nation UNION ALL SELECT 'ws:1:folder:' || n_regionkey, 'ws:1:folder:src:' || n_nationkey FROM nation UNION ALL SELECT 'ws:1:syntax:' || (p_partkey % 25), 'ws:1:fn:' || p_partkey FROM part UNION ALL SELECT 'ws:1:syntax:' || s_nationkey, 'ws:1:type:' || s_suppkey FROM supplier UNION ALL SELECT 'ws:1:proj:' || n_nationkey, 'ws:1:ep:' || n_nationkey FROM nation UNION ALL SELECT 'ws:1:proj:' || (r_regionkey * 5), 'ws:1:main:' || r_regionkey FROM region UNION ALL SELECT 'ws:1:proj:' || (r_regionkey * 3), 'ws:1:es:' || r_regionkey FROM region",
    ),
    "LOCATED_IN": (("Project",), ("Folder",), "SELECT 'ws:1:proj:' || n_nationkey AS src, 'ws:1:folder:' || n_regionkey AS dst FROM nation"),
    "BELONGS_TO": (("ProjectSyntax",), ("Project",), "SELECT 'ws:1:syntax:' || n_nationkey AS src, 'ws:1:proj:' || n_nationkey AS dst FROM nation"),
    "DEPENDS_ON": (("Project", "Query"), ("Project", "Table"), "SELECT 'ws:1:proj:' || n_nationkey AS src, 'ws:1:proj:' || ((n_nationkey * 3 + 1) % 25) AS dst FROM nation UNION ALL SELECT 'ws:1:proj:' || n_nationkey, 'ws:1:proj:' || ((n_nationkey + 7) % 25) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT DISTINCT 'ws:1:query:' || p_type, 'ws:1:table:' || p_brand FROM part"),
    "DECLARED_IN": (
        ("Function", "Type", "Endpoint", "EntryPoint"),
        ("File", "Project"),
        f"SELECT 'ws:1:fn:' || p_partkey AS src, {_FILE.format(key='p_partkey')} AS dst FROM part WHERE p_partkey % 6 <> 5 UNION ALL SELECT 'ws:1:type:' || s_suppkey, {_FILE.format(key='(s_suppkey * 2)')} FROM supplier UNION ALL SELECT 'ws:1:ep:' || n_nationkey, 'ws:1:proj:' || n_nationkey FROM nation UNION ALL SELECT 'ws:1:main:' || r_regionkey, 'ws:1:proj:' || (r_regionkey * 5) FROM region",
    ),
    "HAS_METHOD": (("Type",), ("Function",), f"SELECT {_TYPE.format(key='p_partkey')} AS src, 'ws:1:fn:' || p_partkey AS dst FROM part"),
    "HAS_MEMBER": (("Type",), ("Member",), f"SELECT {_TYPE.format(key='o_custkey')} AS src, 'ws:1:member:' || o_orderkey AS dst FROM orders"),
    "CALLS": (("Function",), ("Function",), "SELECT 'ws:1:fn:' || p_partkey AS src, 'ws:1:fn:' || (p_partkey * 2) AS dst FROM part WHERE p_partkey * 2 <= (SELECT count(*) FROM part) UNION ALL SELECT 'ws:1:fn:' || p_partkey, 'ws:1:fn:' || (p_partkey * 3) FROM part WHERE p_partkey * 3 <= (SELECT count(*) FROM part)"),
    "USES_TYPE": (("Function",), ("Type",), f"SELECT 'ws:1:fn:' || p_partkey AS src, {_TYPE.format(key='p_size')} AS dst FROM part"),
    "IMPLEMENTS": (("Type",), ("Type",), "SELECT 'ws:1:type:' || s_suppkey AS src, 'ws:1:type:' || (s_suppkey - 1) AS dst FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey > 1"),
    "TRIGGERS": (("Endpoint", "Table"), ("Function", "Procedure"), f"SELECT 'ws:1:ep:' || n_nationkey AS src, {_FN.format(key='(n_nationkey * 7)')} AS dst FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT DISTINCT 'ws:1:table:' || p_brand, 'ws:1:proc:' || (p_size % 5) FROM part WHERE p_brand LIKE '%2' AND p_size % 5 < 2"),
    "IMPLEMENTED_BY": (("EntryPoint", "Table"), ("Function", "Type"), f"SELECT 'ws:1:main:' || r_regionkey AS src, {_FN.format(key='r_regionkey')} AS dst FROM region UNION ALL SELECT DISTINCT 'ws:1:table:' || p_brand, 'ws:1:type:1' FROM part WHERE p_brand LIKE '%1'"),
    "EXPOSED_BY": (("Endpoint",), ("Type",), f"SELECT 'ws:1:ep:' || n_nationkey AS src, {_TYPE.format(key='n_nationkey')} AS dst FROM nation WHERE n_nationkey % 2 = 0"),
    "READS_FROM": (
        ("Function", "Query", "Procedure", "Table"),
        ("Table",),
        "SELECT 'ws:1:fn:' || p_partkey AS src, 'ws:1:table:' || p_brand AS dst FROM part WHERE p_size % 9 = 0 UNION ALL SELECT DISTINCT 'ws:1:query:' || p_type, 'ws:1:table:' || p_brand FROM part WHERE p_size % 9 = 3 UNION ALL SELECT DISTINCT 'ws:1:proc:' || (p_size % 5), 'ws:1:table:' || p_brand FROM part WHERE p_size % 10 = 4 UNION ALL SELECT DISTINCT 'ws:1:table:' || p_brand, 'ws:1:table:' || (SELECT min(p_brand) FROM part) FROM part WHERE p_brand LIKE '%5'",
    ),
    "WRITES_TO": (("Function", "Query", "Procedure"), ("Table",), "SELECT 'ws:1:fn:' || p_partkey AS src, 'ws:1:table:' || p_brand AS dst FROM part WHERE p_size % 9 = 1 UNION ALL SELECT DISTINCT 'ws:1:query:' || p_type, 'ws:1:table:' || p_brand FROM part WHERE p_size % 9 = 4 UNION ALL SELECT DISTINCT 'ws:1:proc:' || (p_size % 5), 'ws:1:table:' || p_brand FROM part WHERE p_size % 10 = 6"),
    "ACCESSED_BY": (("Query",), ("Function",), "SELECT DISTINCT 'ws:1:query:' || p_type AS src, 'ws:1:fn:' || p_partkey AS dst FROM part WHERE p_size % 9 = 5"),
    "REFERENCES": (("Table",), ("Table",), "SELECT DISTINCT 'ws:1:table:' || p_brand AS src, 'ws:1:table:' || (SELECT min(p_brand) FROM part) AS dst FROM part WHERE p_brand LIKE '%3'"),
    "QUERIED_BY": (("Table",), ("Function",), "SELECT 'ws:1:table:' || p_brand AS src, 'ws:1:fn:' || p_partkey AS dst FROM part WHERE p_size % 9 = 2"),
    "PUBLISHED_BY": (("Topic",), ("Function",), f"SELECT DISTINCT 'ws:1:topic:' || event_type AS src, {_FN.format(key='(user_id % 5)')} AS dst FROM events WHERE user_id IS NOT NULL"),
    "SUBSCRIBED_BY": (("Topic",), ("Type",), f"SELECT DISTINCT 'ws:1:topic:' || event_type AS src, {_TYPE.format(key='(user_id % 3)')} AS dst FROM events WHERE user_id IS NOT NULL"),
    "CALLED_BY": (("ExternalService",), ("Function",), f"SELECT 'ws:1:es:' || r_regionkey AS src, {_FN.format(key='(r_regionkey * 14)')} AS dst FROM region"),
    "SERVICE_CALL": (("Function",), ("ExternalService",), f"SELECT {_FN.format(key='(r_regionkey * 14)')} AS src, 'ws:1:es:' || r_regionkey AS dst FROM region"),
}


def _frame(spark: SparkSession, tables: Lazy, text: str) -> DataFrame:
    used = {t: tables[t] for t in _TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", text)}
    return spark.sql(re.sub(rf"(FROM|JOIN) ({'|'.join(_TABLES)})\b", r"\1 {\2}", text), **used)


def code_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """NODES and EDGES over the tables of a folder."""
    tables = Lazy({t: lambda t=t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES})
    nodes = {k: lambda text=text: _frame(spark, tables, text).withColumn("nid", F.col("id")) for k, text in NODES.items()}
    edges = {k: lambda a=a, b=b, text=text: Edges(_frame(spark, tables, text), a, b) for k, (a, b, text) in EDGES.items()}
    return Graph(Lazy(nodes), Lazy(edges), ontology=(frozenset(builtin.LABELS), frozenset(builtin.TYPES)))


def sql_tables(text: str) -> str:
    """text with the tables n_<kind> and e_<kind> that it uses, as common table expressions of DuckDB."""
    known = {f"n_{k}": t for k, t in NODES.items()} | {f"e_{k}": t for k, (_, _, t) in EDGES.items()}
    used = [k for k in known if re.search(rf"\b{k}\b", text)]
    head = ", ".join(f"{k} AS ({known[k]})" for k in used)
    return (text.replace("WITH RECURSIVE ", f"WITH RECURSIVE {head}, ", 1) if text.startswith("WITH RECURSIVE ") else text.replace("WITH ", f"WITH {head}, ", 1) if text.startswith("WITH ") else f"WITH {head} {text}") if used else text
