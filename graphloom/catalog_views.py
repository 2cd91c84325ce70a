"""Registered calls of views, of language details and of operators that other entries only touch, each with its SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import analysis, gates, incremental, lineage, merge, search, traverse, views
from graphloom.operators.iterate import shared_folder
from graphloom.plans.planner import run
from graphloom.sources.code import code_graph, sql_tables
from graphloom.sources.entities import entities
from graphloom.sources.files import file_tree
from graphloom.sources.graph import Graph
from graphloom.sources.named import execute
from graphloom.sources.tables import graph_from_tables
from graphloom.streaming import changes


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _edges(g: Graph, *kinds: str) -> DataFrame:
    return g.links(list(kinds), []).select("src", "dst", "kind")


def _modules(g: Graph) -> DataFrame:
    return g.nodes["Function"].select(F.col("id").alias("node"), F.col("project").alias("owner"))


# over the code graph


def component_view(spark, d):
    g = code_graph(spark, d)
    owners = _edges(g, "HAS_METHOD").select(F.col("dst").alias("node"), F.col("src").alias("owner")).unionByName(g.nodes["Type"].select(F.col("id").alias("node"), F.col("id").alias("owner")))
    up = traverse.lift(views.redirected(_edges(g, "CALLS", "USES_TYPE"), _edges(g, "IMPLEMENTS")), owners)
    return up.select("src", "dst", "kind", "weight")


def project_map(spark, d):
    g = code_graph(spark, d)
    ingress = run(g, "MATCH (:Endpoint)-[:TRIGGERS]->(f:Function) RETURN DISTINCT f.id AS node")
    uses = _edges(g, "READS_FROM", "WRITES_TO")
    return views.project_map(_modules(g), _edges(g, "CALLS"), ingress, uses, 3)


def dependency_view(spark, d):
    g = code_graph(spark, d)
    return views.dependency_view(_edges(g, "DEPENDS_ON").where("startswith(src, 'ws:1:proj:')"))


def dependency_ego(spark, d):
    g = code_graph(spark, d)
    return views.dependency_view(_edges(g, "DEPENDS_ON").where("startswith(src, 'ws:1:proj:')"), "ws:1:proj:4")


def data_flow(spark, d):
    g = code_graph(spark, d)
    return views.data_flow(_edges(g, "READS_FROM", "WRITES_TO"), _modules(g))


def system_context(spark, d):
    g = code_graph(spark, d)
    return views.system_context(_edges(g, *g.edges), g.scan(list(g.nodes), []).select("id", "kind"), ["Endpoint", "ExternalService", "Database", "Topic"])


def _domains(spark, d):
    g = code_graph(spark, d)
    words = _t(spark, d, "nation").select(F.regexp_extract("n_name", "[0-9]+$", 0).alias("word"), F.concat(F.lit("domain"), F.col("n_regionkey").cast("string")).alias("domain")).where("n_regionkey < 4")
    return views.domain_map(g.nodes["Project"].select("id", "name", "path"), words, _edges(g, "DEPENDS_ON").where("startswith(src, 'ws:1:proj:')"))


def evidence(spark, d):
    g = code_graph(spark, d)
    at = g.nodes["Function"].select(F.col("id").alias("src"), F.col("file_path").alias("file"), F.col("end_line").alias("line"))
    sites = _edges(g, "CALLS").join(at, "src").withColumn("operation", F.lit(None).cast("string"))
    return views.evidence(sites, _modules(g), ["CALLS"], 3).select("a", "b", "kind", "file", "line", "target", "r")


def affected_groups(spark, d):
    g = code_graph(spark, d)
    f = g.nodes["Function"]
    tests = f.where("is_test").select(F.col("id").alias("test"), F.col("project").alias("class"), F.col("file_path").alias("file"), F.col("test_framework").alias("framework"))
    changed = f.where("start_line > 45").select("id")
    hit = analysis.affected_tests(changed, f.where("is_test").select("id"), _edges(g, "CALLS"))
    return views.affected_groups(hit, tests).select("group", "framework", "n", "all_affected", F.size("tests").alias("listed"), F.substring("command", 1, 20).alias("command"))


def ego_view(spark, d):
    return views.ego(_edges(code_graph(spark, d), "CALLS"), "ws:1:fn:12", 2)


def bundled_edges(spark, d):
    g = code_graph(spark, d)
    return views.bundled(_edges(g, "CALLS"), _modules(g).withColumnRenamed("owner", "group"), [f"p{i}" for i in range(10)])


def domain_infrastructure(spark, d):
    g = code_graph(spark, d)
    belongs = _modules(g).select(F.col("node").alias("src"), F.col("owner").alias("dst"))
    return views.domain_infrastructure(belongs, _edges(g, "READS_FROM", "WRITES_TO"), g.scan(["Table"], []).select("id", "kind"))


def post_index_calls(spark, d):
    return views.call_graph(_edges(code_graph(spark, d), "CALLS", "SERVICE_CALL", "CALLED_BY"), ["CALLS", "SERVICE_CALL"], ["CALLED_BY"])


def context_pack(spark, d):
    g = code_graph(spark, d)
    index = g.scan(["Function", "Type", "Table"], ["name", "file_path"]).select("id", "name", F.col("file_path").alias("path"), "kind")
    return views.context_pack(index, _edges(g, "CALLS", "HAS_METHOD"), "fn12 service")


def contracts(spark, d):
    g = code_graph(spark, d)
    kinds = g.scan(["Table", "ExternalService", "Type"], []).select("id", "kind")
    return analysis.contracts(_edges(g, "READS_FROM", "SERVICE_CALL", "USES_TYPE").where("startswith(src, 'ws:1:fn:')"), kinds)


def edge_categories(spark, d):
    g = code_graph(spark, d)
    kinds = g.scan(list(g.nodes), []).select(F.col("id").alias("dst"), F.col("kind").alias("target"))
    e = _edges(g, *g.edges).join(kinds, "dst")
    return e.groupBy("kind", analysis.edge_category(F.col("kind"), F.col("target")).alias("category")).agg(F.count("*").alias("n"))


def callers(spark, d):
    g = code_graph(spark, d)
    return analysis.callers(_edges(g, "CALLS", "USES_TYPE"), "ws:1:type:3", _edges(g, "HAS_METHOD"))


def module_verdicts(spark, d):
    imports = _edges(code_graph(spark, d), "DEPENDS_ON").where("startswith(src, 'ws:1:proj:')")
    pairs = [("ws:1:proj:0", "ws:1:proj:1"), ("ws:1:proj:1", "ws:1:proj:0"), ("ws:1:proj:3", "ws:1:proj:12")]
    return spark.createDataFrame([(a, b, analysis.module_path(imports, a, b)) for a, b in pairs], "src string, dst string, verdict string")


def arguments(spark, d):
    g = code_graph(spark, d)
    slices = _edges(g, "CALLS").select(F.col("dst").alias("callee"), F.lit("q").alias("callee_param"), F.col("src").alias("caller"), F.lit("q").alias("caller_param"))
    sinks = g.nodes["Function"].where("id in ('ws:1:fn:96', 'ws:1:fn:144')").select(F.col("id").alias("function"), F.lit("q").alias("param"))
    return analysis.propagate_arguments(sinks, slices)


def typed_entities(spark, d):
    f = entities(code_graph(spark, d), "Function")
    return f.where(F.col("start_line") > 40, is_test=False).order_by("start_line", True).then_by("id").skip(2).take(5).rows().select("id", "start_line")


def file_listing(spark, d):
    return file_tree(spark, d, ["lineitem.parquet", "*.tmp"])


# over the tables


def external_domains(spark, d):
    s = _t(spark, d, "supplier")
    entries = s.select(F.col("s_suppkey").alias("entry"), F.col("s_nationkey").alias("project"))
    sinks = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("entry"), (F.col("l_partkey") % 50).alias("sink")).distinct()
    domains = _t(spark, d, "part").select((F.col("p_partkey") % 50).alias("sink"), F.col("p_brand").alias("domain")).distinct()
    return analysis.external_domains(entries, sinks, domains)


def phantoms(spark, d):
    n = _t(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    edges = _t(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")).unionByName(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst")))
    return analysis.without_phantoms(nodes, edges, F.col("name").like("U%") | F.col("name").like("%A"))[1].groupBy("src", "dst").agg(F.count("*").alias("n"))


def provenance(spark, d):
    lines = _t(spark, d, "lineitem").select(F.lit("p").alias("from_id"), F.col("l_suppkey").cast("string").alias("to_id"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("f"), (F.col("l_partkey") % 40).cast("string")).alias("file"), F.col("l_linenumber").alias("line"), F.lit(1).alias("col"), (F.col("l_quantity") > 45).alias("in_loop"), F.lit(0).alias("loop_depth"), F.col("l_linestatus").alias("operation"))
    return merge.merge_edges(lines, most=5).select("from_id", "to_id", "kind", "call_count", F.transform("call_sites", lambda s: F.concat(s["file"], F.lit(":"), s["line"].cast("string"))).alias("sites"), "in_loop", "operation", "truncated")


def matched_calls(spark, d):
    n = _t(spark, d, "nation")
    endpoints = n.select(F.col("n_nationkey").alias("endpoint"), F.concat(F.lit("/api/{id}/"), F.lower("n_name")).alias("route"), F.lit("GET").alias("method"))
    calls = _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("call"), F.concat(F.lit("/api/"), F.col("c_custkey").cast("string"), F.lit("/"), F.lower("n_name")).alias("url"), F.when(F.col("c_custkey") % 3 == 0, "POST").otherwise("GET").alias("verb"))
    return analysis.match_calls(calls, endpoints)


def name_scores(spark, d):
    n = _t(spark, d, "nation").select("n_name")
    pairs = n.toDF("a").join(n.toDF("b"), F.col("a") != F.col("b")).unionByName(n.select(F.col("n_name").alias("a"), F.concat(F.lower("n_name"), F.lit("-S")).alias("b")))
    return pairs.select("a", "b", analysis.name_score(F.col("a"), F.col("b")).alias("score"))


def resolved(spark, d):
    names = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("n"), (F.col("p_partkey") % 30).cast("string")).alias("name"), F.concat_ws(".", "p_brand", F.col("p_size").cast("string")).alias("scope"))
    symbols = names.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), "name", "scope")
    return analysis.resolve_references(names.select(F.col("p_partkey").alias("ref"), "name", "scope"), symbols)


def resolve_identifier(spark, d):
    index = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("name"))
    return search.resolve(search.indexed(index), "part17")


def gate_violations(spark, d):
    gate = next(g for g in gates.GATES if g.id == "G-DEBT")
    return gates.violations(graph_from_tables(spark, d), gate).select("file", "symbol", "occurrence", "fingerprint", "message")


def baseline_update(spark, d):
    c = _t(spark, d, "customer")
    found = c.where("c_acctbal < 0").select(F.col("c_name").alias("fingerprint"))
    old = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("fingerprint"), F.lit("2020").alias("acknowledged_at"), F.col("c_mktsegment").alias("reason"))
    return gates.updated_baseline(found, old, "2021")


def interpolated(spark, d):
    n = _t(spark, d, "nation").withColumn("n_none", F.lit(None).cast("string"))
    return n.select("n_nationkey", gates.interpolate("{n_name} in {n_regionkey} ({n_none|none}, {other|?})", n).alias("message"))


_PATHS = ["/ws/src//a.cs", r"C:\ws\b.cs", "./c.cs", "file:///ws/d.cs/", "urn:code:ws/e.cs", "WS/f.cs", "/", ""]


def normal_paths(spark, d):
    n = _t(spark, d, "nation").where("n_nationkey < 8")
    raw = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), F.col("n_nationkey") + 1)
    return n.select("n_nationkey", views.normal_path(raw).alias("plain"), views.normal_path(F.concat(F.lit("ws/"), raw), "ws").alias("below"))


_SCHEMAS = "CASE {0} % 6 WHEN 0 THEN 'Orders' WHEN 1 THEN 'order_db' WHEN 2 THEN 'orders-database' WHEN 3 THEN 'default' WHEN 4 THEN 'billing' ELSE 'Customers' END"
_ENGINE = "CASE WHEN {0} < 10 THEN 'PostgreSQL' WHEN {0} < 20 THEN 'MySql' ELSE 'Sql' END"


def consolidated(spark, d):
    n = _t(spark, d, "nation").where("n_nationkey <> 23")
    return views.consolidated(n.select(F.col("n_nationkey").alias("id"), F.expr(_ENGINE.format("n_nationkey")).alias("engine"), F.expr(_SCHEMAS.format("n_nationkey")).alias("schema")))


# statements by part: dialect, text, and the tables it uses
STATEMENTS = [
    ("ansi", "SELECT a.x FROM s.orders{k} a, lines b LEFT JOIN parts{k} p ON p.id = a.id -- FROM nothing", [("s.orders{k}", "read"), ("lines", "read"), ("parts{k}", "read")]),
    ("tsql", "INSERT INTO [dbo].[log{k}] SELECT TOP 5 * FROM #tmp t JOIN dbo.users u WITH (NOLOCK) ON 1 = 1", [("dbo.log{k}", "write"), ("dbo.users", "read")]),
    ("mysql", "REPLACE INTO `cache{k}` SELECT * FROM `users`", [("cache{k}", "write"), ("users", "read")]),
    ("postgresql", "WITH w AS (SELECT * FROM base{k}) UPDATE target{k} SET x = 1 FROM w WHERE id::int = 1 RETURNING id", [("base{k}", "read"), ("target{k}", "write")]),
    ("plsql", "MERGE INTO stock{k} s USING moves m ON (s.id = m.id) WHEN MATCHED THEN UPDATE SET n = NVL(m.n, 0)", [("stock{k}", "write"), ("moves", "read")]),
    ("bigquery", "SELECT * FROM `proj-a.set.t{k}`", [("proj-a.set.t{k}", "read")]),
    ("clickhouse", "SELECT x FROM hits{k} FINAL PREWHERE y = 'FROM z'", [("hits{k}", "read")]),
    ("ansi", "DELETE FROM old{k} WHERE id IN (SELECT id FROM gone)", [("old{k}", "write"), ("gone", "read")]),
    ("ansi", "CREATE TABLE child{k} (id int PRIMARY KEY, parent_id int REFERENCES parent (id), n varchar(10), FOREIGN KEY (n) REFERENCES names (n))", [("child{k}", "define"), ("parent", "reference"), ("names", "reference")]),
    ("ansi", "CREATE VIEW v{k} AS SELECT EXTRACT(year FROM d) FROM days{k}", [("v{k}", "define"), ("days{k}", "read")]),
]


def _statements(spark, d):
    texts = F.array(*[F.lit(s) for _, s, _ in STATEMENTS])
    at = (F.col("p_partkey") % len(STATEMENTS)).cast("int")
    return _t(spark, d, "part").select("p_partkey", F.replace(F.element_at(texts, at + 1), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("sql"))


def statement_lineage(spark, d):
    return lineage.lineage(_statements(spark, d)).drop("sql")


def statement_columns(spark, d):
    return lineage.definitions(_statements(spark, d)).drop("sql")


def _listing(spark, d):
    return _t(spark, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime"), F.col("lang").alias("hash"))


def registry_batches(spark, d):
    store = changes.Registry(spark, f"{shared_folder(spark)}/registry-{uuid.uuid4()}")
    one = _listing(spark, d).where("mtime % 4 <> 3")
    changes.apply_batch(store, one, 0)
    two = _listing(spark, d).where("mtime % 2 = 1").withColumn("size", F.expr("size + mtime % 3")).withColumn("mtime", F.expr("mtime + 1"))
    return changes.apply_batch(store, two, 1)


def registry_state(spark, d):
    store = changes.Registry(spark, f"{shared_folder(spark)}/registry-{uuid.uuid4()}")
    for i in range(changes.SNAPSHOT + 2):
        store.write(_listing(spark, d).where(f"mtime % {changes.SNAPSHOT + 2} <= {i} and mtime % 3 = {i % 3}").withColumn("size", F.lit(i).cast("long")), i)
    return store.read(changes.SNAPSHOT + 2).groupBy("size").agg(F.count("*").alias("n"))


def reindexed(spark, d):
    n = _t(spark, d, "customer")
    nodes = n.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("file"))
    edges = n.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 2").alias("dst")).where("dst > 0")
    touched = _t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("file"))
    fresh = nodes.join(touched, "file", "left_semi").where("id % 2 = 0").select("id", "file")
    out = incremental.reindexed(nodes, edges, touched, fresh, fresh.select(F.col("id").alias("src"), F.lit(1).cast("long").alias("dst")))
    return out[0].groupBy("file").agg(F.count("*").alias("n"), F.lit("nodes").alias("what")).unionByName(out[1].groupBy(F.expr("cast(dst % 25 as int)").alias("file")).agg(F.count("*").alias("n"), F.lit("edges").alias("what")))


def edge_difference(spark, d):
    lines = _t(spark, d, "lineitem")
    symbol = lambda flag: lines.where(flag).groupBy(F.col("l_suppkey").cast("string").alias("id")).agg(F.min("l_linenumber").alias("line"), F.lit("s").alias("signature"), F.lit("b").alias("body"), F.sort_array(F.collect_set(F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")))).alias("calls"))
    return incremental.semantic_diff(symbol("l_returnflag = 'A'"), symbol("l_returnflag = 'R'")).select("id", "calls_added", "calls_removed")


def event_windows(spark, d):
    return changes.windowed(_t(spark, d, "events"), "6 hours")


def sliding_windows(spark, d):
    return changes.windowed(_t(spark, d, "events"), "1 day", "12 hours").select("event_type", "start", "end", "n")


def event_sessions(spark, d):
    return changes.sessions(_t(spark, d, "events").where("user_id is not null"), "12 hours")


def _sql(text: str) -> Callable:
    return lambda spark, d: execute(graph_from_tables(spark, d), text)


_R = "WITH RECURSIVE l AS (SELECT DISTINCT a.project AS s, b.project AS e FROM e_CALLS c JOIN n_Function a ON a.id = c.src JOIN n_Function b ON b.id = c.dst WHERE a.project <> b.project), r AS (SELECT s, e FROM l UNION SELECT r.s, l.e FROM r JOIN l ON l.s = r.e)"
_DEP = "SELECT src, dst FROM e_DEPENDS_ON WHERE starts_with(src, 'ws:1:proj:')"
_DEPENDENCIES = f"WITH RECURSIVE l AS ({_DEP}), r AS (SELECT src AS s, dst AS e FROM l UNION SELECT r.s, l.dst FROM r JOIN l ON l.src = r.e) SELECT src, dst, count(*) AS weight, bool_or(EXISTS (SELECT 1 FROM r WHERE r.s = l.dst AND r.e = l.src)) AS in_cycle FROM l WHERE src <> dst"
_OWNER_OF = "SELECT id AS node, project AS owner FROM n_Function"
_KINDS_OF = "(SELECT id, 'Endpoint' AS kind FROM n_Endpoint UNION ALL SELECT id, 'ExternalService' FROM n_ExternalService UNION ALL SELECT id, 'Topic' FROM n_Topic UNION ALL SELECT id, 'Function' FROM n_Function UNION ALL SELECT id, 'Type' FROM n_Type UNION ALL SELECT id, 'Project' FROM n_Project)"
_DOMAINS = "SELECT p.id AS service, coalesce('domain' || n.n_regionkey, 'other') AS domain FROM n_Project p LEFT JOIN nation n ON lower(n.n_name) = p.name AND n.n_regionkey < 4"
_CATEGORY = "CASE WHEN kind IN ('READS_FROM', 'WRITES_TO') THEN 'data' WHEN kind IN ('PUBLISHED_BY', 'SUBSCRIBED_BY') THEN 'messaging' WHEN kind = 'SERVICE_CALL' OR target = 'ExternalService' THEN 'call' WHEN kind IN ('DEPENDS_ON', 'REFERENCES') THEN 'dependency' ELSE 'structure' END"


def _values(rows: list[tuple]) -> str:
    quoted = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + ")"


def _categories_sql() -> str:
    from graphloom.sources.code import EDGES, NODES

    kinds = " UNION ALL ".join(f"SELECT id, '{k}' AS target FROM n_{k}" for k in NODES)
    edges = " UNION ALL ".join(f"SELECT dst, '{k}' AS kind FROM e_{k}" for k in EDGES)
    return f"SELECT kind, {_CATEGORY} AS category, count(*) AS n FROM ({edges}) e JOIN ({kinds}) k ON k.id = e.dst GROUP BY 1, 2"


def _context_sql() -> str:
    from graphloom.sources.code import EDGES, NODES

    kinds = "(" + " UNION ALL ".join(f"SELECT id, '{k}' AS kind FROM n_{k}" for k in NODES) + ")"
    edges = "(" + " UNION ALL ".join(f"SELECT src, dst, '{k}' AS kind FROM e_{k}" for k in EDGES) + ")"
    named = "('Endpoint', 'ExternalService', 'Database', 'Topic')"
    return f"SELECT a.kind AS src_kind, e.kind AS kind, b.kind AS dst_kind, count(*) AS weight FROM {edges} e JOIN {kinds} a ON a.id = e.src JOIN {kinds} b ON b.id = e.dst WHERE a.kind IN {named} OR b.kind IN {named} GROUP BY 1, 2, 3"


_USED = [(i, dialect, table, use) for i, (dialect, _, uses) in enumerate(STATEMENTS) for table, use in uses]
_CALL_STEPS = "SELECT src, dst FROM e_CALLS"
_SESSION = "SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL"
_SYMBOL = "SELECT l_suppkey::VARCHAR AS id, list_sort(list(DISTINCT 'p' || (l_partkey % 20))) AS calls FROM lineitem WHERE l_returnflag = '{0}' GROUP BY 1"

# key: (call, SQL or None)
VIEWS: dict[str, tuple[Callable, str | None]] = {
    "S15_file_tree": (file_listing, None),
    "P27_typed_entities": (typed_entities, "SELECT id, start_line FROM n_Function WHERE start_line > 40 AND NOT coalesce(is_test, false) ORDER BY start_line DESC, id LIMIT 5 OFFSET 2"),
    "N05_affected_groups": (affected_groups, "WITH RECURSIVE w AS (SELECT id AS t, id AS s, 0 AS h FROM n_Function WHERE start_line > 45 UNION SELECT e.src, w.s, h + 1 FROM w JOIN e_CALLS e ON e.dst = w.t WHERE h < 15), g AS (SELECT project AS g, coalesce(test_framework, '') AS f, count(*) AS total, count(*) FILTER (id IN (SELECT t FROM w)) AS n FROM n_Function WHERE is_test GROUP BY 1, 2) SELECT g AS \"group\", f AS framework, n, n = total AS all_affected, n::INT AS listed, 'dotnet test --filter' AS command FROM g WHERE n > 0"),
    "N08_external_domains": (external_domains, "SELECT s_nationkey AS project, list_sort(list(DISTINCT p_brand)) AS domains FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey % 50 = l_partkey % 50 GROUP BY 1"),
    "N09_post_index_calls": (post_index_calls, "SELECT src, dst FROM e_CALLS UNION SELECT src, dst FROM e_SERVICE_CALL UNION SELECT dst, src FROM e_CALLED_BY"),
    "N12_edge_categories_all": (edge_categories, _categories_sql()),
    "N13_phantoms": (phantoms, "WITH gone AS (SELECT n_nationkey AS id FROM nation WHERE n_name LIKE 'U%' OR n_name LIKE '%A') SELECT src, dst, count(*) AS n FROM (SELECT c_custkey AS src, c_nationkey AS dst FROM customer UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation) WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY 1, 2"),
    "N15_consolidated": (consolidated, f"SELECT n_nationkey AS id, {_ENGINE.format('n_nationkey')} || '.' || CASE n_nationkey % 6 WHEN 3 THEN CASE WHEN n_nationkey < 20 THEN 'customers' ELSE 'billing' END WHEN 4 THEN 'billing' WHEN 5 THEN 'customers' ELSE 'orders' END AS canonical FROM nation WHERE n_nationkey <> 23"),
    "N16_provenance": (provenance, "WITH s AS (SELECT l_suppkey, l_returnflag, 'f' || (l_partkey % 40) AS file, l_linenumber AS line, bool_or(l_quantity > 45) AS in_loop, list(DISTINCT l_linestatus) AS ops FROM lineitem GROUP BY 1, 2, 3, 4) SELECT 'p' AS from_id, l_suppkey::VARCHAR AS to_id, l_returnflag AS kind, count(*) AS call_count, list(file || ':' || line ORDER BY file, line)[1:5] AS sites, bool_or(in_loop) AS in_loop, array_to_string(list_sort(list_distinct(flatten(list(ops)))), ',') AS operation, count(*) > 5 AS truncated FROM s GROUP BY 1, 2, 3"),
    "N18_lift_by_query": (lambda spark, d: run(code_graph(spark, d), "MATCH (p:Project)<-[:BELONGS_TO]-(:ProjectSyntax)-[:CONTAINS*0..1]->(x:Function)-[r:CALLS]->(y:Function)<-[:CONTAINS*0..1]-(:ProjectSyntax)-[:BELONGS_TO]->(q:Project) WHERE p <> q RETURN p.id AS src, q.id AS dst, count(r) AS n"), "SELECT 'ws:1:proj:' || substring(a.project, 2) AS src, 'ws:1:proj:' || substring(b.project, 2) AS dst, count(*) AS n FROM e_CALLS e JOIN n_Function a ON a.id = e.src JOIN n_Function b ON b.id = e.dst WHERE a.project <> b.project GROUP BY 1, 2"),
    "N19_component_view": (component_view, "WITH e AS (SELECT src, dst, 'CALLS' AS kind FROM e_CALLS UNION ALL SELECT u.src, coalesce(i.src, u.dst), 'USES_TYPE' FROM e_USES_TYPE u LEFT JOIN e_IMPLEMENTS i ON i.dst = u.dst), o AS (SELECT dst AS node, src AS owner FROM e_HAS_METHOD UNION ALL SELECT id, id FROM n_Type) SELECT a.owner AS src, b.owner AS dst, kind, count(*) AS weight FROM e JOIN o a ON a.node = e.src JOIN o b ON b.node = e.dst WHERE a.owner <> b.owner GROUP BY 1, 2, 3"),
    "N24_project_map": (project_map, _R + ", n AS (SELECT project AS o, count(*) AS n FROM n_Function GROUP BY 1), roots AS (SELECT DISTINCT f.project AS o FROM e_TRIGGERS t JOIN n_Function f ON f.id = t.dst), b AS (SELECT o, 0 AS h FROM roots UNION SELECT l.e, h + 1 FROM b JOIN l ON l.s = b.o WHERE h < 25), u AS (SELECT f.project AS o, x.dst, count(DISTINCT x.src) AS n FROM (SELECT * FROM e_READS_FROM UNION ALL SELECT * FROM e_WRITES_TO) x JOIN n_Function f ON f.id = x.src GROUP BY 1, 2) SELECT n.o AS owner, n.n AS n_nodes, (SELECT count(*) FROM l WHERE e = n.o) AS n_in, (SELECT count(*) FROM l WHERE s = n.o) AS n_out, (CASE WHEN n.o IN (SELECT o FROM roots) THEN 0 WHEN n.o IN (SELECT o FROM b) THEN least(4, (SELECT min(h) FROM b WHERE b.o = n.o)) WHEN n.o NOT IN (SELECT s FROM l) THEN 4 ELSE 2 END)::INT AS tier, coalesce((SELECT least(n.o, min(x.e)) FROM r x JOIN r y ON y.s = x.e AND y.e = x.s WHERE x.s = n.o), n.o) AS component, coalesce((SELECT list(dst ORDER BY k, dst) FROM (SELECT dst, -u.n AS k FROM u WHERE u.o = n.o ORDER BY u.n DESC, dst LIMIT 3)), []) AS resources FROM n"),
    "N25_dependency_view": (dependency_view, _DEPENDENCIES + " GROUP BY 1, 2"),
    "N25_dependency_ego": (dependency_ego, "SELECT * FROM (" + _DEPENDENCIES + f" GROUP BY 1, 2) WHERE src IN (SELECT src FROM ({_DEP}) WHERE dst = 'ws:1:proj:4' UNION SELECT dst FROM ({_DEP}) WHERE src = 'ws:1:proj:4' UNION SELECT 'ws:1:proj:4') AND dst IN (SELECT src FROM ({_DEP}) WHERE dst = 'ws:1:proj:4' UNION SELECT dst FROM ({_DEP}) WHERE src = 'ws:1:proj:4' UNION SELECT 'ws:1:proj:4')"),
    "N28_data_flow": (data_flow, f"SELECT o.owner AS actor, u.dst AS resource, CASE WHEN bool_and(w) THEN 'write' WHEN bool_or(w) THEN 'both' ELSE 'read' END AS direction, count(*) AS weight FROM (SELECT src, dst, false AS w FROM e_READS_FROM UNION ALL SELECT src, dst, true FROM e_WRITES_TO) u JOIN ({_OWNER_OF}) o ON o.node = u.src GROUP BY 1, 2 ORDER BY weight DESC, actor, resource LIMIT 250"),
    "N29_system_context": (system_context, _context_sql()),
    "N30_domain_map": (lambda spark, d: _domains(spark, d)[0], _DOMAINS),
    "N30_domain_edges": (lambda spark, d: _domains(spark, d)[1], f"WITH m AS ({_DOMAINS}) SELECT a.domain AS src, b.domain AS dst, count(*) AS weight FROM ({_DEP}) e JOIN m a ON a.service = e.src JOIN m b ON b.service = e.dst WHERE a.domain <> b.domain GROUP BY 1, 2"),
    "N31_contracts": (contracts, "SELECT src AS service, category, list_sort(list(DISTINCT dst)) AS items FROM (SELECT src, dst, 'data' AS category FROM e_READS_FROM WHERE starts_with(src, 'ws:1:fn:') UNION ALL SELECT src, dst, 'call' FROM e_SERVICE_CALL UNION ALL SELECT src, dst, 'structure' FROM e_USES_TYPE WHERE dst IN (SELECT id FROM n_Type)) GROUP BY 1, 2"),
    "N33_edge_evidence": (evidence, "SELECT * FROM (SELECT a.project AS a, b.project AS b, 'CALLS' AS kind, a.file_path AS file, a.end_line AS line, e.dst AS target, (row_number() OVER (PARTITION BY a.project, b.project ORDER BY a.file_path, a.end_line, e.dst))::INT AS r FROM e_CALLS e JOIN n_Function a ON a.id = e.src JOIN n_Function b ON b.id = e.dst WHERE a.project <> b.project) WHERE r <= 3"),
    "N36_resolve_identifier": (resolve_identifier, "SELECT p_partkey AS id, 'Part' || p_partkey AS name, 1.0::DOUBLE AS score FROM part WHERE p_partkey = 17"),
    "N37_callers": (callers, "SELECT DISTINCT src AS caller FROM (SELECT src, dst FROM e_CALLS UNION ALL SELECT src, dst FROM e_USES_TYPE) WHERE dst = 'ws:1:type:3' OR dst IN (SELECT dst FROM e_HAS_METHOD WHERE src = 'ws:1:type:3')"),
    "N40_context_pack": (context_pack, None),
    "N41_module_path": (module_verdicts, "SELECT * FROM (VALUES ('ws:1:proj:0', 'ws:1:proj:1', 'ALREADY_IMPORTED'), ('ws:1:proj:1', 'ws:1:proj:0', CASE WHEN (WITH RECURSIVE r AS (SELECT 'ws:1:proj:0' AS n, 0 AS h UNION SELECT dst, h + 1 FROM r JOIN e_DEPENDS_ON e ON e.src = r.n WHERE h < 8) SELECT count(*) FROM r WHERE n = 'ws:1:proj:1') > 0 THEN 'CYCLE_WARNING' ELSE 'SAFE' END), ('ws:1:proj:3', 'ws:1:proj:12', CASE WHEN (SELECT count(*) FROM e_DEPENDS_ON WHERE src = 'ws:1:proj:3' AND dst = 'ws:1:proj:12') > 0 THEN 'ALREADY_IMPORTED' WHEN (WITH RECURSIVE r AS (SELECT 'ws:1:proj:12' AS n, 0 AS h UNION SELECT dst, h + 1 FROM r JOIN e_DEPENDS_ON e ON e.src = r.n WHERE h < 8) SELECT count(*) FROM r WHERE n = 'ws:1:proj:3') > 0 THEN 'CYCLE_WARNING' ELSE 'SAFE' END)) t(src, dst, verdict)"),
    "N42_match_calls": (matched_calls, "SELECT c_custkey AS call, c_nationkey AS endpoint, 80.0::DOUBLE AS score FROM customer WHERE c_custkey % 3 <> 0"),
    "N43_resolve_whole": (resolved, "WITH n AS (SELECT p_partkey AS id, 'n' || (p_partkey % 30) AS name, p_brand, p_size FROM part) SELECT ref, min_by(id, k * 1000000000 + id) AS id FROM (SELECT a.id AS ref, b.id AS id, CASE WHEN a.p_brand = b.p_brand AND a.p_size = b.p_size THEN 0 WHEN a.p_brand = b.p_brand THEN 1 ELSE 2 END AS k FROM n a JOIN n b USING (name) WHERE b.id % 2 = 0) GROUP BY ref"),
    "N45_arguments": (arguments, f"WITH RECURSIVE w AS (SELECT s AS f, s AS k, 0 AS h FROM (VALUES ('ws:1:fn:96'), ('ws:1:fn:144')) t(s) UNION SELECT e.src, k, h + 1 FROM w JOIN ({_CALL_STEPS}) e ON e.dst = w.f WHERE h < 6) SELECT f AS function, 'q' AS param, k AS sink, min(h)::INT AS hops FROM w GROUP BY f, k"),
    "N47_domain_infrastructure": (domain_infrastructure, "SELECT DISTINCT f.project AS domain, u.dst AS resource, 'Table' AS kind FROM (SELECT * FROM e_READS_FROM UNION ALL SELECT * FROM e_WRITES_TO) u JOIN n_Function f ON f.id = u.src"),
    "N48_ego": (ego_view, "WITH RECURSIVE b AS (SELECT src AS x, dst AS y FROM e_CALLS UNION SELECT dst, src FROM e_CALLS), w AS (SELECT 'ws:1:fn:12' AS n, 0 AS h UNION SELECT y, h + 1 FROM w JOIN b ON b.x = w.n WHERE h < 1) SELECT least(x, y) AS src, greatest(x, y) AS dst, (min(h) + 1)::INT AS hop FROM b JOIN w ON w.n = b.x GROUP BY 1, 2"),
    "N48_bundled": (bundled_edges, f"WITH s AS ({_OWNER_OF}), c AS (SELECT node, owner FROM s WHERE length(owner) = 2) SELECT coalesce(a.owner, e.src) AS src, coalesce(b.owner, e.dst) AS dst, ['CALLS'] AS kinds, count(*) AS weight FROM e_CALLS e LEFT JOIN c a ON a.node = e.src LEFT JOIN c b ON b.node = e.dst WHERE coalesce(a.owner, e.src) <> coalesce(b.owner, e.dst) GROUP BY 1, 2"),
    "R04_violations": (gate_violations, "SELECT c_mktsegment AS file, 'customer:' || c_custkey AS symbol, 1 AS occurrence, sha256('G-DEBT|' || c_mktsegment || '|customer:' || c_custkey || '|') AS fingerprint, 'customer:' || c_custkey || ' owes' AS message FROM customer WHERE c_acctbal < 0"),
    "R07_baseline_update": (baseline_update, "SELECT c_name AS fingerprint, CASE WHEN c_custkey % 2 = 0 THEN '2020' ELSE '2021' END AS acknowledged_at, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS reason FROM customer WHERE c_acctbal < 0"),
    "K01_statement_lineage": (statement_lineage, f"SELECT p_partkey, dialect, replace(tbl, '{{k}}', p_partkey::VARCHAR) AS \"table\", use FROM part JOIN {_values(_USED)} u(i, dialect, tbl, use) ON u.i = p_partkey % {len(STATEMENTS)}"),
    "K05_columns_and_keys": (statement_columns, "SELECT p_partkey, c.* FROM part, (VALUES ('id', 'int', true, NULL, NULL), ('parent_id', 'int', false, 'parent', 'id'), ('n', 'varchar(10)', false, 'names', 'n')) c(\"column\", type, is_key, ref_table, ref_column) WHERE p_partkey % 10 = 8"),
    "T01_change_feed": (registry_batches, "SELECT 'doc' || doc_id AS path, CASE WHEN doc_id % 4 = 3 THEN 'added' WHEN doc_id % 3 > 0 THEN 'modified' WHEN lang IS NOT NULL THEN 'touched' ELSE 'modified' END AS change FROM documents WHERE doc_id % 2 = 1"),
    "T04_registry": (registry_state, "SELECT i AS size, count(*) AS n FROM (SELECT doc_id, max(i) AS i FROM documents, range(0, 18) t(i) WHERE doc_id % 18 <= i AND doc_id % 3 = i % 3 GROUP BY doc_id) GROUP BY 1"),
    "T05_reindexed": (reindexed, "WITH t AS (SELECT n_nationkey AS f FROM nation WHERE n_regionkey = 1), n AS (SELECT c_custkey AS id, c_nationkey AS file FROM customer WHERE c_nationkey NOT IN (SELECT f FROM t) OR c_custkey % 2 = 0), e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey // 2 > 0 AND c_nationkey NOT IN (SELECT f FROM t) UNION SELECT c_custkey, 1 FROM customer WHERE c_nationkey IN (SELECT f FROM t) AND c_custkey % 2 = 0) SELECT file, count(*) AS n, 'nodes' AS what FROM n GROUP BY 1 UNION ALL SELECT (dst % 25)::INT, count(*), 'edges' FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY 1"),
    "T06_event_windows": (event_windows, "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS \"end\", count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2, 3"),
    "T06_sliding_windows": (sliding_windows, "SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS start, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR + INTERVAL 24 HOUR AS \"end\", count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2, 3"),
    "T06_sessions": (event_sessions, f"SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM ({_SESSION})) GROUP BY user_id, s"),
    "U05_edge_difference": (edge_difference, f"SELECT coalesce(a.id, b.id) AS id, list_sort(list_filter(coalesce(b.calls, []), lambda x: NOT list_contains(coalesce(a.calls, []), x))) AS calls_added, list_sort(list_filter(coalesce(a.calls, []), lambda x: NOT list_contains(coalesce(b.calls, []), x))) AS calls_removed FROM ({_SYMBOL.format('A')}) a FULL JOIN ({_SYMBOL.format('R')}) b USING (id)"),
    "U04_intersect": (_sql("SELECT n_nationkey AS k FROM node_nation INTERSECT SELECT s_suppkey AS k FROM node_supplier"), "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey IN (SELECT s_suppkey FROM supplier)"),
    "S08_raw_sql_except_hits": (_sql("SELECT n_nationkey % 9 AS k FROM node_nation EXCEPT SELECT r_regionkey AS k FROM node_region"), "SELECT DISTINCT n_nationkey % 9 AS k FROM nation WHERE n_nationkey % 9 > 4"),
    "F28_name_scores": (name_scores, "WITH p AS (SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_name <> y.n_name UNION ALL SELECT n_name, lower(n_name) || '-S' FROM nation), q AS (SELECT a, b, regexp_replace(regexp_replace(lower(a), '[^a-z0-9]', '', 'g'), 's$', '') AS x, regexp_replace(regexp_replace(lower(b), '[^a-z0-9]', '', 'g'), 's$', '') AS y FROM p), r AS (SELECT *, least(length(x), length(y)) / greatest(length(x), length(y)) AS ratio, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS near FROM q) SELECT a, b, CASE WHEN a = b THEN 100.0 WHEN x = y AND x <> '' THEN 90.0 WHEN (contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) >= 4 AND ratio >= 0.5 THEN 50 + 30 * ratio WHEN near >= 0.75 THEN 40 + 40 * near ELSE 0.0 END::DOUBLE AS score FROM r"),
    "F29_normal_paths": (normal_paths, "SELECT * FROM (VALUES (0, 'ws/src/a.cs', 'ws/src/a.cs'), (1, 'C:/ws/b.cs', 'C:/ws/b.cs'), (2, 'c.cs', 'c.cs'), (3, 'ws/d.cs', 'file:/ws/d.cs'), (4, 'ws/e.cs', 'urn:code:ws/e.cs'), (5, 'WS/f.cs', 'WS/f.cs'), (6, '', ''), (7, '', '')) t(n_nationkey, plain, below)"),
    "F31_interpolation": (interpolated, "SELECT n_nationkey, n_name || ' in ' || n_regionkey || ' (none, ?)' AS message FROM nation"),
}

# language details over the tables: (query, SQL) or (query, SQL, parameters)
LANGUAGE: dict[str, tuple] = {
    "Q01_tokens": ("/* a comment */ MATCH (`r x`:Region) // another\nWHERE `r x`.r_regionkey < 0x3 RETURN `r x`.r_name AS `the name`, 'it''s' AS a, \"q\" AS b, 1.5e2 AS c, 0x1F AS d", "SELECT r_name AS \"the name\", 'it''s' AS a, 'q' AS b, 150.0::DOUBLE AS c, 31::BIGINT AS d FROM region WHERE r_regionkey < 3"),
    "Q02_writing_words_as_names": ("MATCH (n:Nation) WHERE n.create IS NULL RETURN n.n_name AS n, n.delete IS NULL AS gone", "SELECT n_name AS n, true AS gone FROM nation"),
    "Q03_precedence": ("MATCH (r:Region) RETURN r.r_regionkey + 2 * 3 AS a, NOT r.r_regionkey = 1 OR r.r_regionkey = 1 AS b, 7 - r.r_regionkey - 1 AS c, r.r_regionkey > 1 XOR r.r_regionkey > 2 AND false AS d, (r.r_regionkey + 2) * 3 AS e", "SELECT r_regionkey + 6::BIGINT AS a, true AS b, 6::BIGINT - r_regionkey AS c, r_regionkey > 1 AS d, (r_regionkey + 2::BIGINT) * 3 AS e FROM region"),
    "Q04_comparisons": ("MATCH (r:Region) RETURN r.r_name AS n, (r.r_regionkey < 2) = true AS a, (r.r_regionkey <> 2) <> false AS b", "SELECT r_name AS n, r_regionkey < 2 AS a, r_regionkey <> 2 AS b FROM region"),
    "Q06_patterns": ("MATCH (a:Nation)-->(b:Region), (a)<-[:IN_NATION]-(s:Supplier) RETURN b.r_name AS region, count(DISTINCT a) AS nations, count(s) AS suppliers", "SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(*) AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "Q07_keywords_as_names": ("MATCH (order:Region) WITH order.r_name AS limit RETURN limit AS match", "SELECT r_name AS match FROM region"),
    "Q09_parameters": ("MATCH (n:Nation) WHERE n.n_nationkey IN $keys AND n.n_nationkey > $least RETURN n.n_name AS n, $text AS t SKIP $none", "SELECT n_name AS n, 'x' AS t FROM nation WHERE n_nationkey IN (3, 7, 9)", {"keys": [1, 3, 7, 9], "least": 2, "text": "x", "none": 0}),
    "P14_is_null_hits": ("MATCH (e:Document) RETURN e.lang IS NULL AS missing, e.source IS NOT NULL AS known, count(*) AS n", "SELECT lang IS NULL AS missing, source IS NOT NULL AS known, count(*) AS n FROM documents GROUP BY 1, 2"),
    "P14_is_null_of_optional": ("MATCH (p:Part) WHERE p.p_partkey < 300 OPTIONAL MATCH (p)-[:SUPPLIED_BY]->(s:Supplier) WHERE s.s_suppkey = 3 WITH p, s WHERE s IS NULL RETURN count(p) AS n", "SELECT count(*) AS n FROM part WHERE p_partkey < 300 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3)"),
    "J10_semi_join": ("MATCH (n:Nation) WHERE (n)<-[:IN_NATION]-(:Supplier) RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "J11_anti_join_hits": ("MATCH (p:Part) OPTIONAL MATCH (p)-[r:SUPPLIED_BY]->(s:Supplier) WHERE s.s_suppkey = 3 WITH p, s WHERE s IS NULL RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3)"),
    "J18_lifted_subqueries": ("MATCH (n:Nation) WITH n, COUNT { (n)<-[:IN_NATION]-(:Supplier) } AS s, COUNT { (n)<-[:IN_NATION]-(:Customer) } AS c WHERE s > 0 RETURN n.n_name AS n, s, c", "SELECT n_name AS n, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)"),
    "A01_aggregates": ("MATCH (p:Part) RETURN p.p_brand AS b, count(p) AS n, sum(p.p_size) AS s, avg(p.p_size) AS a, min(p.p_name) AS lo, max(p.p_retailprice) AS hi, stdev(p.p_size) AS d, stdevp(p.p_size) AS dp, size(collect(p.p_name)) AS c", "SELECT p_brand AS b, count(*) AS n, sum(p_size)::BIGINT AS s, avg(p_size) AS a, min(p_name) AS lo, max(p_retailprice) AS hi, stddev(p_size) AS d, stddev_pop(p_size) AS dp, count(*)::INT AS c FROM part GROUP BY 1"),
    "A02_implicit_grouping": ("MATCH (p:Part) RETURN p.p_size % 3 AS m, toLower(p.p_brand) AS b, count(*) + 1 AS n, sum(p.p_size) / count(*) AS q", "SELECT p_size % 3::BIGINT AS m, lower(p_brand) AS b, count(*) + 1 AS n, sum(p_size)::BIGINT // count(*) AS q FROM part GROUP BY 1, 2"),
    "A04_counts": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[r:IN_NATION]-(s:Supplier) RETURN n.n_name AS n, count(r) AS rels, count(s) AS nodes, count(s.s_name) AS names, count(*) AS rows", "SELECT n_name AS n, count(s_suppkey) AS rels, count(s_suppkey) AS nodes, count(s_name) AS names, count(*) AS rows FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "A20_group_concat": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.r_name AS r, group_concat(DISTINCT left(n.n_name, 1)) AS firsts", "SELECT r_name AS r, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS firsts FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "O05_paging": ("MATCH (p:Part) RETURN p.p_partkey AS k ORDER BY k DESC SKIP $skip LIMIT $limit", "SELECT p_partkey AS k FROM part ORDER BY k DESC LIMIT 20 OFFSET 40", {"skip": 40, "limit": 20}),
    "L03_lists": ("MATCH (r:Region) RETURN [r.r_regionkey, 2, 3][0] AS a, size([[1, 2], [3]]) AS b, [r.r_name, 'x'][1] AS c", "SELECT r_regionkey::BIGINT AS a, 2::BIGINT AS b, 'x' AS c FROM region"),
    "L17_list_and_text": ("MATCH (r:Region) WHERE r.tags = [] OR r.r_name = [] OR r.r_regionkey = 1 RETURN r.r_name AS n", "SELECT r_name AS n FROM region WHERE r_regionkey = 1"),
    "L10_head_last": ("MATCH (r:Region) WITH split(r.r_name, 'A') AS l RETURN head(l) AS h, last(l) AS t", "SELECT string_split(r_name, 'A')[1] AS h, string_split(r_name, 'A')[-1] AS t FROM region"),
    "L16_map_literal": ("MATCH (r:Region) WITH {a: r.r_name, b: {c: r.r_regionkey}} AS m RETURN m.a AS a, m.b.c AS c", "SELECT r_name AS a, r_regionkey AS c FROM region"),
    "F08_length": ("MATCH (r:Region) RETURN r.r_name AS r, length(r.r_name) AS n", "SELECT r_name AS r, length(r_name) AS n FROM region"),
    "F10_to_integer": ("MATCH (p:Part) RETURN p.p_partkey AS k, toInteger(toString(p.p_size)) AS a, toInteger(p.p_retailprice) AS b", "SELECT p_partkey AS k, p_size::BIGINT AS a, trunc(p_retailprice)::BIGINT AS b FROM part"),
    "F11_to_float": ("MATCH (p:Part) RETURN p.p_partkey AS k, toFloat(toString(p.p_retailprice)) AS a, toFloat(p.p_size) AS b", "SELECT p_partkey AS k, p_retailprice AS a, p_size::DOUBLE AS b FROM part"),
    "F12_to_boolean": ("MATCH (r:Region) RETURN r.r_name AS r, toBoolean(toString(r.r_regionkey > 2)) AS b", "SELECT r_name AS r, r_regionkey > 2 AS b FROM region"),
    "F19_first_label": ("MATCH (x) WHERE x:Region OR x:Nation RETURN labels(x)[0] AS l, count(*) AS n", "SELECT 'Region' AS l, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation"),
    "F20_type": ("MATCH (n:Nation)-[r]-(x) RETURN type(r) AS t, count(*) AS n", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)"),
    "F30_sha256": ("MATCH (r:Region) RETURN r.r_name AS r, sha256(r.r_name) AS h", "SELECT r_name AS r, sha256(r_name) AS h FROM region"),
    "F32_dates": ("MATCH (o:Order) RETURN year(o.o_orderdate) AS y, month(o.o_orderdate) AS m, count(*) AS n", "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY 1, 2"),
    "G04_filtered_steps": ("MATCH (a:Part {p_partkey: 5})-[:NEXT*1..4 {step: 1}]->(b:Part) RETURN b.p_partkey AS k", "WITH n AS (SELECT count(*) AS n FROM part) SELECT (4 + i) % n + 1 AS k FROM n, range(1, 5) t(i)"),
    "G09_all_shortest_paths": ("MATCH p = allShortestPaths((a:Part {p_partkey: 1})-[:NEXT*1..4]->(b:Part)) RETURN b.p_partkey AS k, length(p) AS d, count(*) AS n", "WITH RECURSIVE e AS (SELECT p_partkey AS a, (p_partkey - 1 + k) % n + 1 AS b FROM part, (VALUES (1), (7)) t(k), (SELECT count(*) AS n FROM part) c), w AS (SELECT 1::BIGINT AS x, 0 AS d, 1::BIGINT AS n UNION ALL SELECT b, d + 1, sum(n)::BIGINT FROM w JOIN e ON e.a = w.x WHERE d < 4 GROUP BY b, d) SELECT x AS k, d::BIGINT AS d, sum(n)::BIGINT AS n FROM w WHERE d > 0 AND d = (SELECT min(d) FROM w v WHERE v.x = w.x) GROUP BY 1, 2"),
}
# the same over the code graph
CODE: dict[str, tuple] = {
    "A16_endpoints_by_project": ("MATCH (p:Project)<-[:DECLARED_IN]-(e:Endpoint) RETURN p.name AS project, count(e) AS n", "SELECT p.name AS project, count(*) AS n FROM n_Project p JOIN e_DECLARED_IN d ON d.dst = p.id JOIN n_Endpoint e ON e.id = d.src GROUP BY 1"),
    "J13_prefix_join": ("MATCH (p:Project), (d:Database) WHERE d.id STARTS WITH p.id RETURN p.id AS p, d.id AS d", "SELECT p.id AS p, d.id AS d FROM n_Project p JOIN n_Database d ON starts_with(d.id, p.id)"),
    "Q05_clauses_in_order": ("MATCH (t:Type) WITH t ORDER BY t.start_line DESC LIMIT 5 MATCH (t)-[:HAS_METHOD]->(f) WITH t, count(f) AS n WHERE n > 0 RETURN t.name AS t, n", "SELECT t.name AS t, count(*) AS n FROM (SELECT * FROM n_Type ORDER BY start_line DESC LIMIT 5) t JOIN e_HAS_METHOD h ON h.src = t.id GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def query(graph: Callable, text: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: run(graph(spark, d), text, params)

    out = {k: f for k, (f, _) in VIEWS.items()}
    for graph, texts in ((graph_from_tables, LANGUAGE), (code_graph, CODE)):
        out |= {k: query(graph, v[0], v[2] if len(v) > 2 else {}) for k, v in texts.items()}
    return out


def oracle_sql() -> dict[str, str]:
    return {k: sql_tables(sql) for k, sql in {**{k: v[1] for k, v in VIEWS.items()}, **{k: v[1] for k, v in LANGUAGE.items()}, **{k: v[1] for k, v in CODE.items()}}.items() if sql}
