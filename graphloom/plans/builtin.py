"""The built-in queries over a graph of source code: by name, with parameters.

``text(name)`` gives the query; ``call(graph, name, **parameters)`` runs it.
Missing parameters are null.  Lists have no order of their own; rows that share
all sort keys are ordered by further columns, so limits are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.plans.lexer import QueryError
from graphloom.plans.planner import run
from graphloom.sources.graph import Graph

# fixed values: file names that every module has, and names that frameworks call
_EVERY_MODULE = ["index.php", "index.js", "index.ts", "__init__.py", "bootstrap.php", "Bootstrap.php", "config.php", "settings.py", "Dockerfile", "Makefile", "README.md", "composer.json", "package.json", "requirements.txt"]
_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
_FRAMEWORK = ["generateMetadata", "generateStaticParams", "generateViewport", "generateImageMetadata", "generateSitemaps", "getServerSideProps", "getStaticProps", "getStaticPaths", "middleware", "proxy", "register", "onRequestError"]
_PAGES = ["page", "layout", "template", "loading", "error", "global-error", "not-found", "default"]
_SITE_FILES = ["robots", "sitemap", "manifest"]
_SKIPPED_PARTS = [".config.", "jest.setup", "jest.env"]
_USES = ["CALLS", "SERVICE_CALL", "CALLS_ENDPOINT", "USES_TYPE", "IMPLEMENTS", "INHERITS_FROM", "PUBLISHES_TO", "SUBSCRIBES_TO", "TRIGGERS"]
_IMPACT, _CALLING = [*_USES, "QUERIED_BY", "PERSISTED_IN"], [*_USES, "USES_DB", "QUERIES_DB"]
_TEST_PLACES, _TEST_ENDS = ["/tests/", "/test/"], ["Tests.cs", ".spec.ts", ".test.ts", "_test.go"]
_IMPACT_LABELS = ["Type", "Function", "Project", "ExternalService", "Table", "Topic"]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(template: str, words: list[str], by: str = " OR ") -> str:
    return "(" + by.join(template.format(w) for w in words) + ")"


def _given(value: str, parameter: str) -> str:
    return f"(${parameter} IS NULL OR ${parameter} = '' OR {value} = ${parameter})"


def _kind(v: str) -> str:
    return f"CASE WHEN {v}:Type THEN CASE {v}.kind WHEN 'class' THEN 'Class' WHEN 'interface' THEN 'Interface' ELSE {v}.kind END ELSE labels({v})[0] END"


def _place(v: str) -> str:
    at = f"coalesce({v}.path, {v}.file_path, f.path)"
    return f"CASE WHEN {at} IS NULL THEN '' WHEN {v}.start_line IS NULL THEN {at} ELSE {at} + ':' + toString({v}.start_line) END"


def _no_test(v: str) -> str:
    return f"({v}.is_test IS NULL OR {v}.is_test = false)"


_OWN_CODE = "coalesce(f.artifact_role, 'source') <> 'vendor'"
_IN_PROJECT = "MATCH (p:Project)<-[:BELONGS_TO]-(:ProjectSyntax)-[:CONTAINS]->"
_PORTS = "[(p)-[:CONTAINS]->(port) WHERE port:Endpoint OR port:EntryPoint | port.name]"
_NEEDED = "[(p)-[:DEPENDS_ON]->(needed:Project) | needed.name]"
_OUTSIDE = "[(p)-[:CONTAINS]->(outside:ExternalService) | outside.name]"


def _symbol(pattern: str, shown: str, where: str = "true") -> str:
    return f"""MATCH {pattern} WHERE {where} AND n.name CONTAINS $name OPTIONAL MATCH (n)-[:DECLARED_IN]->(f:File)
RETURN {shown} AS type, n.name AS name, coalesce(n.symbol, n.name) AS fullName, coalesce(f.path, n.file_path, n.path) AS filePath, coalesce(n.start_line, n.line, 0) AS startLine, coalesce(n.end_line, n.line_end, 0) AS endLine
ORDER BY name, type, fullName LIMIT 10"""


def _outline(child: str, kinds: list[str], shown: str) -> str:
    return f"""MATCH (f:File) WHERE f.path = $filePath OR f.path ENDS WITH '/' + $filePath MATCH {child} WHERE {_any("child:{}", kinds)}
RETURN child.name AS name, {shown} AS type, coalesce(child.start_line, child.line, 0) AS startLine, coalesce(child.end_line, child.line_end, 0) AS endLine, coalesce(child.symbol, child.name) AS symbol"""


_BARE = "replace(replace(toLower({}), '-', ''), '_', '')"
_CALLER_PLACE = "coalesce(caller.path, caller.file_path, '')"

QUERIES = {
    "analyze_code_impact": f"""MATCH (dependent)-[r:{"|".join(_IMPACT)}]->(target)
WHERE {_any("target:{}", _IMPACT_LABELS)} AND ({_any("target.{} = $symbolName", ["symbol", "name", "id", "graphql_field", "graphql_operation"])} OR target.symbol ENDS WITH $symbolName OR target.name CONTAINS $symbolName)
OPTIONAL MATCH (dependent)-[:DECLARED_IN]->(f:File)
RETURN CASE WHEN dependent:Project THEN 'Service' ELSE {_kind("dependent")} END AS dependentType, dependent.name AS dependentName, dependent.symbol AS dependentSymbol, type(r) AS relationship, {_place("dependent")} AS filePath
ORDER BY dependentType, dependentName""",
    "find_module_copy_drift": f"""MATCH (a:File), (b:File)
WHERE a.name = b.name AND a.path < b.path AND NOT coalesce(a.is_test, false) AND NOT coalesce(b.is_test, false) AND coalesce(a.artifact_role, '') <> 'vendor' AND coalesce(b.artifact_role, '') <> 'vendor' AND NOT a.name IN {_list(_EVERY_MODULE)}
RETURN a.name AS fileName, CASE WHEN a.content_hash = b.content_hash THEN 'identical' ELSE 'drifted' END AS status, a.path AS pathA, b.path AS pathB, coalesce(a.line_count, 0) AS linesA, coalesce(b.line_count, 0) AS linesB, abs(coalesce(a.line_count, 0) - coalesce(b.line_count, 0)) AS lineDelta
ORDER BY status, lineDelta DESC, fileName, pathA, pathB LIMIT 100""",
    "find_refactor_dead_code": f"""{_IN_PROJECT}(item)
WHERE {_given("p.name", "projectName")} AND (item:Function OR item:Type) AND {_no_test("item")} AND item.name <> '<module_init>' AND NOT item.name STARTS WITH 'Jest:' AND NOT item.name IN {_list(_FRAMEWORK)} AND NOT (item)<-[:CALLS|USES_TYPE]-()
OPTIONAL MATCH (item)-[:DECLARED_IN]->(f:File)
WITH item, coalesce(f.path, '') AS place, coalesce(f.artifact_role, 'source') AS role
WHERE role <> 'vendor' AND NOT {_any("place CONTAINS '{}'", _SKIPPED_PARTS)} AND NOT place ENDS WITH '.d.ts' AND NOT (item.name IN {_list(_VERBS)} AND place =~ '(?i)(^|/)route[.][jt]sx?$') AND NOT (item:Function AND coalesce(item.is_exported, false) AND place =~ '(?i)/(({"|".join(_PAGES)})[.][jt]sx?|({"|".join(_SITE_FILES)})[.][jt]s)$')
RETURN item.name AS name, {_kind("item")} AS type, place AS filePath, 'dead_code' AS anomalyType ORDER BY name, type, filePath LIMIT 20""",
    "find_refactor_empty_catches": f"""MATCH (c:CatchClause) WHERE {_given("c.project_name", "projectName")} AND c.is_empty = true AND {_no_test("c")}
OPTIONAL MATCH (f:File) WHERE f.path = c.file_path
WITH c, coalesce(f.artifact_role, 'source') AS role WHERE role <> 'vendor'
RETURN c.name AS name, 'CatchClause' AS type, coalesce(c.file_path, '') AS filePath, 'empty_catch' AS anomalyType, coalesce(c.line, 0) AS metricValue ORDER BY filePath, metricValue, name LIMIT 25""",
    "find_refactor_god_functions": f"""{_IN_PROJECT}(n:Function)
WHERE {_given("p.name", "projectName")} AND {_no_test("n")} AND n.name <> '<module_init>' AND NOT n.name STARTS WITH 'Jest:' AND n.end_line - n.start_line >= 150
OPTIONAL MATCH (n)-[:DECLARED_IN]->(f:File)
WITH n, f WHERE {_OWN_CODE}
RETURN n.name AS name, 'Function' AS type, coalesce(f.path, n.file_path, '') AS filePath, 'god_function' AS anomalyType, n.end_line - n.start_line + 1 AS metricValue, n.symbol AS symbol ORDER BY metricValue DESC, name LIMIT 20""",
    "find_refactor_god_objects": f"""{_IN_PROJECT}(n:Type {{kind: 'class'}}) WHERE {_given("p.name", "projectName")} AND {_no_test("n")}
OPTIONAL MATCH (n)-[:DECLARED_IN]->(f:File) WHERE {_OWN_CODE}
MATCH (n)-[:HAS_METHOD|HAS_MEMBER]->(part)
WITH n, f, count(part) AS parts WHERE parts > 15
RETURN n.name AS name, 'Class' AS type, coalesce(f.path, n.file_path, '') AS filePath, 'god_object' AS anomalyType, parts AS metricValue, n.symbol AS symbol ORDER BY metricValue DESC, name LIMIT 20""",
    "find_symbol_all": _symbol("(n)", _kind("n"), "(n:Function OR n:Type OR n:CloudResource)"),
    "find_symbol_class": _symbol("(n:Type {kind: 'class'})", "'Class'"),
    "find_symbol_function": _symbol("(n:Function)", "'Function'"),
    "find_symbol_interface": _symbol("(n:Type {kind: 'interface'})", "'Interface'"),
    "get_affected_tests": f"""MATCH (target:Function)
WHERE {_any("target.{0} = $filePath OR target.{0} ENDS WITH $filePath", ["filePath", "path"])} OR {_any("target.{} = $symbolName", ["symbol", "name"])}
MATCH (target)<-[:CALLS*0..15]-(test:Function) WHERE test.is_test = true OR test.is_test = 'true'
RETURN DISTINCT test.name AS testName, test.symbol AS testSymbol, test.filePath AS testFilePath, test.test_framework AS testFramework, target.name AS affectedMethodName, target.filePath AS affectedFilePath
ORDER BY testFilePath, testName""",
    "get_architecture_map_project": f"""MATCH (p:Project) WHERE {_given("p.name", "projectName")}
OPTIONAL MATCH (p)-[:LOCATED_IN]->(:Folder)-[:CONTAINS]->(sub:Folder)
OPTIONAL MATCH (db:Database) WHERE db.id STARTS WITH p.id
WITH p, collect(DISTINCT sub.name) AS folders, collect(DISTINCT db.name) AS databases
RETURN p.name AS project, p.project_type AS language, folders, {_NEEDED} AS dependencies, databases, {_PORTS} AS ingress, {_OUTSIDE} AS egress""",
    "get_architecture_map_workspace": f"""MATCH (w:Workspace)-[:CONTAINS]->(s:ProjectsStructure)
OPTIONAL MATCH (s)-[:CONTAINS]->(p:Project)
OPTIONAL MATCH (db:Database) WHERE db.id STARTS WITH p.id
WITH w, p, collect(DISTINCT db.name) AS databases
WITH w, collect(DISTINCT {{name: p.name, language: p.project_type, dependencies: {_NEEDED}, databases: databases, ingress: {_PORTS}, egress: {_OUTSIDE}}}) AS found
RETURN w.name AS workspace, w.path AS path, [x IN found WHERE x.name IS NOT NULL] AS projects""",
    "get_architecture_overview": """MATCH (w:Workspace)
OPTIONAL MATCH (w)-[:CONTAINS]->(:ProjectsStructure)-[:CONTAINS]->(p:Project)
WITH w, collect(DISTINCT {name: p.name, language: p.project_type, path: p.path}) AS found
OPTIONAL MATCH (db:Database)
WITH w, found, collect(DISTINCT db.name) AS databases
OPTIONAL MATCH (es:ExternalService)
WITH w, [x IN found WHERE x.name IS NOT NULL] AS projects, databases, collect(DISTINCT es.name) AS externalServices
RETURN w.name AS workspace, w.path AS path, size(projects) AS totalProjects, projects, databases, externalServices""",
    "get_call_chain": "MATCH chain = (a:Function {symbol: $startFunction})-[:CALLS*1..%(depth)d]->(b:Function {symbol: $endFunction}) RETURN nodes(chain) AS chain",
    "get_callers": f"""MATCH (target)
WHERE {_any("target.{} = $target", ["name", "symbol", "id"])} OR target.symbol CONTAINS ':' + $target + ':' OR target.symbol ENDS WITH ':' + $target OR target.symbol ENDS WITH '.' + $target OR ({_any("target:{}", ["ExternalService", "Project", "Topic", "Table"])} AND {_BARE.format("target.name")} CONTAINS {_BARE.format("$target")})
MATCH (target)<-[r:{"|".join(_CALLING)}]-(caller)
WHERE $includeTests OR NOT (coalesce(caller.is_test, false) OR coalesce(caller.project_name, '') CONTAINS '.Test' OR {_any(_CALLER_PLACE + " CONTAINS '{}'", _TEST_PLACES)} OR {_any(_CALLER_PLACE + " ENDS WITH '{}'", _TEST_ENDS)})
OPTIONAL MATCH (owner:Type)-[:HAS_METHOD]->(caller)
OPTIONAL MATCH (caller)-[:DECLARED_IN]->(f:File)
RETURN target.name AS targetName, labels(target)[0] AS targetKind, coalesce(owner.name + '.', '') + caller.name AS callerName, labels(caller)[0] AS callerKind, type(r) AS relKind, coalesce(caller.project_name, '') AS projectName, {_place("caller")} AS location
ORDER BY targetName, callerName""",
    "get_file_outline": _outline("(child)-[:DECLARED_IN]->(f)", ["Type", "Function", "Member", "Query", "CloudResource"], _kind("child")) + "\nUNION\n" + _outline("(f)<-[:DECLARED_IN]-(:Type)-[:HAS_METHOD|HAS_MEMBER]->(child)", ["Function", "Member"], "labels(child)[0]"),
    "get_project_dependencies_all": "MATCH (p:Project)-[:DEPENDS_ON]->(needed) RETURN p.name AS project, needed.name AS dependency, labels(needed)[0] AS dependencyType",
    "get_project_dependencies_filtered": f"""MATCH (p:Project) WHERE {_given("p.name", "projectFilter")}
OPTIONAL MATCH (p)-[:DEPENDS_ON]->(needed)
OPTIONAL MATCH (p)<-[:DEPENDS_ON]-(user)
RETURN p.name AS project, collect(DISTINCT needed.name) AS outgoingDependencies, collect(DISTINCT user.name) AS incomingDependencies""",
    "get_project_entry_points": f"""MATCH (p:Project)<-[:DECLARED_IN]-(ep) WHERE (ep:Endpoint OR ep:EntryPoint) AND {_given("p.name", "projectName")}
OPTIONAL MATCH (ep)-[:TRIGGERS|IMPLEMENTED_BY]->(fn:Function)
OPTIONAL MATCH (ep)-[:EXPOSED_BY]->(class:Type)
OPTIONAL MATCH (fn)-[:DECLARED_IN]->(f:File)
RETURN coalesce(fn.name, ep.name) AS entryPoint, coalesce(fn.symbol, ep.symbol) AS symbol, coalesce(class.name, '') AS className, coalesce(f.path, fn.file_path, ep.file_path, ep.path, '') AS filePath, coalesce(fn.start_line, ep.start_line, 0) AS startLine, coalesce(ep.route, ep.route_template, '') AS route, coalesce(ep.http_method, '') AS httpMethod, coalesce(ep.protocol, 'REST') AS protocol, coalesce(ep.request_type, '') AS requestType, coalesce(ep.response_type, '') AS responseType, coalesce(ep.operation_type, '') AS operationType, coalesce(ep.is_anonymous, false) AS isAnonymous, coalesce(ep.required_roles, '') AS requiredRoles""",
    "get_taxonomy_nodes": "MATCH (a)-[r]->(b) RETURN DISTINCT labels(a)[0] AS fromLabel, type(r) AS relType, labels(b)[0] AS toLabel",
    "get_taxonomy_properties": "MATCH (n) WITH DISTINCT labels(n) AS labels, keys(n) AS names UNWIND labels AS label UNWIND names AS key RETURN DISTINCT label, key",
    "get_test_coverage": """MATCH (item) WHERE (item:Function OR item:Type) AND (item.is_test IS NULL OR (item.is_test <> true AND item.is_test <> 'true')) AND ($projectName IS NULL OR item.project = $projectName)
OPTIONAL MATCH (item)<-[:CALLS*1..10]-(test:Function) WHERE test.is_test = true OR test.is_test = 'true'
WITH item, count(DISTINCT test) AS tests, collect(DISTINCT test.name) AS names
RETURN item.name AS name, item.symbol AS symbol, CASE WHEN item:Type THEN 'Class' ELSE 'Method' END AS kind, coalesce(item.file_path, item.path, '') AS filePath, item.project AS project, CASE WHEN tests > 0 THEN 'Covered' ELSE 'Uncovered' END AS status, tests AS coveringTestCount, names AS coveringTests
ORDER BY status, filePath, name""",
    "get_workspace_content": "MATCH (n) WHERE $type IS NULL OR $type = '' OR any(x IN labels(n) WHERE x = $type) RETURN coalesce(n.name, n.id) AS name, labels(n)[0] AS type, coalesce(n.path, '') AS path ORDER BY name, type, path LIMIT 25",
    "inspect_data_lineage": """MATCH (t:Table) WHERE $tableName IS NULL OR $tableName IN ['', '*'] OR toLower(t.name) CONTAINS toLower($tableName)
OPTIONAL MATCH (q:Query)-[:DEPENDS_ON]->(t)
OPTIONAL MATCH (t)<-[:READS_FROM|WRITES_TO]-(user:Function)
OPTIONAL MATCH (t)-[:ACCESSED_BY|QUERIED_BY]->(older:Function)
OPTIONAL MATCH (t)-[:IMPLEMENTED_BY]->(entity:Type)
RETURN t.name AS tableName, coalesce(q.name, '') AS queryName, coalesce(q.query_text, '') AS queryText, coalesce(q.path, '') AS filePath, collect(DISTINCT coalesce(entity.name, user.name, older.name)) AS parentName, CASE WHEN entity IS NULL THEN 'Function' ELSE 'Entity' END AS parentType
ORDER BY tableName, queryName, parentType LIMIT 50""",
    "resolve_call_target": "MATCH (:Type {name: $interfaceName, kind: 'interface'})<-[:IMPLEMENTS]-(impl:Type {kind: 'class'})-[:HAS_METHOD]->(n:Function {name: $methodName}) RETURN impl.name AS className, n.name AS methodName, n.symbol AS methodSymbol, n.file_path AS filePath, n.start_line AS startLine",
    "trace_cqrs_pipeline": "MATCH (producer)<-[:PUBLISHED_BY]-(m:Topic)-[:SUBSCRIBED_BY]->(consumer) RETURN producer.name AS producer, labels(producer) AS producer_types, m.name AS message, m.broker_type AS broker, consumer.name AS consumer, labels(consumer) AS consumer_types ORDER BY message, producer",
    "trace_ingress_to_egress": """MATCH (ep:Endpoint)-[:DECLARED_IN]->(p:Project)
OPTIONAL MATCH (ep)-[:TRIGGERS]->(fn:Function)
OPTIONAL MATCH (fn)-[:CALLS*0..3]->(inner:Function)
OPTIONAL MATCH (inner)<-[:CALLED_BY|PUBLISHED_BY]-(out)
RETURN p.name AS sourceProject, ep.name AS ingressEndpoint, coalesce(ep.protocol, 'REST') AS ingressProtocol, coalesce(ep.http_method, '') AS ingressMethod, coalesce(ep.route_template, ep.route, '') AS ingressRoute, coalesce(ep.request_type, '') AS requestType, coalesce(ep.response_type, '') AS responseType, coalesce(fn.name, '') AS handlerFunction, labels(out)[0] AS egressKind, coalesce(out.name, '') AS egressTarget""",
}
_OWNED = "OPTIONAL MATCH ({0})<-[:HAS_METHOD]-(owner:Type)"
_USERS = {
    "": "OPTIONAL MATCH (t)<-[r:{0}]-(fn:Function)",
    "q": "OPTIONAL MATCH (t)<-[r:{0}]-(q:Query)-[:ACCESSED_BY]->(fn:Function)",
    "t": "OPTIONAL MATCH (t)-[:ACCESSED_BY|QUERIED_BY]->(fn:Function)",
}


def _user(kind: str, how: str, types: str, extra: str) -> tuple[str, str, str, str, str, str, str]:
    place = {"": "fn.file_path, fn.path, r.file_path", "q": "fn.file_path, fn.path, q.file_path, q.path", "t": "fn.file_path, fn.path"}[how]
    return kind, f"{_USERS[how].format(types)} {_OWNED.format('fn')}", "fn.name", "owner.name", extra, place, "fn.start_line"


def _calling(how: str) -> tuple[str, str, str, str, str, str, str]:
    return "CALLER", f"{_USERS[how].format('READS_FROM|WRITES_TO')} OPTIONAL MATCH (fn)<-[:CALLS]-(c:Function) {_OWNED.format('c')}", "c.name", "owner.name", "''", "c.file_path, c.path", "c.start_line"


# what a table's lineage is made of: kind, pattern, name, owner, extra, places, line
LINEAGE = [
    ("ENTITY", "OPTIONAL MATCH (t)-[:IMPLEMENTED_BY]->(x:Type)", "x.name", "''", "''", "x.file_path, x.path", "0"),
    _user("WRITER", "", "WRITES_TO", "r.operation, 'WRITE'"),
    _user("WRITER", "q", "WRITES_TO", "q.verb, r.operation, 'WRITE'"),
    _user("READER", "", "READS_FROM", "''"),
    _user("READER", "q", "READS_FROM", "''"),
    _user("READER", "t", "", "''"),
    _calling(""),
    _calling("q"),
    _calling("t"),
    ("QUERY", "OPTIONAL MATCH (t)<-[:READS_FROM|WRITES_TO]-(x:Query)", "x.name", "''", "x.query_text", "x.path, x.file_path", "0"),
    ("META", "", "t.sub_kind", "''", "t.columns", "t.path", "0"),
    ("FK_OUT", "OPTIONAL MATCH (t)-[r:REFERENCES]->(x:Table)", "x.name", "''", "r.operation", "''", "0"),
    ("FK_IN", "OPTIONAL MATCH (t)<-[r:REFERENCES]-(x:Table)", "x.name", "''", "r.operation", "''", "0"),
    ("VIEW", "OPTIONAL MATCH (t)<-[:READS_FROM]-(x:Table)", "x.name", "x.sub_kind, 'view'", "''", "x.path", "0"),
    ("PROC", "OPTIONAL MATCH (t)<-[:READS_FROM]-(x:Procedure)", "x.name", "x.sub_kind, 'procedure'", "'READ'", "x.path", "0"),
    ("PROC", "OPTIONAL MATCH (t)<-[:WRITES_TO]-(x:Procedure)", "x.name", "x.sub_kind, 'procedure'", "'WRITE'", "x.path", "0"),
    ("TRIGGER", "OPTIONAL MATCH (t)-[r:TRIGGERS]->(x:Procedure)", "x.name", "x.sub_kind, 'trigger'", "r.operation, x.trigger_event", "x.path", "0"),
]


def table_lineage(graph: Graph, ids: list[str] | None = None) -> DataFrame:
    """tableName, kind, name, ownerName, extra, filePath, startLine: all that touches tables (ids; None: all), each kind with a row of blanks where there is none."""
    at = "MATCH (t:Table)" + ("" if ids is None else " WHERE t.id IN [" + ", ".join("'" + i.replace("'", "''") + "'" for i in ids) + "]")
    arms = [f"{at} {pattern} RETURN t.name AS tableName, '{kind}' AS kind, coalesce({name}, '') AS name, coalesce({owner}, '') AS ownerName, coalesce({extra}, '') AS extra, coalesce({places}, '') AS filePath, coalesce({line}, 0) AS startLine" for kind, pattern, name, owner, extra, places, line in LINEAGE]
    return run(graph, " UNION ".join(arms))


# the labels and types that these queries name; graphs may have no tables of them
LABELS = {"Workspace", "ProjectsStructure", "Project", "ProjectSyntax", "Folder", "File", "Type", "Function", "Member", "CatchClause", "Endpoint", "EntryPoint", "Database", "ExternalService", "Table", "Query", "Topic", "CloudResource", "Procedure"}
TYPES = {*_IMPACT, *_CALLING, "ACCESSED_BY", "BELONGS_TO", "CALLED_BY", "CONTAINS", "DECLARED_IN", "DEPENDS_ON", "EXPOSED_BY", "HAS_MEMBER", "HAS_METHOD", "IMPLEMENTED_BY", "LOCATED_IN", "PUBLISHED_BY", "READS_FROM", "REFERENCES", "SUBSCRIBED_BY", "WRITES_TO"}
PARAMETERS = ["symbolName", "projectName", "name", "filePath", "startFunction", "endFunction", "target", "includeTests", "projectFilter", "type", "tableName", "interfaceName", "methodName"]


def text(name: str, depth: int = 5) -> str:
    """A built-in query. depth: how far get_call_chain goes."""
    if name not in QUERIES:
        raise QueryError(f"no built-in query {name}")
    return QUERIES[name] % {"depth": depth} if name == "get_call_chain" else QUERIES[name]


def call(graph: Graph, query: str, /, depth: int = 5, **parameters) -> DataFrame:
    """The result of a built-in query over a graph."""
    if unknown := set(parameters) - set(PARAMETERS):
        raise QueryError(f"unknown parameter {min(unknown)}")
    return run(graph, text(query, depth), dict.fromkeys(PARAMETERS) | {"includeTests": False} | parameters)
