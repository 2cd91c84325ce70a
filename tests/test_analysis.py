import pytest
from pyspark.sql import functions as F

from graphloom.operators import analysis as a


def vals(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame([("t1", "f"), ("f", "g"), ("g", "h"), ("h", "g"), ("t2", "h"), ("x", "y")], "src string, dst string").withColumn("kind", F.lit("CALLS"))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_tests_and_sinks(spark, calls):
    report = a.test_coverage(ids(spark, "t1", "t2"), ids(spark, "f", "g", "h", "y"), calls)
    assert vals(report) == [("f", True, 1, 1), ("g", True, 2, 2), ("h", True, 1, 2), ("y", False, None, 0)]
    owners = spark.createDataFrame([("f", "A"), ("y", "A"), ("g", "B")], "id string, owner string")
    assert vals(a.coverage_by(report, owners)) == [("A", 2, 1, 50.0), ("B", 1, 1, 100.0)]
    assert vals(a.affected_tests(ids(spark, "g"), ids(spark, "t1", "t2"), calls)) == [("t1", 2), ("t2", 2)]
    hops = a.sink_hops(ids(spark, "h"), calls)
    assert ("t1", "h", 3) in vals(hops) and ("h", "h", 2) in vals(hops)
    entry = a.entry_point_sinks(hops, spark.createDataFrame([("ep", "f")], "src string, dst string"))
    assert vals(entry) == [("ep", "h", 3)]
    assert vals(a.external_domains(spark.createDataFrame([("ep", "P")], "entry string, project string"), entry, spark.createDataFrame([("h", "z.com"), ("h", "a.com")], "sink string, domain string"))) == [("P", ["a.com", "z.com"])]


def test_views(spark, calls):
    nodes = spark.createDataFrame([("f", "p/a/f"), ("g", "p/b/g"), ("h", "p/b/h"), ("t1", "q")], "id string, path string")
    projects = spark.createDataFrame([("P", "p"), ("PB", "p/b")], "owner string, prefix string")
    assert vals(a.project_edges(calls, nodes, projects)) == [("P", "PB", "CALLS", 1)]
    assert vals(a.flow_trace(ids(spark, "t1"), calls, 3)) == [("t1", 1, "t1", "f", "CALLS"), ("t1", 2, "f", "g", "CALLS"), ("t1", 3, "g", "h", "CALLS")]
    assert ("t1", "f") in {r[1:] for r in vals(a.call_flow(ids(spark, "t1"), calls))}
    assert vals(a.shared_resources(calls)) == [("g", 2), ("h", 2)]
    files = spark.createDataFrame([(f"src/main/m{i % 4}/f{i}.py",) for i in range(40)] + [("README",)], "path string")
    assert {m for _, m in vals(a.folder_modules(files))} == {f"src/main/m{i}" for i in range(4)} | {""}
    assert {m for _, m in vals(a.folder_modules(files, most=2))} == {"src/main/m0", "src/main/m1", "(other)"}


def test_lifting_and_contracts(spark):
    depends = spark.createDataFrame([("s", "l1"), ("l1", "l2"), ("s", "s2"), ("s2", "l3")], "src string, dst string")
    uses = spark.createDataFrame([("l2", "db", "USES_DB"), ("s", "q", "PUBLISHES"), ("l1", "q", "PUBLISHES"), ("l3", "x", "USES_DB")], "src string, dst string, kind string")
    assert vals(a.lift_through_libraries(ids(spark, "s", "s2"), ids(spark, "l1", "l2", "l3"), depends, uses)) == [("s", "db", "USES_DB", 2), ("s2", "x", "USES_DB", 1)]
    kinds = spark.createDataFrame([("db", "Database"), ("q", "Topic")], "id string, kind string")
    assert vals(a.contracts(uses, kinds)) == [("l1", "messaging", ["q"]), ("l2", "data", ["db"]), ("s", "messaging", ["q"])]
    nodes = spark.createDataFrame([("a", "p", "svc"), ("b", "p", "lib"), ("c", None, "svc")], "id string, path string, kind string")
    assert [r[0] for r in vals(a.best_of_path(nodes, F.when(F.col("kind") == "lib", 0).otherwise(1)))] == ["b", "c"]
    left, kept = a.without_phantoms(nodes, spark.createDataFrame([("a", "c"), ("b", "c")], "src string, dst string"), F.col("kind") == "lib")
    assert len(vals(left)) == 2 and vals(kept) == [("a", "c")]


def test_resolution_and_matching(spark, calls):
    members = spark.createDataFrame([("T", "g"), ("T", "h")], "src string, dst string")
    assert vals(a.callers(calls, "T", members)) == [("f",), ("g",), ("h",), ("t2",)]
    assert vals(a.impact(calls, "g", members.limit(0))) == [("f", 1), ("g", 2), ("h", 1), ("t1", 2), ("t2", 2)]
    assert a.module_path(calls, "f", "g") == "ALREADY_IMPORTED" and a.module_path(calls, "h", "t1") == "CYCLE_WARNING" and a.module_path(calls, "f", "t2") == "SAFE" and a.module_path(calls, "h", "h") == "CYCLE_WARNING"
    inherits = spark.createDataFrame([("C", "B"), ("B", "A")], "src string, dst string")
    implements = spark.createDataFrame([("A", "I"), ("C", "J")], "src string, dst string")
    assert vals(a.implements_closure(inherits, implements)) == [("A", "I"), ("B", "I"), ("C", "I"), ("C", "J")]
    refs = spark.createDataFrame([(1, "f", "a.b.c"), (2, "f", "x.y"), (3, "nope", "a")], "ref int, name string, scope string")
    symbols = spark.createDataFrame([("s1", "f", "a.b"), ("s2", "f", "a.z"), ("s0", "f", "q")], "id string, name string, scope string")
    assert vals(a.resolve_references(refs, symbols)) == [(1, "s1"), (2, "s0")]
    names = spark.createDataFrame([("orders", "orders"), ("order-s", "Orders"), ("payments-api", "payments"), ("inventory", "inventorx"), ("a", "zzz")], "a string, b string")
    assert [round(r[0]) for r in names.select(a.name_score(F.col("a"), F.col("b"))).collect()] == [100, 90, 69, 76, 0]
    got = a.match_calls(spark.createDataFrame([(1, "/api/orders/5", "get"), (2, "/none", "get")], "call int, url string, verb string"), spark.createDataFrame([("e1", "/api/orders/{id}", "GET"), ("e2", "/api/users/{id}", "GET")], "endpoint string, route string, method string"))
    assert vals(got) == [(1, "e1", 80.0)]
    slices = spark.createDataFrame([("sink", "p", "f", "q"), ("f", "q", "g", "r"), ("g", "other", "h", "x")], "callee string, callee_param string, caller string, caller_param string")
    assert vals(a.propagate_arguments(spark.createDataFrame([("sink", "p")], "function string, param string"), slices)) == [("f", "q", "sink", 1), ("g", "r", "sink", 2), ("sink", "p", "sink", 0)]
    assert vals(a.table_lineage({"READER": ids(spark, "a", "a"), "WRITER": ids(spark, "a")})) == [("READER", "a"), ("WRITER", "a")]
    nodes, edges = a.with_domains(spark.createDataFrame([("n", "p"), ("m", "q")], "id string, path string"), spark.createDataFrame([("p", "Sales")], "file_path string, domain string"))
    assert vals(edges) == [("n", "domain:sales", "BELONGS_TO_DOMAIN")] and nodes.count() == 2
