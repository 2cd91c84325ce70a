import pytest

from graphloom.plans import syntax as s
from graphloom.plans.lexer import QueryError
from graphloom.plans.parser import parse
from graphloom.plans.planner import Planner, run
from graphloom.sources.graph import from_frames
from graphloom.sources.named import NamedQueries, execute, render


def expr(text):
    return parse(f"RETURN {text} AS x").arms[0][0].items[0].expr


def test_precedence():
    assert expr("NOT a AND b") == s.Binary("AND", s.Unary("NOT", s.Var("a")), s.Var("b"))
    assert expr("1 + 2 * 3") == s.Binary("+", s.Lit(1), s.Binary("*", s.Lit(2), s.Lit(3)))
    assert expr("a OR b XOR c AND d").op == "OR"
    assert expr("0x1F") == s.Lit(31) and expr("-2") == s.Lit(-2) and expr(".5e1") == s.Lit(5.0)
    assert expr("'it''s \\n'") == s.Lit("it's \n")


@pytest.mark.parametrize("text, direction, hops", [("-->", "out", None), ("<--", "in", None), ("--", "both", None), ("-[:A]->", "out", None), ("<-[:A|B*]-", "in", (1, None)), ("-[:A*2]-", "both", (2, 2)), ("-[*1..3]->", "out", (1, 3)), ("-[*..4]->", "out", (1, 4)), ("-[*0..]->", "out", (0, None)), ("<-[r:A {k: 1}]->", "both", None)])
def test_arrows(text, direction, hops):
    r = parse(f"MATCH (a){text}(b) RETURN a").arms[0][0].patterns[0].rels[0]
    assert (r.direction, r.hops) == (direction, hops)


@pytest.mark.parametrize("text", ["CREATE (n)", "MATCH (n) DELETE n", "MATCH (n) SET n.x = 1", "MERGE (n)", "MATCH (n) REMOVE n.x RETURN n", "DROP INDEX i"])
def test_writing_is_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_keywords_as_names_and_comments():
    q = parse("MATCH (n:Order) /* x */ RETURN n.limit AS `order by`, n.create // y")
    assert [i.name for i in q.arms[0][1].items] == ["order by", "n.create"]


@pytest.mark.parametrize("text", ["MATCH (n RETURN n", "RETURN", "RETURN 1 +", "MATCH (a)-[>(b) RETURN a", "RETURN a < b < c"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.fixture(scope="module")
def small(spark):
    n = [("ws:1", "Workspace", "{}"), ("f:1", "File", '{"name":"a.py"}'), ("f:2", "File", '{"name":"b.py"}'), ("t:1", "Type", '{"name":"Order","kind":"class"}'), ("fn:process", "Function", '{"name":"process","start_line":1,"end_line":9}'), ("fn:save", "Function", '{"name":"save","start_line":10,"end_line":12}'), ("fn:notify", "Function", '{"name":"notify","start_line":13,"end_line":50}'), ("fn:unused", "Function", '{"name":"unused","start_line":1,"end_line":2}')]
    e = [("ws:1", "f:1", "CONTAINS"), ("ws:1", "f:2", "CONTAINS"), ("f:1", "t:1", "DEFINES"), ("t:1", "fn:process", "HAS_METHOD"), ("t:1", "fn:save", "HAS_METHOD"), ("t:1", "fn:notify", "HAS_METHOD"), ("fn:process", "fn:save", "CALLS"), ("fn:save", "fn:notify", "CALLS"), ("fn:save", "fn:save", "CALLS"), ("f:2", "x:gone", "DEFINES")]
    nodes = spark.createDataFrame(n, "id string, kind string, properties string")
    edges = spark.createDataFrame([(*x, "{}") for x in e], "from_id string, to_id string, kind string, properties string")
    return from_frames(nodes, edges, abstract={"Code": {"Type", "Function"}}).cached()


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_seed_graph(small):
    assert values(run(small, "MATCH (t:Type)-[:HAS_METHOD]->(f) RETURN f.name AS n")) == [("notify",), ("process",), ("save",)]
    assert values(run(small, "MATCH (:Workspace)-[:CONTAINS]->(f:File) OPTIONAL MATCH (f)-[:DEFINES]->(t:Type) RETURN f.name AS f, t.name AS t")) == [("a.py", "Order"), ("b.py", None)]
    assert values(run(small, "MATCH (a:Function {name: 'process'})-[:CALLS*1..]->(b) RETURN b.name AS b")) == [("notify",), ("save",)]
    # a loop at the first step is a path of its own
    assert values(run(small, "MATCH (a:Function {name: 'save'})-[:CALLS*1..2]->(b) RETURN b.name AS b")) == [("notify",), ("notify",), ("save",)]
    assert values(run(small, "MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) AND NOT (f)-[:CALLS]->() RETURN f.name AS n")) == [("unused",)]
    assert values(run(small, "MATCH (f:Function) WHERE f.end_line - f.start_line > $n RETURN f.name AS n", {"N": 10})) == [("notify",)]
    assert values(run(small, "MATCH (u:Unknown)<-[r]-(f) RETURN u.id AS u, type(r) AS t")) == [("x:gone", "DEFINES")]
    assert values(run(small, "MATCH (c:Code) RETURN c.kind AS k, count(*) AS n")) == [("Function", 4), ("class", 1)]


def test_unknown_names_are_errors(small):
    for text in ("MATCH (n:Nowhere) RETURN n", "MATCH ()-[:NO_SUCH]->() RETURN 1", "MATCH (n:File) RETURN m.x", "RETURN nofunction(1)", "MATCH (n:File) WHERE n.x = $gone RETURN n"):
        with pytest.raises(QueryError):
            run(small, text).collect()


def test_optional_matches_behind_others_do_not_multiply(spark, monkeypatch):
    # reads: 30 named users; old: 20 former ones; t1 has both, t2 an unnamed user too, t3 former ones only, t4 entities, t5 nothing
    reads = [(t, f"u{i}") for t in ("t1", "t2") for i in range(30)] + [("t2", "u-"), ("t4", "u1")]
    old = [(t, f"o{i}") for t in ("t1", "t2", "t3", "t4") for i in range(20)]
    types = [("t4", "e1"), ("t4", "e2"), ("t4", "e-")]
    ids = {k: sorted({x for _, x in v}) for k, v in (("User", reads + old), ("Entity", types))} | {"Table": [f"t{i}" for i in range(1, 6)]}
    nodes = spark.createDataFrame([(x, k, "{}" if x.endswith("-") else f'{{"name":"{x}"}}') for k, v in ids.items() for x in v], "id string, kind string, properties string")
    edges = [(u, t, "READS") for t, u in reads] + [(t, u, "OLD") for t, u in old] + [(t, e, "MADE") for t, e in types]
    g = from_frames(nodes, spark.createDataFrame([(*e, "{}") for e in edges], "from_id string, to_id string, kind string, properties string"))
    near = lambda pairs, t: [None if x.endswith("-") else x for k, x in pairs if k == t] or [None]
    product = [(t, e, u, o) for t in ids["Table"] for u in near(reads, t) for o in near(old, t) for e in near(types, t)]
    want = {}
    for t, e, u, o in product:
        want.setdefault(t, set()).update({e or u or o} - {None})
    counts = []
    project = Planner.project
    monkeypatch.setattr(Planner, "project", lambda self, c, state: (counts.append(state.df.count()), project(self, c, state))[1])
    text = "MATCH (t:Table) OPTIONAL MATCH (t)<-[:READS]-(u:User) OPTIONAL MATCH (t)-[:OLD]->(o:User) OPTIONAL MATCH (t)-[:MADE]->(e:Entity) RETURN t.name AS t, "
    assert {r.t: set(r.x) for r in run(g, text + "collect(DISTINCT coalesce(e.name, u.name, o.name)) AS x").collect()} == want
    assert counts.pop() == 30 + (30 + 20) + 20 + 3 + 1
    # what repeated rows change, or what is used elsewhere too, takes every match
    assert {r.t: r.n for r in run(g, text + "count(coalesce(e.name, u.name, o.name)) AS n").collect()} == {t: sum(x[0] == t and any(x[1:]) for x in product) for t in want}
    assert counts.pop() == len(product)
    assert {r.t: (set(r.x), r.n) for r in run(g, text + "collect(DISTINCT coalesce(e.name, u.name, o.name)) AS x, count(DISTINCT o) AS n").collect()} == {t: (x, 0 if t == "t5" else 20) for t, x in want.items()}


def test_named_queries_and_renderings(small, tmp_path):
    names = NamedQueries(str(tmp_path))
    names.save("files", "MATCH (f:File) RETURN f.name AS name ORDER BY name")
    with pytest.raises(QueryError):
        names.save("bad", "MATCH (n) DELETE n")
    df = execute(small, "files", named=names)
    assert names.list() == ["files"] and values(df) == [("a.py",), ("b.py",)]
    assert render(df) == '[{"name": "a.py"}, {"name": "b.py"}]'
    assert render(df, "yaml") == '- name: "a.py"\n- name: "b.py"\n'
    assert render(df, "table").startswith("[2]{name}:") and render(df, "markdown").count("\n") == 3
    assert values(execute(small, "SELECT kind, count(*) AS n FROM nodes GROUP BY kind HAVING count(*) > 1")) == [("File", 2), ("Function", 4)]
    names.delete("files")
    assert names.list() == []


def test_filters_and_columns_reach_the_files(spark):
    from compare import SF

    from graphloom.sources.tables import graph_from_tables

    df = run(graph_from_tables(spark, SF), "MATCH (p:Part) WHERE p.p_size > 40 RETURN p.p_name AS n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,40)" in plan and "ReadSchema: struct<p_name:string,p_size:int>" in plan.replace("p_partkey:bigint,", "")
