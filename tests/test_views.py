import hashlib
from pathlib import Path

import pytest
from compare import SF, rows, sql_rows

from graphloom import catalog_code, catalog_views
from graphloom.operators import search
from graphloom.plans import builtin
from graphloom.plans.lexer import QueryError
from graphloom.sources.code import code_graph
from graphloom.sources.files import file_tree
from graphloom.sources.graph import from_frames
from graphloom.sources.tables import graph_from_tables
from graphloom.streaming import changes


@pytest.fixture(scope="module", autouse=True)
def shared_graphs(spark):
    """All entries of this module use the same two graphs in memory."""
    code, tables = code_graph(spark, SF).cached(), graph_from_tables(spark, SF).cached()
    patch = pytest.MonkeyPatch()
    for module in (catalog_code, catalog_views):
        patch.setattr(module, "code_graph", lambda spark, d: code)
    patch.setattr(catalog_views, "graph_from_tables", lambda spark, d: tables)
    yield
    patch.undo()


@pytest.mark.parametrize("key", catalog_code.queries())
def test_built_in_query_gives_the_rows_of_its_sql(spark, duck, key):
    assert rows(catalog_code.queries()[key](spark, SF)) == sql_rows(duck, catalog_code.oracle_sql()[key])


@pytest.mark.parametrize("key", catalog_views.queries())
def test_view_gives_the_rows_of_its_sql(spark, duck, key):
    got = rows(catalog_views.queries()[key](spark, SF))
    sql = catalog_views.oracle_sql().get(key)
    assert got[1] and (sql is None or got == sql_rows(duck, sql))


def test_built_in_names_and_parameters(spark):
    assert len(builtin.QUERIES) == 28
    with pytest.raises(QueryError):
        builtin.text("get_nothing")
    with pytest.raises(QueryError):
        builtin.call(catalog_code.code_graph(spark, SF), "get_callers", nobody="x")


def test_file_tree(spark, tmp_path):
    files = {"a.txt": b"one\ntwo", "src/b.py": b"x = 1\n", "src/build/c.py": b"", "src/keep/build.py": b"y\n\n", "out/d.log": b"\xff\n", "out/e.log": b"z"}
    for name, data in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {r.path: r for r in file_tree(spark, str(tmp_path), ["# made", "build", "*.log", "!out/e.log"]).collect()}
    assert set(got) == {"a.txt", "src/b.py", "src/keep/build.py", "out/e.log"}
    for name, r in got.items():
        data = files[name]
        assert (r.size, r.hash, r.line_count) == (len(data), hashlib.sha256(data).hexdigest(), len(data.decode("latin-1").splitlines())) and r.extension == Path(name).suffix[1:]


def test_graph_from_two_tables_infers_types(spark):
    nodes = spark.createDataFrame([("a", "K", '{"n": 1, "t": "x", "f": 1.5}'), ("b", "K", '{"n": 2, "l": [1, 2], "o": {"p": true}}'), ("c", "L", None)], "id string, kind string, properties string")
    edges = spark.createDataFrame([("a", "b", "R", '{"w": 3}'), ("b", "c", "R", None), ("a", "z", "S", "{}")], "from_id string, to_id string, kind string, properties string")
    g = from_frames(nodes, edges)
    types = dict(g.nodes["K"].dtypes)
    assert (types["n"], types["t"], types["f"], types["l"], types["o"]) == ("bigint", "string", "double", "array<bigint>", "struct<p:boolean>")
    assert sorted(g.nodes) == ["K", "L", "Unknown"] and g.nodes["Unknown"].first().id == "z"
    assert {(r.src, r.dst, r.w) for r in g.edges["R"].frame.collect()} == {("a", "b", 3), ("b", "c", None)}


def test_search_by_a_stored_index_gives_the_same(spark):
    names = spark.createDataFrame([(i, f"load{x}{y}") for i, (x, y) in enumerate((x, y) for x in ("User", "Order", "HTTPRoute") for y in ("Page", "List", "Cache"))] + [(50, "save_user_page"), (51, None)], "id long, name string")
    for text in ("loadUserPage", "user pages", "qqqq", "Order", "x"):
        assert search.hybrid(names, text).collect() == search.hybrid(search.indexed(names), text).collect()
        assert search.split_words(text) == spark.range(1).select(search.words(search.F.lit(text)).alias("w")).first().w
    assert search.hybrid(names, "loaduserpage").collect()[0].score == 1.0


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = changes.windowed(stream, "6 hours").writeStream.format("memory").queryName("by_window").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    q.awaitTermination(120)
    assert rows(spark.table("by_window")) == rows(changes.windowed(events, "6 hours"))
