import json

from graphloom.operators import gates
from graphloom.operators.lineage import columns_of, dialect, tables_of
from graphloom.streaming.changes import watch


def test_change_feed(spark, tmp_path):
    seen = []
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows))
        (tmp_path / name).rename(folder / name)

    put("a.json", [{"path": "x", "size": 1, "mtime": 1, "hash": "h"}, {"path": "y", "size": 1, "mtime": 1, "hash": "h"}])
    q = watch(spark, str(folder), str(tmp_path / "reg"), str(tmp_path / "ck"), lambda df, n: seen.append(sorted(map(tuple, df.collect()))), "0 seconds")
    try:
        q.processAllAvailable()
        put("b.json", [{"path": "x", "size": 1, "mtime": 2, "hash": "h"}, {"path": "y", "size": 2, "mtime": 2, "hash": "g"}, {"path": "z", "size": 1, "mtime": 1, "hash": "k"}])
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [[("x", "added"), ("y", "added")], [("x", "touched"), ("y", "modified"), ("z", "added")]]


def test_statements():
    assert tables_of("WITH a AS (SELECT 1 FROM b), c AS (SELECT * FROM a) SELECT * FROM c JOIN d ON 1 = 1") == [("b", "read"), ("d", "read")]
    assert tables_of("SELECT trim(BOTH FROM x) FROM t -- FROM u\n") == [("t", "read")]
    assert tables_of("INSERT INTO s.t (a) VALUES ('FROM q')") == [("s.t", "write")]
    assert dialect("SELECT a::int FROM t") == "postgresql" and dialect("SELECT TOP 5 * FROM t") == "tsql"
    assert columns_of("CREATE TABLE t (a INT, b DECIMAL(10, 2), PRIMARY KEY (a))") == [("a", "int", True), ("b", "decimal(10, 2)", False)]


def test_gate_status(tmp_path):
    g = gates.Gate("g", "n", "RETURN 1", fail_at=2)
    assert gates.status(g, 0, 0, False) == "Passed" and gates.status(g, 1, 0, True) == "Warning"
    assert gates.status(g, 2, 0, True) == "FailedNew" and gates.status(g, 0, 3, True) == "PassedTolerated"
    r = gates.Repository(str(tmp_path))
    r.save(g)
    assert r.load() == [g]
