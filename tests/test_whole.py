import pytest
from compare import SF, rows, sql_rows
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import traverse


def reached(edges):
    """Brute force: the nodes that each node reaches, itself included."""
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = {}
    for x in {y for e in edges for y in e}:
        found, todo = {x}, [x]
        while todo:
            for y in ahead.get(todo.pop(), ()):
                if y not in found:
                    found.add(y)
                    todo.append(y)
        out[x] = found
    return out


def brute_components(edges):
    return {x: min(y) for x, y in reached([*edges, *((b, a) for a, b in edges)]).items()}


def brute_strong(edges):
    far = reached(edges)
    own = {x: [y for y in far[x] if x in far[y]] for x in far}
    return {x: (min(y), len(y)) for x, y in own.items()}


def answers(spark, key):
    return rows(catalog.queries()[key](spark, SF))[1]


@pytest.fixture(scope="module")
def ring(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    return [(i, i + 1) for i in range(1, n + 1) if i % 10] + [(i, i - 3) for i in range(6, n + 1, 10)]


def test_components_of_all_parts(spark, ring):
    assert len(brute_components(ring)) > 120
    assert {n: c for c, n in answers(spark, "N20_components_all")} == brute_components(ring)
    assert {n: (c, k) for c, n, k in answers(spark, "N20_strong_components_all")} == brute_strong(ring)


@pytest.mark.parametrize("key", ["N21_tiers", "N11_library_lift", "N44_implements_closure"])
def test_all_parts_hold_the_rows_of_the_first_ones(spark, key):
    some, every = set(answers(spark, key)), set(answers(spark, f"{key}_all"))
    assert some < every


def test_big_and_hot_components(spark):
    # a hub with 400 spokes, a cycle of 40, a path of 60 into it
    edges = [(1000 + i, 1) for i in range(400)] + [(i, i + 1) for i in range(2000, 2040)] + [(2040, 2000)] + [(i, i + 1) for i in range(1940, 2000)] + [(1, 1940)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in traverse.components(df).collect()} == brute_components(edges)
    assert {r.node: (r.component, r["size"]) for r in traverse.strong_components(df).collect()} == brute_strong(edges)
    nodes = df.select(F.col("src").alias("node")).union(df.select("dst")).distinct()
    got = {r.node: r.tier for r in traverse.tiers(nodes, df, nodes.where("node = 1399")).collect()}
    assert (got[1399], got[1], got[1940], got[1941], got[2040], got[1000]) == (0, 1, 2, 3, 4, 2)


def test_all_parts_are_targets_entries_and_ends(spark):
    parts = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    n = len(parts)
    after = {i: {(i - 1 + k) % n + 1 for k in (1, 7)} for i in parts}
    assert set(answers(spark, "J04_connecting_all")) == {(a, b) for a in after for b in after[a] & parts}
    assert set(answers(spark, "J06_relationship_map_all")) == {(a, (a + 6) % n + 1) for a in after if (a + 6) % n + 1 in parts}
    near = {}  # sink: least steps from each caller
    for sink in (30, 31):
        near[sink], front = {}, {sink}
        for depth in (1, 2, 3):
            front = {a for a in after if after[a] & front}
            for a in front:
                near[sink].setdefault(a, depth)
    want = {}
    for sink, callers in near.items():
        for a, depth in callers.items():
            want[f"e{a % 10}", sink] = min(depth + 1, want.get((f"e{a % 10}", sink), 99))
    assert set(answers(spark, "N07_entry_point_sinks_all")) == {(e, h, s) for (e, s), h in want.items()}
    reach = {}
    for t in (0, 1, 2, 3):
        front = {t}
        for _ in range(4):
            front = {b for a in front for b in after.get(a, ())}
            for b in front:
                reach.setdefault(b, set()).add(t)
    assert {(i, k) for _, _, i, k in answers(spark, "N02_test_coverage_all")} == {(i, len(reach.get(i, ()))) for i in after}
    percent = answers(spark, "N02_coverage_percent_all")
    assert sum(x[0] for x in percent) == n and sum(x[1] for x in percent) == len(parts & set(reach))


def test_degrees_keep_parts_and_suppliers_of_one_number_apart(spark, duck, tmp_path):
    # part 1000001 and supplier 1 have one number, and are neighbours; ends can be missing
    pairs = [(1_000_001, 1), (1_000_001, 2), (1_000_001, 2), (7, 1), (1_000_002, 1_000), (None, 2), (8, None), (None, None)]
    spark.createDataFrame(pairs, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    sql = catalog.oracle_sql()["N22_degrees"].replace("lineitem", f"'{tmp_path}/lineitem.parquet/*.parquet'")
    assert rows(catalog.queries()["N22_degrees"](spark, str(tmp_path))) == sql_rows(duck, sql)
    df = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (3, 3), (1, None)], "src long, dst long")
    assert rows(traverse.degrees(df)) == (["n_in", "n_out", "node"], [(1, 1, 1), (1, 1, 2)])
