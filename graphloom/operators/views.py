"""Architecture views: dependencies, maps, data flow, context, domains, evidence, ego graphs, packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import traverse
from graphloom.operators.search import hybrid

# fixed values: how many edges and resources a view shows
DATA_FLOW_EDGES, RESOURCES = 250, 12
_TESTS = r"(?i)(/tests?/|tests\.cs$|\.(spec|test)\.ts$|_test\.go$)"


def normal_path(path: Column, root: str = "") -> Column:
    """Forward slashes, without scheme or URN prefix, root, ./ and slashes at the ends."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(urn:[^:/]+:|[a-z][a-z0-9+.-]*://)", "")
    plain = F.regexp_replace(plain, r"/{2,}", "/")
    if root:
        base = root.replace("\\", "/").rstrip("/")
        plain = F.when(F.startswith(F.lower(plain), F.lit(base.lower() + "/")), F.substr(plain, F.lit(len(base) + 2))).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(plain, r"^(\./)+", ""), r"^/+|/+$", "")


def dependency_view(edges: DataFrame, ego: str | None = None) -> DataFrame:
    """src, dst, weight, in_cycle of dependencies (src, dst): in_cycle if both ends are in one strong component; ego: only edges at that node and between its neighbours."""
    e = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    of = traverse.strong_components(e).select("node", "component")
    out = e.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").select("src", "dst", "weight", (F.col("a") == F.col("b")).alias("in_cycle"))
    if ego is None:
        return out
    near = e.where((F.col("src") == ego) | (F.col("dst") == ego))
    near = near.select(F.col("src").alias("n")).union(near.select("dst")).distinct()
    return out.join(near.toDF("src"), "src", "left_semi").join(near.toDF("dst"), "dst", "left_semi")


def redirected(edges: DataFrame, implements: DataFrame) -> DataFrame:
    """edges (src, dst, kind) to an interface lead to what implements it (src implements dst) instead."""
    to = implements.select(F.col("dst"), F.col("src").alias("real")).distinct()
    return edges.join(to, "dst", "left").select("src", F.coalesce("real", "dst").alias("dst"), "kind").where("src <> dst")


def project_map(owners: DataFrame, edges: DataFrame, ingress: DataFrame, uses: DataFrame | None = None, most: int = RESOURCES) -> DataFrame:
    """owner, n_nodes, n_in, n_out, tier, component, resources: the modules (node, owner), lifted edges (src, dst, kind), and the resources that most of their nodes use (src, dst)."""
    up = traverse.lift(edges, owners).select("src", "dst").distinct()
    named = owners.groupBy("owner").agg(F.count("*").alias("n_nodes"))
    roots = owners.join(ingress.select("node"), "node", "left_semi").select(F.col("owner").alias("node")).distinct()
    tier = traverse.tiers(named.select(F.col("owner").alias("node")), up, roots)
    whole = traverse.strong_components(up).select("node", "component")
    degree = traverse.degrees(up)
    out = named.join(tier.withColumnRenamed("node", "owner"), "owner").join(degree.withColumnRenamed("node", "owner"), "owner", "left").join(whole.withColumnRenamed("node", "owner"), "owner", "left")
    out = out.select("owner", "n_nodes", F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"), "tier", F.coalesce("component", "owner").alias("component"))
    if uses is None:
        return out
    n = uses.join(owners.select(F.col("node").alias("src"), "owner"), "src").groupBy("owner", F.col("dst").alias("resource")).agg(F.countDistinct("src").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("n"), "resource"))).where(F.col("r") <= most)
    top = top.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("r", "resource"))).alias("x")).select("owner", F.col("x.resource").alias("resources"))
    return out.join(top, "owner", "left").withColumn("resources", F.coalesce("resources", F.array().cast("array<string>")))


def data_flow(uses: DataFrame, owners: DataFrame, most: int = DATA_FLOW_EDGES) -> DataFrame:
    """actor, resource, direction, weight: who reads or writes what (src, dst, kind), by owner (node, owner); the ``most`` heaviest."""
    writes = F.col("kind").isin("WRITES_TO", "PUBLISHES_TO", "PERSISTED_IN")
    g = uses.join(owners.select(F.col("node").alias("src"), F.col("owner").alias("actor")), "src").groupBy("actor", F.col("dst").alias("resource")).agg(F.sum(writes.cast("long")).alias("w"), F.count("*").alias("weight"))
    direction = F.when(F.col("w") == 0, "read").when(F.col("w") == F.col("weight"), "write").otherwise("both")
    return g.select("actor", "resource", direction.alias("direction"), "weight").orderBy(F.desc("weight"), "actor", "resource").limit(most)


def system_context(edges: DataFrame, kinds: DataFrame, boundary: list[str]) -> DataFrame:
    """src_kind, kind, dst_kind, weight of the edges (src, dst, kind) with an end of a boundary kind, by kinds (id, kind) of their ends."""
    a, b = kinds.select(F.col("id").alias("src"), F.col("kind").alias("src_kind")), kinds.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"))
    at = edges.join(a, "src").join(b, "dst").where(F.col("src_kind").isin(boundary) | F.col("dst_kind").isin(boundary))
    return at.groupBy("src_kind", "kind", "dst_kind").agg(F.count("*").alias("weight"))


def domain_map(services: DataFrame, words: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """service, domain (the one with most dictionary words (word, domain) in its name and path; ties by name; other), and domain edges (src, dst, weight) from edges between services (id, name, path)."""
    parts = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "name", "path")), "[^a-z0-9]+"), lambda w: w != ""))
    hits = services.select("id", F.explode(parts).alias("word")).join(words, "word").groupBy("id", "domain").agg(F.count("*").alias("n"))
    best = hits.groupBy("id").agg(F.min_by("domain", F.struct(-F.col("n"), F.col("domain"))).alias("domain"))
    of = services.select("id").join(best, "id", "left").select(F.col("id").alias("service"), F.coalesce("domain", F.lit("other")).alias("domain"))
    a, b = of.toDF("src", "a"), of.toDF("dst", "b")
    between = edges.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("weight"))
    return of, between


def evidence(edges: DataFrame, owners: DataFrame, ranks: list[str], per: int = 20) -> DataFrame:
    """a, b, kind, file, line, target, r: the call sites (src, dst, kind, file, line, operation) behind each edge between owners (node, owner), distinct, by rank of kind, file and line, ``per`` of each."""
    a, b = owners.select(F.col("node").alias("src"), F.col("owner").alias("a")), owners.select(F.col("node").alias("dst"), F.col("owner").alias("b"))
    sites = edges.join(a, "src").join(b, "dst").where("a <> b").select("a", "b", "kind", "file", "line", F.col("dst").alias("target"), "operation").distinct()
    order = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in ranks]), F.col("kind")), F.lit(0))
    w = Window.partitionBy("a", "b").orderBy(F.when(order == 0, len(ranks) + 1).otherwise(order), "file", "line", "target", "kind", "operation")
    return sites.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per).drop("operation")


def affected_groups(affected: DataFrame, tests: DataFrame, by: str = "class") -> DataFrame:
    """group, framework, n, tests, all_affected, command of affected tests (test) by class or file of all tests (test, class, file, framework)."""
    key = F.coalesce(F.col(by), F.col("file"), F.lit("")).alias("group")
    t = tests.select("test", key, F.coalesce("framework", F.lit("")).alias("framework")).distinct()
    n = t.groupBy("group", "framework").agg(F.count("*").alias("of"))
    hit = t.join(affected.select("test").distinct(), "test", "left_semi").groupBy("group", "framework").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("test")).alias("tests"))
    names = F.when(F.col("n") == F.col("of"), F.array("group")).otherwise(F.col("tests"))
    # fixed values: how runners take names
    command = (
        F.when(F.col("framework").isin("xunit", "nunit", "mstest"), F.concat(F.lit('dotnet test --filter "'), F.array_join(F.transform(names, lambda x: F.concat(F.lit("FullyQualifiedName~"), x)), "|"), F.lit('"')))
        .when(F.col("framework") == "pytest", F.concat(F.lit('pytest -k "'), F.array_join(names, " or "), F.lit('"')))
        .when(F.col("framework").isin("jest", "vitest"), F.concat(F.lit('npx '), F.col("framework"), F.lit(' -t "'), F.array_join(names, "|"), F.lit('"')))
        .when(F.col("framework") == "go", F.concat(F.lit("go test -run '"), F.array_join(names, "|"), F.lit("'")))
        .otherwise("")
    )
    return hit.join(n, ["group", "framework"]).select("group", "framework", "n", "tests", (F.col("n") == F.col("of")).alias("all_affected"), command.alias("command"))


def ego(edges: DataFrame, centre: str, hops: int = 1, per_node: int = 25) -> DataFrame:
    """src, dst, hop: the edges met on walks of up to ``hops`` from a node in any direction; at each node the first ``per_node`` neighbours."""
    both = traverse.oriented(edges.select("src", "dst").where("src <> dst").distinct(), "both")
    near = both.distinct().withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("r") <= per_node).drop("r")
    start = edges.sparkSession.range(1).select(F.lit(centre).alias("start"))
    found = traverse.reachable(start, near, hops - 1).select("node", "depth").unionByName(start.select(F.col("start").alias("node"), F.lit(0).alias("depth"))) if hops > 1 else start.select(F.col("start").alias("node"), F.lit(0).alias("depth"))
    first = found.groupBy("node").agg(F.min("depth").alias("depth"))
    return near.join(first, near["src"] == first["node"]).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col("depth") + 1).alias("hop")).groupBy("src", "dst").agg(F.min("hop").alias("hop"))


def bundled(edges: DataFrame, groups: DataFrame, collapsed: list[str]) -> DataFrame:
    """src, dst, kinds, weight: edges (src, dst, kind) with the nodes of collapsed groups (node, group) put in one; what joins the same two becomes one edge."""
    shut = groups.where(F.col("group").isin(collapsed))
    a, b = shut.select(F.col("node").alias("src"), F.col("group").alias("a")), shut.select(F.col("node").alias("dst"), F.col("group").alias("b"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "kind").where("src <> dst")
    return moved.groupBy("src", "dst").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("weight"))


def domain_infrastructure(belongs: DataFrame, uses: DataFrame, kinds: DataFrame) -> DataFrame:
    """domain, resource, kind: what the nodes of a domain (src, dst) use (src, dst), by kinds (id, kind) of the resources."""
    return belongs.select("src", F.col("dst").alias("domain")).join(uses.select("src", F.col("dst").alias("resource")), "src").join(kinds.select(F.col("id").alias("resource"), "kind"), "resource").select("domain", "resource", "kind").distinct()


def call_graph(edges: DataFrame, forward: list[str], backward: list[str]) -> DataFrame:
    """src, dst: edges (src, dst, kind) of the forward kinds, and those of the backward kinds turned round, distinct."""
    return edges.where(F.col("kind").isin(forward)).select("src", "dst").union(edges.where(F.col("kind").isin(backward)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


# fixed values: what makes a good anchor of a context pack
ROLE_BONUS = {"Endpoint": 2.5, "Table": 2.2, "Topic": 2.2, "Type": 1.8, "Function": 1.5, "Member": -1.5}
IN_NAME, IN_PATH, PER_CONCEPT, CONCEPT_LENGTH, NOISE = 0.9, 0.4, 2.2, 5, -6.0


def anchor_score(similarity: Column, name: Column, path: Column, kind: Column, tokens: list[str]) -> Column:
    """Similarity, raised by the tokens of the question in name and path, by concepts and by role, lowered in test places."""
    has = lambda c, t: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t)).cast("double")
    total = similarity
    for t in tokens:
        total = total + has(name, t) * IN_NAME + has(path, t) * IN_PATH
        if len(t) >= CONCEPT_LENGTH:
            total = total + has(name, t) * PER_CONCEPT
    role = reduce(lambda out, x: F.when(kind == x[0], x[1]).otherwise(out), ROLE_BONUS.items(), F.lit(0.0))
    return total + role + F.when(F.rlike(F.coalesce(path, F.lit("")), F.lit(_TESTS)), NOISE).otherwise(0.0)


def context_pack(index: DataFrame, edges: DataFrame, text: str, anchors: int = 5, neighbours: int = 10) -> DataFrame:
    """role, id, score: anchors for a text among index (id, name, path, kind), and what edges (src, dst) connect with them, best anchors first."""
    tokens = sorted({w for w in text.lower().split() if len(w) > 2})
    found = hybrid(index.select("id", "name", *[c for c in ("words", "trigrams", "vector") if c in index.columns]), text, 50)
    scored = found.join(index.select("id", "path", "kind"), "id").withColumn("score", anchor_score(F.col("score"), F.col("name"), F.col("path"), F.col("kind"), tokens))
    best = scored.orderBy(F.desc("score"), "id").limit(anchors).select("id", "score")
    both = traverse.oriented(edges.select("src", "dst").distinct(), "both")
    near = both.join(best.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "score").join(best.select("id"), "id", "left_anti").groupBy("id").agg(F.sum("score").alias("score"))
    near = near.orderBy(F.desc("score"), "id").limit(neighbours)
    return best.select(F.lit("anchor").alias("role"), "id", "score").unionByName(near.select(F.lit("neighbour").alias("role"), "id", "score"))


def consolidated(databases: DataFrame) -> DataFrame:
    """id, canonical of databases (id, engine, schema): within an engine, schemas that differ by a database suffix or a plural are one (the shortest, then least, names it), and generic names become the longest concrete schema."""
    low = F.lower("schema")
    stem = F.regexp_replace(F.regexp_replace(low, r"[-_ ]?(db|database)$", ""), r"s$", "")
    # fixed values: names that say nothing
    generic = low.isin("db", "database", "main", "default", "public", "dbo", "master", "")
    x = databases.select("id", "engine", low.alias("schema"), stem.alias("stem"), generic.alias("generic"))
    named = x.where("not generic").groupBy("engine", "stem").agg(F.min_by("schema", F.struct(F.length("schema"), "schema")).alias("name"))
    longest = named.groupBy("engine").agg(F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("longest"))
    out = x.join(named, ["engine", "stem"], "left").join(longest, "engine", "left")
    return out.select("id", F.concat("engine", F.lit("."), F.when(F.col("generic"), F.coalesce("longest", "schema")).otherwise(F.col("name"))).alias("canonical"))
