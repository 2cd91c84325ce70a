"""Analyses over code-like graphs: coverage, sinks, views, flows, matching, resolution.

Edges are frames of src, dst and kind; nodes frames of id, kind, path and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import traverse
from graphloom.operators.iterate import settled
from graphloom.operators.merge import longest_prefix


def test_coverage(tests: DataFrame, targets: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """id, covered, depth, n_tests of each target (id): tests (id) that reach it in at most ``most`` steps."""
    found = traverse.reachable(tests.select(F.col("id").alias("start")), edges, most)
    per = found.groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"), F.countDistinct("start").alias("n_tests"))
    return targets.select("id").join(per, "id", "left").select("id", F.col("depth").isNotNull().alias("covered"), "depth", F.coalesce("n_tests", F.lit(0).cast("long")).alias("n_tests"))


def coverage_by(report: DataFrame, owners: DataFrame) -> DataFrame:
    """owner, n, n_covered, percent of a report (id, covered) by owners (id, owner)."""
    g = report.join(owners, "id").groupBy("owner").agg(F.count("*").alias("n"), F.sum(F.col("covered").cast("int")).alias("n_covered"))
    return g.withColumn("percent", F.round(F.try_divide(F.col("n_covered") * F.lit(100.0), F.col("n")), 1))


def affected_tests(changed: DataFrame, tests: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """test, depth: tests (id) that reach a changed symbol (id), itself included, by the fewest steps."""
    back = traverse.reachable(changed.select(F.col("id").alias("start")), edges, most, "in").select(F.col("node").alias("test"), "depth")
    both = back.unionByName(changed.select(F.col("id").alias("test"), F.lit(0).alias("depth")))
    return both.join(tests.select(F.col("id").alias("test")), "test", "left_semi").groupBy("test").agg(F.min("depth").alias("depth"))


def sink_hops(sinks: DataFrame, calls: DataFrame, most: int = 15) -> DataFrame:
    """caller, sink, hops: all that reach a sink (id) within ``most`` calls."""
    return traverse.reachable(sinks.select(F.col("id").alias("start")), calls, most, "in").select(F.col("node").alias("caller"), F.col("start").alias("sink"), F.col("depth").alias("hops"))


def entry_point_sinks(hops: DataFrame, implements: DataFrame) -> DataFrame:
    """entry, sink, hops: entry points (src) by what implements them (dst), one hop more."""
    return implements.select(F.col("src").alias("entry"), F.col("dst").alias("caller")).join(hops, "caller").groupBy("entry", "sink").agg((F.min("hops") + 1).alias("hops"))


def external_domains(entries: DataFrame, sinks: DataFrame, domains: DataFrame) -> DataFrame:
    """project, domains: sorted distinct domains (sink, domain) behind the entry points (entry, project)."""
    return sinks.join(entries, "entry").join(domains, "sink").groupBy("project").agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def project_edges(edges: DataFrame, nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """src, dst, kind, weight between the projects (owner, prefix) whose path is the longest prefix of the ends' paths (id, path)."""
    owned = longest_prefix(nodes.select("id", "path"), projects).where("owner is not null")
    a, b = owned.select(F.col("id").alias("src"), F.col("owner").alias("a")), owned.select(F.col("id").alias("dst"), F.col("owner").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst"), "kind").agg(F.count("*").alias("weight"))


def lift_through_libraries(services: DataFrame, libraries: DataFrame, depends: DataFrame, uses: DataFrame, most: int = 8) -> DataFrame:
    """service, resource, kind, hops: what libraries use (src, dst, kind) becomes a use of the services that depend on them.

    Only libraries (id) are passed through; what a service uses by itself stays as it is and isn't repeated.
    """
    front = services.select(F.col("id").alias("service"), F.col("id").alias("at"))
    lib = libraries.select(F.col("id").alias("dst"))
    step = depends.select("src", "dst").join(lib, "dst", "left_semi").distinct()
    found = None
    for hops in range(1, most + 1):
        front = front.join(step, front["at"] == step["src"]).select("service", F.col("dst").alias("at")).distinct()
        if found is not None:
            front = front.join(found.select("service", "at"), ["service", "at"], "left_anti")
        front = settled(front.withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            break
        found = front if found is None else found.unionByName(front)
        front = front.select("service", "at")
    if found is None:
        return uses.select(F.col("src").alias("service"), F.col("dst").alias("resource"), "kind", F.lit(0).alias("hops")).where("false")
    own = uses.select(F.col("src").alias("service"), F.col("dst").alias("resource"), "kind")
    up = found.join(uses, found["at"] == uses["src"]).groupBy("service", F.col("dst").alias("resource"), "kind").agg(F.min("hops").alias("hops"))
    return up.join(own, ["service", "resource", "kind"], "left_anti")


def edge_category(kind: Column, target_kind: Column) -> Column:
    """A coarse category of a relationship."""
    return (
        F.when(kind.isin("USES_DB", "READS_FROM", "WRITES_TO"), "data")
        .when(kind.isin("PUBLISHES", "SUBSCRIBES", "PUBLISHED_BY", "SUBSCRIBED_BY"), "messaging")
        .when(kind.isin("SERVICE_CALL", "HTTP_CALL") | (target_kind == "ExternalService"), "call")
        .when(kind.isin("DEPENDS_ON", "REFERENCES", "IMPORTS"), "dependency")
        .otherwise("structure")
    )


def without_phantoms(nodes: DataFrame, edges: DataFrame, phantom: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes that ``phantom`` holds for, and their edges."""
    gone = nodes.where(phantom).select("id")
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def best_of_path(nodes: DataFrame, rank: Column) -> DataFrame:
    """One node for each path: the one of least rank, then least id; nodes without path stay."""
    best = nodes.where("path is not null").groupBy("path").agg(F.min(F.struct(rank.alias("r"), "id")).alias("x")).select(F.col("x.id").alias("id"))
    return nodes.where("path is null").unionByName(nodes.where("path is not null").join(best, "id", "left_semi"))


def folder_modules(files: DataFrame, least: int = 3, most: int = 30, root_share: float = 0.85, most_depth: int = 8) -> DataFrame:
    """path, module: files by folder below the dominant root; all but the ``most`` largest modules are (other).

    The root goes down while one folder holds root_share of all files; modules are
    the folders below it, one level deeper if there are fewer than ``least``.
    """
    cut = files.select("path", F.split("path", "/").alias("p"))
    total, depth = cut.count(), 0
    under = cut
    while depth < most_depth:
        top = under.where(F.size("p") > depth + 1).groupBy(F.col("p")[depth].alias("d")).count().orderBy(F.desc("count"), "d").first()
        if top is None or top["count"] < root_share * total:
            break
        under = under.where(F.get("p", F.lit(depth)) == top["d"])
        depth += 1
    inner = lambda n: F.when(F.size("p") > depth + n, F.array_join(F.slice("p", 1, depth + n), "/")).when(F.size("p") > depth, F.array_join(F.slice("p", 1, F.least(F.size("p") - 1, F.lit(depth + n))), "/")).otherwise("")
    modules = cut.withColumn("module", inner(1))
    if modules.select("module").distinct().count() < least:
        modules = cut.withColumn("module", inner(2))
    keep = modules.groupBy("module").count().orderBy(F.desc("count"), "module").limit(most).select("module", F.lit(True).alias("kept"))
    return modules.join(F.broadcast(keep), "module", "left").select("path", F.when(F.col("kept"), F.col("module")).otherwise("(other)").alias("module"))  # keep: at most ``most`` rows


def call_flow(anchors: DataFrame, calls: DataFrame, hops: int = 5, per_node: int = 25, nodes: int = 120, starts: int = 10) -> DataFrame:
    """step, src, dst of a readable call-flow view: bounded starts, ways out per node, and nodes."""
    w = Window.partitionBy("src").orderBy("dst")
    ways = calls.select("src", "dst").where("src <> dst").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_node).drop("r")
    front = settled(anchors.select(F.col("id").alias("node")).orderBy("node").limit(starts))
    seen, out = front, None
    for step in range(1, hops + 1):
        room = nodes - seen.count()
        if room <= 0:
            break
        edges = ways.join(front, ways["src"] == front["node"], "left_semi")
        new = edges.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").orderBy("node").limit(room)
        new = settled(new)
        here = edges.join(seen.unionByName(new).select(F.col("node").alias("dst")), "dst", "left_semi").select(F.lit(step).alias("step"), "src", "dst")
        out = here if out is None else out.unionByName(here)
        if new.isEmpty():
            break
        seen, front = settled(seen.unionByName(new)), new
    return out


def flow_trace(starts: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """start, hop, src, dst, kind: every edge that a walk from a start (id) of up to ``hops`` edges goes along, at its first hop."""
    near = traverse.reachable(starts.select(F.col("id").alias("start")), edges, hops - 1) if hops > 1 else None
    at = starts.select(F.col("id").alias("start"), F.col("id").alias("src"), F.lit(0).alias("depth"))
    at = at if near is None else at.unionByName(near.select("start", F.col("node").alias("src"), "depth"))
    at = at.groupBy("start", "src").agg(F.min("depth").alias("depth"))
    return at.join(edges, "src").select("start", (F.col("depth") + 1).alias("hop"), "src", "dst", "kind").distinct()


def shared_resources(uses: DataFrame) -> DataFrame:
    """resource, n_users of what more than one user uses (src, dst)."""
    return uses.groupBy(F.col("dst").alias("resource")).agg(F.countDistinct("src").alias("n_users")).where("n_users > 1")


def contracts(edges: DataFrame, target_kinds: DataFrame) -> DataFrame:
    """service, category, items: what each service (src) offers and uses, sorted, by category of relationship."""
    x = edges.join(target_kinds.select(F.col("id").alias("dst"), F.col("kind").alias("target_kind")), "dst")
    return x.groupBy(F.col("src").alias("service"), edge_category(F.col("kind"), F.col("target_kind")).alias("category")).agg(F.array_sort(F.collect_set("dst")).alias("items"))


def callers(edges: DataFrame, symbol: str, members: DataFrame) -> DataFrame:
    """caller of a symbol, or of any method (src has dst) of it if it is a type."""
    own = edges.where(F.col("dst") == symbol).select(F.col("src").alias("caller"))
    methods = members.where(F.col("src") == symbol).select("dst")
    return own.union(edges.join(methods, "dst", "left_semi").select("src")).distinct()


def impact(edges: DataFrame, symbol: str, members: DataFrame, seeds: int = 25, most: int = 60) -> DataFrame:
    """caller, hop: direct callers, then callers of the first ``seeds`` of them, at most ``most``."""
    first = callers(edges, symbol, members)
    few = first.orderBy("caller").limit(seeds).select(F.col("caller").alias("dst"))
    second = edges.join(few, "dst", "left_semi").select(F.col("src").alias("caller")).distinct().join(first, "caller", "left_anti").orderBy("caller").limit(most)
    return first.select("caller", F.lit(1).alias("hop")).unionByName(second.select("caller", F.lit(2).alias("hop")))


def module_path(imports: DataFrame, src: str, dst: str, most: int = 8) -> str:
    """Verdict on a new import of dst by src: ALREADY_IMPORTED, CYCLE_WARNING (dst reaches src) or SAFE."""
    if not imports.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty():
        return "ALREADY_IMPORTED"
    spark = imports.sparkSession
    back = traverse.reachable(spark.createDataFrame([(dst,)], "start string"), imports, most).where(F.col("node") == src)
    return "SAFE" if back.isEmpty() else "CYCLE_WARNING"


def implements_closure(inherits: DataFrame, implements: DataFrame, most: int = 8) -> DataFrame:
    """type, interface: interfaces of all bases (src inherits dst) up to ``most`` levels, and own ones."""
    up = traverse.reachable(inherits.select(F.col("src").alias("start")).distinct(), inherits, most)
    far = up.join(implements, up["node"] == implements["src"]).select(F.col("start").alias("type"), F.col("dst").alias("interface"))
    return far.union(implements.select("src", "dst")).distinct()


def resolve_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref, id: the symbol (id, name, scope) of each reference (ref, name, scope): most leading scope parts in common, then least id."""
    # every scope by its own beginnings, the empty one included: one symbol for each name and beginning, met by equality
    parts = F.split("scope", r"\.")
    begins = F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), ".").alias("begin"))))
    best = symbols.select("id", "name", begins.alias("x")).groupBy("name", "x.n", "x.begin").agg(F.min("id").alias("id"))
    found = references.select("ref", "name", begins.alias("x")).select("ref", "name", "x.n", "x.begin").join(best, ["name", "n", "begin"])
    return found.groupBy("ref").agg(F.max_by("id", "n").alias("id"))


# fixed values: scores of entity matching
PROJECT_MATCH, ENDPOINT_MATCH, SAME_PROJECT_BIAS = 40, 50, 20


def name_score(a: Column, b: Column) -> Column:
    """Likeness of two project names, 0 to 100."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "s$", "")
    x, y = plain(a), plain(b)
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    near = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    inside = (F.contains(x, y) | F.contains(y, x)) & (F.least(F.length(x), F.length(y)) >= 4) & (ratio >= 0.5)
    return F.when(a == b, 100.0).when((x == y) & (x != ""), 90.0).when(inside, 50 + 30 * ratio).when(near >= 0.75, 40 + 40 * near).otherwise(0.0)


def route_score(route: Column, other: Column, method: Column, other_method: Column) -> Column:
    """Likeness of two routes: common segments (parameters match anything), equal route, equal method; 0 at least."""
    cut = lambda c: F.filter(F.split(F.lower(c), "/"), lambda s: s != "")
    a, b = cut(route), cut(other)
    wild = lambda s: F.startswith(s, F.lit("{")) | F.startswith(s, F.lit(":"))
    m = F.size(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: (z["x"] == z["y"]) | wild(z["x"]) | wild(z["y"])))
    jaccard = F.try_divide(m, F.size(a) + F.size(b) - m)
    return F.greatest(F.lit(0.0), F.coalesce(jaccard, F.lit(0.0)) * 60 + F.when(F.lower(route) == F.lower(other), 70).otherwise(0) + F.when(F.upper(method) == F.upper(other_method), 20).otherwise(-20))


def match_calls(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """call, endpoint, score: the best endpoint (endpoint, route, method) for calls (call, url, verb) with one segment in common, if it reaches the threshold."""
    parts = lambda c: F.filter(F.split(F.lower(c), "/"), lambda s: (s != "") & ~F.startswith(s, F.lit("{")) & ~F.startswith(s, F.lit(":")))
    a = calls.withColumn("segment", F.explode(parts("url")))
    b = endpoints.withColumn("segment", F.explode(parts("route")))
    pairs = a.join(b, "segment").select("call", "url", "verb", "endpoint", "route", "method").distinct()
    scored = pairs.withColumn("score", route_score(F.col("url"), F.col("route"), F.col("verb"), F.col("method"))).where(F.col("score") >= ENDPOINT_MATCH)
    return scored.groupBy("call").agg(F.max_by(F.struct("endpoint", "score"), F.struct("score", F.col("endpoint"))).alias("x")).select("call", "x.endpoint", "x.score")


def propagate_arguments(sinks: DataFrame, slices: DataFrame, most: int = 6) -> DataFrame:
    """function, param, sink, hops: a sink's parameters (function, param) travel to callers through slices (callee, callee_param, caller, caller_param)."""
    front = sinks.select("function", "param", F.col("function").alias("sink"))
    found = settled(front.withColumn("hops", F.lit(0)))
    for hops in range(1, most + 1):
        nxt = front.join(slices, (F.col("function") == F.col("callee")) & (F.col("param") == F.col("callee_param"))).select(F.col("caller").alias("function"), F.col("caller_param").alias("param"), "sink").distinct()
        nxt = settled(nxt.join(found, ["function", "param", "sink"], "left_anti").withColumn("hops", F.lit(hops)))
        if nxt.isEmpty():
            break
        found, front = found.unionByName(nxt), nxt.select("function", "param", "sink")
    return found


def table_lineage(arms: dict[str, DataFrame]) -> DataFrame:
    """role, id: the arms (id) of a lineage question as one tagged set."""
    out = None
    for role, df in arms.items():
        tagged = df.select(F.lit(role).alias("role"), "id")
        out = tagged if out is None else out.unionByName(tagged)
    return out.distinct()


def with_domains(nodes: DataFrame, intents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with the domain of their file (file_path, domain), and BELONGS_TO_DOMAIN edges to domain nodes."""
    d = intents.groupBy(F.col("file_path").alias("path")).agg(F.min("domain").alias("domain"))
    out = nodes.join(d, "path", "left")
    edges = out.where("domain is not null").select(F.col("id").alias("src"), F.concat(F.lit("domain:"), F.lower("domain")).alias("dst"), F.lit("BELONGS_TO_DOMAIN").alias("kind"))
    return out, edges
